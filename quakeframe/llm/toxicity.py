"""Toxicity: a convolutional text classifier over hashed word embeddings, in numpy.

A word's hash names one of 2**24 embeddings, those of unseen words too.  Buckets in fewer
than LEAST_TEXTS labelled texts stay at zero and aren't stored.  Filters of widths 1, 2 and 3
slide over the whole text, each is max-pooled and a logistic layer reads the pools.

Every labelled row is learned from.  Word counts are sums over all of them.  For training
the rows are dealt into shards of about SHARD; a round descends once through each shard, as
a task, from common weights, and the next round starts from the mean over the shards (of an
embedding: over those that hold its word).  Every fifth row is left out of training and
calibrates one threshold per language, from counts of all such rows by logit; a text's
language is guessed from its words alone, so that scores read nothing but the text.  A score
is the logistic of the distance to that threshold, 0.5 at the threshold.  The driver sees
the weights and the counts, no text.

Defined cases: null and empty texts score like a text of unknown words; labels that are
null or repeated per id count once (the larger); of rows that repeat a labelled id the one
whose text comes last in order is learned from; without both classes every score is 0; rows
with a null doc_id are scored; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_mod, discard, durable, slices, small_batches, word_hashes

#: Bits of a word's hash that name its bucket.
BUCKET_BITS = 24
#: A bucket in fewer labelled texts keeps the zero embedding.  Beyond so many embeddings (70 MB) the
#: rarest stay at zero too: the size of the model, whatever the number of rows that it learns from.
LEAST_TEXTS, MOST_STORED = 2, 1 << 20
WIDTHS, FILTERS, DIM = (1, 2, 3), 8, 12
PAD = max(WIDTHS) - 1
#: Rows that a task trains on in a round, about; rounds; texts of a step, its rate.
SHARD, ROUNDS, STEP, RATE = 4096, 6, 32, 0.08
#: Logits are counted by this part of one, up to this size.
LOGIT_STEP, MOST_LOGIT = 1 / 256, 64


@dataclass
class Model:
    learned: np.ndarray  # sorted numbers of the buckets that have an embedding other than zero
    emb: np.ndarray  # (1 + learned, DIM), row 0 for padding and all other buckets
    kernel: np.ndarray  # (DIM, sum(WIDTHS) * FILTERS): every tap of every filter
    bias: np.ndarray  # (pools,)
    out: np.ndarray  # (pools,)
    shift: float
    tongue: np.ndarray  # (1 + learned, languages): log-odds of a bucket in a language
    thresholds: np.ndarray  # of the logit, by language


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def indices(learned: np.ndarray, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding table for PAD zeros and then the words of each text, and where each text begins."""
    parts = [(t or "").encode() for t in texts]
    data = b" ".join(parts)
    begins = np.cumsum([0] + [len(p) + 1 for p in parts])[:-1]
    h, at = word_hashes(data) if data else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    found = np.zeros(len(h), np.int32)
    if len(learned) and len(h):
        own = buckets_of(h)
        near = np.minimum(np.searchsorted(learned, own), len(learned) - 1)
        found = np.where(learned[near] == own, near + 1, 0).astype(np.int32)
    first = np.searchsorted(at, begins)  # the first word of each text
    counts = np.diff(np.append(first, len(h)))
    starts = np.cumsum(np.concatenate(([0], counts + PAD)))[:-1]
    out = np.zeros(len(h) + PAD * (len(texts) + 1), np.int32)
    out[np.arange(len(h)) + PAD * (1 + np.repeat(np.arange(len(texts)), counts))] = found
    return out, starts


def convolve(own: np.ndarray) -> np.ndarray:
    """(positions, pools): every filter at every position that a text or its padding begins; own: each word's part of each tap."""
    n = len(own) - PAD
    out = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
    k = 0
    for w, width in enumerate(WIDTHS):
        for j in range(width):
            out[:, w * FILTERS : (w + 1) * FILTERS] += own[j : n + j, k * FILTERS : (k + 1) * FILTERS]
            k += 1
    return out


def _convolve_rows(taps: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``convolve`` of taps[rows], which isn't made as a whole."""
    n = len(rows) - PAD
    out = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
    k = 0
    for w, width in enumerate(WIDTHS):
        for j in range(width):
            tap = np.ascontiguousarray(taps[:, k * FILTERS : (k + 1) * FILTERS])
            out[:, w * FILTERS : (w + 1) * FILTERS] += tap[rows[j : n + j]]
            k += 1
    return out


def logits(model: Model, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Logit and guessed language number of each text, whole texts, about 256 KB at a time."""
    raw, lang = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for i, j in slices(texts, 1 << 18):
        rows, starts = indices(model.learned, texts[i:j])
        pooled = np.maximum.reduceat(convolve(model.emb[rows] @ model.kernel), starts, axis=0)
        raw[i:j] = np.maximum(pooled + model.bias, 0) @ model.out + model.shift
        lang[i:j] = np.add.reduceat(model.tongue[rows[: len(rows) - PAD]], starts, axis=0).argmax(axis=1)
    return raw, lang


@dataclass
class Weights:
    """What training moves, with the squared gradients that Adagrad divides by (of an embedding: their mean)."""

    emb: np.ndarray
    emb_memory: np.ndarray
    dense: np.ndarray  # kernel, bias, out and shift one after another
    dense_memory: np.ndarray

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Views of kernel (taps, DIM, FILTERS), bias, out and shift."""
        pools, cut = len(WIDTHS) * FILTERS, sum(WIDTHS) * DIM * FILTERS
        d = self.dense
        return d[:cut].reshape(sum(WIDTHS), DIM, FILTERS), d[cut : cut + pools], d[cut + pools : cut + 2 * pools], d[cut + 2 * pools :]


def _odds(texts: np.ndarray, bad: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Smoothed log-odds of toxic texts for buckets in so many texts, of which bad are toxic."""
    odds = np.log((bad + 0.5) / (n1 + 1)) - np.log((texts - bad + 0.5) / (n0 + 1))
    return odds * np.minimum(1, texts / 8.0)


def _counted(texts: list, toxic: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, ...]:
    """(bucket, language, texts, toxic texts, words) of texts, a row for each bucket and language that occurs."""
    parts = [np.unique(buckets_of(word_hashes(t.encode())[0]), return_counts=True) if t else (np.zeros(0, np.int32), np.zeros(0, np.int64)) for t in texts]
    size = np.array([len(x) for x, _ in parts], np.int64)
    if not size.sum():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    code = np.concatenate([x for x, _ in parts]).astype(np.int64) | (np.repeat(np.asarray(lang, np.int64), size) << BUCKET_BITS)
    found, where, n = np.unique(code, return_inverse=True, return_counts=True)
    bad = np.bincount(where, weights=np.repeat(np.asarray(toxic, float), size), minlength=len(found)).astype(np.int64)
    words = np.bincount(where, weights=np.concatenate([w for _, w in parts]), minlength=len(found)).astype(np.int64)
    return found & ((1 << BUCKET_BITS) - 1), found >> BUCKET_BITS, n, bad, words


def _begin(odds: np.ndarray, seed: int = 7) -> Weights:
    rng, pools = np.random.default_rng(seed), len(WIDTHS) * FILTERS
    emb = rng.normal(0, 0.05, (len(odds) + 1, DIM))
    emb[1:, 0] = odds / 2
    emb[0] = 0
    kernel = rng.normal(0, 0.1, (sum(WIDTHS), DIM, FILTERS))
    kernel[:, 0, : FILTERS // 2] += 0.5
    dense = np.concatenate([kernel.ravel(), np.zeros(pools), np.full(pools, 0.1), [-0.5]])
    return Weights(emb, np.full(len(emb), 1e-6), dense, np.full_like(dense, 1e-6))


def _descend(w: Weights, prepared: list, toxic: np.ndarray, balance: np.ndarray, order: np.ndarray) -> None:
    """One pass of Adagrad on the logistic loss through texts (rows of the embedding table) in that order; w moves in place."""
    kernel, bias, out, shift = w.parts()
    pools = len(bias)
    offsets = np.repeat(np.arange(len(WIDTHS)), WIDTHS)  # the width of each tap
    seen, number = np.zeros(len(w.emb), bool), np.zeros(len(w.emb), np.int64)
    for at in range(0, len(order), STEP):
        batch = order[at : at + STEP]
        # The padding before a text ends the one before it.
        rows_of = np.concatenate([*(prepared[b][:-PAD] for b in batch), np.zeros(PAD, np.int64)])
        edges = np.cumsum([0, *(len(prepared[b]) - PAD for b in batch)])
        seen[rows_of] = True
        used = np.flatnonzero(seen)
        seen[used] = False
        number[used] = np.arange(len(used))
        flat = kernel.transpose(1, 0, 2).reshape(DIM, -1)
        c = _convolve_rows((w.emb[used] @ flat).astype(np.float32), number[rows_of])
        place = np.stack([c[i:j].argmax(axis=0) + i for i, j in zip(edges[:-1], edges[1:], strict=True)])
        pooled = c[place, np.arange(pools)].astype(float)
        active = pooled + bias > 0
        hidden = np.where(active, pooled + bias, 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ out + shift[0], -30, 30)))
        error = (p - toxic[batch]) * balance[batch] / len(batch)
        g_out = hidden.T @ error + 1e-4 * out
        back = error[:, None] * out * active
        g_emb, g_kernel = np.zeros((len(used), DIM)), np.zeros_like(kernel)
        for k, width in enumerate(offsets):
            j = k - sum(WIDTHS[:width])
            cols = slice(width * FILTERS, (width + 1) * FILTERS)
            rows = rows_of[place[:, cols] + j]
            own = number[rows]
            g_kernel[k] = np.einsum("bfd,bf->df", w.emb[rows], back[:, cols])
            np.add.at(g_emb, own.ravel(), (back[:, cols, None] * kernel[k].T[None]).reshape(-1, DIM))
        w.emb_memory[used] += (g_emb**2).mean(axis=1)
        w.emb[used] -= RATE * g_emb / np.sqrt(w.emb_memory[used])[:, None]
        w.emb[0] = 0
        g = np.concatenate([g_kernel.ravel(), back.sum(axis=0), g_out, [error.sum()]])
        w.dense_memory += g**2
        w.dense -= RATE * g / np.sqrt(w.dense_memory)


def _model(learned: np.ndarray, w: Weights, tongue: np.ndarray) -> Model:
    kernel, bias, out, shift = w.parts()
    flat = kernel.transpose(1, 0, 2).reshape(DIM, -1).astype(np.float32)
    return Model(learned.astype(np.int32), w.emb.astype(np.float32), flat, bias.copy(), out.copy(), float(shift[0]), tongue, np.zeros(tongue.shape[1]))


def _nothing(languages: int) -> Model:
    """Scores everything 0."""
    w = Weights(np.zeros((1, DIM)), np.zeros(1), np.zeros(len(_begin(np.zeros(0)).dense)), np.zeros(0))
    w.dense[-1] = -50.0
    return _model(np.zeros(0, np.int32), w, np.zeros((1, languages), np.float32))


def _balance(toxic: np.ndarray, n1: int, n0: int) -> np.ndarray:
    return np.where(toxic == 1, (n1 + n0) / (2 * n1), (n1 + n0) / (2 * n0))


def _held(n_held: int, fit_classes: int) -> bool:
    """Whether the rows put aside are enough to calibrate by, and the rest to learn from; else all serve for both."""
    return n_held >= 20 and fit_classes == 2


def train(texts: list, toxic: np.ndarray, langs: list) -> Model:
    """A model of texts in memory, as ``fit`` makes one of a table that is a single shard; every fifth text calibrates."""
    toxic = np.asarray(toxic, np.int64)
    names = sorted({x or "" for x in langs}) or [""]
    lang = np.array([names.index(x or "") for x in langs], np.int64)
    held = np.arange(len(texts)) % 5 == 4
    held &= _held(int(held.sum()), len(set(toxic[~held].tolist())))
    rows = np.flatnonzero(~held)
    n1 = int(toxic[rows].sum())
    learned, texts_of, bad, words = _merged(*_counted([texts[i] for i in rows], toxic[rows], lang[rows]), len(names))
    if not 0 < n1 < len(rows) or not len(learned):
        return _nothing(len(names))
    w = _begin(_odds(texts_of, bad, n1, len(rows) - n1))
    prepared = [indices(learned, [texts[i]])[0] for i in rows]
    for turn in range(ROUNDS):
        _descend(w, prepared, toxic[rows], _balance(toxic[rows], n1, len(rows) - n1), np.random.default_rng(turn).permutation(len(rows)))
    model = _model(learned, w, _tongues(words))
    check = np.flatnonzero(held) if held.any() else rows
    raw, guess = logits(model, [texts[i] for i in check])
    model.thresholds[:] = _thresholds(guess, np.round(np.clip(raw, -MOST_LOGIT, MOST_LOGIT) / LOGIT_STEP).astype(np.int64), toxic[check], np.ones(len(check), np.int64), len(names))
    return model


def _merged(bucket: np.ndarray, lang: np.ndarray, texts: np.ndarray, bad: np.ndarray, words: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets in LEAST_TEXTS texts or more, in order, their texts, toxic texts, and words (buckets, languages)."""
    found, where = np.unique(bucket, return_inverse=True)
    total = lambda v: np.bincount(where, weights=v, minlength=len(found))
    keep = total(texts) >= LEAST_TEXTS
    table = np.zeros((len(found), languages))
    np.add.at(table, (where, lang.astype(np.int64)), words)
    return found[keep].astype(np.int32), total(texts)[keep], total(bad)[keep], table[keep]


def _tongues(words: np.ndarray) -> np.ndarray:
    """(1 + buckets, languages): log-odds of a bucket in a language, row 0 for all others."""
    counts = np.concatenate([np.zeros((1, words.shape[1])), words]).T
    table = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1]))
    table[:, 0] = 0
    return (table - table.mean(axis=0)).T.astype(np.float32)


def _threshold(step: np.ndarray, toxic: np.ndarray, n: np.ndarray, otherwise: float) -> float:
    """The median of the thresholds between counted logits that judge the fewest of n rows wrong."""
    if not len(step):
        return otherwise
    x, where = np.unique(step, return_inverse=True)
    bad, good = (np.bincount(where, weights=n * (toxic == k), minlength=len(x)) for k in (1, 0))
    wrong = np.concatenate(([0], np.cumsum(bad))) + np.concatenate((np.cumsum(good[::-1])[::-1], [0]))
    edges = np.concatenate(([x[0] - 256.0], (x[1:] + x[:-1]) / 2, [x[-1] + 256.0]))
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    return float(edges[best[len(best) // 2]]) * LOGIT_STEP


def _thresholds(guess: np.ndarray, step: np.ndarray, toxic: np.ndarray, n: np.ndarray, languages: int) -> list[float]:
    overall, found = _threshold(step, toxic, n, 0.0), []
    for k in range(languages):
        own = guess == k
        rows, bad = n[own].sum(), n[own & (toxic == 1)].sum()
        found.append(_threshold(step[own], toxic[own], n[own], overall) if rows >= 40 and 5 <= bad < rows else overall)
    return found


def labelled(docs: DataFrame, labels: DataFrame, learnable: Column) -> DataFrame:
    """(doc_id, text, toxic, lang, aside): every document with a label that learnable admits, once; aside: not trained on."""
    marks = labels.where(learnable).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")).join(marks, "doc_id")
    once = rows.groupBy("doc_id").agg(F.max(F.struct("text", "lang", "toxic")).alias("row"))
    aside = F.pmod(F.xxhash64(F.lit("aside"), "doc_id"), F.lit(5)) == 4
    return once.select("doc_id", "row.text", "row.toxic", "row.lang", aside.alias("aside"))


def _count_words(rows: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets in LEAST_TEXTS or more of all rows, their texts, toxic texts, and words by language."""
    number = {name: k for k, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic, langs = (c.to_pylist() for c in batch.columns)
            for i, j in slices(texts, 1 << 22):
                found = _counted(texts[i:j], np.array(toxic[i:j]), np.array([number[x] for x in langs[i:j]]))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found], ["bucket", "lang", "texts", "bad", "words"])

    each = rows.select("text", "toxic", "lang").mapInArrow(run, "bucket long, lang long, texts long, bad long, words long")
    by_lang = [F.sum(F.when(F.col("lang") == k, F.col("words")).otherwise(0)).alias(f"w{k}") for k in range(len(names))]
    held = durable(each.groupBy("bucket").agg(F.sum("texts").alias("texts"), F.sum("bad").alias("bad"), *by_lang).where(F.col("texts") >= LEAST_TEXTS))
    kept, least = 0, LEAST_TEXTS
    if held.count() > MOST_STORED:
        for r in held.groupBy("texts").count().orderBy(F.desc("texts")).collect():  # a row for each frequency
            kept += r["count"]
            if kept > MOST_STORED:
                least = r["texts"] + 1
                break
    found = held.where(F.col("texts") >= least).toArrow().sort_by("bucket")
    discard(held)
    columns = [found.column(c).to_numpy() for c in found.column_names]
    return columns[0].astype(np.int32), columns[1], columns[2], np.stack(columns[3:], axis=1)


def _prepare(rows: DataFrame, learned: np.ndarray, shards: int) -> DataFrame:
    """(shard, doc_id, toxic, words), written: each text's rows of the embedding table."""
    shared = rows.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [indices(shared.value, [t])[0].tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(words, pa.binary())], ["shard", "place", "toxic", "words"])

    dealt = rows.select(F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards)).alias("shard"), F.xxhash64("doc_id").alias("place"), "toxic", "text")
    made = durable(dealt.mapInArrow(run, "shard long, place long, toxic int, words binary"))
    shared.destroy()
    return made


def _round(prepared: DataFrame, w: Weights, n1: int, n0: int, turn: int) -> Weights:
    """The mean of what every shard makes of w in one pass."""
    # Weights that don't belong to a word travel as rows of numbers below zero.
    dense = np.concatenate([w.dense, w.dense_memory])
    lines = -(-len(dense) // (DIM + 1))
    shared = prepared.sparkSession.sparkContext.broadcast(w)
    names = ["row", "n", *[f"v{k}" for k in range(DIM + 1)]]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "words"], kind="stable")
        texts = [np.frombuffer(x, np.int32) for x in pdf["words"]]
        used = np.unique(np.concatenate([np.zeros(1, np.int32), *texts]))
        texts = [np.searchsorted(used, t) for t in texts]
        old = shared.value
        own = Weights(old.emb[used].astype(float), old.emb_memory[used].astype(float), old.dense.copy(), old.dense_memory.copy())
        toxic = pdf["toxic"].to_numpy(np.int64)
        _descend(own, texts, toxic, _balance(toxic, n1, n0), np.random.default_rng([turn, int(key[0])]).permutation(len(texts)))
        moved = np.column_stack([own.emb - old.emb[used], own.emb_memory - old.emb_memory[used]])[1:]
        flat = np.zeros(lines * (DIM + 1))
        flat[: len(dense)] = np.concatenate([own.dense - old.dense, own.dense_memory - old.dense_memory])
        table = np.concatenate([moved, flat.reshape(lines, DIM + 1)])
        out = pd.DataFrame(table, columns=names[2:])
        out.insert(0, "row", np.concatenate([used[1:].astype(np.int64), -1 - np.arange(lines)]))
        out.insert(1, "n", 1)
        return out

    each = prepared.groupBy("shard").applyInPandas(run, "row long, n long, " + ", ".join(f"{v} double" for v in names[2:]))
    means = durable(each.groupBy("row").agg(*[(F.sum(v) / F.sum("n")).cast("float").alias(v) for v in names[2:]]))
    found = means.toArrow()
    discard(means)
    shared.destroy()
    row, values = found.column("row").to_numpy(), np.stack([found.column(v).to_numpy() for v in names[2:]], axis=1)
    own = row >= 0
    emb, memory = w.emb.copy(), w.emb_memory.copy()
    emb[row[own]] += values[own, :DIM]
    memory[row[own]] += values[own, DIM]
    flat = values[~own][np.argsort(-row[~own])].ravel()[: len(dense)] + dense
    return Weights(emb, memory, flat[: len(w.dense)], flat[len(w.dense) :])


def _calibrate(rows: DataFrame, model: Model) -> None:
    """Sets the thresholds of model from counts of all rows by guessed language and logit."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, lang = logits(shared.value, batch.column(0).to_pylist())
            step = np.round(np.clip(raw, -MOST_LOGIT, MOST_LOGIT) / LOGIT_STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int64()), pa.array(step), batch.column(1)], ["guess", "step", "toxic"])

    counts = rows.select("text", "toxic").mapInArrow(run, "guess long, step long, toxic int").groupBy("guess", "step", "toxic").agg(F.count(F.lit(1)).alias("n"))
    found = counts.toArrow()  # at most a row for each language, class and step
    shared.destroy()
    model.thresholds[:] = _thresholds(*(found.column(c).to_numpy() for c in ("guess", "step", "toxic", "n")), len(model.thresholds))


def fit(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, shard: int = SHARD) -> Model:
    """A model from all labelled rows that learnable admits, shard of them a task."""
    small_batches(docs.sparkSession)
    rows = durable(labelled(docs, labels, F.lit(True) if learnable is None else learnable))
    counts = rows.groupBy("aside", "toxic", "lang").count().collect()  # a row for each language and class
    names = sorted({r["lang"] for r in counts}) or [""]
    size = lambda aside, toxic: sum(r["count"] for r in counts if r["toxic"] == toxic and (aside is None or r["aside"] == aside))
    apart = _held(size(True, 0) + size(True, 1), (size(False, 0) > 0) + (size(False, 1) > 0))
    own, check = (rows.where("not aside"), rows.where("aside")) if apart else (rows, rows)
    n0, n1 = (size(False if apart else None, k) for k in (0, 1))
    if not n0 or not n1:
        discard(rows)
        return _nothing(len(names))
    learned, texts, bad, words = _count_words(own, names)
    if not len(learned):
        discard(rows)
        return _nothing(len(names))
    prepared = _prepare(own, learned, -(-(n0 + n1) // shard))
    w = _begin(_odds(texts, bad, n1, n0))
    w = Weights(w.emb.astype(np.float32), w.emb_memory.astype(np.float32), w.dense, w.dense_memory)
    for turn in range(ROUNDS):
        w = _round(prepared, w, n1, n0, turn)
    discard(prepared)
    model = _model(learned, w, _tongues(words))
    _calibrate(check, model)
    discard(rows)
    return model


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with the score of each row's whole text in the column name, which docs must not have."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the words of labelled texts
    at = docs.columns.index("text")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, lang = logits(shared.value, batch.column(at).to_pylist())
            p = 1 / (1 + np.exp(-np.clip(raw - shared.value.thresholds[lang], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score below one half, with the columns of docs."""
    name = "toxicity"
    while name in docs.columns:
        name += "_"
    return with_score(docs, model, name).where(F.col(name) < 0.5).drop(name)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; ids whose crc32 modulo 5 is 0 are held out of learning."""
    model = fit(docs, labels, crc32_mod(F.col("doc_id"), 5) != 0)
    scored = with_score(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model)
    return scored.select(
        "doc_id", (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
