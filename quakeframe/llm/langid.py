"""Language ID by error-correcting output codes over hashed byte n-grams.

Each language has a codeword; one linear n-gram classifier per bit is fitted on a bounded
sample (PER_LANGUAGE rows a language, MOST_ROWS in all) in one task.  A text's bits
have margins; decoding sums each codeword's logistic loss, weighted by how well its bit
was learned, and takes the nearest codeword.  ``ambiguous`` marks a text whose second
codeword is nearly as near.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every
text where no language was learned; rows with a null doc_id are judged; extra columns
are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, first_by_hash

PER_LANGUAGE, MOST_ROWS = 400, 6400
BUCKETS, ORDERS = 1 << 14, (1, 2, 3)
EPOCHS, BATCH, RATE, MOMENTUM, PENALTY = 10, 64, 0.25, np.float32(0.9), np.float32(1e-4)
AMBIGUOUS = 0.7  # a score below it
_LETTER = regex.compile(r"\p{L}")
#: ASCII letters in lower case; other ASCII becomes a word break.
_FOLD = np.array([b if b > 127 else (b | 32 if chr(b).isalpha() else 32) for b in range(256)], np.uint32)


@dataclass
class Model:
    names: list[str]
    codes: np.ndarray  # (languages, bits) of -1 and 1
    weights: np.ndarray  # (BUCKETS, bits)
    bias: np.ndarray
    trust: np.ndarray  # (bits,)
    scale: float = 1.0


def profile(text: str) -> np.ndarray:
    """Shares of the hashed byte n-grams of the whole text."""
    b = _FOLD[np.frombuffer(f" {text} ".encode(), np.uint8)]
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(b), 1 << 20):  # windows overlap, so no n-gram is lost
        part = b[at : at + (1 << 20) + max(ORDERS) - 1]
        n = min(len(part), 1 << 20)
        key = np.zeros(n, np.uint32)
        for k in range(max(ORDERS)):
            shifted = part[k : k + n]
            key = key[: len(shifted)] * np.uint32(2654435761) + shifted * np.uint32(40503) + np.uint32(k + 1)
            if k + 1 in ORDERS:
                mixed = key ^ (key >> np.uint32(15))
                counts += np.bincount(mixed & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return (counts / max(1, counts.sum())).astype(np.float32)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """Exhaustive codes for up to 5 classes, else random ones with the best least distance of 200 draws."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        columns = [[1 if c == 0 or (m >> (c - 1)) & 1 else -1 for c in range(n)] for m in range(2 ** (n - 1) - 1)]
        return np.array(columns, float).T
    rng, best, least = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart = (bits - code @ code.T) / 2 + bits * np.eye(n)
        if apart.min() > least and (np.abs(code.sum(axis=0)) < n).all():
            best, least = code, apart.min()
    return best


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that the text's profile fills, and their shares."""
    shares = profile(text)
    filled = np.flatnonzero(shares).astype(np.uint16)
    return filled, shares[filled]


def train(texts: list, langs: list, epochs: int = EPOCHS) -> Model:
    return train_profiles([sparse(t or "") for t in texts], langs, epochs)


def train_profiles(profiles: list[tuple[np.ndarray, np.ndarray]], langs: list, epochs: int = EPOCHS) -> Model:
    """Logistic regression per bit on profiles scaled by the root of their mean.

    Mini-batches in a seeded order, with momentum and a step that falls to zero; only a
    batch at a time is dense, and each language weighs the same.
    """
    names = sorted(set(langs))
    codes = codewords(len(names))
    if len(names) < 2:
        return Model(names, codes, np.zeros((BUCKETS, codes.shape[1]), np.float32), np.ones(codes.shape[1]) * 5, np.ones(codes.shape[1]))
    mean = np.zeros(BUCKETS)
    for filled, shares in profiles:
        mean[filled] += shares
    root = np.sqrt(mean / len(profiles) + 1e-7).astype(np.float32)
    own = np.array([names.index(g) for g in langs])
    y = codes[own].astype(np.float32)
    w = (len(own) / (len(names) * np.bincount(own, minlength=len(names))))[own].astype(np.float32)
    size = np.mean([c * ((shares / root[filled]) ** 2).sum() for c, (filled, shares) in zip(w, profiles, strict=True)])
    rng = np.random.default_rng(3)

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for k, r in enumerate(rows):
            filled, shares = profiles[r]
            x[k, filled] = shares / root[filled]
        return x

    beta, bias = np.zeros((BUCKETS, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    speed, drift = np.zeros_like(beta), np.zeros_like(bias)
    steps, t = epochs * -(-len(own) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(own))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            x = dense(rows)
            margin = x @ beta + bias
            pull = -w[rows, None] * y[rows] / (1 + np.exp(np.clip(y[rows] * margin, -30, 30))) / len(rows)
            rate = np.float32(RATE * 4 / size * (1 - t / steps))
            speed = MOMENTUM * speed - rate * (x.T @ pull + PENALTY * beta)
            drift = MOMENTUM * drift - rate * pull.sum(axis=0)
            beta, bias, t = beta + speed, bias + drift, t + 1
    right = np.zeros(y.shape[1])
    for at in range(0, len(own), BATCH):
        rows = np.arange(at, min(at + BATCH, len(own)))
        right += ((dense(rows) @ beta + bias) * y[rows] > 0).sum(axis=0)
    right /= len(own)
    trust = np.log((right + 0.01) / (1.01 - right)).clip(0.1)
    return Model(names, codes, (beta / root[:, None]).astype(np.float32), bias.astype(float), trust / trust.mean())


def identify(model: Model, text: str | None) -> tuple[str, float, bool]:
    """Language, score of the nearest codeword, whether it is ambiguous."""
    if not model.names or text is None or not _LETTER.search(text):
        return "und", 0.0, True
    margin = profile(text) @ model.weights + model.bias
    loss = (model.trust * np.logaddexp(0, -model.codes * margin)).sum(axis=1)
    p = np.exp(loss.min() - loss)
    p /= p.sum()
    k = int(loss.argmin())
    return model.names[k], float(p[k]), bool(p[k] < AMBIGUOUS)


def fit(docs: DataFrame, learnable: Column | None = None, per_language: int = PER_LANGUAGE) -> Model:
    """A model from a bounded sample: each language's first rows by a hash of their id.

    One task turns the sample's texts into profiles, batch by batch, and trains on them;
    the driver sees the model alone.
    """
    known = docs.select("doc_id", "lang").where("lang is not null and doc_id is not null")
    known = known.where(learnable) if learnable is not None else known
    few = first_by_hash(known, "lang", per_language).orderBy("rank", "lang").limit(MOST_ROWS).select("doc_id").distinct()
    rows = docs.where("lang is not null").select("doc_id", "text", "lang").join(F.broadcast(few), "doc_id")  # MOST_ROWS ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, langs = [], []
        for batch in batches:
            for text, lang in zip(*batch.columns, strict=True):
                if (t := text.as_py()) and _LETTER.search(t):
                    profiles.append(sparse(t))
                    langs.append(lang.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train_profiles(profiles, langs))], pa.binary())], ["model"])

    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").select("text", "lang")
    found = ordered.mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0][0]) if found else train([], [])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [identify(shared.value, x.as_py()) for x in batch.column(1)]
            lang, score, doubt = ([x[k] for x in found] for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(doubt, pa.bool_())],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    schema = "doc_id long, lang_pred string, score double, ambiguous boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; ids whose crc32 modulo 4 is 2 are held out of learning."""
    model = fit(docs, crc32_mod(F.col("doc_id"), 4) != 2)
    found = predict(docs, model)
    return found.select("doc_id", (crc32_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
