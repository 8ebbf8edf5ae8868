"""Ranked lexical search: best-first search of document intervals bounded by range maxima.

Documents are indexed in blocks of some megabytes: for each term its documents in the
order of doc_id and how often they hold it.  For a query the impacts of its terms'
postings are known, and a sparse table over each posting list gives the place of the
greatest impact within any interval.  The sum of those maxima bounds the score of every
document of the interval.  Of each query the intervals with the highest bounds are taken
first and split at the document of their greatest single impact, which is scored on the
way: one search for it in each list gives its postings and the two rests.  Intervals whose
bound is below the k-th best score are left; on equal bounds their smallest doc_id decides.
Queries advance together, so that each step works on arrays of intervals.

Blocks know nothing of each other but the scores that their task has found before; the
best k of the tasks are merged.  Statistics (documents, lengths, document frequencies) are
summed over all blocks first.  Queries are taken in chunks of QUERIES, whose terms go to
the tasks with the code, so neither the corpus nor the query set passes anywhere whole.

Defined cases: null texts have no terms; documents or items without terms are not found or
find nothing; every row is a document and an item of its own, and rows with equal ids are
ranked each; a null doc_id counts as the greatest id and comes out as null; ties in all
stand in any order; an empty table gives an empty result; extra columns are ignored.
Terms are looked up by 64-bit hashes and compared with the query's letter by letter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, slices, word_spans

#: Bytes of text of one block, queries of one pass over the index, queries that advance together.
BLOCK, QUERIES, TOGETHER = 1 << 20, 4096, 32
#: Bytes of blocks that are written and read at once.
ROW_GROUP = 1 << 21
#: Intervals of each query that one step splits.
SPLITS = 32
#: Share of the document's length in the score, of 100 (fixed value of the formula).
LENGTH_SHARE = 75
_LAST = np.iinfo(np.int64).max
_FIELDS = (("ids", np.int64), ("lengths", np.int64), ("hashes", np.uint64), ("letters", np.uint8), ("ends", np.int32), ("offsets", np.int32), ("docs", np.int32), ("tfs", np.int32))
_INDEX = ", ".join(f"{name} binary" for name, _ in _FIELDS)


def index_block(ids: np.ndarray, texts: list) -> list[np.ndarray]:
    """The block's documents by id, its terms by hash, and each term's postings."""
    order = np.argsort(ids, kind="stable")
    parts = [(texts[k] or "").encode() for k in order.tolist()]
    h, starts, ends, raw = word_spans(b"\n".join(parts))
    begins = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
    doc = np.searchsorted(begins, starts, "right") - 1
    by_term = np.argsort(h, kind="stable")
    h, doc = h[by_term], doc[by_term]
    new_term = np.diff(h, prepend=~h[:1]) != 0
    new_posting = new_term | (np.diff(doc, prepend=-1) != 0)
    at = np.flatnonzero(new_posting)
    first = by_term[new_term]
    sizes = ends[first] - starts[first]
    stop = np.cumsum(sizes)
    letters = raw[np.repeat(starts[first] - (stop - sizes), sizes) + np.arange(int(stop[-1]) if len(stop) else 0)]
    offsets = np.append(np.searchsorted(at, np.flatnonzero(new_term)), len(at))
    return [ids[order], np.bincount(doc, minlength=len(ids)), h[new_term], letters, stop, offsets, doc[at], np.diff(np.append(at, len(h)))]


def build_index(docs: DataFrame) -> DataFrame:
    """A row of arrays for each block of whole documents, written."""
    kind = pa.schema([(name, pa.binary()) for name, _ in _FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple[list, list]]:
            ids, texts, size = [], [], 0
            for whole in batches:
                for start in range(0, whole.num_rows, 256):
                    batch = whole.slice(start, 256)
                    keys, values = batch.column(0).fill_null(_LAST).to_pylist(), batch.column(1).to_pylist()
                    for i, j in slices(values, BLOCK // 4):
                        ids += keys[i:j]
                        texts += values[i:j]
                        size += sum(len(t) for t in values[i:j] if t)
                        if size >= BLOCK:
                            yield ids, texts
                            ids, texts, size = [], [], 0
            if ids:
                yield ids, texts

        for ids, texts in blocks():
            arrays = index_block(np.array(ids, np.int64), texts)
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(a, k).tobytes()], pa.binary()) for a, (_, k) in zip(arrays, _FIELDS, strict=True)], schema=kind)

    blocks = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _INDEX)
    # Rows are large: Parquet is told to look at its buffer after each of them.
    looks = {f"parquet.{what}.size.row.check.{end}": 1 for what in ("page", "block") for end in ("min", "max")}
    return durable(blocks, **{"parquet.block.size": ROW_GROUP, **looks})


@dataclass
class Queries:
    """hashes: the distinct terms' hashes, sorted; words: their letters; items: each query's (term, times)."""

    hashes: np.ndarray
    words: list[bytes]
    items: list[list[tuple[int, int]]]

    @classmethod
    def of(cls, texts: list) -> Queries:
        counts: list[Counter] = []
        known: dict[bytes, int] = {}
        for text in texts:
            h, starts, ends, raw = word_spans((text or "").encode())
            words = [raw[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            counts.append(Counter(words))
            known |= dict(zip(words, h.tolist(), strict=True))
        words = sorted(known, key=known.__getitem__)
        number = {w: k for k, w in enumerate(words)}
        return cls(np.array([known[w] for w in words], np.uint64), words, [[(number[w], n) for w, n in c.items()] for c in counts])

    def terms(self, block: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the queries' terms that the block has, and the block's numbers of them."""
        if not len(block["hashes"]) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(block["hashes"], self.hashes), len(block["hashes"]) - 1)
        mine = np.flatnonzero(block["hashes"][at] == self.hashes)
        begin = np.concatenate(([0], block["ends"]))
        letters = block["letters"]
        same = [letters[begin[t] : begin[t + 1]].tobytes() == self.words[k] for k, t in zip(mine.tolist(), at[mine].tolist(), strict=True)]
        mine = mine[np.array(same, bool)]
        return mine, at[mine]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: np.frombuffer(batch.column(name)[k].as_buffer(), kind) for name, kind in _FIELDS if name in batch.schema.names}


def frequencies(index: DataFrame, queries: Queries) -> np.ndarray:
    """Documents that hold each of the queries' terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(queries.words), np.int64)
        for block in _blocks(batches):
            mine, at = queries.terms(block)
            df[mine] += np.diff(block["offsets"])[at]
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["term", "df"])

    df = np.zeros(len(queries.words), np.int64)
    for r in index.select("hashes", "letters", "ends", "offsets").mapInArrow(run, "term long, df long").groupBy("term").sum("df").collect():  # a row for each term of a chunk
        df[r[0]] = r[1]
    return df


def totals(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms with repeats, over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([int((x > 0).sum()) for x in lengths]), pa.array([int(x.sum()) for x in lengths])], names=["n", "l"])

    found = index.select("lengths").mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return found[0] or 0, found[1] or 0


class RangeMaxima:
    """Sparse tables over many lists laid one after another, longest first; level k holds places of maxima of 2**k values."""

    def __init__(self, values: np.ndarray, begins: np.ndarray, sizes: np.ndarray):
        self.values, self.levels = values, [np.arange(len(values), dtype=np.int32)]
        while True:
            step = 1 << len(self.levels)
            long_lists = int((sizes >= step).sum())
            if not long_lists:
                break
            till = int(begins[long_lists - 1] + sizes[long_lists - 1]) - step + 1
            a, b = self.levels[-1][:till], self.levels[-1][step // 2 : step // 2 + till]
            self.levels.append(np.where(values[a] >= values[b], a, b))

    def places(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first place of the greatest value within each [low, high), which lies in one list and isn't empty."""
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for level in np.unique(k).tolist():
            mine = np.flatnonzero(k == level)
            a, b = self.levels[level][low[mine]], self.levels[level][high[mine] - (1 << level)]
            out[mine] = np.where(self.values[a] >= self.values[b], a, b)
        return out


class Best:
    """The k best (score, doc_id) of each query so far, best first; score 0 marks free places."""

    def __init__(self, n: int, k: int):
        self.score, self.doc = np.zeros((n, k), np.int64), np.full((n, k), _LAST)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        """item may repeat."""
        k = self.score.shape[1]
        some = np.unique(item)
        it = np.concatenate([np.repeat(some, k), item])
        sc, dc = np.concatenate([self.score[some].ravel(), score]), np.concatenate([self.doc[some].ravel(), doc])
        order = np.lexsort((dc, -sc, it))
        it, sc, dc = it[order], sc[order], dc[order]
        rank = np.arange(len(it)) - np.searchsorted(it, it)
        top = rank < k
        self.score[it[top], rank[top]], self.doc[it[top], rank[top]] = sc[top], dc[top]

    def open(self, item: np.ndarray, bound: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether an interval with this bound and smallest doc_id may still change a query's best."""
        kth = self.score[item, -1]
        return (bound > kth) | ((bound == kth) & (bound > 0) & (least < self.doc[item, -1]))


def search_block(block: dict[str, np.ndarray], queries: Queries, weights: np.ndarray, n_docs: int, n_terms: int, best: Best) -> None:
    """Adds the block's documents to the queries' best."""
    mine, at = queries.terms(block)
    if not len(mine):
        return
    sizes = np.diff(block["offsets"])[at]
    longest = np.argsort(-sizes, kind="stable")
    mine, at, sizes = mine[longest], at[longest], sizes[longest]
    stop = np.cumsum(sizes)
    begins = stop - sizes
    take = np.repeat(block["offsets"][at] - begins, sizes) + np.arange(int(stop[-1]))
    docs, tf = block["docs"][take], block["tfs"][take].astype(np.int64)
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * block["lengths"] * n_docs) // n_terms
    impact = np.repeat(weights[mine], sizes) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]))
    tables = RangeMaxima(impact, begins, sizes)
    place = np.full(len(queries.words), -1, np.int64)
    place[mine] = np.arange(len(mine))
    for start in range(0, len(queries.items), TOGETHER):
        some = range(start, min(start + TOGETHER, len(queries.items)))
        pairs = [(i, place[t], times) for i in some for t, times in queries.items[i] if place[t] >= 0]
        if pairs:
            item, term, times = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
            _search(item, times, begins[term], begins[term] + sizes[term], docs, impact, tables, block["ids"], best)


def _search(item, times, low, high, docs, impact, tables: RangeMaxima, ids, best: Best) -> None:
    """Best-first over intervals; one row for each interval and list that has postings in it, an interval's rows together."""
    where = tables.places(low, high)
    head = np.flatnonzero(np.diff(item, prepend=-1))
    waiting = None
    while True:
        # Bounds of the intervals that are new, and which of them count.
        worth = times * impact[where]
        count = np.diff(np.append(head, len(low)))
        bound = np.add.reduceat(worth, head)
        least = ids[np.minimum.reduceat(docs[low], head)]
        fresh = (item[head], bound, least, count, (times, low, high, where))
        waiting = fresh if waiting is None else (*(np.concatenate([a, b]) for a, b in zip(waiting[:4], fresh[:4], strict=True)), tuple(np.concatenate([a, b]) for a, b in zip(waiting[4], fresh[4], strict=True)))
        owner, bound, least, count, rows = waiting
        keep = best.open(owner, bound, least)
        owner, bound, least = owner[keep], bound[keep], least[keep]
        rows = tuple(x[np.repeat(keep, count)] for x in rows)
        count = count[keep]
        if not len(owner):
            return
        # The highest bounds of each query are split, the others wait.
        order = np.lexsort((-bound, owner))
        rank = np.empty(len(owner), np.int64)
        rank[order] = np.arange(len(owner)) - np.searchsorted(owner[order], owner[order])
        now = rank < SPLITS
        later = ~now
        row_now = np.repeat(now, count)
        waiting = (owner[later], bound[later], least[later], count[later], tuple(x[~row_now] for x in rows))
        owner, count = owner[now], count[now]
        times, low, high, where = (x[row_now] for x in rows)
        head = np.cumsum(count) - count
        group = np.repeat(np.arange(len(owner)), count)
        # The document with the greatest single impact.
        worth = times * impact[where]
        most = np.flatnonzero(worth == np.repeat(np.maximum.reduceat(worth, head), count))
        split = np.empty(len(owner), np.int64)
        split[group[most[::-1]]] = docs[where[most[::-1]]]
        doc = split[group]
        # Its place in every list: lower bounds of all rows together.
        a, b = low.copy(), high.copy()
        for _ in range(int(np.max(high - low)).bit_length()):
            mid = (a + b) >> 1
            right = (a < b) & (docs[np.minimum(mid, len(docs) - 1)] < doc)
            a, b = np.where(right, mid + 1, a), np.where(right, b, mid)
        hit = (a < high) & (docs[np.minimum(a, len(docs) - 1)] == doc)
        score = np.add.reduceat(np.where(hit, times * impact[np.minimum(a, len(docs) - 1)], 0), head)
        better = best.open(owner, score, ids[split])
        if better.any():
            best.add(owner[better], score[better], ids[split][better])
        # What is left of it and right of it.
        left, right = np.flatnonzero(a > low), np.flatnonzero(a + hit < high)
        side = np.concatenate([group[left] * 2, group[right] * 2 + 1])
        order = np.argsort(side, kind="stable")
        side = side[order]
        if not len(side):
            if not len(waiting[0]):
                return
            item, times, low, high, where, head = (np.zeros(0, np.int64),) * 6
            times, low, high, where = waiting[4]
            item, count = waiting[0], waiting[3]
            head = np.cumsum(count) - count
            item = np.repeat(item, count)
            waiting = None
            continue
        times = np.concatenate([times[left], times[right]])[order]
        low, high = np.concatenate([low[left], (a + hit)[right]])[order], np.concatenate([a[left], high[right]])[order]
        where = tables.places(low, high)
        item = owner[side >> 1]
        head = np.flatnonzero(np.diff(side, prepend=-1))


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0."""
    spark = index.sparkSession
    n_docs, n_terms = totals(index)
    kind = "item_id long, item long, doc_id long, score long"
    found = spark.createDataFrame([], kind)
    for number, (keys, texts) in enumerate(_chunks(items)):
        queries = Queries.of(texts)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in frequencies(index, queries).tolist()], np.int64)

        def run(batches, queries=queries, weights=weights, keys=keys, number=number) -> Iterator[pa.RecordBatch]:
            best = Best(len(keys), k)
            for block in _blocks(batches):
                search_block(block, queries, weights, n_docs, n_terms, best)
            q, r = np.nonzero(best.score)
            doc = best.doc[q, r]
            columns = [pa.array([keys[x] for x in q.tolist()], pa.int64()), pa.array(q + number * QUERIES), pa.array(doc, mask=doc == _LAST), pa.array(best.score[q, r])]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "item", "doc_id", "score"])

        found = found.union(index.mapInArrow(run, kind))
    # Of many tasks' best the best of groups first, so that no item's rows meet at once.
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    salted = found.withColumn("salt", F.spark_partition_id() % 64)
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _chunks(items: DataFrame) -> Iterator[tuple[list, list]]:
    """The query set, QUERIES rows at a time."""
    keys, texts = [], []
    for r in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        keys.append(r[0])
        texts.append(r[1])
        if len(keys) == QUERIES:
            yield keys, texts
            keys, texts = [], []
    if keys:
        yield keys, texts


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Ranks all docs for each item; builds the index on the way."""
    return search(build_index(docs), items, k)
