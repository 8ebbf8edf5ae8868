"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The six ASCII white-space characters of the contracts: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where the session names none (local tests) a temporary one is set.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="quakeframe-")
        context.setCheckpointDir(found)
    return found


#: Bound of the table of groups that sampling broadcasts.
MOST_GROUPS = 1 << 14
#: Spark's setting that removes a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows that Spark hands to a Python worker at once.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def durable(df: DataFrame, **options: object) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder and read it back.

    Lost executors lose nothing of it, and what stands above isn't computed twice.  The
    write's own shuffle files go with it, as a job of many steps would otherwise keep them
    all to its end.  options: of the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quakeframe-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    _written[found] = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``durable`` that nothing reads any more."""
    for df in tables:
        if path := _written.pop(df, None):
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers BATCH_BYTES at a time, unless the session says otherwise.

    A batch is held several times over, in the JVM and in Python, by every task of an
    executor, and Spark's own bounds (10,000 rows, 64 MB) let it grow with the texts.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def first_by_hash(rows: DataFrame, group: str, most: int) -> DataFrame:
    """At most ``most`` rows of each group, the first by a hash of doc_id (column rank, from 1); rows without a group go.

    Counts in 4,096 ranges of the hash, summed before they are shuffled, tell in which range
    a group's sample ends; only rows up to there are shuffled and sorted, however large the
    group.  Of more than MOST_GROUPS groups the first by name give a sample.
    """
    placed = rows.where(F.col(group).isNotNull()).withColumn("range", F.shiftrightunsigned(F.xxhash64("doc_id"), 52))
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(group, "range").count().withColumn("passed", F.coalesce(F.sum("count").over(before), F.lit(0)))
    last = counts.where(F.col("passed") < most).groupBy(group).agg(F.max("range").alias("last"))
    few = placed.join(F.broadcast(last.orderBy(group).limit(MOST_GROUPS)), group).where("range <= last")
    order = Window.partitionBy(group).orderBy("range", F.xxhash64("doc_id"), "doc_id")
    return few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(*rows.columns, "rank")


def row_key(text: Column) -> Column:
    """Tells rows of one doc_id apart by their texts."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, row_key) is in kept, null ids included; of rows equal in both one stays."""
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    rows = rows.withColumns({"id": F.col("row.doc_id").cast("long"), "key": row_key(F.col("row.text"))})
    repeats = rows.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chosen = kept.select(F.col("doc_id").alias("id"), F.col("row_key").alias("key")).distinct()
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["key"] == b["key"])
    met = rows.join(chosen, same(rows, chosen), "left_semi")
    several = durable(repeats.join(chosen, same(repeats, chosen), "left_semi").select("id", "key"))
    if several.isEmpty():
        return met.select("row.*")
    # Rows equal in both are few, and only they are moved again.
    once = met.join(several, same(met, several), "left_anti").select("row.*")
    again = met.join(several, same(met, several), "left_semi").dropDuplicates(["id", "key"])
    return once.union(again.select("row.*"))


def crc32_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def slices(texts: list, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of about most_bytes together, at least one text each."""
    i, size = 0, 0
    for j, text in enumerate(texts):
        n = len(text) if text else 0
        if j > i and size + n > most_bytes:
            yield i, j
            i, size = j, 0
        size += n
    if i < len(texts):
        yield i, len(texts)


_POWER = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_POWER**i and _POWER**-i modulo 2**64 for i < n (kept in the worker)."""
    have = _tables.get("up")
    if have is None or len(have) < n:
        inverse = np.uint64(pow(int(_POWER), -1, 1 << 64))
        with np.errstate(over="ignore"):
            size = max(n, 1 << 16)
            _tables["up"] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _POWER))))
            _tables["down"] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, inverse))))
    return _tables["up"], _tables["down"]


#: Lower-cases A-Z; everything but ASCII letters and digits and bytes over 127 becomes 0.
_WORD_BYTE = np.zeros(256, np.uint8)
for _b in range(256):
    if chr(_b).isascii():
        _WORD_BYTE[_b] = ord(chr(_b).lower()) if chr(_b).isalnum() else 0
    else:
        _WORD_BYTE[_b] = _b


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of data, each word's first byte position and the one after it, and the folded bytes.

    Words are runs of ASCII letters or digits (case-folded) and non-ASCII bytes.  The
    hash is polynomial, from prefix sums with wrap-around, so no word is looped over.
    """
    raw = _WORD_BYTE[np.frombuffer(data, np.uint8)]
    inside = raw > 0
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(raw.astype(np.uint64) * up[: len(raw)], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h, starts, ends, raw


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first positions of ``word_spans``."""
    return word_spans(data)[:2]
