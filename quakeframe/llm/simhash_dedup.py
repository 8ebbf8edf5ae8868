"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two 32-bit segments, and a table for each holds the codes by
the segment's value.  Two codes at most two bits apart differ by one bit at most in the
first segment, or else not at all in the second: so each code enumerates the Hamming ball
of radius 1 of its first segment and of radius 0 of its second, 33 + 1 keys, fetches the
codes that the tables hold there, and links to those whose complete distance is small
enough.  A bucket of more than MOST_IN_BUCKET codes (clusters of near copies share
segments) isn't fetched, as its pairs would grow with the square: its codes meet in
tables of the whole code with each single bit flipped, where a bucket holds 65 codes
whatever the cluster's size, and are kept as stars there, which leaves the components as
they are.  A code outside such buckets still finds one inside by the reverse lookup.

Defined cases: a null or blank text has fingerprint zero and links like any other; rows
that share a text share a fingerprint; rows with a null doc_id are returned, but don't
name a component unless all of its rows have none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, keep_rows, row_key, small_batches
from .components import connected_components

BITS, SEGMENT_BITS, MAX_DISTANCE = 64, 32, 2
#: Codes of one segment value that a lookup fetches; more meet by whole codes.
MOST_IN_BUCKET = 64


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(words) - width + 1)
    first, last = (ends - sizes)[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], seed) for i, j in zip(first, last, strict=True)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, row_key, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash(x.as_py(), width, seed) for x in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found.view(np.int64))], ["doc_id", "row_key", "fp"])

    small_batches(docs.sparkSession)
    picked = docs.select(F.col("doc_id").cast("long"), row_key(F.col("text")).alias("row_key"), F.col("text").cast("string"))
    return picked.mapInArrow(run, "doc_id long, row_key long, fp long")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def segment_keys(fp: Column, radii: tuple[int, int]) -> Column:
    """Keys of both segment tables (the second's from 2**32 on), with the ball of radius 0 or 1 around each."""
    first, second = F.shiftrightunsigned(fp, SEGMENT_BITS), fp.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)).bitwiseOR(F.lit(1 << SEGMENT_BITS))
    flips = [1 << bit for bit in range(SEGMENT_BITS)]
    return F.array(*[key.bitwiseXOR(F.lit(x)) for key, radius in ((first, radii[0]), (second, radii[1])) for x in [0, *(flips if radius else [])]])


def within(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= MAX_DISTANCE


def stars(codes: DataFrame) -> DataFrame:
    """(a, b) star links between the codes that meet at a whole code with one bit flipped."""
    fp = F.col("fp")
    ball = F.array(fp, *[fp.bitwiseXOR(F.lit(_signed(1 << bit))) for bit in range(BITS)])
    table = codes.select("fp", F.explode(ball).alias("key"))
    met = table.withColumn("hub", F.min("fp").over(Window.partitionBy("key"))).where("fp > hub")
    return met.where(within(F.col("fp"), F.col("hub"))).select(F.col("hub").alias("a"), F.col("fp").alias("b"))


def links(codes: DataFrame, most: int = MOST_IN_BUCKET) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp) at 1 or 2 differing bits; all pairs, but stars in crowded buckets."""
    table = codes.select(F.col("fp").alias("b"), F.explode(segment_keys(F.col("fp"), (0, 0))).alias("key"))
    crowded = durable(table.groupBy("key").count().where(F.col("count") > most).select("key"))
    probes = codes.select(F.col("fp").alias("a"), F.explode(segment_keys(F.col("fp"), (1, 0))).alias("key"))
    fetched = probes.join(table.join(crowded, "key", "left_anti"), "key")
    met = fetched.where("a <> b").where(within(F.col("a"), F.col("b"))).select("a", "b")
    return met.union(stars(table.join(crowded, "key", "left_semi").select(F.col("b").alias("fp")).distinct()))


def rooted_codes(fps: DataFrame) -> DataFrame:
    """(fp, root), written: one fingerprint of each component for all of its fingerprints."""
    codes = durable(fps.select("fp").distinct())
    parts = connected_components(links(codes)).select(F.col("node").alias("fp"), "root")
    return durable(codes.join(parts, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    fps = durable(fingerprints(docs))
    rooted = rooted_codes(fps)
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    least = rooted.join(first, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_code = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(by_code, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """Of each component the row with the smallest doc_id (then row_key) stays, one without an id only where none has one."""
    fps = durable(fingerprints(docs))
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    first = fps.groupBy("fp").agg(row.alias("row"))
    kept = rooted_codes(fps).join(first, "fp").groupBy("root").agg(F.min("row").alias("row"))
    return keep_rows(docs, kept.select("row.doc_id", "row.row_key"))
