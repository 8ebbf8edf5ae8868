"""Exact duplicates through content-defined chunk recipes, in SQL functions only.

Normalised text is cut after the first sentence mark past a least size (or at a most
size), so that cut points move with the content.  A chunk's key is a 64-bit hash; one
grouping of the chunks by (key, chunk text) verifies which keys stand for one text alone
- each distinct chunk is moved once per map task, whole documents never.  A key that
stands for several texts is told apart by an ordinal.  A document is then the ordered
list of its verified identifiers, and equal lists are equal texts.

Defined cases: null counts as the empty text; texts that are empty after normalising are
equal; a row with a null doc_id belongs to its group, but stays only if all have none;
of rows that repeat a doc_id and a text one stays; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ASCII_SPACE, durable, keep_rows, row_key

LEAST_CHUNK, MOST_CHUNK = 512, 4096


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), ASCII_SPACE, "")


def chunks(norm: Column, least: int = LEAST_CHUNK, most: int = MOST_CHUNK) -> Column:
    """Array of consecutive chunks that join to norm."""
    pattern = rf"(?s).{{{least},{most - 1}}}?[.!?;:]|.{{1,{most}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def chunk_key(chunk: Column, key_bits: int) -> Column:
    key = F.xxhash64(chunk)
    return key if key_bits >= 64 else key.bitwiseAND(F.lit((1 << key_bits) - 1))


def recipes(docs: DataFrame, least: int = LEAST_CHUNK, most: int = MOST_CHUNK, key_bits: int = 64) -> DataFrame:
    """(doc_id, row_key, rid, n_cp, text_sha256, keys, ords), written: keys and ords are the recipe, rid numbers the rows.

    ords is empty where every key of the document stands for one chunk text alone.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key(F.col("text")).alias("row_key"),
        F.char_length(text).cast("long").alias("n_cp"),
        normalised(F.col("text")).alias("norm"),
    )
    parts = chunks(F.col("norm"), least, most)
    base = durable(
        cut.select(
            "doc_id",
            "row_key",
            F.monotonically_increasing_id().alias("rid"),
            "n_cp",
            F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
            F.transform(parts, lambda c: chunk_key(c, key_bits)).alias("keys"),
        )
    )
    pieces = cut.select(F.explode(parts).alias("chunk")).select(chunk_key(F.col("chunk"), key_bits).alias("key"), "chunk")
    once = pieces.distinct()
    shared = durable(once.groupBy("key").count().where("count > 1").select("key"))
    if shared.isEmpty():
        return base.withColumn("ords", F.array().cast("array<int>"))
    # Two chunk texts share a key: number the texts of such keys, and look up each use.
    number = F.row_number().over(Window.partitionBy("key").orderBy("chunk"))
    texts = durable(once.join(shared, "key", "left_semi").withColumn("ord", number))
    uses = cut.select("doc_id", F.col("norm").alias("whole"), F.posexplode(parts).alias("pos", "chunk"))
    uses = uses.select("doc_id", F.sha2(F.col("whole").cast("binary"), 256).alias("text_sha256"), "pos", "chunk", chunk_key(F.col("chunk"), key_bits).alias("key"))
    uses = uses.join(shared, "key", "left_semi").join(texts, ["key", "chunk"]).select("doc_id", "text_sha256", "pos", "ord").distinct()
    found = uses.groupBy("doc_id", "text_sha256").agg(F.array_sort(F.collect_list(F.struct("pos", "ord"))).alias("at"))
    found = found.select("doc_id", "text_sha256", F.transform("at", lambda x: x["ord"]).alias("found"))
    both = base["doc_id"].eqNullSafe(found["doc_id"]) & (base["text_sha256"] == found["text_sha256"])
    return durable(
        base.join(found, both, "left").select(
            base["doc_id"], "row_key", "rid", "n_cp", base["text_sha256"], "keys", F.coalesce("found", F.array().cast("array<int>")).alias("ords")
        )
    )


def judged_rows(docs: DataFrame, least: int = LEAST_CHUNK, most: int = MOST_CHUNK, key_bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, row_key, keep_id, group_size, kept, text_sha256."""
    base = recipes(docs, least, most, key_bits)
    none = F.col("doc_id").isNull()
    best = F.min(F.struct((-F.col("n_cp")).alias("less"), none.alias("none"), F.col("doc_id").alias("id"), F.col("rid").alias("rid")))
    groups = base.groupBy("keys", "ords").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    groups = groups.select("keys", "ords", "group_size", F.col("best.id").alias("keep_id"), F.col("best.rid").alias("best"))
    return base.join(groups, ["keys", "ords"]).select(
        "doc_id", "row_key", "keep_id", "group_size", (F.col("rid") == F.col("best")).alias("kept"), "text_sha256"
    )


def exact_duplicates(docs: DataFrame, least: int = LEAST_CHUNK, most: int = MOST_CHUNK, key_bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points, then the smallest doc_id stays.
    """
    return judged_rows(docs, least, most, key_bits).drop("row_key")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, whether they have an id or not."""
    return keep_rows(docs, judged_rows(docs).where("kept"))
