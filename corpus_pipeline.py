"""A training corpus from raw documents: five stages, each written as Parquet and read again.

Defined cases: a row without a doc_id is a document of its own, kept or dropped by its text
like any other, but in the mixing, where such rows of a leaf are placed together; rows that
repeat a doc_id with different texts are told apart by the text until then; null and empty
texts are clean, equal to each other, and hold no tokens, so one of them stays at most; an
empty table passes through empty.  All stages but the last return the columns of documents,
the last one doc_id, n_tokens, ids and the text that they decode to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm import bpe, exact_dedup, mixing, simhash_dedup, toxicity
from quakeframe.llm.common import crc32_mod, durable, table

#: Of all tokens that reach the mixing stage, and how often a document may be used.
MIX_SHARE, MIX_EPOCHS = 0.9, 1


def keep_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids, null being an id like any other."""
    chosen = ids.select("doc_id").distinct()
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["doc_id"]), "left_semi")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc32_mod(F.col("doc_id"), 5) != 0)
    return toxicity.drop_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return simhash_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf of the domain-language-source tree gives a prefix of its seeded order."""
    return keep_ids(docs, mixing.mix(docs, share=MIX_SHARE, epochs=MIX_EPOCHS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, and what they decode to."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SimHash, the classifier and BPE can't be said in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
