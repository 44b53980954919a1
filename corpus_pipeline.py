"""Documents to packed training windows: five stages, each read from the last one's table.

Empty tables pass through every stage; other columns are carried along up to the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortsmith.llm import exact_dedup, mixing, packing, queries, simhash, toxicity
from cohortsmith.llm.tables import register, table
from cohortsmith.session import fresh_path, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier chain rejects go; NULL and empty texts stay."""
    chain = queries.toxicity_chain(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, chain, "toxic", queries.TOXIC)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays; NULL and empty are equal."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every SimHash component the document with the smallest doc_id stays.

    Texts without words are near copies of each other.
    """
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mix takes them; longer ones are likelier."""
    return mixing.mix(docs, appeal=mixing.substance)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of up to 2048 tokens with their places; a copy is a document of its own."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

# A trained classifier, hashed sampling and a tokenizer have no SQL; tests compare the
# stages with brute force.
ORACLE_SQL = None


@register("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again.

    What a stage writes on the way to its result is deleted once that is written.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = fresh_path(spark, "stage")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
