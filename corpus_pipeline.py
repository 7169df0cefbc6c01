"""A corpus pipeline: language, exact copies, near copies, source weights, sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waveloom.llm import exact_dedup, langid, mixing, near_dup, packing
from waveloom.llm.common import documents, materialize
from waveloom.scratch import delete, scope


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without any letter go, null and empty ones too. Repeated rows stay, columns are those of docs, and an
    empty table stays empty; so it is with the stages below."""
    return langid.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays; null equals empty, and one row of repeated ones stays. Texts are compared whole."""
    return exact_dedup.drop_exact_duplicates(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the one with the least doc_id stays. Texts without words are near to equal ones only."""
    return near_dup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, kept or left out so that sources come near their target weights. Null and empty texts are never taken; a null source
    is a source of its own."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; texts of any length are cut, null and empty ones are their end id, repeated rows are packed
    repeatedly, and an empty table has no pieces."""
    return packing.pack(docs)


STAGES = [("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("packing", pack)]

#: Language ID, MinHash, pivotal draws and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; tables that only a former stage needed are deleted."""
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES:
        with scope(spark) as made:
            docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
            kept = made.pop()
        if last:
            delete(spark, last)
        last = kept
    return docs
