"""Exact deduplication by a 128-bit content hash, with bytes compared inside every hash group.

Rows are grouped by (hash, text): the hash leads, the bytes decide, so texts whose hashes collide end in
separate classes. The partial aggregate runs before the shuffle, so a text that holds a third of all rows
sends one row per task. The classes go back to the documents on (hash, SHA-256), without the texts; documents of very large
classes are dealt to several tasks for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

#: Classes above this size, and above one in SHARE of all rows, are dealt to SALTS tasks. There are less than SHARE of them, so they can be broadcast.
LARGE, SHARE, SALTS = 100_000, 10_000, 64


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_classes(docs: DataFrame, keep: str = "min", hash_of=content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "min" or "max", the stable id that stays. Null text counts as empty. A null doc_id never
    stays if the class has another one. Rows that repeat both doc_id and text are the same document: they
    all report kept. An empty table gives an empty result; other columns are ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    rows = rows.withColumn("h", hash_of(F.col("t")))
    pick = F.min if keep == "min" else F.max
    classes = (
        rows.groupBy("h", "t")
        .agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2(F.col("t"), 256).alias("text_sha256"), "keep_id", "group_size")
    )
    classes = materialize(classes, "exact-classes")
    bar = max(LARGE, (classes.agg(F.sum("group_size")).first()[0] or 0) // SHARE)
    large = classes.where(F.col("group_size") > bar)
    rows = rows.select("doc_id", "h", F.sha2(F.col("t"), 256).alias("text_sha256"))
    rows = rows.join(F.broadcast(large.select("h", "text_sha256", F.lit(SALTS).alias("salts"))), ["h", "text_sha256"], "left")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    salts = F.when(F.col("group_size") > bar, F.lit(SALTS)).otherwise(1)
    classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return rows.join(classes, ["h", "text_sha256", "salt"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, keep: str = "min", hash_of=content_hash) -> DataFrame:
    """One row of each class of equal texts, with all its columns, in a single shuffle.

    Rows that tie on doc_id are told apart by a hash of all their columns; if that ties too they are equal rows.
    """
    order = F.struct(F.col("doc_id").isNull() if keep == "min" else F.col("doc_id").isNotNull(), F.col("doc_id"), F.xxhash64(*docs.columns))
    pick = F.min_by if keep == "min" else F.max_by
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(
        hash_of(text_of()).alias("__h"), text_of().alias("__t"),
        F.struct(*rest, F.col("text").isNull().alias("__null")).alias("__row"), order.alias("__order"),
    )
    out = rows.groupBy("__h", "__t").agg(pick("__row", "__order").alias("__row"))
    text = F.when(F.col("__row.__null"), F.lit(None)).otherwise(F.col("__t"))
    return out.select(*[(text.alias(c) if c == "text" else F.col("__row")[c].alias(c)) for c in docs.columns])


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
