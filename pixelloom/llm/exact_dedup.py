"""Exact dedup by skew-safe combining.

Documents are deduplicated in their own partitions first (the partial
aggregation, whose keys are whole texts), then merged by (digest, salt), and
the salts' winners are combined by digest. The text is part of the grouping
key at every stage, so contents are compared in full and a digest's collision
merges nothing.

A text's salt is that of the partition that it was read in, so a hot text
arrives at SALTS tasks, and one winner comes of each. All texts go the same
way, however many rows they have, and are shuffled twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

#: Salts of a digest.
SALTS = 16


def _digest(text: Column) -> Column:
    return F.xxhash64(text)


def _combine(docs: DataFrame, text: str, first: Column, salts: int) -> DataFrame:
    """(digest, text, first) with the least ``first`` of each text."""
    rows = docs.select(_digest(col(text)).alias("digest"), (F.spark_partition_id() % salts).alias("salt"), col(text).alias("text"), first.alias("first"))
    won = rows.groupBy("digest", "salt", "text").agg(F.min("first").alias("first"))
    return won.groupBy("digest", "text").agg(F.min("first").alias("first"))


def exact_winners(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """(doc_id, digest): for each distinct text the least id that has it; and
    the text's MD5.

    Texts are equal if all their bytes are: blanks and case count, and very long
    texts are compared whole. Null texts equal each other and differ from the
    empty text. Null ids lose to others; a text with null ids only gives null.
    Ids keep their type. Repeated rows count once. An empty table gives no rows.
    No columns but the two named are read."""
    won = _combine(docs, text, col(doc_id), salts)
    return won.select(F.col("first").alias("doc_id"), F.md5("text").alias("digest"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """One row of each distinct text, whole: that of the least id, and of rows
    with the same id the least by the other columns in their order (nulls last).
    Columns that can't be ordered (maps, variants) decide by their JSON. Columns
    may have any names."""
    order, kinds = [doc_id, *[c for c in docs.columns if c not in (doc_id, text)]], dict(docs.dtypes)
    rough = [c for c in order if "map<" in kinds[c] or "variant" in kinds[c]]
    key = [x for i, c in enumerate(order) for x in (col(c).isNull().alias(f"n{i}"), (F.to_json(F.struct(col(c))) if c in rough else col(c)).alias(f"k{i}"))]
    back = {c: F.col(f"first.k{i}") for i, c in enumerate(order) if c not in rough} | {text: F.col("text")}
    if rough:
        # such values can't be compared, so they are carried beside what is
        rows = docs.select(_digest(col(text)).alias("digest"), (F.spark_partition_id() % salts).alias("salt"), col(text).alias("text"), F.struct(*key).alias("first"), F.struct(*[col(c).alias(f"r{i}") for i, c in enumerate(rough)]).alias("rough"))
        best = [F.min_by("rough", "first").alias("rough"), F.min("first").alias("first")]
        won = rows.groupBy("digest", "salt", "text").agg(*best).groupBy("digest", "text").agg(*best)
        back |= {c: F.col(f"rough.r{i}") for i, c in enumerate(rough)}
    else:
        won = _combine(docs, text, F.struct(*key), salts)
    return won.select(*[back[c].alias(c) for c in docs.columns])


EXACT_SQL = """
SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text"""
