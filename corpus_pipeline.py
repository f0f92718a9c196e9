"""From raw documents to packed sequences: five stages, each written as Parquet
and read again by the next.

All stages take null ids, texts and sources, empty and very long texts (whole),
ties and repeated rows, an empty table (which gives an empty result), ids of any
type and columns of any other names, which all stages but the last keep. Quality
rules reject null and empty texts; exact dedup keeps the least id of a text, near
dedup that of a group, null ids last; repeated rows are copies. Mixing repeats
documents, whole, as their source's weight asks for; rows that share an id are
taken together. Packing has a piece for each document taken, tokens being words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm import exact_dedup, mixing, near_dedup, packing, quality
from pixelloom.llm.common import scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces lie in the packed sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]

#: Near dedup and packing have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of the documents; what a stage wrote on its way is deleted when
    its result is written, and its result when the next one is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch() as done:
        for name, stage in STAGES:
            docs = done(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return docs
