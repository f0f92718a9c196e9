"""The driver's tables seen as images, for Spark and (the same) for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import GridSpec

PART_COLS, EMB_COLS = 50, 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def li_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A four-band scene without unique cells."""
    li = read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("blue"), (F.col("l_discount") * 10).alias("green"), (F.col("l_tax") * 12.5).alias("red"), (F.col("l_extendedprice") / 105000).alias("nir"))


LI = "(SELECT l_orderkey, l_linenumber, l_quantity / 50 AS blue, l_discount * 10 AS green, l_tax * 12.5 AS red, l_extendedprice / 105000 AS nir FROM lineitem)"


def part_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid 50 wide with p_size and p_retailprice as bands."""
    z = F.col("p_partkey")
    df = read(spark, sf_dir, "part").select((z + 1).alias("cell"), F.floor(z / PART_COLS).cast("int").alias("row"), (z % PART_COLS).cast("int").alias("col"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return df.withColumn("x", F.col("col") + 0.5).withColumn("y", -(F.col("row") + 0.5))


PART = f"(SELECT p_partkey + 1 AS cell, (p_partkey // {PART_COLS})::INT AS row, (p_partkey % {PART_COLS})::INT AS col, p_size::DOUBLE AS size, p_retailprice AS price FROM part)"


def part_grid(spark: SparkSession, sf_dir: str) -> GridSpec:
    n = read(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] + 1
    return GridSpec(PART_COLS, -(-n // PART_COLS))


def emb_pixels(spark: SparkSession, sf_dir: str, bands: int = 8) -> DataFrame:
    """A grid 20 wide with the first elements of the embeddings as bands b0 ..."""
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.floor(F.col("vec_id") / EMB_COLS).cast("int").alias("row"), (F.col("vec_id") % EMB_COLS).cast("int").alias("col"), (F.col("label") + 1).alias("label"), *[F.col("embedding")[i].cast("double").alias(f"b{i}") for i in range(bands)])


def emb(bands: int = 8) -> str:
    return f"(SELECT vec_id, (vec_id // {EMB_COLS})::INT AS row, (vec_id % {EMB_COLS})::INT AS col, (label + 1)::INT AS label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS b{i}" for i in range(bands)) + " FROM embeddings)"


def veg_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten reflectance-like bands from the embeddings."""
    names = ("blue", "green", "red", "redEdge1", "redEdge2", "redEdge3", "nir", "swir1", "swir2", "swir3")
    e = emb_pixels(spark, sf_dir, 10)
    return e.select("vec_id", *[(F.abs(F.col(f"b{i}")) + 0.05).alias(n) for i, n in enumerate(names)])


VEG = "(SELECT vec_id, " + ", ".join(f"abs(embedding[{i + 1}]::DOUBLE) + 0.05 AS {n}" for i, n in enumerate(("blue", "green", "red", "redEdge1", "redEdge2", "redEdge3", "nir", "swir1", "swir2", "swir3"))) + " FROM embeddings)"


def rounded(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """Doubles rounded (half to even), and no negative zero, so that engines can be
    compared. Unlike round(), this stays in doubles."""
    k = 10.0**digits
    return df.withColumns({c: F.rint(F.col(c).cast("double") * k) / F.lit(k) + F.lit(0.0) for c in cols})


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round_even(({expr})::DOUBLE * {10.0**digits}, 0) / {10.0**digits} + 0.0 AS {name}"
