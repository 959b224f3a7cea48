"""Clouds derived from the driver's tables, and the same as SQL. Coordinates are dyadic, so sums are exact in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHIFT = (1 / 16, -1 / 32, 1 / 64)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grid(i: int) -> Column:
    return F.floor(F.col("embedding")[i].cast("double") * 4096) / F.lit(4096.0)


def embedded(spark: SparkSession, sf_dir: str, shift=(0.0, 0.0, 0.0), normals: bool = False, colors: bool = False) -> DataFrame:
    """Points from the embeddings' first numbers; raw normals and colours from the next."""
    names = ["x", "y", "z"] + (["nx", "ny", "nz"] if normals else []) + (["r", "g", "b"] if colors else [])
    at = [0, 1, 2] + ([3, 4, 5] if normals else []) + ([6, 7, 8] if colors else [])
    moved = [_grid(i) + F.lit(float(shift[i])) if i < 3 and any(shift) else _grid(i) for i in at]
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), *[c.alias(n) for c, n in zip(moved, names, strict=True)])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from lineitem: quantity, price, discount. Without ids: for aggregates."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.floor("l_extendedprice").cast("double").alias("y"), F.floor(F.col("l_discount") * 100 + 0.5).cast("double").alias("z"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("pid"), (F.floor(F.col("value") * 4) / F.lit(4.0)).alias("x"), F.col("user_id").cast("double").alias("y"), F.minute("ts").cast("double").alias("z"))


def features(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    """Half of the embeddings as 64 numbers each."""
    return read(spark, sf_dir, "embeddings").where(F.col("vec_id") % 2 == odd).select(F.col("vec_id").alias("pid"), F.col("embedding").cast("array<double>").alias("feat"))


def mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertices from the embeddings; triangles from parts' numbers modulo 500, some of them degenerate."""
    vertices = embedded(spark, sf_dir).withColumnRenamed("pid", "vid")
    k = F.col("p_partkey")
    triangles = read(spark, sf_dir, "part").select(k.alias("tid"), (k % 500).cast("int").alias("v0"), ((k * 7 + 3) % 500).cast("int").alias("v1"), ((k * 13 + 11) % 510).cast("int").alias("v2"))
    return vertices, triangles


def _sql_grid(i: int) -> str:
    return f"floor(CAST(embedding[{i + 1}] AS DOUBLE) * 4096) / 4096.0"


def sql_embedded(shift=(0.0, 0.0, 0.0)) -> str:
    """All columns that ``embedded`` can have."""
    xyz = ", ".join(f"{_sql_grid(i)} + ({float(s)!r}) AS {n}" for i, (s, n) in enumerate(zip(shift, "xyz", strict=True)))
    rest = ", ".join(f"{_sql_grid(i)} AS {n}" for i, n in enumerate(("nx", "ny", "nz", "r", "g", "b"), 3))
    return f"(SELECT vec_id AS pid, {xyz}, {rest} FROM embeddings)"


SQL_LINES = "(SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(floor(l_extendedprice) AS DOUBLE) AS y, CAST(floor(l_discount * 100 + 0.5) AS DOUBLE) AS z FROM lineitem)"
SQL_EVENTS = "(SELECT event_id AS pid, floor(value * 4) / 4.0 AS x, CAST(user_id AS DOUBLE) AS y, CAST(minute(ts) AS DOUBLE) AS z FROM events)"
SQL_TRIANGLES = "(SELECT p_partkey AS tid, CAST(p_partkey % 500 AS INT) AS v0, CAST((p_partkey * 7 + 3) % 500 AS INT) AS v1, CAST((p_partkey * 13 + 11) % 510 AS INT) AS v2 FROM part)"


def sql_features(odd: int) -> str:
    return f"(SELECT vec_id AS pid, embedding FROM embeddings WHERE vec_id % 2 = {odd})"
