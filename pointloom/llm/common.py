"""Helpers shared by the training-data operators: text columns, Arrow maps, tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.plans.staging import discard, scratch_dir, tidy, written

__all__ = ["az_lower", "crc_mod", "discard", "map_arrow", "scratch_dir", "table", "tidy", "unwrapped", "words_of", "wrapped", "written"]

#: White space of the contracts, and what separates words made of letters and digits.
SPACE = r"[\x20\x09-\x0D]+"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def az_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. ASCII texts, where ``lower`` does the same, take the fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column, separator: str = SPACE) -> Column:
    """The words between runs of ``separator``; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def wrapped(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` in one struct ``d``, so that no helper column can clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))


def unwrapped(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` out of the struct ``d``."""
    return df.select(*[F.col("d").getField(c).alias(c) for c in like.columns])


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
