"""XYZ text: a point a line, over Spark's text source. Parsing is column expressions."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.functions.formatting import fixed
from pointloom.functions.vec import XYZ

#: The longest numeric start of a token, as the C library reads it.
NUMBER = r"^([+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?))"
SPECIAL = r"^([+-]?)(?i:(nan|inf))"


def number_of(token: Column) -> Column:
    """The number a token starts with; null if it starts with none."""
    text = F.regexp_extract(token, NUMBER, 1)
    sign, word = F.regexp_extract(token, SPECIAL, 1), F.lower(F.regexp_extract(token, SPECIAL, 2))
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    special = F.when(word == "nan", nan).when((word == "inf") & (sign == "-"), -inf).when(word == "inf", inf)
    return F.when(text != "", text.try_cast("double")).otherwise(special)


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """x, y, z of each line that starts with three numbers; other lines are skipped, further tokens ignored."""
    parts = F.split(F.trim(F.regexp_replace(column, r"\s+", " ")), " ")
    got = lines.select(*[c for c in lines.columns if c != column], *[number_of(F.get(parts, i)).alias(c) for i, c in enumerate(XYZ)])
    return got.where("x is not null and y is not null and z is not null")


@F.pandas_udf(T.StringType())
def _line(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
    """C's rounding, by the exact binary value; Java's formatter rounds the shortest decimal half up instead."""
    parts = []
    for column in (x, y, z):
        values = column.to_numpy(float)
        text = np.char.mod("%.10f", values).astype(object)
        for i in np.flatnonzero(~np.isfinite(values)):
            text[i] = fixed(values[i])
        parts.append(text)
    return pd.Series(parts[0] + " " + parts[1] + " " + parts[2], dtype=object)


def formatted(cloud: DataFrame) -> DataFrame:
    """pid and the line of each point, ten digits after the point."""
    return cloud.select("pid", _line(*XYZ).alias("line"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A distributed read of XYZ text; pid is unique and grows along each file."""
    return parse(spark.read.text(path)).select(F.monotonically_increasing_id().alias("pid"), *XYZ)


def write(cloud: DataFrame, path: str) -> None:
    """A folder of part files, in the order of pid."""
    formatted(cloud).orderBy("pid").select("line").write.text(path)


def _number(token: str) -> float | None:
    if m := re.match(NUMBER, token):
        return float(m[1])
    if m := re.match(SPECIAL, token):
        return math.copysign(float(m[2].lower()), -1 if m[1] == "-" else 1)
    return None


def parse_text(text: str) -> list[tuple[float, float, float]]:
    """The same parser for a small text on the driver."""
    rows = []
    for line in text.splitlines():
        values = [_number(t) for t in line.split()[:3]]
        if len(values) == 3 and None not in values:
            rows.append(tuple(values))
    return rows
