"""3-vectors as tuples of columns. Literal matrices fold into the expressions, so Catalyst keeps one projection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ, NORMAL, COLOR = ("x", "y", "z"), ("nx", "ny", "nz"), ("r", "g", "b")
Vec = tuple[Column, Column, Column]
NAN = float("nan")


def vec(names: Sequence[str] = XYZ, of: str = "") -> Vec:
    """The columns ``names`` as a vector; ``of`` is a table alias."""
    return tuple(F.col(f"{of}.{n}" if of else n) for n in names)


def lits(values: Sequence[float]) -> Vec:
    return tuple(F.lit(float(v)) for v in values)


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def times(a: Vec, s) -> Vec:
    return tuple(x * s for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm2(a: Vec) -> Column:
    return dot(a, a)


def norm(a: Vec) -> Column:
    return F.sqrt(norm2(a))


def mat_vec(m, v: Vec) -> Vec:
    """A literal 3x3 matrix times ``v``."""
    return tuple(dot(lits(row), v) for row in np.asarray(m, float)[:3, :3])


def select_when(condition: Column, yes: Vec, no: Vec) -> Vec:
    return tuple(F.when(condition, a).otherwise(b) for a, b in zip(yes, no, strict=True))


def over(a: Vec, divisor: Column) -> Vec:
    """``a / divisor``; null where the divisor is zero, since ANSI mode would raise."""
    return tuple(F.try_divide(x, divisor) for x in a)


def with_vec(df: DataFrame, names: Sequence[str], v: Vec) -> DataFrame:
    return df.withColumns(dict(zip(names, v, strict=True)))


def has(df: DataFrame, names: Sequence[str]) -> bool:
    return set(names) <= set(df.columns)


def stable_normalized(v: Vec) -> Vec:
    """``v / |v|`` scaled by its largest part first; zero and NaN vectors stay as they are."""
    top = F.greatest(*[F.abs(x) for x in v])
    scaled = over(v, top)
    length = norm(scaled)
    usable = (top > 0) & ~F.isnan(top) & (length > 0) & ~F.isnan(length)
    return select_when(usable, over(scaled, length), v)
