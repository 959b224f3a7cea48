"""Bounds, centres and axis-aligned boxes: one hash aggregate each."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.vec import XYZ


def _some(name: str) -> Column:
    return F.when(~F.isnan(name), F.col(name))


def bounds(cloud: DataFrame) -> DataFrame:
    """One row: min_x .. max_z. NaN coordinates don't count; an empty cloud has NaN bounds."""
    nan = F.lit(float("nan"))
    return cloud.agg(*[F.coalesce(f(_some(c)), nan).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in XYZ])


def center(cloud: DataFrame) -> DataFrame:
    """One row: x, y, z, the mean of the points; zeros for an empty cloud."""
    return cloud.agg(*[F.coalesce(F.try_divide(F.sum(c), F.count(F.lit(1))), F.lit(0.0)).alias(c) for c in XYZ])


def bounds_of(cloud: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    row = bounds(cloud).first()
    return np.array(row[:3], float), np.array(row[3:], float)


def center_of(cloud: DataFrame) -> np.ndarray:
    return np.array(center(cloud).first(), float)


def inside(low: Sequence[float], high: Sequence[float], eps: float = 1e-9) -> Column:
    """Within a box, both ends included; comparisons with literals reach the Parquet scan."""
    out = F.lit(True)
    for name, a, b in zip(XYZ, low, high, strict=True):
        out = out & (F.col(name) >= float(a) - eps) & (F.col(name) <= float(b) + eps)
    return out


@dataclass
class Box:
    """An axis-aligned box. Bounds given the wrong way round are swapped."""

    min_bound: np.ndarray = field(default_factory=lambda: np.zeros(3))
    max_bound: np.ndarray = field(default_factory=lambda: np.zeros(3))
    color: np.ndarray = field(default_factory=lambda: np.ones(3))

    def __post_init__(self):
        a, b = np.array(self.min_bound, float), np.array(self.max_bound, float)
        self.min_bound, self.max_bound = np.where(b < a, b, a), np.where(b < a, a, b)
        self.color = np.array(self.color, float)

    @staticmethod
    def of(cloud: DataFrame) -> Box:
        """The box of a cloud; a zero box for an empty one."""
        low, high = bounds_of(cloud)
        return Box() if np.isnan(low).any() else Box(low, high)

    @staticmethod
    def of_points(points: Iterable[Sequence[float]]) -> Box:
        p = np.array(list(points), float).reshape(-1, 3)
        return Box(np.fmin.reduce(p), np.fmax.reduce(p)) if len(p) else Box()

    def extent(self) -> np.ndarray:
        return self.max_bound - self.min_bound

    def volume(self) -> float:
        return float(np.prod(self.extent()))

    def is_empty(self) -> bool:
        return self.volume() <= 1e-12

    def center(self) -> np.ndarray:
        return np.zeros(3) if self.is_empty() else (self.min_bound + self.max_bound) * 0.5

    def corners(self) -> np.ndarray:
        """min, +x, +y, +z, +xy, +yz, +xz, max."""
        steps = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (0, 1, 1), (1, 0, 1), (1, 1, 1)]
        return np.where(np.array(steps, bool), self.max_bound, self.min_bound)

    def merged(self, other: Box) -> Box:
        if self.is_empty():
            return Box(other.min_bound, other.max_bound, other.color)
        if other.is_empty():
            return self
        return Box(np.minimum(self.min_bound, other.min_bound), np.maximum(self.max_bound, other.max_bound), self.color)

    def translated(self, t: Sequence[float], relative: bool = True) -> Box:
        shift = np.asarray(t, float) - (0 if relative else self.center())
        return Box(self.min_bound + shift, self.max_bound + shift, self.color)

    def scaled(self, factor: float, center: Sequence[float]) -> Box:
        c = np.asarray(center, float)
        return Box(c + factor * (self.min_bound - c), c + factor * (self.max_bound - c), self.color)

    def print_info(self) -> str:
        a, b = (", ".join(f"{v:.4f}" for v in x) for x in (self.min_bound, self.max_bound))
        return f"AxisAlignedBoundingBox: min: ({a}), max: ({b})"


def box_properties(cloud: DataFrame) -> DataFrame:
    """One row: extents, half extents, the largest, volume, emptiness and centre of the cloud's box."""
    b = bounds(cloud)
    extent = {c: F.col(f"max_{c}") - F.col(f"min_{c}") for c in XYZ}
    volume = extent["x"] * extent["y"] * extent["z"]
    empty = volume <= 1e-12
    return b.select(
        *[e.alias(f"extent_{c}") for c, e in extent.items()],
        *[(e * 0.5).alias(f"half_{c}") for c, e in extent.items()],
        F.greatest(*extent.values()).alias("max_extent"), volume.alias("volume"), empty.alias("is_empty"),
        *[F.when(empty, 0.0).otherwise((F.col(f"min_{c}") + F.col(f"max_{c}")) * 0.5).alias(f"center_{c}") for c in XYZ],
    )


def box_points(cloud: DataFrame) -> DataFrame:
    """The eight corners of the cloud's box, numbered as in ``Box.corners``."""
    steps = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (0, 1, 1), (1, 0, 1), (1, 1, 1)]
    corner = lambda s: [F.col(f"{'max' if k else 'min'}_{c}").alias(c) for k, c in zip(s, XYZ, strict=True)]
    rows = F.array(*[F.struct(F.lit(i).alias("corner"), *corner(s)) for i, s in enumerate(steps)])
    return bounds(cloud).select(F.explode(rows).alias("b")).select("b.*")
