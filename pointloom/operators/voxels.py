"""Voxel operators: a cell number by ``floor``, then one hash aggregate with map-side partial sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.vec import COLOR, NORMAL, XYZ, has
from pointloom.operators.bounds import bounds_of
from pointloom.operators.transforms import normalize_normals

VOXEL, INT_MAX = ("vx", "vy", "vz"), 2**31 - 1


def cell_index(name: str, origin: float, size: float) -> Column:
    """The cell of a coordinate, saturated to 32 bits; NaN counts as cell 0."""
    cell = F.floor((F.col(name) - F.lit(float(origin))) / F.lit(float(size)))
    return F.when(F.isnan(name), 0).otherwise(F.greatest(F.lit(-INT_MAX - 1), F.least(F.lit(INT_MAX), cell))).cast("int")


def _check_size(size: float) -> None:
    if not size > 0:
        raise ValueError("voxel_size <= 0.")


def down_sample(cloud: DataFrame, size: float, origin: Sequence[float] | None = None) -> DataFrame:
    """One point for each occupied voxel: the mean of its points and colours, and the direction of its normals' sum.

    The grid starts at the cloud's minimum, unless told where. NaN normals don't add to the sum. Result columns: pid
    (the voxel's number in its grid; a hash of it where the grid's cells can't be numbered in 63 bits, or where the grid
    is told), x, y, z and what the cloud has of normals and colours.
    """
    _check_size(size)
    pid = F.xxhash64(*VOXEL)
    if origin is None:
        low, high = bounds_of(cloud)
        if np.isnan(low).any():
            return cloud
        if size * INT_MAX < float(np.max(high - low)) + 1e-9:
            raise ValueError("voxel_size is too small.")
        origin = low
        wide = [int(w // size) + 2 if np.isfinite(w) else 1 << 63 for w in high - low]
        if wide[0] * wide[1] * wide[2] < 1 << 63:
            x, y, z = (F.col(v).cast("long") for v in VOXEL)
            pid = (x * F.lit(wide[1]) + y) * F.lit(wide[2]) + z
    n = F.count(F.lit(1))
    mean = [(F.sum(c) / n).alias(c) for c in XYZ]
    bare = F.isnan("nx") | F.isnan("ny") | F.isnan("nz") if has(cloud, NORMAL) else None
    mean += [(F.coalesce(F.sum(F.when(~bare, F.col(c))), F.lit(0.0)) / n).alias(c) for c in NORMAL] if bare is not None else []
    mean += [(F.sum(c) / n).alias(c) for c in COLOR] if has(cloud, COLOR) else []
    cells = [cell_index(c, o, size).alias(v) for c, o, v in zip(XYZ, origin, VOXEL, strict=True)]
    out = cloud.groupBy(*cells).agg(*mean).withColumn("pid", pid).drop(*VOXEL)
    out = out.select("pid", *[c for c in out.columns if c != "pid"])
    return normalize_normals(out) if bare is not None else out


def occupied(cloud: DataFrame, size: float, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """The distinct voxels (vx, vy, vz) of points within low <= p < high; NaN coordinates count as within, in cell 0."""
    _check_size(size)
    low, high = np.asarray(low, float), np.asarray(high, float)
    if np.nanmax(high - low, initial=0) / size > INT_MAX:
        raise ValueError("voxel_size is too small.")
    keep = F.lit(True)
    for c, a, b in zip(XYZ, low, high, strict=True):
        keep = keep & (F.isnan(c) | ((F.col(c) >= float(a)) & (F.col(c) < float(b))))
    return cloud.where(keep).select(*[cell_index(c, o, size).alias(v) for c, o, v in zip(XYZ, low, VOXEL, strict=True)]).distinct()


def grid_of(cloud: DataFrame, size: float) -> tuple[DataFrame, np.ndarray]:
    """The occupied voxels and the origin of a grid padded by half a voxel on each side."""
    low, high = bounds_of(cloud)
    if np.isnan(low).any():
        return cloud.select(*[F.lit(0).alias(v) for v in VOXEL]).limit(0), np.zeros(3)
    _check_size(size)
    return occupied(cloud, size, low - size * 0.5, high + size * 0.5), low - size * 0.5


def grid_bounds(voxels: DataFrame, origin: Sequence[float], size: float) -> DataFrame:
    """One row, min_x .. max_z; the origin itself for no voxels."""
    ends = [("min", F.min, 0), ("max", F.max, 1)]
    return voxels.agg(*[F.coalesce(F.lit(float(o)) + (f(v) + add) * F.lit(float(size)), F.lit(float(o))).alias(f"{n}_{c}") for n, f, add in ends for c, v, o in zip(XYZ, VOXEL, origin, strict=True)])


def grid_center(voxels: DataFrame, origin: Sequence[float], size: float) -> DataFrame:
    """One row, x, y, z: the mean of the voxels' centres; zeros for no voxels."""
    n = F.count(F.lit(1))
    middle = [F.sum(F.lit(float(o)) + (F.col(v) + 0.5) * F.lit(float(size))) for v, o in zip(VOXEL, origin, strict=True)]
    return voxels.agg(*[F.coalesce(F.try_divide(m, n), F.lit(0.0)).alias(c) for m, c in zip(middle, XYZ, strict=True)])
