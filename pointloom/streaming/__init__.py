"""Clouds that arrive as streams: row-wise maps work on them as they are; voxel means are kept as sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.vec import XYZ
from pointloom.operators.voxels import VOXEL, cell_index


def voxel_means(stream: DataFrame, size: float, origin: Sequence[float]) -> DataFrame:
    """(vx, vy, vz, n, x, y, z): running means of a stream's points; the grid's origin must be given.

    State is one row an occupied voxel, so it is bounded by the space seen, not by the points.
    """
    if not size > 0:
        raise ValueError("voxel_size <= 0.")
    cells = [cell_index(c, o, size).alias(v) for c, o, v in zip(XYZ, origin, VOXEL, strict=True)]
    n = F.count(F.lit(1))
    return stream.groupBy(*cells).agg(n.alias("n"), *[(F.sum(c) / n).alias(c) for c in XYZ])
