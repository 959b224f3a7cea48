"""Row-wise maps of clouds: each is one projection, fused by Catalyst with what stands around it.

A cloud has normals if it has the columns nx, ny, nz, and colours if it has r, g, b. Other columns come through.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.solve import inverse_or_identity
from pointloom.functions.vec import COLOR, NAN, NORMAL, XYZ, Vec, add, cross, dot, has, lits, mat_vec, norm, over, select_when, stable_normalized, sub, times, vec, with_vec
from pointloom.operators.bounds import center_of

__all__ = ["transform", "transform_points", "transform_normals", "translate", "scale", "rotate", "normalize_normals", "paint_uniform_color", "orient_to_direction", "orient_to_camera", "remove_non_finite", "cross"]


def _matrix4(m) -> np.ndarray:
    m = np.asarray(m, float)
    if m.shape != (4, 4):
        raise ValueError("transformation must be a 4x4 matrix")
    return m


def moved_points(m, p: Vec) -> Vec:
    """Homogeneous transform; a row whose w is within 1e-9 of zero becomes NaN."""
    m = _matrix4(m)
    x, y, z = (dot(lits(row[:3]), p) + F.lit(float(row[3])) for row in m[:3])
    if (m[3] == [0, 0, 0, 1]).all():
        return x, y, z
    w = dot(lits(m[3, :3]), p) + F.lit(float(m[3, 3]))
    return select_when((F.abs(w) > 1e-9) & ~F.isnan(w), over((x, y, z), w), lits([NAN] * 3))


def moved_normals(m, n: Vec) -> Vec:
    """Inverse transpose of the linear part, normalised; what isn't a number becomes the zero vector."""
    turned = stable_normalized(mat_vec(inverse_or_identity(_matrix4(m)[:3, :3]).T, n))
    return select_when(F.isnan(turned[0]) | F.isnan(turned[1]) | F.isnan(turned[2]), lits([0, 0, 0]), turned)


def transform_points(cloud: DataFrame, m) -> DataFrame:
    return with_vec(cloud, XYZ, moved_points(m, vec()))


def transform_normals(cloud: DataFrame, m) -> DataFrame:
    return with_vec(cloud, NORMAL, moved_normals(m, vec(NORMAL)))


def transform(cloud: DataFrame, m) -> DataFrame:
    """Points, and normals where there are some."""
    out = transform_points(cloud, m)
    return transform_normals(out, m) if has(cloud, NORMAL) else out


def translate(cloud: DataFrame, t: Sequence[float], relative: bool = True) -> DataFrame:
    """By ``t``; or, not relative, so that the centre comes to lie at ``t``."""
    shift = np.asarray(t, float) - (0 if relative else center_of(cloud))
    return with_vec(cloud, XYZ, add(vec(), lits(shift)))


def scale(cloud: DataFrame, factor: float, center: Sequence[float]) -> DataFrame:
    c = lits(center)
    return with_vec(cloud, XYZ, add(c, times(sub(vec(), c), F.lit(float(factor)))))


def rotate(cloud: DataFrame, rotation, center: Sequence[float] | None = None) -> DataFrame:
    """About ``center``, by default the cloud's own; normals turn along."""
    c = lits(center_of(cloud) if center is None else center)
    out = with_vec(cloud, XYZ, add(c, mat_vec(rotation, sub(vec(), c))))
    return with_vec(out, NORMAL, mat_vec(rotation, vec(NORMAL))) if has(cloud, NORMAL) else out


def normalize_normals(cloud: DataFrame, names: Sequence[str] = NORMAL) -> DataFrame:
    """To unit length; zero vectors stay zero, a NaN first part gives (0, 0, 1)."""
    n = stable_normalized(vec(names))
    return with_vec(cloud, names, select_when(F.isnan(n[0]), lits([0, 0, 1]), n))


def paint_uniform_color(cloud: DataFrame, color: Sequence[float], clamp: bool = True) -> DataFrame:
    """One colour for all; clamped to [0, 1], NaN to 0, unless told otherwise."""
    c = np.asarray(color, float)
    return with_vec(cloud, COLOR, lits(np.clip(np.nan_to_num(c, nan=0.0), 0, 1) if clamp else c))


def _need_normals(cloud: DataFrame) -> None:
    if not has(cloud, NORMAL):
        raise RuntimeError("No normals in the PointCloud. Call estimate_normals() first.")


def _zero(n: Vec) -> Column:
    return (n[0] == 0) & (n[1] == 0) & (n[2] == 0)


def orient_to_direction(cloud: DataFrame, reference: Sequence[float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """Flips normals that point against ``reference``; zero normals become the reference itself."""
    _need_normals(cloud)
    n, ref = vec(NORMAL), lits(reference)
    along = dot(n, ref)
    flipped = select_when((along < 0) & ~F.isnan(along), times(n, F.lit(-1.0)), n)
    return with_vec(cloud, NORMAL, select_when(_zero(n), ref, flipped))


def orient_to_camera(cloud: DataFrame, camera: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Flips normals that point away from ``camera``; zero normals point to it, or up where the point is the camera."""
    _need_normals(cloud)
    n, ref = vec(NORMAL), sub(lits(camera), vec())
    along, length = dot(n, ref), norm(ref)
    toward = select_when(length == 0, lits([0, 0, 1]), over(ref, length))
    flipped = select_when((along < 0) & ~F.isnan(along), times(n, F.lit(-1.0)), n)
    return with_vec(cloud, NORMAL, select_when(_zero(n), toward, flipped))


def remove_non_finite(cloud: DataFrame, remove_nan: bool = True, remove_infinite: bool = True) -> DataFrame:
    """Drops rows with a NaN coordinate, with an infinite one, or both."""
    inf = float("inf")
    if remove_nan:
        cloud = cloud.where(~(F.isnan("x") | F.isnan("y") | F.isnan("z")))
    if remove_infinite:
        cloud = cloud.where(~(F.abs("x").eqNullSafe(inf) | F.abs("y").eqNullSafe(inf) | F.abs("z").eqNullSafe(inf)))
    return cloud
