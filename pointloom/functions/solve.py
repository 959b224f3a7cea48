"""Small dense problems on the driver: what is left when Spark has summed the rows."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np


def inverse_or_identity(m: np.ndarray) -> np.ndarray:
    return np.linalg.inv(m) if abs(np.linalg.det(m)) > 1e-12 else np.eye(3)


def vector6_to_matrix4(x: np.ndarray) -> np.ndarray:
    """Rotation Rz * Ry * Rx of the first three numbers, translation by the last three."""
    from pointloom.functions.rotation import get_rotation_matrix_from_zyx

    out = np.eye(4)
    out[:3, :3] = get_rotation_matrix_from_zyx(x[2::-1])
    out[:3, 3] = x[3:]
    return out


def solve_psd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a x = b`` for a symmetric ``a``; singular parts get the least-squares answer."""
    if not np.isfinite(a).all() or not np.isfinite(b).all():
        return np.full(len(b), np.nan)
    return np.linalg.lstsq(a, b, rcond=1e-15)[0]


def point_to_plane(jtj: np.ndarray, jtr: np.ndarray) -> np.ndarray:
    return vector6_to_matrix4(solve_psd(jtj, -jtr))


def umeyama(cov: np.ndarray, var_source: float, mean_source: np.ndarray, mean_target: np.ndarray, with_scaling: bool) -> np.ndarray:
    """Least-squares motion out of the centred cross-covariance target x source."""
    if not np.isfinite(cov).all():
        return np.eye(4)
    u, sigma, vt = np.linalg.svd(cov)
    sign = np.array([1.0, 1.0, -1.0 if np.linalg.det(u @ vt) < 0 else 1.0])
    rotation = u * sign @ vt
    scale = float(sigma @ sign) / var_source if with_scaling and var_source > 0 else 1.0
    out = np.eye(4)
    out[:3, :3] = scale * rotation
    out[:3, 3] = mean_target - scale * rotation @ mean_source
    return out


def symmetric(values: Mapping[str, float], n: int, prefix: str) -> np.ndarray:
    """The matrix whose upper triangle is in ``values`` as prefix + i + j."""
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            out[i, j] = out[j, i] = values[f"{prefix}{i}{j}"] or 0.0
    return out
