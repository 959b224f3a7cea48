"""Rotation matrices, on the driver."""

from __future__ import annotations

import numpy as np


def _axis(name: str, angle: float) -> np.ndarray:
    c, s = np.cos(angle), np.sin(angle)
    return {"x": np.array([[1, 0, 0], [0, c, -s], [0, s, c]]), "y": np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]), "z": np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])}[name]


def _euler(order: str):
    def rotation(rotation: np.ndarray) -> np.ndarray:
        out = np.eye(3)
        for name, angle in zip(order, np.asarray(rotation, float).ravel(), strict=True):
            out = out @ _axis(name, angle)
        return out

    rotation.__name__ = f"get_rotation_matrix_from_{order}"
    rotation.__doc__ = f"Product of the axis rotations in the order {order}; the angles are given in that order."
    return rotation


get_rotation_matrix_from_xyz = _euler("xyz")
get_rotation_matrix_from_yzx = _euler("yzx")
get_rotation_matrix_from_zxy = _euler("zxy")
get_rotation_matrix_from_xzy = _euler("xzy")
get_rotation_matrix_from_zyx = _euler("zyx")
get_rotation_matrix_from_yxz = _euler("yxz")


def get_rotation_matrix_from_axis_angle(rotation) -> np.ndarray:
    """The angle is the vector's length; up to 1e-12 it is the identity."""
    v = np.asarray(rotation, float).ravel()
    angle = np.linalg.norm(v)
    if not angle > 1e-12:
        return np.eye(3)
    x, y, z = v / angle
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * (k @ k)


def get_rotation_matrix_from_quaternion(rotation) -> np.ndarray:
    """(w, x, y, z), normalised first; a zero or non-finite quaternion is an error."""
    q = np.asarray(rotation, float).ravel()
    length = np.linalg.norm(q)
    if q.shape != (4,) or not np.isfinite(length) or length == 0:
        raise ValueError("quaternion must be finite and non-zero")
    w, v = q[0] / length, q[1:] / length
    x, y, z = v
    return (w * w - v @ v) * np.eye(3) + 2 * np.outer(v, v) + 2 * w * np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
