"""Verbosity, the random engine, and containers of numbers, vectors and matrices."""

from __future__ import annotations

import logging
from enum import IntEnum
from types import SimpleNamespace

import numpy as np

from pointloom.functions import rng

random = SimpleNamespace(seed=rng.seed)


class VerbosityLevel(IntEnum):
    Error = 0
    Warning = 1
    Info = 2
    Debug = 3


_level = VerbosityLevel.Info
_LOGGING = {VerbosityLevel.Error: logging.ERROR, VerbosityLevel.Warning: logging.WARNING, VerbosityLevel.Info: logging.INFO, VerbosityLevel.Debug: logging.DEBUG}


def set_verbosity_level(level: VerbosityLevel) -> None:
    global _level
    _level = VerbosityLevel(level)
    logging.getLogger("pointloom").setLevel(_LOGGING[_level])


def get_verbosity_level() -> VerbosityLevel:
    return _level


def reset_print_function() -> None:
    """Nothing prints but through ``logging``."""


class VerbosityContextManager:
    def __init__(self, level: VerbosityLevel):
        self.level = level

    def __enter__(self) -> VerbosityContextManager:
        self.before = get_verbosity_level()
        set_verbosity_level(self.level)
        return self

    def __exit__(self, *_) -> None:
        set_verbosity_level(self.before)


class _Container:
    """A list of numbers, of rows of numbers or of matrices, with one NumPy array behind it."""

    shape: tuple[int, ...] = ()
    kind: type = float
    text = ""

    def __init__(self, values=None):
        self._data = self._rows([] if values is None else values)

    def _rows(self, values) -> np.ndarray:
        data = np.array(values, self.kind)
        if data.shape[1:] != self.shape and data.size:
            raise TypeError(f"{type(self).__name__} needs elements of shape {self.shape}, not {data.shape[1:]}")
        return data.reshape(-1, *self.shape)

    def _row(self, value) -> np.ndarray:
        row = np.array(value, self.kind)
        if row.shape != self.shape:
            raise TypeError("invalid element size")
        return row

    def _at(self, index: int, message: str) -> int:
        at = index + len(self) if index < 0 else index
        if not 0 <= at < len(self):
            raise IndexError(message)
        return at

    def _places(self, value) -> np.ndarray:
        row = np.asarray(value, self.kind)
        if row.shape != self.shape:
            return np.zeros(0, int)
        return np.flatnonzero((self._data == row).reshape(len(self), -1).all(1))

    def __len__(self) -> int:
        return len(self._data)

    def __iter__(self):
        return iter(self._data.copy())

    def __getitem__(self, index: int):
        return self._data[self._at(index, "list index out of range")].copy()[()]

    def __setitem__(self, index: int, value) -> None:
        row = self._row(value)
        self._data[self._at(index, "list assignment index out of range")] = row

    def append(self, value) -> None:
        self._data = np.concatenate([self._data, self._row(value)[None]])

    def extend(self, values) -> None:
        self._data = np.concatenate([self._data, self._rows(np.asarray(values))])

    def insert(self, index: int, value) -> None:
        """Beyond either end, at that end."""
        at = max(0, index + len(self)) if index < 0 else min(index, len(self))
        self._data = np.insert(self._data, at, self._row(value), axis=0)

    def pop(self, index: int = -1):
        at = self._at(index, "pop index out of range")
        row = self._data[at].copy()[()]
        self._data = np.delete(self._data, at, axis=0)
        return row

    def remove(self, value) -> None:
        """The first of equal elements."""
        places = self._places(value)
        if not len(places):
            raise TypeError("value not found")
        self._data = np.delete(self._data, places[0], axis=0)

    def count(self, value) -> int:
        return len(self._places(value))

    def clear(self) -> None:
        self._data = self._data[:0]

    def __copy__(self):
        return type(self)(self._data)

    def __deepcopy__(self, _):
        return type(self)(self._data)

    def __eq__(self, other) -> bool:
        return type(other) is type(self) and np.array_equal(self._data, other._data)

    __hash__ = None

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        """The array itself, so that changes write through, unless another type or a copy is asked for."""
        return self._data.astype(dtype, copy=bool(copy)) if dtype is not None else self._data.copy() if copy else self._data

    def __repr__(self) -> str:
        return f"{self.text} with {len(self)} elements.\nUse numpy.asarray() to access data."


class DoubleVector(_Container):
    text = "std::vector<double>"


class IntVector(_Container):
    kind, text = np.int32, "std::vector<int>"


class Vector3dVector(_Container):
    shape, text = (3,), "std::vector<Eigen::Vector3d>"


class Vector2dVector(_Container):
    shape, text = (2,), "std::vector<Eigen::Vector2d>"


class Vector3iVector(_Container):
    shape, kind, text = (3,), np.int32, "std::vector<Eigen::Vector3i>"


class Vector2iVector(_Container):
    shape, kind, text = (2,), np.int32, "std::vector<Eigen::Vector2i>"


class Vector4iVector(_Container):
    shape, kind, text = (4,), np.int32, "std::vector<Eigen::Vector4i>"


class Matrix3dVector(_Container):
    shape, text = (3, 3), "std::vector<Eigen::Matrix3d>"


class Matrix4dVector(_Container):
    shape, text = (4, 4), "std::vector<Eigen::Matrix4d>"
