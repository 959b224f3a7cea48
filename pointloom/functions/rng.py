"""The shared random engine: mt19937 and bounded integers by multiply-shift with rejection."""

from __future__ import annotations

import numpy as np

_engine: np.random.RandomState | None = None


def seed(value: int) -> None:
    """Seeds the engine; unseeded, it starts from the system's entropy."""
    global _engine
    _engine = np.random.RandomState(np.uint32(value & 0xFFFFFFFF))


def engine() -> np.random.RandomState:
    global _engine
    if _engine is None:
        _engine = np.random.RandomState()
    return _engine


def snapshot() -> tuple:
    return engine().get_state()


def restore(state: tuple) -> None:
    engine().set_state(state)


def bounded(n: int) -> int:
    """A uniform integer in [0, n)."""
    raw = engine()._bit_generator.random_raw
    product = int(raw()) * n
    if product & 0xFFFFFFFF < n:
        floor = (1 << 32) % n
        while product & 0xFFFFFFFF < floor:
            product = int(raw()) * n
    return product >> 32
