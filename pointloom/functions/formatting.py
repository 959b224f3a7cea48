"""C-style number text."""

from __future__ import annotations

import math


def _special(v: float) -> str | None:
    if math.isnan(v):
        return "-nan" if math.copysign(1.0, v) < 0 else "nan"
    return ("-inf" if v < 0 else "inf") if math.isinf(v) else None


def fixed(v: float, digits: int = 10) -> str:
    return _special(v) or f"{v:.{digits}f}"


def general(v: float) -> str:
    return _special(v) or "%g" % v


def exponent(v: float) -> str:
    return _special(v) or "%e" % v
