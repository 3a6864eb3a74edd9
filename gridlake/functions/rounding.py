"""Rounding as SQL does it."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np


def round_half_up(v: np.ndarray, places: int = 4) -> np.ndarray:
    """v as Spark's round(v, places) + 0.0: decimal halves, in the shortest digits of a double, go away from zero.
    (m + 0.5) / ten is the double nearest to the half, whose shortest digits are the half itself up to 15 of them, so
    that a comparison decides, whatever v * ten was rounded to. Larger numbers are rare and go by their digits."""
    ten = 10.0**places
    size = np.abs(v)
    with np.errstate(over="ignore", invalid="ignore"):
        m = np.floor(size * ten)
        m += size >= (m + 0.5) / ten
        out = np.copysign(m / ten, v) + 0.0
    if (large := ~(size < 10.0 ** (14 - places))).any():
        unit = Decimal(1).scaleb(-places)
        out[large] = [float(Decimal(repr(x)).quantize(unit, ROUND_HALF_UP)) if abs(x) < 2.0**53 else x for x in v[large].tolist()]
    return out
