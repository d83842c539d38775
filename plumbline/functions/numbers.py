"""Rounding of collected figures."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal


def half_up(x: float, digits: int) -> float:
    """Rounding as Spark's ``round`` does it: half up on the decimal form of the number."""
    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))
