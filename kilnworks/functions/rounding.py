"""Rounding of doubles to decimals, half to even on the exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_round(x: Column, digits: int) -> Column:
    """Nearest value with ``digits`` decimals; only an exact binary tie goes to the even neighbour.

    Spark rounds the shortest decimal form, which turns near ties into ties. Here
    the exact error of the scaled product (a two-product) decides them.
    """
    scale = float(10 ** digits)
    size = F.abs(x)
    y = size * scale
    c = size * F.lit(134217729.0)
    hi = c - (c - size)
    err = (hi * scale - y) + (size - hi) * scale
    low = F.floor(y).cast("double")
    frac = y - low
    odd = F.floor(y) % 2 != 0
    up = (frac > 0.5) | ((frac == 0.5) & ((err > 0) | ((err == 0) & odd)))
    near = (low + F.when(up, 1.0).otherwise(0.0)) / scale
    return F.when(x < 0, -near).otherwise(near)


def fixed(x: Column, digits: int) -> Column:
    """Fixed-point text of :func:`exact_round`; the sign is kept even when it rounds to zero."""
    body = F.format_string(f"%.{digits}f", F.abs(exact_round(x, digits)))
    return F.concat(F.when(x < 0, "-").otherwise(""), body)
