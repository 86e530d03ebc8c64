"""Exact decimal money. Column scales follow the operational schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clamp share and overrun threshold.
PRICE_CLAMP = "0.30"
OVERRUN = "1.10"


def dec(c: Column | str, p: int = 18, s: int = 4) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(f"decimal({p},{s})")


def line_amount(quantity: Column, price: Column) -> Column:
    """quantity x price at two places, half up."""
    return F.round(dec(quantity) * dec(price), 2).cast("decimal(18,2)")


def margin_fraction(price: Column, cost: Column) -> Column:
    p = dec(price)
    return F.when(p > 0, F.try_divide(p - dec(cost), p))


def margin_amount(price: Column, cost: Column, quantity: Column) -> Column:
    return F.round((dec(price) - dec(cost)) * dec(quantity), 2).cast("decimal(18,2)")


def price_bounds(base: Column) -> tuple[Column, Column]:
    b, share = dec(base), F.lit(PRICE_CLAMP).cast("decimal(3,2)")
    one = F.lit("1").cast("decimal(3,2)")
    return b * (one - share), b * (one + share)


def clamp_price(price: Column, base: Column) -> Column:
    lo, hi = price_bounds(base)
    return F.round(F.least(F.greatest(dec(price, 30, 12), lo), hi), 2).cast("decimal(18,2)")


def is_clamped(price: Column, base: Column) -> Column:
    lo, hi = price_bounds(base)
    return (dec(price, 30, 12) < lo) | (dec(price, 30, 12) > hi)


def ratio(actual: Column, expected: Column) -> Column:
    return F.when(dec(expected) > 0, F.try_divide(dec(actual), dec(expected)))


def is_overrun(actual: Column, expected: Column) -> Column:
    """Strictly more than 110 % of the expected amount, compared without dividing."""
    over = dec(actual) > dec(expected) * F.lit(OVERRUN).cast("decimal(3,2)")
    return F.when(dec(expected) > 0, over).otherwise(False)
