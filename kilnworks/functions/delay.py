"""Column expressions for work orders: progress, overrun, risk, signals, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kilnworks.functions.rounding import fixed

INF = float("inf")
# Signals in canonical order with the value above which each fires.
BASELINES = {"time_overrun_ratio": 1.0, "operator_pace_ratio": 1.2, "material_shortfall_ratio": 0.0,
             "supplier_reliability": 1.0, "critical_path_cascade_ratio": 1.2, "predecessor_time_overrun_ratio": 1.2}
SIGNALS = list(BASELINES)
DEFAULT_WEIGHTS = {"time_overrun_ratio": 0.50, "operator_pace_ratio": 0.35, "material_shortfall_ratio": 0.10,
                   "supplier_reliability": 0.05}
BP_SIGNAL = {"time_overrun_ratio": "time_overrun", "operator_pace_ratio": "operator_skill",
             "material_shortfall_ratio": "material_availability", "supplier_reliability": "supplier_reliability"}
GATE = 0.25
THRESHOLD = 1.0
CASCADE_BASELINE = 1.20
FLOAT_TOLERANCE = 1e-7


def truthy(c: Column) -> Column:
    """Null for null and for zero."""
    return F.nullif(c.cast("double"), F.lit(0.0))


def work_done(done: Column, quantity: Column) -> Column:
    return truthy(done) / truthy(quantity)


def time_overrun(actual: Column, expected: Column, done: Column, quantity: Column) -> Column:
    return truthy(actual) / (work_done(done, quantity) * truthy(expected))


def predicted_overrun_hours(actual: Column, expected: Column, done: Column, quantity: Column, pace: Column) -> Column:
    """Projected hours over plan: from progress if there is any, else from the operators' pace."""
    e = expected.cast("double")
    return (F.coalesce(truthy(actual) / work_done(done, quantity), e * pace) - e) / 60.0


def overrun_basis(actual: Column, done: Column, quantity: Column, pace: Column) -> Column:
    has = truthy(actual).isNotNull() & work_done(done, quantity).isNotNull()
    return F.when(has, "quantity").when(pace.isNotNull(), "operator_pace").otherwise("none")


def progress_parts(expected: Column, done: Column, quantity: Column) -> tuple[Column, Column]:
    """(weighted progress, planned minutes) aggregates of one job."""
    e = F.when(expected > 0, expected.cast("double"))
    share = F.when(quantity > 0, F.least(F.greatest(done / quantity, F.lit(0.0)), F.lit(1.0)))
    return F.sum(e * F.coalesce(share, F.lit(0.0))), F.sum(e)


def shortfall(required: Column, available: Column) -> Column:
    """Ratio of one short component; infinite with nothing in stock; null when not short."""
    short = available < required
    return F.when(short & (available == 0), F.lit(INF)).when(short, required / F.nullif(available, F.lit(0.0)))


def composite(values: dict[str, Column], weights: dict[str, Column | float]) -> Column:
    """Weighted mean of the signals that have a value, their weights renormalised."""
    num, den = F.lit(0.0), F.lit(0.0)
    for k, w in weights.items():
        w = w if isinstance(w, Column) else F.lit(float(w))
        have = values[k].isNotNull()
        num = num + F.when(have, w * values[k]).otherwise(0.0)
        den = den + F.when(have, w).otherwise(0.0)
    return num / F.nullif(den, F.lit(0.0))


def weights_from_bp(bp: dict[str, Column]) -> dict[str, Column]:
    """Basis points per weight signal to risk weights; signals the score lacks are dropped."""
    return {k: bp[s] / 10000.0 for k, s in BP_SIGNAL.items() if s in bp}


def overlay(base: Column, cascade: Column) -> Column:
    b = F.coalesce(base, F.lit(0.0))
    return F.when(cascade.isNull(), base).otherwise(F.greatest(cascade, b + (cascade - 1.0)))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != INF), c)


def fired(key: str, value: Column) -> Column:
    return F.coalesce(value > BASELINES[key], F.lit(False))


def json_number(c: Column) -> Column:
    """JSON text of a double: infinities as 'inf' and '-inf', NaN as null."""
    return F.when(F.isnan(c), F.lit(None)).when(c == INF, '"inf"').when(c == -INF, '"-inf"').otherwise(c.cast("string"))


def label(name: Column, center: Column, kind: Column, op_id: Column) -> Column:
    kind = F.coalesce(kind, F.lit("Operation"))
    short = F.concat(kind, F.lit(" · "), F.substring(op_id, 1, 8))
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(center, F.lit("")), F.when(op_id != "", short), kind)


def quantity_text(x: Column) -> Column:
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(fixed(x, 2))
