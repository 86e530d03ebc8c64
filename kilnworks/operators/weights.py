"""Risk weights in basis points, one row per (tenant, signal).

Every tenant has the same few signals, so the per-tenant windows are bounded by
the number of signals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOTAL = 10_000
# Signals in canonical order with their prior weight and bounds.
SIGNALS = [("time_overrun", 4000, 3000, 5000), ("operator_skill", 3500, 2000, 4500), ("seasonality", 1000, 500, 2000),
           ("material_availability", 1000, 500, 2500), ("supplier_reliability", 500, 300, 1500)]
SHRINKAGE_K = 40
EVENTS_PER_PARAMETER = 10
MIN_SPAN, PREFERRED_SPAN, MIN_COMPLETED, MIN_DELAYED, MIN_COVERAGE = 180, 365, 500, 50, 0.80


def _div(a: Column, b: Column) -> Column:
    return F.floor(a / b)


def _over(by: str = "tenant") -> Window:
    return Window.partitionBy(by)


def _spread(floors: Column, eligible: Column) -> Column:
    """Add the units lost to flooring, one each in canonical order over the eligible rows."""
    per, ordered = _over(), Window.partitionBy("tenant").orderBy("ord")
    left = F.lit(TOTAL) - F.sum(F.when(eligible, floors)).over(per)
    n = F.count_if(eligible).over(per)
    rank = F.count_if(eligible).over(ordered)
    return floors + F.when(eligible, F.floor(left / n) + F.when(rank <= left % n, 1).otherwise(0)).otherwise(0)


def redistribute(df: DataFrame) -> DataFrame:
    """Move the weight of unavailable signals to the others; scale their bounds, widen if infeasible."""
    on, per = F.col("available"), _over()
    total = F.coalesce(F.sum(F.when(on, F.col("prior_bp"))).over(per), F.lit(0))
    n = F.count_if(on).over(per)
    df = df.withColumns({"__t": total, "__n": n})
    floors = F.when(on, F.when(F.col("__t") > 0, _div(F.col("prior_bp") * TOTAL, F.nullif(F.col("__t"), F.lit(0))))
                    .otherwise(_div(F.lit(TOTAL), F.nullif(F.col("__n"), F.lit(0))))).otherwise(F.lit(0))
    df = df.withColumn("__f", floors.cast("bigint"))
    df = df.withColumn("new_prior_bp", F.coalesce(_spread(F.col("__f"), on), F.lit(0)).cast("bigint"))
    scale = F.when(F.col("__t") > 0, F.col("__t")).otherwise(TOTAL)
    for side in ("min_bp", "max_bp"):
        scaled = F.least(_div(F.col(side) * TOTAL, scale), F.lit(TOTAL))
        df = df.withColumn(f"__{side}", F.when(on, scaled).otherwise(0).cast("bigint"))
    fits = (F.sum("__min_bp").over(per) <= TOTAL) & (F.sum("__max_bp").over(per) >= TOTAL)
    df = df.withColumn("widened", ~fits & (F.col("__n") > 0))
    return df.withColumns({
        "new_min_bp": F.when(on & F.col("widened"), 0).otherwise(F.col("__min_bp")).cast("bigint"),
        "new_max_bp": F.when(on & F.col("widened"), TOTAL).otherwise(F.col("__max_bp")).cast("bigint"),
    }).drop("__t", "__n", "__f", "__min_bp", "__max_bp")


def usable_floor(available_signals: Column) -> Column:
    return F.lit(EVENTS_PER_PARAMETER) * F.greatest(available_signals - 1, F.lit(0))


def trust_bp(n: Column, floor: Column, k: int = SHRINKAGE_K) -> Column:
    """Share of the fitted weights, growing with events beyond the floor; rounded to whole bp."""
    e = F.greatest(n - floor, F.lit(0)).cast("bigint")
    return F.when(e == 0, F.lit(0)).otherwise(_div(TOTAL * e + _div(e + k, F.lit(2)), e + k)).cast("bigint")


def blend(df: DataFrame) -> DataFrame:
    """Prior and fitted weights mixed by ``lambda_bp``, adding up to 10,000 exactly."""
    lam = F.col("lambda_bp")
    floors = _div(lam * F.col("fitted_bp") + (TOTAL - lam) * F.col("prior_bp"), F.lit(TOTAL)).cast("bigint")
    mixed = _spread(floors, F.lit(True))
    return df.withColumn("final_bp", F.when(lam <= 0, F.col("prior_bp")).when(lam >= TOTAL, F.col("fitted_bp"))
                         .otherwise(mixed).cast("bigint"))


def project(df: DataFrame) -> DataFrame:
    """Adjusted weights clipped to their bounds, the rest spread by headroom.

    One pass is enough: what flooring leaves over is less than the number of
    signals that still have room. Fails when the room is less than the rest.
    """
    per = _over()
    c = F.least(F.greatest(F.col("prior_bp") + F.col("adjust_bp"), F.col("min_bp")), F.col("max_bp"))
    df = df.withColumn("__c", c.cast("bigint"))
    df = df.withColumn("__r", F.lit(TOTAL) - F.sum("__c").over(per))
    room = F.when(F.col("__r") > 0, F.col("max_bp") - F.col("__c")).otherwise(F.col("__c") - F.col("min_bp"))
    df = df.withColumn("__room", room).withColumn("__all", F.sum("__room").over(per))
    amount = F.least(F.abs("__r"), F.col("__all"))
    share = F.when(F.col("__all") > 0, _div(amount * F.col("__room"), F.nullif(F.col("__all"), F.lit(0)))).otherwise(0)
    df = df.withColumn("__s", share.cast("bigint"))
    left = F.least(F.abs("__r"), F.col("__all")) - F.sum("__s").over(per)
    can = F.col("__room") - F.col("__s") > 0
    rank = F.count_if(can).over(Window.partitionBy("tenant").orderBy("ord"))
    bump = F.when(can & (rank <= left), 1).otherwise(0)
    ok = F.col("__all") >= F.abs("__r")
    return df.withColumns({"success": ok, "projected_bp": F.when(
        ok, F.col("__c") + F.signum("__r").cast("bigint") * (F.col("__s") + bump)).cast("bigint")}).drop(
            "__c", "__r", "__room", "__all", "__s")


def history_tier(df: DataFrame) -> DataFrame:
    """Admissibility of a tenant's history with the reasons that hold it back."""
    low = F.col("delayed") <= F.col("usable_floor")
    reasons = [F.when(low, "delayed_work_orders_at_or_below_usable_floor"),
               F.when(F.col("span_days") < MIN_SPAN, "history_span_below_minimum"),
               F.when(F.col("completed") < MIN_COMPLETED, "completed_work_orders_below_minimum"),
               F.when(F.col("delayed") < MIN_DELAYED, "delayed_work_orders_below_minimum"),
               F.when(F.col("min_coverage") < MIN_COVERAGE, "signal_coverage_below_minimum")]
    df = df.withColumn("reasons", F.array_compact(F.array(*reasons)))
    tier = (F.when(low, "inadmissible").when(F.size("reasons") > 0, "usable_weak")
            .when(F.col("span_days") >= PREFERRED_SPAN, "preferred").otherwise("sufficient"))
    return df.withColumn("tier", tier)
