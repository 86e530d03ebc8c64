"""Leakage-free history: totals over strictly earlier rows of the same key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnworks.functions.quote import smoothed_rate
from kilnworks.operators.scale import (
    id_levels, instant_levels, join_on, prefix_sums, with_scalars)


def _levels(time: Column, daily: bool) -> list[Column]:
    return [time] if daily else instant_levels(time)


def prior_history(df: DataFrame, keys: Sequence[str], time: str, measures: dict[str, Column],
                  daily: bool = True) -> DataFrame:
    """Per (key, instant): ``prior_<m>``, the sum of each measure over strictly earlier rows.

    Rows of one instant never see each other. ``daily`` is for date columns, whose
    distinct values are bounded; timestamps are cut into blocks and
    come back as ``__t`` micros.
    """
    levels = _levels(F.col(time), daily)
    done = prefix_sums(df.filter(F.col(time).isNotNull()), keys, levels, measures)
    at = time if daily else "__t"
    return done.select(*keys, F.col(f"_l{len(levels) - 1}").alias(at),
                       *[F.col(f"{m}_before").alias(f"prior_{m}") for m in measures])


def prior_totals(df: DataFrame, keys: Sequence[str], time: str, measures: dict[str, Column],
                 daily: bool = True) -> DataFrame:
    """``df`` with the history of its own rows beside each row."""
    history = prior_history(df, keys, time, measures, daily)
    if daily:
        return join_on(df, history, [*keys, time])
    return join_on(df.withColumn("__t", instant_levels(F.col(time))[-1]), history, [*keys, "__t"]).drop("__t")


def two_clock_prior(probes: DataFrame, events: DataFrame, keys: Sequence[str], probe_time: str,
                    event_time: str, measures: dict[str, Column]) -> DataFrame:
    """As-of totals where events count from their own clock (close) and probes ask at theirs.

    Probes and events are put on one time axis with probes adding nothing, so one
    prefix pass answers all probes; there is no pairing of probes with events.
    """
    zero = {m: F.lit(0.0) for m in measures}
    ev = events.filter(F.col(event_time).isNotNull()).select(
        *keys, F.col(event_time).cast("timestamp").alias("__at"),
        *[e.cast("double").alias(m) for m, e in measures.items()])
    pr = probes.select(*keys, F.col(probe_time).cast("timestamp").alias("__at"),
                       *[z.alias(m) for m, z in zero.items()])
    axis = ev.unionByName(pr)
    done = prefix_sums(axis, keys, instant_levels(F.col("__at")), {m: F.col(m) for m in measures})
    right = done.select(*keys, F.col("_l1").alias("__t"),
                        *[F.col(f"{m}_before").alias(f"prior_{m}") for m in measures])
    left = probes.withColumn("__t", F.unix_micros(F.col(probe_time).cast("timestamp")))
    return join_on(left, right, [*keys, "__t"]).drop("__t")


def prior_ratio(value: Column, prior_sum: Column, prior_n: Column) -> Column:
    """Value over its prior mean; 1.0 where there is no usable history."""
    mean = F.try_divide(prior_sum, F.when(prior_n > 0, prior_n))
    return F.coalesce(F.try_divide(value, mean), F.lit(1.0))


def value_and_count(name: str, c: Column) -> dict[str, Column]:
    """Measures for a mean that skips nulls."""
    c = c.cast("double")
    return {f"{name}_s": F.coalesce(c, F.lit(0.0)), f"{name}_n": F.when(c.isNotNull(), 1).otherwise(0)}


def win_rate_history(df: DataFrame, key: str, time: str, label: str, out: str,
                     quote: str | None = None) -> DataFrame:
    """Per (key, date): smoothed win rate over strictly earlier quotes.

    With ``quote`` given, each (key, quote) pair counts once however many lines it has.
    """
    uniq = df if quote is None else df.select(key, quote, time, label).dropDuplicates([key, quote])
    overall = uniq.agg(F.coalesce(F.avg(label), F.lit(0.5)).alias("__g"))
    done = prior_history(uniq, [key], time, value_and_count("won", F.col(label)))
    rate = smoothed_rate(F.col("prior_won_s"), F.col("prior_won_n"), F.col("__g"))
    return with_scalars(done, overall).select(key, time, rate.alias(out))


def prior_win_rate(df: DataFrame, key: str, time: str, label: str, out: str,
                   quote: str | None = None) -> DataFrame:
    """``df`` with the smoothed win rate of its key before each row."""
    return join_on(df, win_rate_history(df, key, time, label, out, quote), [key, time])


def count_and_recency_history(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Per row id: number of earlier rows of the key in (time, tie) order, days since the last.

    Days with rows form the first order level; ids break ties inside a day.
    """
    levels = [F.col(time), *id_levels(df, tie)]
    order = prefix_sums(df, [key], levels, {"rows": F.lit(1)})
    seq = order.select(key, F.col("_l0").alias(time), F.col(f"_l{len(levels) - 1}").alias(tie),
                       F.col("rows_before").alias("prior_count"))
    days = df.groupBy(key, time).agg(F.min(tie).alias("__first"))
    w = Window.partitionBy(key).orderBy(time)
    days = days.withColumn("__gap", F.datediff(F.col(time), F.lag(time).over(w)))
    gap = F.when(F.col(tie) == F.col("__first"), F.coalesce("__gap", F.lit(-1))).otherwise(0)
    return join_on(seq, days, [key, time], "inner").select(
        tie, "prior_count", gap.cast("double").alias("recency_days"))
