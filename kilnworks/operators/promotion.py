"""Promotion gates over a table with one (candidate, champion) metrics row per model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnworks.operators.scale import top_per_key

# Gate limits.
ECE_MAX, ECE_MIN_ROWS = 0.05, 1200
AUC_EPS, BRIER_TOLERANCE, BRIER_EPS = 1e-9, 0.01, 1e-6


def _check(name: str, passed: Column, detail: Column, skipped: Column | None = None) -> Column:
    skipped = F.lit(False) if skipped is None else F.coalesce(skipped, F.lit(False))
    return F.struct(F.lit(name).alias("name"), (skipped | F.coalesce(passed, F.lit(False))).alias("passed"),
                    skipped.alias("skipped"), detail.alias("detail"))


def _text(fmt: str, *cols: Column) -> Column:
    return F.format_string(fmt, *cols)


def quality_floor() -> list[Column]:
    """Absolute checks: calibration, skill over the majority class, probability skill."""
    ece, n, over = F.col("ece"), F.col("n_test"), F.col("accuracy_over_base_rate")
    brier, rate = F.col("brier"), F.col("positive_rate")
    noise = ece.isNull() | n.isNull() | (n < ECE_MIN_ROWS)
    zero = rate * (1 - rate)
    return [
        _check("calibration", ece <= ECE_MAX,
               F.when(noise, "calibration: not evaluated").otherwise(_text("ECE %.4f on %d holdout rows", ece, n.cast("bigint"))), noise),
        _check("skill", over > 0, F.when(over.isNull(), "skill: not evaluated").otherwise(
            _text("accuracy over the majority class %+.4f", over)), over.isNull()),
        _check("probability_skill", (zero > 0) & (brier < zero),
               F.when(brier.isNull() | rate.isNull(), "probability_skill: not evaluated").otherwise(
                   _text("Brier %.4f against %.4f of a constant predictor", brier, zero)), brier.isNull() | rate.isNull())]


def versus_champion() -> list[Column]:
    """Ranking must not fall; Brier may rise 1 % only where ranking really improved."""
    auc, brier = F.col("auc"), F.col("brier")
    m_auc, m_brier = F.col("champion_auc"), F.col("champion_brier")
    allowance = F.when(auc - m_auc > AUC_EPS, m_brier * BRIER_TOLERANCE).otherwise(BRIER_EPS)
    none = m_auc.isNull()
    return [_check("auc", auc - m_auc >= -AUC_EPS, F.when(none, "no incumbent").otherwise(
                _text("AUC %.6f, champion %.6f", auc, m_auc)), none),
            _check("brier", brier <= m_brier + allowance, F.when(none, "no incumbent").otherwise(
                _text("Brier %.6f, champion %.6f", brier, m_brier)), none)]


def promotion_gate(metrics: DataFrame, force: Column | None = None) -> DataFrame:
    """Decision per row: checks, names of the failed ones, the first failure as blocker.

    Invalid data always blocks. ``force`` overrides failed performance checks but
    leaves them listed.
    """
    force = F.lit(False) if force is None else force
    valid = F.coalesce(F.col("data_validation_passed"), F.lit(True))
    data = F.array(_check("data_validation", F.lit(False), F.lit("data-validation failed — never promote")))
    checks = F.when(~valid, data).otherwise(F.array(*quality_floor(), *versus_champion()))
    out = metrics.withColumn("checks", checks).withColumn("__failed", F.filter("checks", lambda c: ~c["passed"]))
    clean = F.size("__failed") == 0
    return out.withColumns({
        "promote": valid & (clean | force),
        "failed": F.transform("__failed", lambda c: c["name"]),
        "blocker": F.when(~(valid & (clean | force)), F.element_at("__failed", 1)["detail"]),
        "reasons": F.concat(F.transform("__failed", lambda c: c["detail"]),
                            F.transform(F.filter("checks", lambda c: c["passed"]), lambda c: c["detail"]))}).drop("__failed")


def price_gate(metrics: DataFrame) -> DataFrame:
    """Serve the new band only if it covers no less and its pinball loss is no worse."""
    ok = (F.col("coverage") >= F.col("champion_coverage")) & (F.col("pinball") <= F.col("champion_pinball"))
    return metrics.withColumn("promote", F.col("champion_coverage").isNull() | ok)


def choose_candidate(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best row per key: floor-passing first, then mean horizon Brier, weekly ECE, weekly AUC."""
    mean = (F.col("risk_30d_brier") + F.col("risk_60d_brier")) / 2
    order = [F.desc("quality_floor_passed"), F.asc(mean), F.asc("weekly_ece"), F.desc("weekly_auc"), F.asc("algorithm")]
    return top_per_key(metrics, keys, order, 1).drop("rn")


def below_cost_dip(df: DataFrame, ratio: str, label: str, min_rows: int = 200, min_dip: float = 0.02) -> DataFrame:
    """Do loss-making lines win less often than the cheapest profitable quarter?"""
    from kilnworks.operators.scale import exact_quantiles, with_scalars
    r = F.col(ratio)
    edge = exact_quantiles(df.filter(r >= 1), [], ratio, {"near": 0.25})
    tagged = with_scalars(df, edge)
    below = r < 1
    out = tagged.agg(F.count_if(below).alias("below_rows"), F.count_if(~below).alias("above_rows"),
                     F.avg(F.when(below, F.col(label))).alias("rate_below"),
                     F.avg(F.when(~below & (r <= F.col("near")), F.col(label))).alias("rate_near"))
    enough = (F.col("below_rows") >= min_rows) & (F.col("above_rows") >= min_rows)
    dip = F.col("rate_near") - F.col("rate_below")
    return out.withColumns({"dip": dip, "helps": enough & (dip >= min_dip)})
