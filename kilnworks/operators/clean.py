"""Cleaning: drop duplicates, clip outliers, fill gaps; fitted on training rows, reused later."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.operators.metrics import long_form
from kilnworks.operators.scale import exact_quantiles

# The kept band.
LOWER_Q, UPPER_Q = 0.005, 0.995


@dataclass
class Fitted:
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    medians: dict[str, float] = field(default_factory=dict)
    fill: dict[str, str] = field(default_factory=dict)


def outlier_bounds(df: DataFrame, numeric: Sequence[str], lo: float = LOWER_Q, hi: float = UPPER_Q) -> DataFrame:
    """Quantile band per column; constant and empty columns have none."""
    q = exact_quantiles(long_form(df, numeric), ["feature"], "value", {"lo": lo, "hi": hi})
    return q.filter(F.col("hi") > F.col("lo"))


def medians(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Median per column, zero where a column is empty."""
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in numeric], "feature string")
    q = exact_quantiles(long_form(df, numeric), ["feature"], "value", {"median": 0.5})
    return names.join(q, "feature", "left").select("feature", F.coalesce("median", F.lit(0.0)).alias("median"))


def fit(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], clip: Sequence[str]) -> Fitted:
    """Fitted constants: one row per column comes to the driver, nothing else.

    Medians are taken after clipping, so an absurd value cannot drag them.
    """
    bounds = {r["feature"]: (r["lo"], r["hi"]) for r in outlier_bounds(df, clip).collect()} if clip else {}
    clipped = apply_bounds(df, bounds)
    return Fitted(bounds, {r["feature"]: r["median"] for r in medians(clipped, numeric).collect()},
                  {c: "unknown" for c in categorical})


def apply_bounds(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    clipped = {}
    for c, (lo, hi) in bounds.items():
        v = F.col(c).cast("double")
        clipped[c] = F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))
    return df.withColumns(clipped) if clipped else df


def apply_fill(df: DataFrame, fitted: Fitted) -> DataFrame:
    fills = {c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in fitted.medians.items()}
    fills |= {c: F.coalesce(F.col(c).cast("string"), F.lit(w)) for c, w in fitted.fill.items()}
    return df.withColumns(fills)


def dedupe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per distinct key; rows that differ only in the label are kept when it is in the key."""
    return df.dropDuplicates(list(cols))


def clean(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], dedupe_on: Sequence[str],
          clip: Sequence[str], fitted: Fitted | None = None) -> tuple[DataFrame, Fitted]:
    """Dedupe, then clip, then fill. Pass ``fitted`` to treat holdout or serving rows alike."""
    out = dedupe(df, dedupe_on)
    fitted = fitted or fit(out, numeric, categorical, clip)
    return apply_fill(apply_bounds(out, fitted.bounds), fitted), fitted


def report(df: DataFrame, dedupe_on: Sequence[str], fitted: Fitted) -> DataFrame:
    """Rows in and out, duplicates, values clipped, values filled: two aggregates."""
    kept = dedupe(df, dedupe_on)

    def outside(c, lo, hi):
        v = F.col(c).cast("double")
        return F.count_if((v < lo) | (v > hi))

    zero = F.lit(0).cast("bigint")
    clipped = sum([outside(c, *b) for c, b in fitted.bounds.items()], zero)
    filled = sum([F.count_if(F.col(c).isNull()) for c in [*fitted.medians, *fitted.fill]], zero)
    after = kept.agg(F.count(F.lit(1)).alias("rows_out"), clipped.alias("outliers_clipped"), filled.alias("missing_filled"))
    before = df.agg(F.count(F.lit(1)).alias("rows_in"))
    one = after.withColumn("rows_in", before.scalar())
    return one.withColumn("duplicates_removed", F.col("rows_in") - F.col("rows_out"))
