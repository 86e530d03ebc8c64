"""Train, calibration and test splits that keep groups and time together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnworks.operators.scale import id_levels, join_on, prefix_sums, text_levels, with_scalars
from kilnworks.session import durable

# Fold shares, fold minimum, fallback seeds.
TRAIN_SHARE, CALIBRATION_SHARE = 0.60, 0.20
MIN_FOLD_ROWS = 20
FALLBACK_SEEDS = range(7, 27)


def _walk(df: DataFrame, group: str, sizes: DataFrame, levels: list[Column], total: DataFrame) -> DataFrame:
    """Give whole groups, walked in level order, to train, calibration, holdout by rows seen before."""
    placed = prefix_sums(sizes, [], levels, {"rows": F.col("size")})
    last = f"_l{len(levels) - 1}"
    placed = with_scalars(placed, total)
    seen = F.col("rows_before")
    fold = (F.when(seen < TRAIN_SHARE * F.col("__n"), "train")
            .when(seen < (TRAIN_SHARE + CALIBRATION_SHARE) * F.col("__n"), "calibration").otherwise("holdout"))
    keyed = sizes.withColumn("__leaf", levels[-1]).select(group, "__leaf")
    folds = keyed.join(placed.select(F.col(last).alias("__leaf"), fold.alias("fold")), "__leaf").select(group, "fold")
    return df.join(folds, group)


def temporal_group_split(df: DataFrame, group: str, date: str) -> DataFrame:
    """Whole groups in order of their first date (ties by id), 60/20/20 by rows."""
    sizes = df.groupBy(group).agg(F.min(date).alias("__d"), F.count(F.lit(1)).alias("size"))
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    return _walk(df, group, sizes, [F.col("__d"), *id_levels(df, group)], total)


def hashed_group_split(df: DataFrame, group: str, seed: int) -> DataFrame:
    """Whole groups in a seeded hash order, 60/20/20 by rows."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    return _walk(df, group, sizes, text_levels(F.concat_ws("-", F.lit(seed), F.col(group))), total)


def folds_usable(df: DataFrame, label: str) -> bool:
    per = df.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("classes"))
    ok = per.filter((F.col("n") >= MIN_FOLD_ROWS) & (F.col("classes") >= 2))
    return ok.count() == 3


def three_way_split(df: DataFrame, group: str, date: str, label: str) -> tuple[DataFrame, str]:
    """Temporal groups; random groups if a fold is unusable; single rows as the last resort."""
    out = temporal_group_split(df, group, date)
    if folds_usable(out, label):
        return out, "temporal-grouped"
    for seed in FALLBACK_SEEDS:
        out = hashed_group_split(df, group, seed)
        if folds_usable(out, label):
            return out, "random-grouped"
    return stratified_rows(df, label), "stratified-rowwise"


def stratified_rows(df: DataFrame, label: str, seed: int = FALLBACK_SEEDS[0]) -> DataFrame:
    """Single rows in a seeded hash order within each label, 60/20/20 of each.

    Rows are numbered in a written table, so equal rows have places of their own.
    """
    rows = durable(df.withColumn("__row", F.monotonically_increasing_id()))
    levels = text_levels(F.concat_ws("-", F.lit(seed), F.col("__row")))
    ranked = prefix_sums(rows, [label], levels, {"rows": F.lit(1)})
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    seen = F.col("rows_before")
    fold = (F.when(seen < F.round(TRAIN_SHARE * F.col("__n")), "train")
            .when(seen < F.round((TRAIN_SHARE + CALIBRATION_SHARE) * F.col("__n")), "calibration").otherwise("holdout"))
    folds = join_on(ranked, n, [label]).select(label, F.col("_l1").alias("__leaf"), fold.alias("fold"))
    return join_on(rows.withColumn("__leaf", levels[-1]), folds, [label, "__leaf"], "inner").drop("__leaf", "__row")


def stratified_group_split(df: DataFrame, group: str, label: str, share: float = 0.8) -> DataFrame:
    """80/20 by group inside each label, in md5 order of the group id."""
    groups = df.select(group, label).dropDuplicates([group])
    levels = text_levels(F.col(group))
    ranked = prefix_sums(groups, [label], levels, {"rows": F.lit(1)})
    n = groups.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    folds = join_on(ranked, n, [label]).select(
        label, F.col("_l1").alias("__leaf"),
        F.when(F.col("rows_before") < F.floor(share * F.col("__n")), "train").otherwise("test").alias("fold"))
    keyed = groups.withColumn("__leaf", levels[-1])
    return df.join(join_on(keyed, folds, [label, "__leaf"], "inner").select(group, "fold"), group)


def chronological_split(df: DataFrame, date: str, train: float = 0.70, calibration: float = 0.15) -> DataFrame:
    """Whole dates in order, cut at int(dates x share); the date axis is bounded."""
    days = df.select(date).distinct()
    w = Window.orderBy(date)
    ranked = days.withColumn("__i", F.row_number().over(w) - 1)
    total = days.agg(F.count(F.lit(1)).alias("__n"))
    ranked = with_scalars(ranked, total)
    first = F.greatest(F.lit(1), F.floor(F.col("__n") * train))
    second = F.least(F.greatest(first + 1, F.floor(F.col("__n") * (train + calibration))), F.col("__n") - 1)
    fold = F.when(F.col("__i") < first, "train").when(F.col("__i") < second, "calibration").otherwise("test")
    return df.join(ranked.select(date, fold.alias("fold")), date)


def drop_holdout_history(df: DataFrame, keys: list[str], holdout: str, date: str) -> DataFrame:
    """Remove rows before the test window of every group that has a held-out row."""
    start = df.filter(F.col("fold") == "test").agg(F.min(date).alias("__test"))
    held = df.filter(F.col(holdout)).select(*keys).distinct()
    past = with_scalars(df.filter(F.col("fold") != "test"), start).filter(F.col(date) < F.col("__test")).drop("__test")
    return past.join(held, keys, "left_anti").unionByName(df.filter(F.col("fold") == "test"))
