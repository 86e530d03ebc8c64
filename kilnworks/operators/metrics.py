"""Model metrics over scored tables. Ranks and quantiles are exact and distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnworks.functions.quote import wilson
from kilnworks.operators.scale import (
    exact_quantiles, ordered_text_levels, prefix_sums, quantiles_of_ranked, real_levels, text_levels, with_scalars)
from kilnworks.session import durable

BINS = 10
EDGES = [i * 0.1 for i in range(1, BINS)]
PSI_FLOOR = 1e-6
PSI_DRIFT = 0.2


def confusion(df: DataFrame, y: str, p: str, threshold: float = 0.5, groups: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1, base rate and lift over it."""
    hit, pos = F.col(p) >= threshold, F.col(y) == 1
    c = df.groupBy(*groups).agg(
        F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"), F.count_if(hit & pos).alias("tp"))
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    accuracy = (F.col("tp") + F.col("tn")) / n
    rate = (F.col("tp") + F.col("fn")) / n
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    base = F.greatest(rate, 1 - rate)
    return c.withColumns({
        "accuracy": accuracy, "precision": precision, "recall": recall,
        "f1": F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)),
        "positive_rate": rate, "base_rate_accuracy": base, "accuracy_over_base_rate": accuracy - base})


def _score_cells(df: DataFrame, y: str, p: str, groups: Sequence[str]) -> DataFrame:
    ok = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    return prefix_sums(ok, groups, real_levels(F.col(p)),
                       {"pos": F.col(y).cast("double"), "neg": 1.0 - F.col(y).cast("double")}, totals=True)


def _auc() -> Column:
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return F.try_divide(wins, F.sum("pos") * F.sum("neg"))


def _average_precision() -> Column:
    tp, fp = F.col("pos_total") - F.col("pos_before"), F.col("neg_total") - F.col("neg_before")
    return F.sum(F.try_divide(F.col("pos"), F.col("pos_total")) * F.try_divide(tp, tp + fp))


def rank_metrics(df: DataFrame, y: str, p: str, groups: Sequence[str] = ()) -> DataFrame:
    """``auc`` and ``pr_auc`` from one ranking of the scores."""
    return _score_cells(df, y, p, groups).groupBy(*groups).agg(_auc().alias("auc"), _average_precision().alias("pr_auc"))


def roc_auc(df: DataFrame, y: str, p: str, groups: Sequence[str] = (), out: str = "auc") -> DataFrame:
    """Probability that a positive outranks a negative, ties counted half. Null for one class."""
    return _score_cells(df, y, p, groups).groupBy(*groups).agg(_auc().alias(out))


def average_precision(df: DataFrame, y: str, p: str, groups: Sequence[str] = (), out: str = "pr_auc") -> DataFrame:
    """Step-wise area under precision and recall, one step per distinct score from the top."""
    return _score_cells(df, y, p, groups).groupBy(*groups).agg(_average_precision().alias(out))


def precision_at_positives(df: DataFrame, y: str, p: str, tie: str, out: str = "precision_at_k") -> DataFrame:
    """Precision of the k best scores, k being the number of positives; ties by md5 order of the id."""
    levels = [*real_levels(-F.col(p)), *text_levels(F.col(tie))]
    order = prefix_sums(df, [], levels, {"rows": F.lit(1), "pos": F.col(y).cast("double")})
    k = df.agg(F.sum(F.col(y).cast("bigint")).alias("__k"))
    top = with_scalars(order, k).filter(F.col("rows_before") < F.col("__k"))
    return top.agg(F.try_divide(F.sum("pos"), F.max("__k")).alias(out))


def brier(y: Column, p: Column) -> Column:
    return F.avg((p - y) * (p - y))


def pinball(y: Column, q: Column, alpha: float) -> Column:
    d = y - q
    return F.avg(F.greatest(alpha * d, (alpha - 1) * d))


def coverage(y: Column, lo: Column, hi: Column) -> Column:
    return F.avg(((y >= lo) & (y <= hi)).cast("double"))


def equal_width_bin(p: Column) -> Column:
    """0..9 for ten equal bins of [0, 1]; the last bin is closed."""
    inside = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return sum([(inside >= F.lit(e)).cast("int") for e in EDGES], F.lit(0))


def reliability_table(df: DataFrame, y: str, p: str, groups: Sequence[str] = ()) -> DataFrame:
    b = F.col("bin")
    return df.groupBy(*groups, equal_width_bin(F.col(p)).alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(p).alias("mean_probability"),
        F.avg(F.col(y).cast("double")).alias("observed_rate")).withColumns({
            "bin_lower": b * 0.1, "bin_upper": (b + 1) * 0.1})


def expected_calibration_error(df: DataFrame, y: str, p: str, groups: Sequence[str] = (), out: str = "ece") -> DataFrame:
    t = reliability_table(df, y, p, groups)
    gap = F.sum(F.col("rows") * F.abs(F.col("observed_rate") - F.col("mean_probability")))
    return t.groupBy(*groups).agg((gap / F.sum("rows")).alias(out))


def calibration_bands(df: DataFrame, y: str, p: str) -> DataFrame:
    """Quantile bins of the score with the Wilson interval of the win rate in each."""
    few = df.limit(100).count()
    bins = BINS if few >= 100 else min(BINS, max(2, few // 10))
    probs = {f"q{i}": i / bins for i in range(bins + 1)}
    edges = exact_quantiles(df, [], p, probs).select(F.array_distinct(F.array(*probs)).alias("edges"))
    tagged = with_scalars(df, edges)
    at = F.size(F.filter("edges", lambda e: e <= F.col(p))) - 1
    tagged = tagged.withColumn("band", F.least(F.greatest(at, F.lit(0)), F.greatest(F.size("edges") - 2, F.lit(0))))
    g = tagged.groupBy("band").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(y).cast("double")).alias("wins"),
                                   F.max("edges").alias("edges"))
    lo, hi = wilson(F.col("wins"), F.col("rows"))
    return g.select("band", "rows", "wins", F.element_at("edges", F.col("band") + 1).alias("lower"),
                    F.try_element_at("edges", F.col("band") + 2).alias("upper"), lo.alias("ci_low"), hi.alias("ci_high"))


# --- distributions of many features at once ---------------------------------
def long_form(df: DataFrame, features: Sequence[str], *keep: str) -> DataFrame:
    """(keep.., feature, value): one row per row and feature."""
    return df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        list(keep), list(features), "feature", "value")


def psi(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """Population stability per feature over ten reference-quantile bins.

    Values outside the reference range are not counted in any bin; features with
    fewer than two rows on a side or three edges score zero.
    """
    ref, cur = long_form(reference, features), long_form(current, features)
    both = ref.withColumn("is_ref", F.lit(1)).unionByName(cur.withColumn("is_ref", F.lit(0))).filter(
        F.col("value").isNotNull() & ~F.isnan("value"))
    # equal values are counted once, for the edges and for the bins
    cells = durable(both.groupBy("feature", "value").agg(F.sum("is_ref").alias("r"), F.sum(1 - F.col("is_ref")).alias("c")))
    probs = {f"q{i}": i / BINS for i in range(BINS + 1)}
    edges = exact_quantiles(cells, ["feature"], "value", probs, "r").select(
        "feature", F.array_distinct(F.array(*probs)).alias("edges"))
    # one row of edges per feature: bounded by the number of columns
    binned = cells.join(F.broadcast(edges), "feature")
    v, size = F.col("value"), F.size("edges")
    below = F.size(F.filter("edges", lambda e: e <= v))
    bin_no = F.when((below >= 1) & (v <= F.element_at("edges", -1)), F.least(below, size - 1))
    per = binned.groupBy("feature", bin_no.alias("bin")).agg(
        F.sum("r").alias("r"), F.sum("c").alias("c"), F.max(size).alias("size"))
    totals = per.groupBy("feature").agg(F.sum("r").alias("rn"), F.sum("c").alias("cn"), F.max("size").alias("size"))
    grid = totals.filter((F.col("size") >= 3) & (F.col("rn") >= 2) & (F.col("cn") >= 2)).withColumn(
        "bin", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    j = grid.join(per.select("feature", "bin", "r", "c"), ["feature", "bin"], "left")
    rs = F.greatest(F.coalesce("r", F.lit(0)) / F.col("rn"), F.lit(PSI_FLOOR))
    cs = F.greatest(F.coalesce("c", F.lit(0)) / F.col("cn"), F.lit(PSI_FLOOR))
    score = j.groupBy("feature").agg(F.sum((cs - rs) * F.ln(cs / rs)).alias("psi"))
    return totals.select("feature").join(score, "feature", "left").select(
        "feature", F.coalesce("psi", F.lit(0.0)).alias("psi"),
        (F.coalesce("psi", F.lit(0.0)) > PSI_DRIFT).alias("drift"))


def ks_statistic(a: DataFrame, b: DataFrame, features: Sequence[str]) -> DataFrame:
    """Largest gap between the two cumulative distributions, per feature."""
    both = long_form(a, features).withColumn("a", F.lit(1)).unionByName(long_form(b, features).withColumn("a", F.lit(0)))
    both = both.filter(F.col("value").isNotNull())
    cells = prefix_sums(both, ["feature"], real_levels(F.col("value")), {"na": F.col("a"), "nb": 1 - F.col("a")}, totals=True)
    gap = F.abs(F.try_divide(F.col("na_before") + F.col("na"), F.col("na_total"))
                - F.try_divide(F.col("nb_before") + F.col("nb"), F.col("nb_total")))
    return cells.groupBy("feature").agg(F.max(gap).alias("ks"))


def spearman_pairs(df: DataFrame, features: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """Feature pairs whose rank correlation reaches the threshold in size; a pair is ranked on its complete rows.

    How a feature ranks beside another one depends only on which rows the other one lacks. Features that lack the
    same rows share a pattern, so each feature is ranked once for each pattern, all in one table of cells, and all
    pairs are one aggregate: the number of jobs does not depend on the number of features.
    """
    names = list(features)
    values = [F.col(f).cast("double") for f in names]
    values = [F.when(~F.isnan(v), v) for v in values]
    rows = durable(df.select(*[v.alias(f"v{i}") for i, v in enumerate(values)]).withColumn("id", F.monotonically_increasing_id()))
    lacks = rows.agg(*[F.sum(F.when(F.col(f"v{i}").isNull(), F.xxhash64("id").cast("decimal(38,0)"))).alias(f"h{i}") for i in range(len(names))],
                     *[F.count_if(F.col(f"v{i}").isNull()).alias(f"n{i}") for i in range(len(names))]).first()
    signs = [(lacks[f"n{i}"], lacks[f"h{i}"]) for i in range(len(names))]
    patterns = sorted(set(signs), key=str)
    pattern = [patterns.index(s) for s in signs]
    shown = [next(i for i, p in enumerate(pattern) if p == k) for k in range(len(patterns))]  # one feature that lacks a pattern's rows
    cells = F.array(*[F.struct(F.lit(i).alias("f"), F.lit(k).alias("k"), F.when(F.col(f"v{shown[k]}").isNotNull(), F.col(f"v{i}")).alias("v"))
                      for i in range(len(names)) for k in range(len(patterns))])
    long = durable(rows.select("id", F.explode(F.filter(cells, lambda c: c["v"].isNotNull())).alias("c")).select("id", "c.f", "c.k", (F.col("c.v") + F.lit(0.0)).alias("v")))
    levels = real_levels(F.col("v"))
    ranks = prefix_sums(long, ["f", "k"], levels, {"n": F.lit(1)}).select(
        "f", "k", F.col(f"_l{len(levels) - 1}").alias("v"), (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank"))
    place = F.col("f") * len(patterns) + F.col("k")
    wide = long.join(ranks, ["f", "k", "v"]).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(place.alias("at"), "rank"))).alias("r"))  # one entry each
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    at = lambda i, j: F.col("r")[F.lit(i * len(patterns) + pattern[j])]
    found = wide.agg(F.array(*[F.struct(F.lit(names[i]).alias("feature_left"), F.lit(names[j]).alias("feature_right"), F.corr(at(i, j), at(j, i)).alias("spearman"))
                               for i, j in pairs]).alias("p")) if pairs else None
    if found is None:
        return df.sparkSession.createDataFrame([], "feature_left string, feature_right string, spearman double, absolute_spearman double")
    each = found.select(F.explode("p").alias("p")).select("p.*").withColumn("absolute_spearman", F.abs("spearman"))
    return each.where(F.col("spearman").isNotNull() & ~F.isnan("spearman") & (F.col("absolute_spearman") >= threshold))


def single_feature_auc(df: DataFrame, y: str, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Direction-free AUC of every feature alone; categories are ordered by name."""
    long = long_form(df, numeric, y)
    for c in categorical:
        s = F.coalesce(F.col(c).cast("string"), F.lit(""))
        names = df.select(s.alias("__c")).distinct()
        levels = ordered_text_levels(names, F.col("__c"))
        order = prefix_sums(names, [], levels, {"n": F.lit(1)})
        coded = df.select(y, s.alias("__c")).join(order.select(F.col(f"_l{len(levels) - 1}").alias("__c"), "n_before"), "__c")
        long = long.unionByName(coded.select(y, F.lit(c).alias("feature"), F.col("n_before").cast("double").alias("value")))
    auc = roc_auc(long, y, "value", ["feature"])
    return auc.select("feature", F.greatest("auc", 1 - F.col("auc")).alias("auc"))


AUDIT_FLAGS = ["near_zero_variance", "low_observed_support", "synthetic_only_variation", "synthetic_dominates_nonzero",
               "extreme_test_ood", "train_test_mismatch"]
# Audit limits.
NEAR_ZERO_STD, MIN_SUPPORT, EXTREME_Z, MAX_SHIFT, MAX_KS = 0.005, 0.01, 20.0, 2.0, 0.5


def audit_features(train: DataFrame, test: DataFrame, features: Sequence[str], synthetic: str) -> DataFrame:
    """Support of every numeric feature in training and its drift on the untouched test rows.

    Both tables are laid out by feature once and counted in cells of equal values: real and synthetic training rows and
    test rows. All statistics follow from the cells, and quartiles and KS from one ranking of them.
    """
    made = F.coalesce(F.col(synthetic), F.lit(False)).cast("int")
    both = long_form(train.withColumn("__k", made), features, "__k").unionByName(long_form(test.withColumn("__k", F.lit(2)), features, "__k"))
    each = [F.count_if(F.col("__k") == k).alias(n) for k, n in enumerate(("r", "s", "t"))]
    cells = durable(both.groupBy("feature", F.when(F.col("value") == 0, F.lit(0.0)).otherwise(F.col("value")).alias("v")).agg(*each))
    v, r, s, t = (F.col(c) for c in ("v", "r", "s", "t"))
    levels = real_levels(v)
    ranked = durable(prefix_sums(cells.filter(v.isNotNull()), ["feature"], levels, {"n": r + s, "t": t, "numbers": F.when(F.isnan(v), 0).otherwise(r + s)}, totals=True).withColumnRenamed(f"_l{len(levels) - 1}", "__v"))
    quart = quantiles_of_ranked(ranked.filter(~F.isnan("__v")).withColumn("n_total", F.col("numbers_total")), ["feature"], {"q1": 0.25, "train_median": 0.5, "q3": 0.75})
    ends = ranked.groupBy("feature").agg(F.sum("n").alias("tn"), F.sum("t").alias("tt"))
    gap = F.abs(F.try_divide(F.col("n_before") + F.col("n"), F.col("tn")) - F.try_divide(F.col("t_before") + F.col("t"), F.col("tt")))
    ks = ranked.join(F.broadcast(ends), "feature").groupBy("feature").agg(F.max(gap).alias("ks_statistic"))
    # everything joined below holds one row per feature
    known = durable(cells.select("feature").distinct().join(F.broadcast(quart), "feature", "left"))
    med, n = F.coalesce("train_median", F.lit(0.0)), r + s
    filled = F.coalesce(v, med)
    has = cells.join(F.broadcast(known), "feature")
    over = lambda w, x: F.try_divide(F.sum(F.when(w > 0, x * w)), F.sum(F.when(x.isNotNull(), w)))
    kinds = {"real": r, "synthetic": s}
    one = has.groupBy("feature").agg(
        F.min(F.when(n > 0, v)).alias("train_min"), F.max(F.when(n > 0, v)).alias("train_max"), F.max(med).alias("train_median"),
        over(n, v).alias("train_mean"), F.max(F.col("q3") - F.col("q1")).alias("train_iqr"),
        F.try_divide(F.sum(F.when(v == 0, n).otherwise(0)), F.sum(n)).alias("__zero"), F.try_divide(F.sum(F.when(v.isNull(), n).otherwise(0)), F.sum(n)).alias("__none"),
        over(n, filled).alias("imputed_train_mean"), F.sum(n).alias("__rows"),
        *[c for k, w in kinds.items() for c in (
            F.sum(F.when(v.isNotNull(), w).otherwise(0)).alias(f"{k}_rows"), F.sum(F.when(v != 0, w).otherwise(0)).alias(f"{k}_nonzero_rows"),
            over(w, v).alias(f"{k}_mean"), F.min(F.when(w > 0, v)).alias(f"{k}_min"), F.max(F.when(w > 0, v)).alias(f"{k}_max"))],
        F.sum(t).alias("__tests"), F.min(F.when(t > 0, v)).alias("test_min"), F.max(F.when(t > 0, v)).alias("test_max"), over(t, filled).alias("__mean"),
        F.min(F.when(t > 0, filled)).alias("__lo"), F.max(F.when(t > 0, filled)).alias("__hi"))
    one = durable(one.filter("__rows > 0 AND __tests > 0"))
    spread = lambda w, x, m: F.sqrt(F.try_divide(F.sum(F.when(w > 0, w * (x - F.col(m)) * (x - F.col(m)))), F.sum(F.when(x.isNotNull(), w))))
    two = cells.join(F.broadcast(one), "feature").groupBy("feature").agg(
        spread(n, v, "train_mean").alias("train_std"), spread(n, filled, "imputed_train_mean").alias("imputed_train_std"),
        spread(r, v, "real_mean").alias("real_std"), spread(s, v, "synthetic_mean").alias("synthetic_std"))
    a = one.join(F.broadcast(two), "feature").withColumns({"train_pct_zero": F.col("__zero") * 100, "train_pct_missing": F.col("__none") * 100})
    m, s = F.col("imputed_train_mean"), F.col("imputed_train_std")
    inf = F.lit(float("inf"))
    far = F.greatest(F.abs(F.col("__hi") - m), F.abs(F.col("__lo") - m))
    z = F.when(s > 0, far / s).otherwise(F.when(far > 0, inf).otherwise(0.0))
    shift = F.when(s > 0, F.abs(F.col("__mean") - m) / s).otherwise(z)
    nonzero = F.col("real_nonzero_rows") + F.col("synthetic_nonzero_rows")
    share = F.coalesce(F.try_divide(F.col("synthetic_nonzero_rows"), nonzero), F.lit(0.0))
    out = a.join(F.broadcast(ks), "feature", "left").withColumns(
        {"max_abs_test_z": z, "standardized_mean_shift": shift, "synthetic_share_nonzero": share})
    return out.drop("__mean", "__lo", "__hi", "__zero", "__none", "__rows", "__tests").withColumns({
        "near_zero_variance": s < NEAR_ZERO_STD,
        "low_observed_support": 1 - F.col("train_pct_missing") / 100 < MIN_SUPPORT,
        "synthetic_only_variation": (F.col("real_nonzero_rows") == 0) & (F.col("synthetic_nonzero_rows") > 0),
        "synthetic_dominates_nonzero": share > 0.5,
        "extreme_test_ood": F.col("max_abs_test_z") > EXTREME_Z,
        "train_test_mismatch": (F.col("standardized_mean_shift") > MAX_SHIFT)
        | F.coalesce(F.col("ks_statistic") > MAX_KS, F.lit(False))})


def serving_ood(df: DataFrame, audit: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature: serving rows beyond the training z limit or seen only in synthetic rows."""
    cols = audit.select("feature", "imputed_train_mean", "imputed_train_std", "train_median", "synthetic_only_variation")
    j = long_form(df, features).join(F.broadcast(cols), "feature")
    x, m, s = F.coalesce("value", "train_median"), F.col("imputed_train_mean"), F.col("imputed_train_std")
    z = F.abs(F.when(s <= 1e-12, F.when(x == m, 0.0).otherwise(float("inf"))).otherwise((x - m) / s))
    far = z > EXTREME_Z
    odd = F.col("synthetic_only_variation") & (F.coalesce("value", F.lit(0.0)) != 0)
    j = j.withColumns({"z": z, "far": far, "odd": odd})
    hit = F.col("far") | F.col("odd")
    return j.filter(hit).groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"), F.max("z").alias("max_abs_z"), F.min("value").alias("min_value"),
        F.max("value").alias("max_value"), F.count_if("far").alias("extreme_z_rows"), F.count_if("odd").alias("synthetic_only_support_rows"))


def safeguard_messages(audit: DataFrame) -> DataFrame:
    """Features listed under every flag that fired for at least one of them."""
    flags = {"zero_variance": F.col("imputed_train_std") <= 1e-12} | {f: F.col(f) for f in AUDIT_FLAGS if f != "synthetic_dominates_nonzero"}
    fired = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()])))
    return audit.select("feature", fired.alias("flag")).groupBy("flag").agg(
        F.concat_ws(",", F.array_sort(F.collect_list("feature"))).alias("features"))
