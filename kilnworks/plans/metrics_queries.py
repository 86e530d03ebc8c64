"""Registered metric, drift, cleaning, gate and weight queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnworks.operators import checks as K
from kilnworks.operators import clean as C
from kilnworks.operators import metrics as M
from kilnworks.operators import promotion as G
from kilnworks.operators import weights as W
from kilnworks.plans.catalog import query
from kilnworks.session import durable
from kilnworks.sources import proxies as P
from kilnworks.sources.oracle_views import VIEWS

FEATURES = ["price_ratio", "quantity", "unitPrice", "discountPercent"]
NAMES = "[" + ", ".join(f"'{f}'" for f in FEATURES) + "]"
VALUES = "[" + ", ".join(FEATURES) + "]"
VIEWS["long_scored"] = f"SELECT id, quotationID, productID, y, unnest({NAMES}) AS feature, unnest({VALUES}) AS value FROM scored"
TENTHS = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"
BIN = " + ".join(f"CASE WHEN p >= {e!r}::DOUBLE THEN 1 ELSE 0 END" for e in M.EDGES)


def scored(spark, sf):
    return P.scored_lines(spark, sf)


def halves(spark, sf):
    s = scored(spark, sf)
    return s.filter(F.col("quotationID") % 2 == 0), s.filter(F.col("quotationID") % 2 == 1)


def conf_sql(by="", p="p"):
    g = f"{by}, " if by else ""
    return f"""SELECT {g}tn, fp, fn, tp, (tp + tn) / n AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
 coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1, (tp + fn) / n AS positive_rate, greatest((tp + fn) / n, 1 - (tp + fn) / n) AS base_rate_accuracy,
 (tp + tn) / n - greatest((tp + fn) / n, 1 - (tp + fn) / n) AS accuracy_over_base_rate FROM (SELECT {g}count(*) AS n, count(CASE WHEN {p} < 0.5 AND y = 0 THEN 1 END) AS tn, count(CASE WHEN {p} >= 0.5 AND y = 0 THEN 1 END) AS fp,
 count(CASE WHEN {p} < 0.5 AND y = 1 THEN 1 END) AS fn, count(CASE WHEN {p} >= 0.5 AND y = 1 THEN 1 END) AS tp FROM scored {"GROUP BY " + by if by else ""})"""


ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("accuracy", "precision", "recall", "f1", "positive_rate", "base_rate_accuracy", "accuracy_over_base_rate"))


@query("d15_confusion", f"SELECT tn, fp, fn, tp, {ROUNDED} FROM ({conf_sql()})")
def _(spark, sf):
    return M.confusion(scored(spark, sf), "y", "p")


@query("d15_confusion_by_type", f"SELECT materialSpec, tn, fp, fn, tp, {ROUNDED} FROM ({conf_sql('materialSpec')})")
def _(spark, sf):
    return M.confusion(scored(spark, sf), "y", "p", groups=["materialSpec"])


def auc_sql(by="", p="p", src="scored"):
    part = f"PARTITION BY {by}" if by else ""
    tie = f"PARTITION BY {by + ', ' if by else ''}{p}"
    return f"""SELECT {by + ',' if by else ''} (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM (
 SELECT {by + ',' if by else ''} y::DOUBLE AS y, rank() OVER ({part} ORDER BY {p}) + (count(*) OVER ({tie}) - 1) / 2 AS r FROM {src}) {'GROUP BY ' + by if by else ''}"""


@query("d16_roc_auc", f"SELECT round(auc, 6) AS auc FROM ({auc_sql()})")
def _(spark, sf):
    return M.roc_auc(scored(spark, sf), "y", "p")


@query("d16_roc_auc_by_type", f"SELECT materialSpec, round(auc, 6) AS auc FROM ({auc_sql('materialSpec')})")
def _(spark, sf):
    return M.roc_auc(scored(spark, sf), "y", "p", ["materialSpec"])


@query("d17_average_precision", """SELECT round(sum(pos / total * tp / (tp + fp)), 6) AS pr_auc FROM (SELECT pos, sum(pos) OVER () AS total, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp
 FROM (SELECT p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM scored GROUP BY p) WINDOW w AS (ORDER BY p DESC))""")
def _(spark, sf):
    return M.average_precision(scored(spark, sf), "y", "p")


@query("d18_losses", """SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(avg(abs(p - y)), 6) AS mae, round(avg(greatest(0.25 * (price_ratio - p), (0.25 - 1) * (price_ratio - p))), 6) AS pinball,
 round(avg(CASE WHEN price_ratio >= p2 AND price_ratio <= p2 + 1 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM scored""")
def _(spark, sf):
    y, p = F.col("y"), F.col("p")
    return scored(spark, sf).agg(
        M.brier(y, p).alias("brier"), F.avg(F.abs(p - y)).alias("mae"), M.pinball(F.col("price_ratio"), p, 0.25).alias("pinball"),
        M.coverage(F.col("price_ratio"), F.col("p2"), F.col("p2") + 1).alias("coverage"))


@query("d19_precision_at_k", """SELECT round(avg(y), 6) AS precision_at_k FROM (SELECT y, row_number() OVER (ORDER BY p DESC, md5(id), id) AS rn, sum(y) OVER () AS k FROM scored) WHERE rn <= k""")
def _(spark, sf):
    return M.precision_at_positives(scored(spark, sf), "y", "p", "id")


@query("d20_ece", f"SELECT round(sum(n * gap) / sum(n), 6) AS ece FROM (SELECT {BIN} AS bin, count(*) AS n, abs(avg(y) - avg(p)) AS gap FROM scored GROUP BY 1)")
def _(spark, sf):
    return M.expected_calibration_error(scored(spark, sf), "y", "p")


@query("d21_reliability_table", f"""SELECT bin, rows, round(mp, 6) AS mean_probability, round(obs, 6) AS observed_rate, round(bin * 0.1, 6) AS bin_lower, round((bin + 1) * 0.1, 6) AS bin_upper
 FROM (SELECT {BIN} AS bin, count(*) AS rows, avg(p) AS mp, avg(y) AS obs FROM scored GROUP BY 1)""")
def _(spark, sf):
    return M.reliability_table(scored(spark, sf), "y", "p")


@query("d22_calibration_bands", f"""WITH e AS (SELECT list_sort(list_distinct(quantile_cont(p, {TENTHS}))) AS edges FROM scored),
 g AS (SELECT least(greatest(len(list_filter(edges, lambda x: x <= p)) - 1, 0), len(edges) - 2) AS band, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS k, any_value(edges) AS edges FROM scored, e GROUP BY 1)
 SELECT band, n::BIGINT AS rows, k AS wins, round(edges[band + 1], 6) AS lower, round(edges[band + 2], 6) AS upper,
 round(greatest(0, (k/n + 1.6449*1.6449/(2*n)) / (1 + 1.6449*1.6449/n) - 1.6449 * sqrt(k/n*(1-k/n)/n + 1.6449*1.6449/(4*n*n)) / (1 + 1.6449*1.6449/n)), 6) AS ci_low,
 round(least(1, (k/n + 1.6449*1.6449/(2*n)) / (1 + 1.6449*1.6449/n) + 1.6449 * sqrt(k/n*(1-k/n)/n + 1.6449*1.6449/(4*n*n)) / (1 + 1.6449*1.6449/n)), 6) AS ci_high FROM g""")
def _(spark, sf):
    return M.calibration_bands(scored(spark, sf), "y", "p")


@query("d23_psi_drift", f"""WITH e AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, {TENTHS}))) AS edges FROM long_scored WHERE quotationID % 2 = 0 GROUP BY 1),
 b AS (SELECT l.feature, quotationID % 2 AS side, len(edges) AS size, CASE WHEN len(list_filter(edges, lambda x: x <= value)) >= 1 AND value <= edges[-1] THEN least(len(list_filter(edges, lambda x: x <= value)), len(edges) - 1) END AS bin
   FROM long_scored l JOIN e ON e.feature = l.feature),
 t AS (SELECT feature, any_value(size) AS size, count(CASE WHEN side = 0 THEN 1 END) AS rn, count(CASE WHEN side = 1 THEN 1 END) AS cn FROM b GROUP BY 1),
 s AS (SELECT t.feature, greatest(count(CASE WHEN side = 0 THEN 1 END) / any_value(rn), 1e-6) AS r, greatest(count(CASE WHEN side = 1 THEN 1 END) / any_value(cn), 1e-6) AS c
   FROM t JOIN (SELECT unnest(range(1, 11)) AS bin) g ON g.bin < t.size LEFT JOIN b ON b.feature = t.feature AND b.bin = g.bin GROUP BY t.feature, g.bin)
 SELECT feature, round(sum((c - r) * ln(c / r)), 6) AS psi, sum((c - r) * ln(c / r)) > 0.2 AS drift FROM s GROUP BY 1""")
def _(spark, sf):
    return M.psi(*halves(spark, sf), FEATURES)


KS = """SELECT feature, max(abs(ca / ta - cb / tb)) AS ks FROM (SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY feature) AS ta, sum(b) OVER (PARTITION BY feature) AS tb FROM (
 SELECT feature, value, count(CASE WHEN {train} THEN 1 END)::DOUBLE AS a, count(CASE WHEN NOT ({train}) THEN 1 END)::DOUBLE AS b FROM long_scored GROUP BY 1, 2) WINDOW w AS (PARTITION BY feature ORDER BY value)) GROUP BY 1"""


@query("d24_ks_two_sample", "SELECT feature, round(ks, 6) AS ks FROM (" + KS.format(train="quotationID % 2 = 0") + ")")
def _(spark, sf):
    return M.ks_statistic(*halves(spark, sf), FEATURES)


RANKED = "SELECT id, " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in ("price_ratio", "p", "p2", "quantity")) + " FROM scored"
PAIRS = [("price_ratio", "p"), ("price_ratio", "p2"), ("price_ratio", "quantity"), ("p", "p2"), ("p", "quantity"), ("p2", "quantity")]


@query("d25_spearman_pairs", f"WITH r AS ({RANKED}) SELECT feature_left, feature_right, round(s, 5) AS spearman, round(abs(s), 5) AS absolute_spearman FROM ("
       + " UNION ALL ".join(f"SELECT '{a}' AS feature_left, '{b}' AS feature_right, corr({a}, {b}) AS s FROM r" for a, b in PAIRS) + ") WHERE abs(s) >= 0.95", digits=5)
def _(spark, sf):
    return M.spearman_pairs(scored(spark, sf), ["price_ratio", "p", "p2", "quantity"])


VIEWS["audit_rows"] = "SELECT feature, CASE WHEN value = 5 AND feature = 'quantity' THEN NULL WHEN feature = 'price_ratio' AND quotationID % 5 = 4 THEN value * 40 WHEN feature = 'unitPrice' AND productID % 10 <> 0 THEN 0 ELSE value END AS value, productID % 10 = 0 AS syn, quotationID % 5 < 4 AS train FROM long_scored"
VIEWS["audit_ks"] = KS.format(train="train").replace("FROM long_scored", "FROM audit_rows WHERE value IS NOT NULL")
VIEWS["audit"] = """SELECT *, CASE WHEN imputed_train_std > 0 THEN greatest(abs(hi - imputed_train_mean), abs(lo - imputed_train_mean)) / imputed_train_std ELSE 0 END AS max_abs_test_z,
 CASE WHEN imputed_train_std > 0 THEN abs(tmean - imputed_train_mean) / imputed_train_std ELSE 0 END AS standardized_mean_shift, synthetic_nonzero_rows / nullif(real_nonzero_rows + synthetic_nonzero_rows, 0) AS synthetic_share_nonzero
 FROM (SELECT a.feature, min(value) AS train_min, max(value) AS train_max, any_value(med) AS train_median, avg(value) AS train_mean, stddev_pop(value) AS train_std, any_value(iqr) AS train_iqr,
  count(CASE WHEN value = 0 THEN 1 END) / count(*) * 100 AS train_pct_zero, count(CASE WHEN value IS NULL THEN 1 END) / count(*) * 100 AS train_pct_missing, avg(coalesce(value, med)) AS imputed_train_mean, stddev_pop(coalesce(value, med)) AS imputed_train_std,
  count(CASE WHEN NOT syn THEN value END) AS real_rows, count(CASE WHEN NOT syn AND value <> 0 THEN 1 END) AS real_nonzero_rows, avg(CASE WHEN NOT syn THEN value END) AS real_mean, stddev_pop(CASE WHEN NOT syn THEN value END) AS real_std,
  min(CASE WHEN NOT syn THEN value END) AS real_min, max(CASE WHEN NOT syn THEN value END) AS real_max, count(CASE WHEN syn THEN value END) AS synthetic_rows, count(CASE WHEN syn AND value <> 0 THEN 1 END) AS synthetic_nonzero_rows,
  avg(CASE WHEN syn THEN value END) AS synthetic_mean, stddev_pop(CASE WHEN syn THEN value END) AS synthetic_std, min(CASE WHEN syn THEN value END) AS synthetic_min, max(CASE WHEN syn THEN value END) AS synthetic_max
  FROM audit_rows a JOIN (SELECT feature, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM audit_rows WHERE train GROUP BY 1) m ON m.feature = a.feature WHERE train GROUP BY 1) x
 JOIN (SELECT t.feature, min(value) AS test_min, max(value) AS test_max, avg(coalesce(value, med2)) AS tmean, min(coalesce(value, med2)) AS lo, max(coalesce(value, med2)) AS hi FROM audit_rows t JOIN
  (SELECT feature, quantile_cont(value, 0.5) AS med2 FROM audit_rows WHERE train GROUP BY 1) m ON m.feature = t.feature WHERE NOT train GROUP BY 1) y USING (feature) JOIN (SELECT feature, ks AS ks_statistic FROM audit_ks) k USING (feature)"""
NUMBERS = ["train_min", "train_max", "train_median", "train_mean", "train_std", "train_iqr", "train_pct_zero", "train_pct_missing", "test_min", "test_max", "max_abs_test_z",
           "imputed_train_mean", "imputed_train_std", "standardized_mean_shift", "ks_statistic", "real_mean", "real_std", "real_min", "real_max",
           "synthetic_share_nonzero", "synthetic_mean", "synthetic_std", "synthetic_min", "synthetic_max"]


def audit_rows(spark, sf):
    """Lines with gaps, a drifted test side and a feature only synthetic rows carry."""
    made, test = F.col("productID") % 10 == 0, F.col("quotationID") % 5 == 4
    return scored(spark, sf).withColumns({
        "made": made, "quantity": F.when(F.col("quantity") != 5, F.col("quantity")),
        "price_ratio": F.col("price_ratio") * F.when(test, 40.0).otherwise(1.0),
        "unitPrice": F.when(made, F.col("unitPrice")).otherwise(0.0)})


def audit(spark, sf):
    s = audit_rows(spark, sf)
    return M.audit_features(s.filter(F.col("quotationID") % 5 < 4), s.filter(F.col("quotationID") % 5 == 4), FEATURES, "made")


@query("d26_feature_audit", "SELECT feature, " + ", ".join(f"round({c}, 5) AS {c}" for c in NUMBERS) + """, real_rows, real_nonzero_rows, synthetic_rows, synthetic_nonzero_rows, imputed_train_std < 0.005 AS near_zero_variance,
 1 - train_pct_missing / 100 < 0.01 AS low_observed_support, real_nonzero_rows = 0 AND synthetic_nonzero_rows > 0 AS synthetic_only_variation, synthetic_share_nonzero > 0.5 AS synthetic_dominates_nonzero,
 max_abs_test_z > 20 AS extreme_test_ood, standardized_mean_shift > 2 OR ks_statistic > 0.5 AS train_test_mismatch FROM audit""", digits=5)
def _(spark, sf):
    return audit(spark, sf)


@query("d27_serving_ood", """SELECT feature, count(*) AS rows, round(max(z), 5) AS max_abs_z, round(min(value), 5) AS min_value, round(max(value), 5) AS max_value, count(CASE WHEN z > 20 THEN 1 END) AS extreme_z_rows, count(CASE WHEN odd THEN 1 END) AS synthetic_only_support_rows FROM (
 SELECT feature, value, abs(coalesce(value, train_median) - imputed_train_mean) / imputed_train_std AS z, real_nonzero_rows = 0 AND synthetic_nonzero_rows > 0 AND coalesce(value, 0) <> 0 AS odd FROM audit_rows JOIN audit USING (feature)) WHERE z > 20 OR odd GROUP BY 1""", digits=5)
def _(spark, sf):
    return M.serving_ood(audit_rows(spark, sf), durable(audit(spark, sf)), FEATURES)


@query("d28_safeguards", """SELECT flag, string_agg(feature, ',' ORDER BY feature) AS features FROM (SELECT 'extreme_test_ood' AS flag, feature FROM audit WHERE max_abs_test_z > 20 UNION ALL
 SELECT 'near_zero_variance', feature FROM audit WHERE imputed_train_std < 0.005 UNION ALL SELECT 'zero_variance', feature FROM audit WHERE imputed_train_std <= 1e-12 UNION ALL
 SELECT 'low_observed_support', feature FROM audit WHERE 1 - train_pct_missing / 100 < 0.01 UNION ALL SELECT 'synthetic_only_variation', feature FROM audit WHERE real_nonzero_rows = 0 AND synthetic_nonzero_rows > 0 UNION ALL
 SELECT 'train_test_mismatch', feature FROM audit WHERE standardized_mean_shift > 2 OR ks_statistic > 0.5) GROUP BY 1""")
def _(spark, sf):
    return M.safeguard_messages(audit(spark, sf))


@query("d29_single_feature_leak", "SELECT feature, round(greatest(auc, 1 - auc), 6) AS auc FROM (" + auc_sql("feature", "value", "long_scored") + " UNION ALL SELECT 'materialSpec', auc FROM ("
       + auc_sql("", "materialSpec") + "))")
def _(spark, sf):
    return M.single_feature_auc(scored(spark, sf), "y", FEATURES, ["materialSpec"])


@query("d30_schema_gate", """SELECT 'null:l_tax' AS rule, count(CASE WHEN l_tax = 0 THEN 1 END) AS violations FROM lineitem UNION ALL SELECT 'non_finite:l_extendedprice', count(CASE WHEN l_linenumber = 7 THEN 1 END) FROM lineitem
 UNION ALL SELECT 'unknown_column:actual_end', 1 UNION ALL SELECT 'forbidden_column:actual_end', 1 UNION ALL SELECT 'missing_parent:l_partkey', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)""")
def _(spark, sf):
    li = P.table(spark, sf, "lineitem").withColumns({
        "l_tax": F.when(F.col("l_tax") != 0, F.col("l_tax")), "actual_end": F.col("l_shipdate"),
        "l_extendedprice": F.when(F.col("l_linenumber") == 7, float("inf")).otherwise(F.col("l_extendedprice"))})
    allowed = [c for c in li.columns if c != "actual_end"]
    return K.schema_gate(li, ["l_tax"], ["l_extendedprice"], allowed,
                         {"l_partkey": (P.table(spark, sf, "part").filter(F.col("p_size") < 40), "p_partkey")})


@query("d31_realism_gate", "SELECT round(avg(y), 6) AS positive_rate, 'flat' AS constant_features, false AS passed FROM scored")
def _(spark, sf):
    s = scored(spark, sf).withColumn("flat", F.lit(1.0))
    return K.realism_gate(s, "y", [*FEATURES, "flat"], 0.25, 0.72)


@query("d33_below_cost_dip", """WITH e AS (SELECT quantile_cont(price_ratio, 0.25) AS near FROM scored WHERE price_ratio >= 1) SELECT *, below_rows >= 200 AND above_rows >= 200 AND dip >= 0.02 AS helps FROM (SELECT count(CASE WHEN price_ratio < 1 THEN 1 END) AS below_rows,
 count(CASE WHEN price_ratio >= 1 THEN 1 END) AS above_rows, round(avg(CASE WHEN price_ratio < 1 THEN y END), 6) AS rate_below, round(avg(CASE WHEN price_ratio >= 1 AND price_ratio <= near THEN y END), 6) AS rate_near, round(any_value(near), 6) AS near,
 round(avg(CASE WHEN price_ratio >= 1 AND price_ratio <= near THEN y END) - avg(CASE WHEN price_ratio < 1 THEN y END), 6) AS dip FROM scored, e)""".replace("any_value(near), 6) AS near,", "any_value(near), 6) AS near_edge,").replace(", round(any_value(near), 6) AS near_edge", ""))
def _(spark, sf):
    return G.below_cost_dip(scored(spark, sf), "price_ratio", "y")


@query("d34_outlier_bounds", "SELECT feature, round(lo, 6) AS lo, round(hi, 6) AS hi FROM (SELECT feature, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM long_scored GROUP BY 1) WHERE hi > lo")
def _(spark, sf):
    return C.outlier_bounds(scored(spark, sf), FEATURES)


@query("d35_impute_medians", "SELECT feature, round(median, 6) AS median FROM (SELECT feature, quantile_cont(value, 0.5) AS median FROM long_scored GROUP BY 1 UNION ALL SELECT 'empty', 0.0)")
def _(spark, sf):
    return C.medians(scored(spark, sf).withColumn("empty", F.lit(None).cast("double")), [*FEATURES, "empty"])


HOLES = "SELECT productID, materialSpec, CASE WHEN quantity <> 7 THEN quantity END AS quantity, floor(price_ratio) AS pr, y FROM scored"
KEPT = f"SELECT DISTINCT * FROM ({HOLES})"


def holes(spark, sf):
    s = scored(spark, sf)
    return s.select("productID", "materialSpec", F.when(F.col("quantity") != 7, F.col("quantity")).alias("quantity"),
                    F.floor("price_ratio").cast("double").alias("pr"), "y")


@query("g01_exact_dedupe", KEPT.replace("SELECT DISTINCT *", "SELECT DISTINCT productID, materialSpec, quantity, pr, y"))
def _(spark, sf):
    return C.dedupe(holes(spark, sf), ["productID", "materialSpec", "quantity", "pr", "y"])


@query("d36_cleaning_report", f"""WITH k AS ({KEPT}), b AS (SELECT quantile_cont(quantity, 0.005) AS ql, quantile_cont(quantity, 0.995) AS qh, quantile_cont(pr, 0.005) AS pl, quantile_cont(pr, 0.995) AS ph FROM k)
 SELECT (SELECT count(*) FROM scored) AS rows_in, count(*) AS rows_out, (SELECT count(*) FROM scored) - count(*) AS duplicates_removed, count(CASE WHEN qh > ql AND (quantity < ql OR quantity > qh) THEN 1 END) + count(CASE WHEN ph > pl AND (pr < pl OR pr > ph) THEN 1 END) AS outliers_clipped,
 count(CASE WHEN quantity IS NULL THEN 1 END) AS missing_filled FROM k, b""")
def _(spark, sf):
    cols = ["productID", "materialSpec", "quantity", "pr", "y"]
    df = holes(spark, sf)
    fitted = C.fit(C.dedupe(df, cols), ["quantity", "pr"], ["materialSpec"], ["quantity", "pr"])
    return C.report(df, cols, fitted)


@query("h56_clip_and_fill", f"""WITH k AS ({KEPT}), b AS (SELECT quantile_cont(quantity, 0.005) AS ql, quantile_cont(quantity, 0.995) AS qh, quantile_cont(pr, 0.5) AS pm FROM k),
 c AS (SELECT productID, y, materialSpec, least(greatest(quantity, ql), qh) AS q, pr, pm FROM (SELECT productID, y, materialSpec, quantity, pr, ql, qh, pm FROM k, b))
 SELECT y, count(*) AS n, round(sum(coalesce(CASE WHEN q IS NULL THEN NULL ELSE q END, (SELECT quantile_cont(q2, 0.5) FROM (SELECT CASE WHEN quantity IS NOT NULL THEN least(greatest(quantity, ql), qh) END AS q2 FROM k, b)))), 4) AS quantity, round(sum(coalesce(pr, pm)), 4) AS pr FROM (
 SELECT k.productID, k.y, CASE WHEN k.quantity IS NOT NULL THEN least(greatest(k.quantity, ql), qh) END AS q, k.pr, pm FROM k, b) GROUP BY y""", digits=4)
def _(spark, sf):
    """price_ratio's tails are signal, so only quantity is clipped."""
    out, _fitted = C.clean(holes(spark, sf), ["quantity", "pr"], ["materialSpec"],
                           ["productID", "materialSpec", "quantity", "pr", "y"], ["quantity"])
    return out.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"), F.sum("pr").alias("pr"))


def model_metrics(df, p, prefix=""):
    """Gate metrics per material type for one score column."""
    c = M.confusion(df, "y", p, groups=["materialSpec"]).select(
        "materialSpec", "accuracy", "base_rate_accuracy", "accuracy_over_base_rate", "positive_rate",
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_test"))
    b = df.groupBy("materialSpec").agg(M.brier(F.col("y"), F.col(p)).alias("brier"))
    out = (c.join(b, "materialSpec").join(M.roc_auc(df, "y", p, ["materialSpec"]), "materialSpec")
           .join(M.expected_calibration_error(df, "y", p, ["materialSpec"]), "materialSpec"))
    return out.select("materialSpec", *[F.col(x).alias(prefix + x) for x in out.columns if x != "materialSpec"])


def metrics_sql(p):
    bins = BIN.replace("p >=", f"{p} >=")
    return f"""SELECT materialSpec, c.accuracy_over_base_rate, c.positive_rate, b.brier, b.n AS n_test, a.auc, e.ece FROM ({conf_sql('materialSpec', p)}) c JOIN (SELECT materialSpec, avg(({p} - y) * ({p} - y)) AS brier, count(*) AS n FROM scored GROUP BY 1) b USING (materialSpec)
 JOIN ({auc_sql('materialSpec', p)}) a USING (materialSpec) JOIN (SELECT materialSpec, sum(n * gap) / sum(n) AS ece FROM (SELECT materialSpec, {bins} AS bin, count(*) AS n, abs(avg(y) - avg({p})) AS gap FROM scored GROUP BY 1, 2) GROUP BY 1) e USING (materialSpec)"""


GATE = f"""SELECT c.*, NOT (c.ece <= 0.05 OR c.n_test < 1200) AS f1, NOT c.accuracy_over_base_rate > 0 AS f2, NOT (c.positive_rate * (1 - c.positive_rate) > 0 AND c.brier < c.positive_rate * (1 - c.positive_rate)) AS f3,
 NOT c.auc - m.auc >= -1e-9 AS f4, NOT c.brier <= m.brier + CASE WHEN c.auc - m.auc > 1e-9 THEN m.brier * 0.01 ELSE 1e-6 END AS f5 FROM ({metrics_sql('p2')}) c JOIN ({metrics_sql('p')}) m ON m.materialSpec = c.materialSpec"""


@query("h60_promotion_gate", f"""SELECT materialSpec, NOT (f1 OR f2 OR f3 OR f4 OR f5) AS promote, concat_ws(',', CASE WHEN f1 THEN 'calibration' END, CASE WHEN f2 THEN 'skill' END, CASE WHEN f3 THEN 'probability_skill' END,
 CASE WHEN f4 THEN 'auc' END, CASE WHEN f5 THEN 'brier' END) AS failed, round(auc, 6) AS auc, round(brier, 6) AS brier, round(ece, 6) AS ece FROM ({GATE})""")
def _(spark, sf):
    df = durable(scored(spark, sf).select("materialSpec", "y", "p", "p2"))
    champion = model_metrics(df, "p", "champion_").select("materialSpec", "champion_auc", "champion_brier")
    out = G.promotion_gate(model_metrics(df, "p2").join(champion, "materialSpec", "left").withColumn("data_validation_passed", F.lit(True)))
    return out.select("materialSpec", "promote", F.concat_ws(",", "failed").alias("failed"), "auc", "brier", "ece")


BAND_SQL = "SELECT productID % 50 AS model, avg(CASE WHEN price_ratio >= {lo} AND price_ratio <= {hi} THEN 1.0 ELSE 0.0 END) AS cov, avg(greatest(0.5 * (price_ratio - {q}), -0.5 * (price_ratio - {q}))) AS pin FROM scored GROUP BY 1"


@query("h61_price_gate", f"SELECT model, n.cov >= c.cov AND n.pin <= c.pin AS promote, round(n.cov, 6) AS coverage, round(n.pin, 6) AS pinball FROM ({BAND_SQL.format(lo='p', hi='p + 2', q='p')}) n JOIN ({BAND_SQL.format(lo='p2', hi='p2 + 2', q='p2')}) c USING (model)")
def _(spark, sf):
    def band(p, prefix=""):
        y = F.col("price_ratio")
        return scored(spark, sf).groupBy((F.col("productID") % 50).alias("model")).agg(
            M.coverage(y, F.col(p), F.col(p) + 2).alias(prefix + "coverage"), M.pinball(y, F.col(p), 0.5).alias(prefix + "pinball"))

    return G.price_gate(band("p").join(band("p2", "champion_"), "model")).select("model", "promote", "coverage", "pinball")


CANDIDATES = """SELECT productID AS item, materialSpec AS algorithm, avg((p - y) * (p - y)) AS b30, avg((p2 - y) * (p2 - y)) AS b60, abs(avg(p) - avg(y)) AS ece, avg(p) AS auc, count(*) > 3 AS ok FROM (
 SELECT quotationID % 500 AS productID, materialSpec, p, p2, y FROM scored) GROUP BY 1, 2"""


@query("i21_candidate_choice", f"SELECT item, algorithm, round((b30 + b60) / 2, 6) AS final_brier FROM ({CANDIDATES}) QUALIFY row_number() OVER (PARTITION BY item ORDER BY ok DESC, (b30 + b60) / 2, ece, auc DESC, algorithm) = 1")
def _(spark, sf):
    s, y = scored(spark, sf), F.col("y")
    m = s.groupBy((F.col("quotationID") % 500).alias("item"), F.col("materialSpec").alias("algorithm")).agg(
        M.brier(y, F.col("p")).alias("risk_30d_brier"), M.brier(y, F.col("p2")).alias("risk_60d_brier"),
        F.abs(F.avg("p") - F.avg("y")).alias("weekly_ece"), F.avg("p").alias("weekly_auc"), (F.count(F.lit(1)) > 3).alias("quality_floor_passed"))
    return G.choose_candidate(m, ["item"]).select("item", "algorithm", ((F.col("risk_30d_brier") + F.col("risk_60d_brier")) / 2).alias("final_brier"))


@query("h62_redistribution", """WITH a AS (SELECT *, coalesce(sum(CASE WHEN available THEN prior_bp END) OVER w, 0) AS t FROM tenant_signals WINDOW w AS (PARTITION BY tenant)),
 f AS (SELECT *, CASE WHEN available THEN prior_bp * 10000 // t ELSE 0 END AS fl, CASE WHEN available THEN least(min_bp * 10000 // t, 10000) ELSE 0 END AS lo, CASE WHEN available THEN least(max_bp * 10000 // t, 10000) ELSE 0 END AS hi FROM a),
 r AS (SELECT *, 10000 - sum(fl) OVER w AS res, count(CASE WHEN available THEN 1 END) OVER (PARTITION BY tenant ORDER BY ord) AS rk, t > 0 AND NOT (sum(lo) OVER w <= 10000 AND sum(hi) OVER w >= 10000) AS wide FROM f WINDOW w AS (PARTITION BY tenant))
 SELECT tenant, signal, CAST(fl + CASE WHEN available AND rk <= res THEN 1 ELSE 0 END AS BIGINT) AS new_prior_bp, CAST(CASE WHEN available AND wide THEN 0 ELSE lo END AS BIGINT) AS new_min_bp, CAST(CASE WHEN available AND wide THEN 10000 ELSE hi END AS BIGINT) AS new_max_bp FROM r""")
def _(spark, sf):
    return W.redistribute(P.tenant_signals(spark, sf)).select("tenant", "signal", "new_prior_bp", "new_min_bp", "new_max_bp")


LAMBDA = "SELECT o_custkey AS tenant, CASE WHEN e = 0 THEN 0 ELSE (10000 * e + (e + 40) // 2) // (e + 40) END AS lambda_bp FROM (SELECT o_custkey, greatest(count(*) * 10 - 40, 0) AS e FROM orders GROUP BY 1)"


@query("h63_shrinkage_blend", f"""WITH b AS (SELECT s.*, l.lambda_bp, (l.lambda_bp * fitted_bp + (10000 - l.lambda_bp) * prior_bp) // 10000 AS fl FROM tenant_signals s JOIN ({LAMBDA}) l USING (tenant))
 SELECT tenant, signal, CAST(lambda_bp AS BIGINT) AS lambda_bp, CAST(CASE WHEN lambda_bp <= 0 THEN prior_bp ELSE fl + CASE WHEN ord < 10000 - sum(fl) OVER (PARTITION BY tenant) THEN 1 ELSE 0 END END AS BIGINT) AS final_bp FROM b""")
def _(spark, sf):
    n = P.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("tenant")).agg((F.count(F.lit(1)) * 10).alias("n"))
    lam = n.select("tenant", W.trust_bp(F.col("n"), W.usable_floor(F.lit(5))).alias("lambda_bp"))
    return W.blend(P.tenant_signals(spark, sf).join(lam, "tenant")).select("tenant", "signal", "lambda_bp", "final_bp")


@query("h64_bounded_projection", """WITH c AS (SELECT *, least(greatest(prior_bp + adjust_bp, min_bp), max_bp) AS c FROM tenant_signals), r AS (SELECT *, 10000 - sum(c) OVER (PARTITION BY tenant) AS r FROM c),
 h AS (SELECT *, CASE WHEN r > 0 THEN max_bp - c ELSE c - min_bp END AS room FROM r), t AS (SELECT *, sum(room) OVER (PARTITION BY tenant) AS total FROM h),
 s AS (SELECT *, least(abs(r), total) * room // nullif(total, 0) AS share FROM t), k AS (SELECT *, least(abs(r), total) - sum(share) OVER (PARTITION BY tenant) AS lft, count(CASE WHEN room - share > 0 THEN 1 END) OVER (PARTITION BY tenant ORDER BY ord) AS rk FROM s)
 SELECT tenant, signal, total >= abs(r) AS success, CAST(CASE WHEN total >= abs(r) THEN c + sign(r) * (share + CASE WHEN room - share > 0 AND rk <= lft THEN 1 ELSE 0 END) END AS BIGINT) AS projected_bp FROM k""")
def _(spark, sf):
    return W.project(P.tenant_signals(spark, sf)).select("tenant", "signal", "success", "projected_bp")


@query("d49_history_tier", """SELECT tenant, CASE WHEN delayed <= 40 THEN 'inadmissible' WHEN reasons <> '' THEN 'usable_weak' WHEN span >= 365 THEN 'preferred' ELSE 'sufficient' END AS tier, reasons FROM (
 SELECT o_custkey % 20 AS tenant, count(CASE WHEN o_orderstatus = 'P' AND o_custkey % 40 < 20 THEN 1 END) AS delayed, datediff('day', min(o_orderdate), max(o_orderdate)) AS span,
 concat_ws(',', CASE WHEN count(CASE WHEN o_orderstatus = 'P' AND o_custkey % 40 < 20 THEN 1 END) <= 40 THEN 'delayed_work_orders_at_or_below_usable_floor' END, CASE WHEN datediff('day', min(o_orderdate), max(o_orderdate)) < 180 THEN 'history_span_below_minimum' END,
 CASE WHEN count(*) < 500 THEN 'completed_work_orders_below_minimum' END, CASE WHEN count(CASE WHEN o_orderstatus = 'P' AND o_custkey % 40 < 20 THEN 1 END) < 50 THEN 'delayed_work_orders_below_minimum' END,
 CASE WHEN avg(CASE WHEN o_orderpriority = '5-LOW' THEN 0.0 ELSE 1.0 END) < 0.80 THEN 'signal_coverage_below_minimum' END) AS reasons FROM orders GROUP BY 1)""")
def _(spark, sf):
    o = P.table(spark, sf, "orders")
    late = (F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 40 < 20)
    h = o.groupBy((F.col("o_custkey") % 20).alias("tenant")).agg(
        F.count_if(late).alias("delayed"), F.count(F.lit(1)).alias("completed"),
        F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("span_days"),
        F.avg((F.col("o_orderpriority") != "5-LOW").cast("double")).alias("min_coverage"))
    h = h.withColumn("usable_floor", W.usable_floor(F.lit(5)))
    return W.history_tier(h).select("tenant", "tier", F.concat_ws(",", "reasons").alias("reasons"))
