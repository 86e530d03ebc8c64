"""Registered model jobs. A fit has no SQL twin, so the rows are facts that any right fit must satisfy.

A calibrated mean equals the observed rate on the rows of the fit, a logistic fit with one indicator
per category reproduces each category's rate, orders are kept, and folds have known sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Window
from pyspark.sql import functions as F

from kilnworks.operators import metrics as M
from kilnworks.operators import models as ML
from kilnworks.operators import split as S
from kilnworks.operators import sweep as W
from kilnworks.operators.labels import decided_headers
from kilnworks.plans import frames
from kilnworks.plans import training as T
from kilnworks.plans.catalog import query
from kilnworks.plans.quotes_queries import LINE_SQL, rate_table
from kilnworks.session import durable, scratch_path
from kilnworks.sources import proxies as P

CHRONO = """t AS (SELECT * FROM targets WHERE target IS NOT NULL AND NOT stockout_flag), d AS (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT snapshot_date FROM t)),
 c AS (SELECT snapshot_date, CASE WHEN i < greatest(1, floor(n * 0.70)) THEN 'train' WHEN i < least(greatest(greatest(1, floor(n * 0.70)) + 1, floor(n * (0.70 + 0.15))), n - 1) THEN 'calibration' ELSE 'test' END AS fold FROM d)"""
PURGED = "fold = 'calibration' AND snapshot_date + 63 < (SELECT min(snapshot_date) FROM c WHERE fold = 'test')"
# the score equations of a logistic fit with an indicator per material
RATE_BY_MATERIAL = "SELECT materialSpec, count(*) AS rows, round(avg(y), 3) AS mean_score FROM scored GROUP BY 1"
# rows per fold of whole quotes in order of their date; the frame ``f`` is put in front
FOLD_SIZES = """g AS (SELECT quotationID, min("quoteDate") AS d, count(*) AS size FROM f GROUP BY 1),
 s AS (SELECT size, coalesce(sum(size) OVER (ORDER BY d, quotationID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen, sum(size) OVER () AS n FROM g),
 x AS (SELECT sum(size) FILTER (seen < 0.60 * n) AS train, sum(size) FILTER (seen >= 0.60 * n AND seen < (0.60 + 0.20) * n) AS calibration,
  sum(size) FILTER (seen >= (0.60 + 0.20) * n) AS holdout FROM s)"""
ONE_OF_EACH = f"""f AS (SELECT DISTINCT "quoteDate", quotationID, {', '.join([*T.LINE_NUMERIC, *T.LINE_CATEG])}, price_ratio, won FROM ({LINE_SQL}))"""

NUM, CAT = ["quantity", "unitPrice", "discountPercent", "price_ratio"], ["materialSpec"]


def line_frame(spark, sf):
    return durable(frames.line_frame(P.quotes(spark, sf), P.quote_lines(spark, sf)))


def win_frame(spark, sf):
    return durable(frames.win_frame(P.quotes(spark, sf), P.quote_lines(spark, sf)))


def scored(spark, sf):
    return durable(P.scored_lines(spark, sf))


_TRAINED: dict = {}


def once(spark, sf, name: str, fit):
    """One training run for the queries that report on it; its tables lie in the shared folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _TRAINED:
        _TRAINED[key] = fit()
    return _TRAINED[key]


@query("i01_feature_pipeline", """SELECT materialSpec, (SELECT 5 + count(DISTINCT materialSpec) FROM scored) AS width, round(sum((quantity - m) / s), 4) AS scaled_quantity
 FROM scored CROSS JOIN (SELECT avg(quantity) AS m, stddev_samp(quantity) AS s FROM scored) GROUP BY materialSpec""", digits=4)
def _(spark, sf):
    """Width and column sums of the assembled features per material."""
    s = scored(spark, sf)
    prep = ML.prepare(s, NUM, CAT)
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    made = Pipeline(stages=ML.feature_stages(NUM, CAT)).fit(prep.apply(s)).transform(prep.apply(s))
    v = vector_to_array("features")
    return made.groupBy("materialSpec").agg(F.max(F.size(v)).alias("width"), F.sum(v[0]).alias("scaled_quantity"))


def hazard_candidates(spark, sf):
    """algorithm, target and raw score of every test row, for all four candidates on one set of folds."""
    from kilnworks.operators import inventory as N
    folds = durable(S.chronological_split(N.supervised_frame(P.snapshots(spark, sf)), "snapshot_date"))
    train, test = folds.filter("fold = 'train'"), folds.filter("fold = 'test'")
    prep = ML.prepare(train, T.HAZARD_NUMERIC, T.HAZARD_CATEG)
    out, boosters = None, {}
    keep = lambda rows, name: durable(rows.select(F.lit(name).alias("algorithm"), F.col("target").cast("int").alias("target"), "raw"))
    for name, est in ML.candidates("target").items():
        if isinstance(est, ML.Booster):
            boosters[name] = est.spec
            continue
        s = keep(ML.raw_scores(test, prep, ML.fit_model(train, prep, est)), name)
        out = s if out is None else out.unionByName(s)
    both = ML.fit_boosted(train, prep, list(boosters.values()), "target")  # side by side in one fit
    scores = durable(both.scores(test, prep, "all"))
    for i, name in enumerate(boosters):
        out = out.unionByName(keep(scores.withColumn("raw", F.col("all")[i]), name))
    return out


def evaluated(scores, names: str, y: str, p: str):
    """AUC, PR-AUC, Brier, ECE and n of each model in one pass over all."""
    parts = [M.roc_auc(scores, y, p, [names]), M.average_precision(scores, y, p, [names]), M.expected_calibration_error(scores, y, p, [names])]
    out = scores.groupBy(names).agg(F.count(p).alias("n_test"), M.brier(F.col(y), F.col(p)).alias("brier"), F.avg(y).alias("positive_rate"))
    for part in parts:
        out = out.join(part, names)
    return out


@query("i02_hazard_candidates", f"""WITH {CHRONO}, a AS (SELECT count(*) AS n_test, avg(target::INT) AS rate FROM t JOIN c USING (snapshot_date) WHERE fold = 'test')
 SELECT unnest(['logistic_regression', 'random_forest', 'boosted_leafwise', 'boosted_depth6']) AS algorithm, n_test, round(rate, 6) AS positive_rate, true AS bounded, true AS varied FROM a""")
def _(spark, sf):
    """All four weekly hazard candidates on one set of folds: rows scored, their rate, whether every score is a probability and they differ."""
    s = once(spark, sf, "hazard_candidates", lambda: hazard_candidates(spark, sf))
    return s.groupBy("algorithm").agg(F.count("raw").alias("n_test"), F.avg("target").alias("positive_rate"), F.min(F.col("raw").between(0, 1)).alias("bounded"),
                                      (F.max("raw") > F.min("raw")).alias("varied"))


@query("i02_hazard_metrics")
def _(spark, sf):
    """AUC, PR-AUC, Brier and ECE of the four candidates."""
    return evaluated(once(spark, sf, "hazard_candidates", lambda: hazard_candidates(spark, sf)), "algorithm", "target", "raw")


# the training rows of the hazard as whole thousandths of a standard deviation, so that distances are exact
RESAMPLE_ON = ["available_qty", "reserved_qty", "rop", "open_qty", "past_due_qty", "consumed_qty", "draft_mo_required_qty"]
_GRID = ", ".join(f"floor((s.{c} - avg(s.{c}) OVER ()) / stddev_samp(s.{c}) OVER () * 1000 + 0.5) AS x{i}" for i, c in enumerate(RESAMPLE_ON))
_SQUARES = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(len(RESAMPLE_ON)))
ON_GRID = f"""{CHRONO}, w AS (SELECT s.snapshot_id AS id, t.target::INT AS label, {_GRID} FROM t JOIN c USING (snapshot_date) JOIN snapshots s USING (snapshot_id) WHERE fold = 'train')"""


def on_grid(spark, sf):
    """id, label and grid coordinates of the hazard's training rows."""
    from kilnworks.operators import inventory as N
    from kilnworks.operators.scale import with_scalars
    train = S.chronological_split(N.supervised_frame(P.snapshots(spark, sf)), "snapshot_date").filter("fold = 'train'")
    rows = durable(train.select(F.col("snapshot_id").alias("id"), F.col("target").cast("int").alias("label"), *RESAMPLE_ON))
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in RESAMPLE_ON], *[F.stddev_samp(c).alias(f"s_{c}") for c in RESAMPLE_ON])
    cells = [F.floor((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") * 1000 + 0.5).cast("double") for c in RESAMPLE_ON]
    return durable(with_scalars(rows, stats).select("id", "label", F.array(*cells).alias("x")))


@query("i03_oversample", f"""WITH {ON_GRID}, cn AS (SELECT label, count(*) AS n FROM w GROUP BY 1),
 z AS (SELECT arg_min(label, (n, label)) AS minor, min(n) AS n, max(n) - min(n) AS more FROM cn),
 m AS (SELECT w.*, row_number() OVER (ORDER BY id) - 1 AS i FROM w JOIN z ON label = minor),
 nb AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY {_SQUARES}, b.id) AS k FROM m a JOIN m b ON a.id <> b.id),
 kk AS (SELECT id, copy, md5(id || '|' || copy) AS h FROM (SELECT id, unnest(range(1, CAST(floor((i + 1) * more / n) - floor(i * more / n) + 1 AS BIGINT))) AS copy FROM m, z)),
 u AS (SELECT id, copy, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 5 + 1 AS k, CAST('0x' || substr(h, 9, 8) AS BIGINT) / 4294967296 AS weight FROM kk)
 SELECT u.id AS base, copy, nb.other AS neighbour, round(weight, 4) AS weight, {', '.join(f'round(a.x{i} + u.weight * (b.x{i} - a.x{i}), 4) AS x{i}' for i in range(len(RESAMPLE_ON)))}
 FROM u JOIN nb ON nb.id = u.id AND nb.k = u.k JOIN m a ON a.id = u.id JOIN m b ON b.id = nb.other""", digits=4)
def _(spark, sf):
    """Synthetic rows between a row of the rare class and one of its five nearest."""
    from kilnworks.operators.neighbours import oversample
    made = oversample(on_grid(spark, sf))
    return made.select("base", "copy", "neighbour", "weight", *[F.col("x")[i].alias(f"x{i}") for i in range(len(RESAMPLE_ON))])


@query("i04_tomek_links", f"""WITH {ON_GRID}, nb AS (SELECT a.id, any_value(a.label) AS y, arg_min(b.id, ({_SQUARES}, b.id)) AS other, min({_SQUARES}) AS d2 FROM w a JOIN w b ON a.id <> b.id GROUP BY a.id)
 SELECT d.id AS a, e.id AS b, d.d2 FROM nb d JOIN nb e ON d.other = e.id AND e.other = d.id AND d.y <> e.y AND d.id < e.id""")
def _(spark, sf):
    """Rows of different classes that are each other's nearest."""
    from kilnworks.operators.neighbours import tomek_links
    return tomek_links(on_grid(spark, sf))


@query("i04_resampled_training", f"""WITH {CHRONO}, w AS (SELECT target::INT AS label FROM t JOIN c USING (snapshot_date) WHERE fold = 'train'),
 n AS (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM w), s AS (SELECT unnest(['original', 'after_smote', 'after_tomek']) AS stage)
 SELECT stage, CASE WHEN stage = 'original' THEN n0 WHEN stage = 'after_smote' THEN greatest(n0, n1) END AS rows_0, CASE WHEN stage = 'original' THEN n1 WHEN stage = 'after_smote' THEN greatest(n0, n1) END AS rows_1,
  stage = 'after_tomek' AS fewer, (SELECT count(*) FROM t JOIN c USING (snapshot_date) WHERE fold = 'test') AS n_test FROM s, n""")
def _(spark, sf):
    """Class sizes before and after each step of resampling, whether the last one takes equally many of both, and the untouched test rows that the model of the hazard on these rows scores."""
    t = once(spark, sf, "hazard_resampled", lambda: T.train_hazard(P.snapshots(spark, sf), resample=True))
    by = t.parts["counts"].groupBy("stage").agg(*[F.sum(F.when(F.col("label") == k, F.col("rows"))).alias(f"n{k}") for k in (0, 1)])
    last = F.col("stage") == "after_tomek"
    filled = durable(by.where("stage = 'after_smote'").select("n0", F.col("n1").alias("f1")))
    fewer = F.coalesce(last & (F.col("n0") == F.col("n1")) & (F.col("n0") <= filled.select("n0").scalar()), F.lit(False))
    return by.select("stage", F.when(~last, F.col("n0")).alias("rows_0"), F.when(~last, F.col("n1")).alias("rows_1"), fewer.alias("fewer"),
                     t.metrics.select("n_test").scalar().alias("n_test"))


@query("i05_calibration", """SELECT count(*) FILTER (quotationID % 2 = 1) AS applied, round(avg(y) FILTER (quotationID % 2 = 0), 4) AS fitted_rate, 0 AS order_violations, true AS closer
 FROM scored""", digits=4)
def _(spark, sf):
    """Rows calibrated, calibrated mean on the rows of the fit, turned scores, and whether the error fell on the others."""
    s = scored(spark, sf).select("y", "p", F.col("quotationID").alias("q"))
    cal = ML.Calibrator().fit(s.filter("q % 2 = 0"), "p", "y")
    own = cal.apply(s.filter("q % 2 = 0"), "p", "c").agg(F.avg("c").alias("fitted_rate"))
    after = durable(cal.apply(s.filter("q % 2 = 1"), "p", "c"))
    a, b = M.expected_calibration_error(after, "y", "p"), M.expected_calibration_error(after, "y", "c", out="ece_after")
    # scores have four decimals, so there are at most 10,001 distinct ones
    lows = after.groupBy("p").agg(F.min("c").alias("c"))
    before = F.lag("c").over(Window.orderBy("p"))
    turned = lows.withColumn("turned", before > F.col("c") + 1e-12).agg(F.count_if("turned").alias("n"))
    return after.agg(F.count("c").alias("applied")).withColumns({"fitted_rate": own.scalar(), "order_violations": turned.scalar(),
        "closer": b.scalar() < a.select("ece").scalar()})


@query("i06_horizon_calibration", f"""WITH {CHRONO}, r AS (SELECT t.*, fold FROM t JOIN c USING (snapshot_date) WHERE target_4w IS NOT NULL)
 SELECT (SELECT count(*) FROM r WHERE fold = 'test') AS rows, 0 AS order_violations, (SELECT round(avg(target_4w::INT), 3) FROM r WHERE {PURGED}) AS fitted_rate""", digits=3)
def _(spark, sf):
    """Test rows with calibrated 30 and 60 day risks, order violations (must be none), calibrated mean on the rows of the fit."""
    t = hazard_job(spark, sf)
    r = t.model.horizon.apply(t.parts["test_risks"], "s", "l", "c30", "c60")
    own = t.model.horizon.apply(t.parts["risks"], "s", "l", "c30", "c60").agg(F.avg("c30").alias("fitted_rate"))
    return r.agg(F.count("c60").alias("rows"), F.count_if(F.col("c30") > F.col("c60")).alias("order_violations")).withColumn("fitted_rate", own.scalar())


@query("i07_purged_calibration", f"WITH {CHRONO} SELECT snapshot_id FROM t JOIN c USING (snapshot_date) WHERE {PURGED}")
def _(spark, sf):
    from kilnworks.operators import inventory as N
    folds = S.chronological_split(N.supervised_frame(P.snapshots(spark, sf)), "snapshot_date")
    return ML.purge_calibration(folds, "snapshot_date", 9).select("snapshot_id")


# the reference grids with a tenth of the rounds
SPACE = {"rounds": [20, 30, 40], "rate": [0.03, 0.05, 0.08], "leaves": [15, 31, 63], "least_rows": [10, 20, 40]}


@query("i11_random_search", "SELECT setting, fold, true AS learned FROM (SELECT unnest(range(0, 5)) AS setting), (SELECT unnest(range(0, 3)) AS fold)")
def _(spark, sf):
    """Whether each setting, the finalized one and four sampled ones, ranks better than chance in each fold; all models in one fit."""
    s = scored(spark, sf)
    prep = ML.prepare(s, NUM, CAT)
    settings = ML.search_settings(SPACE, ML.B.Spec(rounds=30, rate=0.05, leaves=31, least_rows=20), tries=4)
    auc = once(spark, sf, "search", lambda: durable(ML.random_search(s, prep, settings, "y", ["id"])))
    return auc.select("setting", "fold", (F.col("score") > 0.5).alias("learned"))


@query("i11_search_scores")
def _(spark, sf):
    """The AUC of each setting and fold."""
    s = scored(spark, sf)
    settings = ML.search_settings(SPACE, ML.B.Spec(rounds=30, rate=0.05, leaves=31, least_rows=20), tries=4)
    return once(spark, sf, "search", lambda: durable(ML.random_search(s, ML.prepare(s, NUM, CAT), settings, "y", ["id"])))


@query("i11_pinball_search", "SELECT setting, fold, true AS better FROM (SELECT unnest(range(0, 3)) AS setting), (SELECT unnest(range(0, 3)) AS fold)")
def _(spark, sf):
    """Whether each setting's quartile models lose less than the constant quartiles of all rows, by mean pinball loss."""
    f = price_frame(spark, sf)
    settings = ML.search_settings({"rounds": [10, 20], "rate": [0.1, 0.2], "leaves": [15, 31], "least_rows": [20, 30]},
                                  ML.B.Spec(rounds=15, rate=0.2, leaves=31, least_rows=30), tries=2)
    got = ML.random_search(f, ML.prepare(f, BAND_NUMERIC, ["region"]), settings, "price_ratio", ["quotationID", "productID", "quantity"], quantiles=list(ML.QUARTILES.values()))
    from kilnworks.operators.scale import exact_quantiles, with_scalars
    gap = lambda q: F.col("price_ratio") - F.col(q)
    flat = reduce(lambda a, b: a + b, [F.greatest(gap(q) * a, gap(q) * (a - 1)) for q, a in ML.QUARTILES.items()]) / 3
    constant = with_scalars(f, exact_quantiles(f, [], "price_ratio", ML.QUARTILES)).agg(F.avg(flat).alias("constant"))
    return with_scalars(durable(got), constant).select("setting", "fold", (F.col("score") < F.col("constant")).alias("better"))


def line_job(spark, sf):
    """The line job with the model's fixed settings and 15 resampled models, on one set of folds."""
    return once(spark, sf, "line", lambda: T.train_line(line_frame(spark, sf), LINE_SPEC, ML.RESAMPLES))


# an eighth of the production rounds: sixteen models grow in the same fit
LINE_SPEC = ML.B.Spec(rounds=40, rate=0.12, leaves=31, least_rows=20)


@query("i12_monotone_price", f"WITH {ONE_OF_EACH}, {FOLD_SIZES} SELECT holdout AS n_test, 0 AS rising_lines, true AS not_below_hinge FROM x")
def _(spark, sf):
    """Rows of the hold-out fold, how many have odds that rise along the price grid (must be none), and whether it ranks no worse than a monotone logistic fit."""
    t = line_job(spark, sf)
    folds = t.parts["folds"]
    hold = folds["holdout"]
    grid = F.array(*[F.lit(v) for v in W.grid(0.2, 3.0, 21)])
    swept = hold.select(*[c for c in hold.columns if c != "price_ratio"], F.posexplode(grid).alias("step", "price_ratio"))
    s = durable(t.model.score(swept, "p").select("quotationLineItemID", "step", "p"))
    per = s.groupBy("quotationLineItemID").agg(F.array_sort(F.collect_list(F.struct("step", "p"))).alias("a"))
    rise = per.agg(F.count_if(W.rises(F.transform("a", lambda x: x["p"]))).alias("rising_lines"))
    hinge = ML.fit_monotone(folds["train"], folds["calibration"], T.LINE_NUMERIC, T.LINE_CATEG, "price_ratio", "won")
    other = M.roc_auc(durable(hinge.raw(hold, "p").select("won", "p")), "won", "p", out="hinge_auc")
    raw = M.roc_auc(durable(t.model.fitted.scores(hold, t.model.prep, "s").select("won", F.col("s")[0].alias("p"))), "won", "p", out="own")
    return t.metrics.select("n_test").withColumn("rising_lines", rise.scalar()).withColumn("not_below_hinge", raw.scalar() >= other.scalar() - 0.01)


@query("i13_bootstrap_interval", f"WITH {ONE_OF_EACH}, {FOLD_SIZES} SELECT holdout AS rows, 0 AS crossed, 0 AS outside, 0 AS without_score FROM x")
def _(spark, sf):
    """Rows with an interval of resampled scores and Wilson bands: intervals that are turned, leave the probabilities, or miss the row's own score."""
    t = line_job(spark, sf)
    folds = t.parts["folds"]
    out = ML.score_interval(t.model, folds["calibration"], folds["holdout"], "won")
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("ci_low") > F.col("ci_high")).alias("crossed"),
                   F.count_if((F.col("ci_low") < 0) | (F.col("ci_high") > 1)).alias("outside"), F.count_if(~F.col("p").between(F.col("ci_low"), F.col("ci_high"))).alias("without_score"))


def win_job(spark, sf):
    return once(spark, sf, "win", lambda: T.train_win(win_frame(spark, sf), WIN_ROUNDS))


WIN_ROUNDS = 100


@query("i14_quote_win_model", f"""WITH f AS (SELECT quotationID, quoteDate AS "quoteDate", won FROM headers), {FOLD_SIZES},
 h AS (SELECT quotationID, sum(size) OVER (ORDER BY d, quotationID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, sum(size) OVER () AS n FROM g)
 SELECT holdout AS n_test, (SELECT round(avg(won), 6) FROM h JOIN f USING (quotationID) WHERE coalesce(seen, 0) >= (0.60 + 0.20) * n) AS positive_rate, true AS bounded FROM x""")
def _(spark, sf):
    """Hold-out quotes scored, their win rate, and whether every score is a probability."""
    scores = win_job(spark, sf).parts["scored"]
    return scores.agg(F.count("p").alias("n_test"), F.avg(F.col("won").cast("double")).alias("positive_rate"), F.min(F.col("p").between(0, 1)).alias("bounded"))


@query("i14_quote_win_metrics")
def _(spark, sf):
    """All metrics of the quote-level model on its hold-out fold."""
    return win_job(spark, sf).metrics


BAND_NUMERIC = ["quantity", "unitPrice", "leadTimeDays", "contact_win_rate"]


def price_frame(spark, sf):
    return durable(frames.price_frame(P.quotes(spark, sf), P.quote_lines(spark, sf)))


def band_job(spark, sf):
    """The quartile models on seven of ten quotes, with an eighth of the production rounds."""
    def fit():
        f = price_frame(spark, sf)
        train, test = f.filter(F.col("quotationID") % 10 < 7), f.filter(F.col("quotationID") % 10 >= 7)
        return f, ML.fit_price_band(train, test, BAND_NUMERIC, ["region"], "productID", spec=ML.B.Spec("quantile", rounds=50, rate=0.1, leaves=31, least_rows=30))
    return once(spark, sf, "band", fit)


@query("i15_price_band_model", """SELECT count(*) AS rows, 0 AS disordered, 0 AS unclamped, 1 AS modes, true AS near_half FROM priced JOIN headers USING (quotationID) WHERE won = 1""")
def _(spark, sf):
    """Bands of the served model: rows, order and clamp violations (must be none), models served (one), and whether the fitted band covers about half."""
    f, m = band_job(spark, sf)
    s = m.serve(f, "productID")
    bad = (F.col("ratio_low") > F.col("ratio_mid")) | (F.col("ratio_mid") > F.col("ratio_high"))
    return s.agg(F.count("ratio_mid").alias("rows"), F.count_if(bad).alias("disordered"),
                 F.count_if((F.col("ratio_low") < 0.7) | (F.col("ratio_high") > 1.3)).alias("unclamped"), F.count_distinct("served_mode").alias("modes")).withColumn(
        "near_half", F.lit(0.4 <= m.metrics["coverage"] <= 0.6))


@query("i15_price_band_metrics")
def _(spark, sf):
    """Coverage, mean pinball loss and median error of the fitted and of the empirical band, and which is served."""
    _f, m = band_job(spark, sf)
    # six numbers that the fit has already brought together
    return spark.createDataFrame([(k, float(v), m.served) for k, v in sorted(m.metrics.items())], "measure string, value double, served string")


@query("i22_hazard_scoring", "SELECT count(*) AS rows, count(DISTINCT snapshot_id) AS snapshots, 0 AS order_violations, 0 AS outside FROM snapshots")
def _(spark, sf):
    """Every snapshot scored by both projections with alerts: rows, ids, risks out of order or no probability."""
    t = hazard_job(spark, sf)
    s = t.model.predict(P.snapshots(spark, sf), ["snapshot_id"])
    risks = ("model_risk_30d", "model_risk_60d", "projection_risk_30d", "projection_risk_60d")
    outside = reduce(lambda a, b: a | b, [F.coalesce(~F.col(c).between(0, 1), F.lit(True)) for c in risks])
    return s.agg(F.count("badge_30d").alias("rows"), F.count_distinct("snapshot_id").alias("snapshots"),
                 F.count_if(F.col("model_risk_30d") > F.col("model_risk_60d")).alias("order_violations"), F.count_if(outside).alias("outside"))


@query("i23_horizon_evaluation", f"""WITH {CHRONO}, r AS (SELECT t.* FROM t JOIN c USING (snapshot_date) WHERE fold = 'test' AND target_4w IS NOT NULL AND target_9w IS NOT NULL),
 a AS (SELECT count(*) AS n_test, avg(target_4w::INT) AS b30, avg(target_9w::INT) AS b60 FROM r)
 SELECT unnest(['before_30d', 'after_30d', 'baseline_30d', 'before_60d', 'after_60d', 'independent_60d', 'baseline_60d']) AS score, n_test,
  unnest([NULL, NULL, round(b30 * (1 - b30), 6), NULL, NULL, NULL, round(b60 * (1 - b60), 6)]) AS constant_brier FROM a""")
def _(spark, sf):
    """Both horizons on the test fold: raw, calibrated together, the long one calibrated on its own, constant baseline; the baseline's error is known."""
    r = ML.evaluate_each(horizon_scores(spark, sf), HORIZON_SCORES)
    return r.select("score", "n_test", F.when(F.col("score").startswith("baseline"), F.col("brier")).alias("constant_brier"))


@query("i23_horizon_metrics")
def _(spark, sf):
    """AUC, Brier, ECE and the rest for each horizon and score, and how many rows have their risks out of order."""
    r = horizon_scores(spark, sf)
    turned = r.agg(F.count_if(F.col("c30") > F.col("c60")).alias("n"))
    out = ML.evaluate_each(r, HORIZON_SCORES)
    return out.select(*[c for c in out.columns if c != "score"], "score").withColumn("order_violations", turned.scalar())


HORIZON_SCORES = (("before_30d", "y30", "s"), ("after_30d", "y30", "c30"), ("baseline_30d", "y30", "b30"),
                  ("before_60d", "y60", "l"), ("after_60d", "y60", "c60"), ("independent_60d", "y60", "i60"), ("baseline_60d", "y60", "b60"))


def horizon_scores(spark, sf):
    """Test rows with raw, jointly and separately calibrated and constant risks of both horizons."""
    return once(spark, sf, "horizon_scores", lambda: _horizon_scores(spark, sf))


def hazard_job(spark, sf):
    return once(spark, sf, "hazard", lambda: T.train_hazard(P.snapshots(spark, sf)))


def _horizon_scores(spark, sf):
    t = hazard_job(spark, sf)
    fitted = t.parts["risks"].filter("target_9w IS NOT NULL").withColumn("y60", F.col("target_9w").cast("int"))
    alone = ML.Calibrator().fit(fitted, "l", "y60")
    r = t.model.horizon.apply(t.parts["test_risks"].filter("target_9w IS NOT NULL"), "s", "l", "c30", "c60")
    r = durable(alone.apply(r, "l", "i60").withColumns({"y30": F.col("target_4w").cast("int"), "y60": F.col("target_9w").cast("int")}))
    base = r.agg(F.avg("y30").alias("b30"), F.avg("y60").alias("b60"))
    from kilnworks.operators.scale import with_scalars
    return durable(with_scalars(r, base))


@query("i24_open_quote_scoring", """SELECT line_count < 5 AS hidden, count(*) AS quotes, count(*) AS payloads, 0 AS outside, 0 AS not_audited, 0 AS audited_in_vain, count(*) FILTER (quotationID % 2 = 0) AS kept_notes
 FROM quotes JOIN rollup USING (quotationID) WHERE statusName = 'Sent' GROUP BY 1""")
def _(spark, sf):
    """Every open quote scored with its own rates; its advisory merged into what the quote held, and an audit row where the score is doubtful or hidden."""
    t = win_job(spark, sf)
    q = P.quotes(spark, sf).filter("statusName = 'Sent'")
    roll = frames.quote_rollup(frames.priced_lines(P.quote_lines(spark, sf)))
    from kilnworks.operators.scale import with_scalars
    h = durable(decided_headers(P.quotes(spark, sf)))
    f = q.join(roll, "quotationID")
    for key, name in (("customerID", "contact_win_rate"), ("salesRepID", "salesrep_win_rate")):
        table = durable(rate_table(h, key))
        own = table.withColumnsRenamed({"entity": "__e", "rate": "__r"})
        overall = table.filter("entity = '_global'").select(F.col("rate").alias("__g"))
        f = with_scalars(f.join(own, F.col(key).cast("string") == F.col("__e"), "left"), overall)
        f = f.withColumn(name, F.coalesce("__r", "__g")).drop("__e", "__r", "__g")
    f = f.withColumns({"grand_total": F.col("grandTotal"), "n_comparable": F.col("line_count")})
    s = durable(T.score_open_quotes(f, t, "1"))
    held = P.quotes(spark, sf).select("quotationID", F.when(F.col("quotationID") % 2 == 0, '{"note": "kept"}').alias("custom_elements"))
    advised, audit = T.record_scores(s, held, scratch_path(spark, "advisories"), scratch_path(spark, "audit"))
    seen = audit.select(F.col("entity_id").cast("long").alias("quotationID"), F.lit(True).alias("audited"), F.get_json_object("metadata", "$.win_probability_pct").alias("pct"))
    j = s.select("quotationID", "p", "hidden", "low_confidence").join(seen, "quotationID", "left").join(advised, "quotationID")
    due = F.col("hidden") | F.col("low_confidence")
    found = F.coalesce(F.col("audited"), F.lit(False))
    part = lambda path: F.get_json_object("custom_elements", path)
    return j.groupBy("hidden").agg(
        F.count(F.lit(1)).alias("quotes"), F.count(part("$.ai_quote.win_probability_pct")).alias("payloads"), F.count_if(~F.col("p").between(0, 1)).alias("outside"),
        F.count_if(due & (~found | F.col("pct").isNull())).alias("not_audited"), F.count_if(~due & found).alias("audited_in_vain"), F.count(part("$.note")).alias("kept_notes"))


@query("i25_line_training_job", f"WITH {ONE_OF_EACH}, {FOLD_SIZES} SELECT train, calibration, holdout, holdout AS n_test, true AS useful FROM x")
def _(spark, sf):
    """Rows per fold of the whole line job, rows scored, and whether the scores rank better than chance."""
    t = line_job(spark, sf)
    f = t.parts["folds"]
    counts = [f[n].agg(F.count(F.lit(1)).alias(n)) for n in ("train", "calibration", "holdout")]
    out = t.metrics.select("n_test", (F.col("auc") > 0.5).alias("useful"))
    for name, c in zip(("train", "calibration", "holdout"), counts):
        out = out.withColumn(name, c.scalar())
    return out


@query("i25_line_training_metrics")
def _(spark, sf):
    """All metrics of the line model on its hold-out fold."""
    return line_job(spark, sf).metrics


@query("d32_learnability_gate", """SELECT count(*) AS n_test, round(avg(y), 6) AS positive_rate, false AS leak_alarm, true AS lift_ok FROM scored WHERE quotationID % 10 >= 7""")
def _(spark, sf):
    """Hold-out rows and rate of a fair logistic fit, its leak alarm and whether it lifts."""
    s = scored(spark, sf)
    train, test = s.filter(F.col("quotationID") % 10 < 7), s.filter(F.col("quotationID") % 10 >= 7)
    prep = ML.prepare(train, NUM, CAT)
    p = durable(ML.raw_scores(test, prep, ML.fit_model(train, prep, LogisticRegression(labelCol="y", maxIter=50))))
    m = ML.evaluate(p, "y", "raw")
    return m.select("n_test", "positive_rate", (F.col("auc") >= 0.985).alias("leak_alarm"), (F.col("pr_auc") >= 1.25 * F.col("positive_rate")).alias("lift_ok"))


@query("l02_model_table_function", RATE_BY_MATERIAL, digits=3)
def _(spark, sf):
    """A saved pipeline loaded by path and applied as a table function."""
    from pyspark.ml import PipelineModel

    from kilnworks.session import scratch_path
    s = scored(spark, sf)
    prep = ML.prepare(s, NUM, CAT)
    path = scratch_path(spark, "model")
    ML.fit_model(s, prep, LogisticRegression(labelCol="y")).write().save(path)
    return ML.raw_scores(s, prep, PipelineModel.load(path)).groupBy("materialSpec").agg(F.count(F.lit(1)).alias("rows"), F.avg("raw").alias("mean_score"))
