"""Model fits with Spark ML and with boosted trees on histograms. Fits are distributed; only fitted parameters reach the driver."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import (
    OneHotEncoder, OneHotEncoderModel, StandardScaler, StandardScalerModel, StringIndexer, StringIndexerModel, VectorAssembler)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnworks.operators import boosting as B
from kilnworks.operators import clean as C
from kilnworks.operators import metrics as M
from kilnworks.operators import neighbours as NB
from kilnworks.operators.scale import exact_quantiles, join_on, top_per_key
from kilnworks.session import durable

SEED = 7
TOP_CATEGORIES = 8
# Served probability bounds, band clamp, calibrator rules, resamples.
PROB_FLOOR, PROB_CEIL = 0.01, 0.99
TREES, ROUNDS = 300, 350
RATIO_CLAMP = (0.7, 1.3)
ISOTONIC_ROWS, ISOTONIC_CLASS, ISOTONIC_DISTINCT = 500, 30, 20
# Cells of a calibration fit: steps of log-odds, so both ends of the scale are told apart.
LOGIT_STEPS = 32_768
RESAMPLES, CI_LOW, CI_HIGH = 15, 0.05, 0.95


def positive(vector: str = "probability") -> Column:
    return vector_to_array(F.col(vector))[1]


# --- features ---------------------------------------------------------------
def top_categories(df: DataFrame, cols: Sequence[str], n: int = TOP_CATEGORIES) -> dict[str, list[str]]:
    """The n most frequent values per column; n values per column come to the driver."""
    pairs = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    counts = pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    kept = top_per_key(counts, ["column"], [F.desc("n"), F.asc("value")], n).collect()
    return {c: sorted(r["value"] for r in kept if r["column"] == c) for c in cols}


def collapse(df: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """Values outside the vocabulary become 'Other', so the encoders stay bounded."""
    return df.withColumns({c: F.when(F.col(c).cast("string").isin(v), F.col(c).cast("string")).otherwise("Other")
                           for c, v in vocabulary.items()})


def feature_stages(numeric: Sequence[str], categorical: Sequence[str], out: str = "features") -> list:
    """Standardised numbers beside one-hot categories; unseen categories have their own slot."""
    stages: list = [VectorAssembler(inputCols=list(numeric), outputCol="__num", handleInvalid="error"),
                    StandardScaler(inputCol="__num", outputCol="__scaled", withMean=True, withStd=True)]
    parts = ["__scaled"]
    if categorical:
        idx, hot = [f"__i_{c}" for c in categorical], [f"__h_{c}" for c in categorical]
        stages += [StringIndexer(inputCols=list(categorical), outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCols=idx, outputCols=hot, handleInvalid="keep")]
        parts += hot
    return stages + [VectorAssembler(inputCols=parts, outputCol=out)]


@dataclass
class Prepared:
    """What training learned about its inputs: fills and category vocabularies."""
    numeric: list[str]
    categorical: list[str]
    fitted: C.Fitted
    vocabulary: dict[str, list[str]]

    def apply(self, df: DataFrame) -> DataFrame:
        return collapse(C.apply_fill(C.apply_bounds(df, self.fitted.bounds), self.fitted), self.vocabulary)


def prepare(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], clip: Sequence[str] = ()) -> Prepared:
    return Prepared(list(numeric), list(categorical), C.fit(train, numeric, categorical, list(clip)),
                    top_categories(train, categorical) if categorical else {})


# --- candidates -------------------------------------------------------------
@dataclass(frozen=True)
class Booster:
    """Boosted trees to be fitted."""
    spec: B.Spec
    label: str


@dataclass
class Boosted:
    """Fitted boosted trees, behind the stages that make their features."""
    front: PipelineModel
    models: list[B.Model]

    def scores(self, df: DataFrame, prep: Prepared, out: str) -> DataFrame:
        """``out``: an array with the score of each model."""
        tagged = prep.apply(df.withColumn("__row", F.struct(*[F.col(c) for c in df.columns])))
        made = self.front.transform(tagged).select("__row", vector_to_array("features").alias("__x"))
        return made.withColumn(out, B.score(self.models, "__x")).select("__row.*", out)


def fit_boosted(train: DataFrame, prep: Prepared, specs: Sequence[B.Spec], label: str, key: Sequence[str] = ()) -> Boosted:
    """All models in one fit. Rows are told apart by ``key``, or by all their columns, where a model takes only some of them."""
    ready = prep.apply(train.withColumn("__h", F.xxhash64(*(key or train.columns))))
    front = Pipeline(stages=feature_stages(prep.numeric, prep.categorical)).fit(ready)
    rows = front.transform(ready).select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"), F.col("__h").alias("h"))
    return Boosted(front, B.fit(rows, specs))


def candidates(label: str, trees: int = TREES, rounds: int = ROUNDS) -> dict[str, Any]:
    """Logistic regression, random forest and two boosted settings: best leaf first, and six full levels."""
    common = {"labelCol": label, "featuresCol": "features"}
    return {
        "logistic_regression": LogisticRegression(maxIter=100, **common),
        "random_forest": RandomForestClassifier(numTrees=trees, minInstancesPerNode=5, seed=SEED, **common),
        "boosted_leafwise": Booster(B.Spec(rounds=rounds, rate=0.04, leaves=31, least_rows=25), label),
        "boosted_depth6": Booster(B.Spec(rounds=rounds, rate=0.04, leaves=64, depth=6, least_rows=1, least_hessian=3.0, l2=1.0), label)}


def fit_model(train: DataFrame, prep: Prepared, estimator: Estimator | Booster) -> PipelineModel | Boosted:
    if isinstance(estimator, Booster):
        return fit_boosted(train, prep, [estimator.spec], estimator.label)
    return Pipeline(stages=[*feature_stages(prep.numeric, prep.categorical), estimator]).fit(prep.apply(train))


def fit_resampled(train: DataFrame, prep: Prepared, estimator: Estimator | Booster, label: str, key: str) -> tuple[PipelineModel | Boosted, DataFrame]:
    """A model of balanced training rows: the rare class is filled up between its neighbours, then Tomek links go on both sides.

    Also returned: stage, class and rows, before and after each step. Other folds keep their natural rates.
    """
    front = Pipeline(stages=feature_stages(prep.numeric, prep.categorical)).fit(prep.apply(train))
    points = durable(front.transform(prep.apply(train)).select(F.col(key).cast("string").alias("id"), vector_to_array("features").alias("x"), F.col(label).cast("int").alias("label")))
    made = NB.oversample(points).select(F.concat_ws("#", "base", "copy").alias("id"), "x", "label")
    filled = durable(points.unionByName(made))
    left = durable(NB.without_tomek_links(filled))
    counts = None
    for stage, rows in (("original", points), ("after_smote", filled), ("after_tomek", left)):
        part = rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(stage).alias("stage"), "label", "rows")
        counts = part if counts is None else counts.unionByName(part)
    if isinstance(estimator, Booster):
        rows = left.select("x", F.col("label").cast("double").alias("y"), F.xxhash64("id").alias("h"))
        return Boosted(front, B.fit(rows, [estimator.spec])), durable(counts)
    fitted = estimator.fit(left.select(array_to_vector("x").alias("features"), F.col("label").alias(label)))
    return PipelineModel(stages=[*front.stages, fitted]), durable(counts)


def linear_score(model: PipelineModel, numeric: Sequence[str], categorical: Sequence[str]) -> Column | None:
    """The probability of a fitted logistic model as one expression over the prepared columns; None where the stages are others.

    The stages make several vectors a row, in one generated method too long to be compiled; the same sum of plain columns is about ten times as fast.
    """
    kinds = [VectorAssembler, StandardScalerModel, *([StringIndexerModel, OneHotEncoderModel] if categorical else []), VectorAssembler, LogisticRegressionModel]
    if [type(s) for s in model.stages] != kinds or model.stages[-1].numClasses != 2:
        return None
    scaler, fitted = model.stages[1], model.stages[-1]
    weights, at = [float(w) for w in fitted.coefficients.toArray()], len(numeric)
    values = [F.col(c).cast("double") for c in numeric]
    margin = F.lit(float(fitted.intercept))
    for x, mean, std, weight in zip(values, scaler.mean, scaler.std, weights):
        margin = margin + (x - float(mean)) * ((1 / float(std) if std else 0.0) * weight)
    for c, labels, size in zip(categorical, *((model.stages[2].labelsArray, model.stages[3].categorySizes) if categorical else ())):
        if size != len(labels) + 1:  # the last slot is that of values not seen
            return None
        own, at = weights[at:at + size], at + size
        term = reduce(lambda chain, lw: chain.when(F.col(c) == lw[0], lw[1]), zip(labels, own), F.when(F.lit(False), 0.0))
        margin = margin + term.otherwise(own[len(labels)])
    if at != len(weights):
        return None
    missing = reduce(lambda a, b: a | b, [x.isNull() | F.isnan(x) for x in values])
    return F.when(missing, F.raise_error(F.lit("a feature is null or NaN")).cast("double")).otherwise(1 / (1 + F.exp(-margin)))


def raw_scores(df: DataFrame, prep: Prepared, model: PipelineModel | Boosted, out: str = "raw") -> DataFrame:
    if isinstance(model, Boosted):
        return model.scores(df, prep, "__all").withColumn(out, F.col("__all")[0]).drop("__all")
    keep = [F.col(c) for c in df.columns]
    tagged = prep.apply(df.withColumn("__row", F.struct(*keep)))
    score = linear_score(model, prep.numeric, prep.categorical)
    if score is not None:
        return tagged.select("__row.*", score.alias(out))
    return model.transform(tagged).select("__row.*", positive().alias(out))


def search_settings(space: dict[str, list], finalized: B.Spec, tries: int = 8) -> list[B.Spec]:
    """The finalized settings and a seeded sample of the space."""
    rnd = random.Random(SEED)
    return [finalized, *[replace(finalized, **{k: rnd.choice(v) for k, v in space.items()}) for _ in range(tries)]]


def random_search(train: DataFrame, prep: Prepared, settings: Sequence[B.Spec], label: str, key: Sequence[str] = (), folds: int = 3,
                  quantiles: Sequence[float] = ()) -> DataFrame:
    """setting, fold, score: cross-validated AUC of each setting, or its mean pinball loss over ``quantiles``.

    The models of all settings, folds and quantiles grow in one fit over the same rows; each row is then
    scored once, by the models that did not learn from it.
    """
    alphas = list(quantiles) or [None]
    specs, of = [], []
    for i, spec in enumerate(settings):
        for f in range(folds):
            for a in alphas:
                specs.append(replace(spec, fold=(f, folds), **({} if a is None else {"objective": "quantile", "alpha": a})))
                of.append((i, f, a))
    key = list(key or train.columns)
    fitted = fit_boosted(train, prep, specs, label, key)
    scored = fitted.scores(train.withColumn("__h", F.xxhash64(*key)), prep, "__s").select(F.col(label).cast("double").alias("y"), "__h", "__s")

    @F.pandas_udf("long")
    def fold_of(h):
        import pandas as pd
        return pd.Series(B.folds_of(h.to_numpy(), folds))

    each = F.explode(F.array(*[F.struct(F.lit(i).alias("setting"), F.lit(f).alias("fold"), F.lit(a if a is not None else 0.0).cast("double").alias("alpha"),
                                        F.col("__s")[n].alias("p")) for n, (i, f, a) in enumerate(of)]))
    rows = durable(scored.withColumn("own", fold_of("__h")).select("y", "own", each.alias("e")).where("own = e.fold").select("y", "e.*"))
    if not quantiles:
        return M.roc_auc(rows, "y", "p", ["setting", "fold"], "score")
    gap = F.col("y") - F.col("p")
    return rows.groupBy("setting", "fold").agg(F.avg(F.greatest(gap * F.col("alpha"), gap * (F.col("alpha") - 1))).alias("score"))


# --- calibration ------------------------------------------------------------
class Calibrator:
    """Isotonic where the fold is large enough, else a one-feature logistic fit.

    Scores are first counted in cells of log-odds, 32,768 to a unit: at most 900,000
    cells, each within 2e-5 of its scores relative to the nearer end, bound what the
    isotonic fit has to pool.
    """

    def __init__(self) -> None:
        self.method = ""
        self.model: Any = None

    @staticmethod
    def _clip(c: Column) -> Column:
        return F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))

    def fit(self, df: DataFrame, raw: str, label: str) -> "Calibrator":
        x = self._clip(F.col(raw))
        step = 1 / (1 + F.exp(-F.round(F.log(x / (1 - x)) * LOGIT_STEPS) / LOGIT_STEPS))
        cells = durable(df.select(step.alias("x"), F.col(label).cast("double").alias("label")).groupBy("x", "label").agg(
            F.count(F.lit(1)).cast("double").alias("weight")))
        s = cells.agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("pos"),
                      F.count_distinct("x").alias("distinct")).first()
        n, pos = s["n"] or 0, s["pos"] or 0
        if n >= ISOTONIC_ROWS and min(pos, n - pos) >= ISOTONIC_CLASS and s["distinct"] >= ISOTONIC_DISTINCT:
            self.method = "isotonic"
            self.model = IsotonicRegression(featuresCol="x", labelCol="label", weightCol="weight", predictionCol="__cal").fit(cells)
        else:
            self.method = "platt"
            vec = VectorAssembler(inputCols=["x"], outputCol="__v").transform(cells)
            self.model = LogisticRegression(featuresCol="__v", labelCol="label", weightCol="weight", standardization=False).fit(vec)
        return self

    def apply(self, df: DataFrame, raw: str, out: str) -> DataFrame:
        x = self._clip(F.col(raw))
        if self.method == "isotonic":
            done = self.model.transform(df.withColumn("x", x)).withColumn(out, F.col("__cal")).drop("x", "__cal")
        else:
            a, b = float(self.model.coefficients[0]), float(self.model.intercept)
            done = df.withColumn(out, 1 / (1 + F.exp(-(F.lit(a) * x + F.lit(b)))))
        return done.withColumn(out, F.least(F.greatest(F.col(out), F.lit(0.0)), F.lit(1.0)))


def increment(short: Column, long: Column) -> Column:
    """Chance of the event after the short horizon, given none before."""
    s = F.least(F.greatest(short, F.lit(0.0)), F.lit(1.0))
    top = F.least(F.greatest(long, s), F.lit(1.0))
    return F.least(F.greatest((top - s) / F.greatest(1 - s, F.lit(1e-12)), F.lit(0.0)), F.lit(1.0))


class HorizonCalibrator:
    """Short horizon and conditional increment, each calibrated; the long one can never fall below the short."""

    def __init__(self) -> None:
        self.short, self.rest = Calibrator(), Calibrator()

    def fit(self, df: DataFrame, short: str, long: str, y_short: str, y_long: str) -> "HorizonCalibrator":
        self.short.fit(df.filter(F.col(y_short).isNotNull()).withColumn("__y", F.col(y_short).cast("int")), short, "__y")
        left = df.filter(F.col(y_long).isNotNull() & ~F.col(y_short))
        if left.isEmpty():
            raise ValueError("no rows at risk after the short horizon")
        left = left.withColumns({"__inc": increment(F.col(short), F.col(long)), "__y": F.col(y_long).cast("int")})
        self.rest.fit(left, "__inc", "__y")
        return self

    def apply(self, df: DataFrame, short: str, long: str, out_short: str, out_long: str) -> DataFrame:
        df = self.short.apply(df, short, out_short)
        df = self.rest.apply(df.withColumn("__inc", increment(F.col(short), F.col(long))), "__inc", "__rest")
        total = F.col(out_short) + (1 - F.col(out_short)) * F.col("__rest")
        return df.withColumn(out_long, F.least(F.greatest(total, F.col(out_short)), F.lit(1.0))).drop("__inc", "__rest")


def purge_calibration(df: DataFrame, date: str, weeks: int) -> DataFrame:
    """Calibration rows whose outcome window ends before the test window starts."""
    start = df.filter("fold = 'test'").agg(F.min(date).alias("s"))
    ends = F.date_add(F.col(date), 7 * weeks)
    return df.filter("fold = 'calibration'").filter(ends < start.scalar())


# --- monotone price classifier ----------------------------------------------
def price_basis(price: str, knots: Sequence[float]) -> dict[str, Column]:
    """Pieces that rise with price; with coefficients at or below zero their sum can only fall."""
    p = F.col(price)
    up = {f"__up{i}": F.greatest(p - k, F.lit(0.0)) for i, k in enumerate(knots)}
    down = {f"__dn{i}": F.least(p - k, F.lit(0.0)) for i, k in enumerate(knots)}
    return up | down


@dataclass
class MonotonePriceModel:
    prep: Prepared
    price: str
    knots: list[float]
    stages: PipelineModel
    calibrator: Calibrator

    def raw(self, df: DataFrame, out: str = "raw") -> DataFrame:
        keep = F.struct(*[F.col(c) for c in df.columns])
        ready = self.prep.apply(df.withColumn("__row", keep)).withColumns(price_basis(self.price, self.knots))
        return self.stages.transform(ready).select("__row.*", positive().alias(out))

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        done = self.calibrator.apply(self.raw(df, "__raw"), "__raw", out).drop("__raw")
        return done.withColumn(out, F.least(F.greatest(F.col(out), F.lit(PROB_FLOOR)), F.lit(PROB_CEIL)))


def fit_monotone(train: DataFrame, calibration: DataFrame, numeric: Sequence[str], categorical: Sequence[str], price: str,
                 label: str, max_iter: int = 50) -> MonotonePriceModel:
    """Logistic fit whose price pieces are bounded at zero from above: odds can never rise with price."""
    q = exact_quantiles(train, [], price, {f"k{i}": i / 6 for i in range(1, 6)}).first()
    knots = sorted({float(v) for v in q})
    prep = prepare(train, [*numeric, price], categorical, clip=list(numeric))
    basis = list(price_basis(price, knots))
    others = feature_stages(numeric, categorical, "__other")
    ready = prep.apply(train).withColumns(price_basis(price, knots))
    front = Pipeline(stages=[*others, VectorAssembler(inputCols=[*basis, "__other"], outputCol="features")]).fit(ready)
    made = front.transform(ready)
    size = made.schema["features"].metadata["ml_attr"]["num_attrs"]
    bounds = DenseMatrix(1, size, [0.0] * len(basis) + [1e9] * (size - len(basis)))
    lr = LogisticRegression(labelCol=label, featuresCol="features", maxIter=max_iter, upperBoundsOnCoefficients=bounds, standardization=True)
    fitted = lr.fit(made)
    model = MonotonePriceModel(prep, price, knots, PipelineModel(stages=[*front.stages, fitted]), Calibrator())
    model.calibrator.fit(model.raw(calibration), "raw", label)
    return model


@dataclass
class BoostedPriceModel:
    """Boosted trees whose score never rises with price, calibrated; with resampled models, also their scores."""
    prep: Prepared
    fitted: Boosted
    calibrators: list[Calibrator]

    def all_scores(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        """One calibrated column for each model."""
        out = self.fitted.scores(df, self.prep, "__all").withColumns({f"__r{i}": F.col("__all")[i] for i in range(len(names))}).drop("__all")
        for i, (name, cal) in enumerate(zip(names, self.calibrators)):
            out = cal.apply(out, f"__r{i}", name).drop(f"__r{i}").withColumn(name, F.least(F.greatest(F.col(name), F.lit(PROB_FLOOR)), F.lit(PROB_CEIL)))
        return out

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        one = BoostedPriceModel(self.prep, Boosted(self.fitted.front, self.fitted.models[:1]), self.calibrators[:1])
        return one.all_scores(df, [out])


# Settings of the price classifier.
PRICE_SPEC = B.Spec(rounds=300, rate=0.05, leaves=31, least_rows=20)


def fit_monotone_boosted(train: DataFrame, calibration: DataFrame, numeric: Sequence[str], categorical: Sequence[str], price: str, label: str,
                         spec: B.Spec = PRICE_SPEC, resamples: int = 0, key: Sequence[str] = ()) -> BoostedPriceModel:
    """Boosted trees bounded to fall with price, and as many more on Poisson resamples, in one fit; each has its own calibrator."""
    prep = prepare(train, [*numeric, price], categorical, clip=list(numeric))
    falling = replace(spec, falling=(len(numeric),))  # the price is the last number
    fitted = fit_boosted(train, prep, [falling, *[replace(falling, resample=i) for i in range(resamples)]], label, key)
    raw = durable(fitted.scores(calibration, prep, "__all").select(F.col(label).alias("__y"), "__all"))
    return BoostedPriceModel(prep, fitted, [Calibrator().fit(raw.select("__y", F.col("__all")[i].alias("raw")), "raw", "__y") for i in range(resamples + 1)])


def score_interval(model: BoostedPriceModel, calibration: DataFrame, target: DataFrame, label: str, out: str = "p") -> DataFrame:
    """``target`` with the score, ci_low and ci_high: the union of two uncertainties.

    One is the 5th to 95th percentile of the resampled models' scores of the row, which widens for unusual rows; the other
    the Wilson interval of the win rate among calibration rows of about that score, which widens where there are few.
    """
    names = [f"__b{i}" for i in range(1, len(model.calibrators))]
    bands = sorted(M.calibration_bands(durable(model.score(calibration, out)), label, out).collect(), key=lambda r: r["lower"])  # at most ten bins
    rows = durable(model.all_scores(target, [out, *names]))
    ordered = F.array_sort(F.array(*names))
    n = len(names)

    def at(q: float) -> Column:
        pos = q * (n - 1)
        lo, hi = int(pos), min(int(pos) + 1, n - 1)
        return F.get(ordered, F.lit(lo)) + (F.get(ordered, F.lit(hi)) - F.get(ordered, F.lit(lo))) * (pos - int(pos))

    low, high = F.least(F.col(out), at(CI_LOW)), F.greatest(F.col(out), at(CI_HIGH))
    if bands:
        place = F.lit(0)
        for i, r in enumerate(bands[1:], 1):
            place = F.when(F.col(out) >= r["lower"], i).otherwise(place)
        pick = lambda name: F.array(*[F.lit(float(r[name])) for r in bands])[place]
        low, high = F.least(low, pick("ci_low")), F.greatest(high, pick("ci_high"))
    zero_to_one = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return rows.withColumns({"ci_low": zero_to_one(low), "ci_high": zero_to_one(high)}).drop(*names)


# --- price band -------------------------------------------------------------
@dataclass
class PriceBandModel:
    """Boosted trees for each quartile of the price ratio, and the empirical quartiles of each group."""
    prep: Prepared
    fitted: Boosted
    empirical: DataFrame
    overall: tuple[float, float, float]
    served: str
    metrics: dict[str, float]

    def fitted_band(self, df: DataFrame) -> DataFrame:
        return self.fitted.scores(df, self.prep, "__q").withColumns({c: F.col("__q")[i] for i, c in enumerate(QUARTILES)}).drop("__q")

    def empirical_band(self, df: DataFrame, group: str) -> DataFrame:
        tagged = df.withColumn("__g", F.col(group).cast("string"))
        j = join_on(tagged, self.empirical, ["__g"]).drop("__g")
        return j.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in zip(("q25", "q50", "q75"), self.overall)})

    def serve(self, df: DataFrame, group: str) -> DataFrame:
        band = self.fitted_band(df) if self.served == "fitted" else self.empirical_band(df, group)
        lo, hi = (F.lit(v) for v in RATIO_CLAMP)
        s = F.transform(F.array_sort(F.array("q25", "q50", "q75")), lambda x: F.least(F.greatest(x, lo), hi))
        band = band.withColumn("__s", s)
        names = ("ratio_low", "ratio_mid", "ratio_high")
        out = band.withColumns({n: F.col("__s")[i] for i, n in enumerate(names)})
        out = out.withColumns({f"recommended_price_{n[6:]}": F.col("unitPrice") * F.col(n) for n in names})
        return out.withColumn("served_mode", F.lit(self.served)).drop("__s", "q25", "q50", "q75")


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _band_metrics(df: DataFrame, target: str) -> dict[str, float]:
    y = F.col(target)
    pins = [M.pinball(y, F.col(c), q) for c, q in QUARTILES.items()]
    r = df.agg(M.coverage(y, F.col("q25"), F.col("q75")).alias("coverage"), ((pins[0] + pins[1] + pins[2]) / 3).alias("pinball"),
               F.avg(F.abs(y - F.col("q50"))).alias("mae")).first()
    return r.asDict()


# Settings of the quartile models.
BAND_SPEC = B.Spec(objective="quantile", rounds=400, rate=0.05, leaves=31, least_rows=30)


def fit_price_band(train: DataFrame, test: DataFrame, numeric: Sequence[str], categorical: Sequence[str], group: str,
                   target: str = "price_ratio", spec: B.Spec = BAND_SPEC) -> PriceBandModel:
    """Boosted quartiles by pinball loss against the empirical ones per group; the fitted are served only if no worse in both measures."""
    prep = prepare(train, numeric, categorical)
    fitted = fit_boosted(train, prep, [replace(spec, alpha=a) for a in QUARTILES.values()], target)
    emp = exact_quantiles(train.withColumn("__g", F.col(group).cast("string")), ["__g"], target, QUARTILES)
    g = exact_quantiles(train, [], target, QUARTILES).first()
    model = PriceBandModel(prep, fitted, emp, (g["q25"], g["q50"], g["q75"]), "empirical", {})
    a = _band_metrics(model.fitted_band(test), target)
    b = _band_metrics(model.empirical_band(test, group), target)
    model.served = "fitted" if a["coverage"] >= b["coverage"] and a["pinball"] <= b["pinball"] else "empirical"
    model.metrics = a | {f"empirical_{k}": v for k, v in b.items()}
    return model


# --- evaluation -------------------------------------------------------------
def evaluate(df: DataFrame, label: str, p: str) -> DataFrame:
    """All probability metrics of one score column as a single row."""
    one = M.confusion(df, label, p)
    for part in _measures(df, label, p):
        cols = part.columns
        packed = part.select(F.struct(*cols)).scalar()
        one = one.withColumns({c: packed.getField(c) for c in cols})
    return one


def _measures(df: DataFrame, label: str, p: str, groups: Sequence[str] = ()) -> list[DataFrame]:
    y = F.col(label).cast("double")
    return [M.rank_metrics(df, label, p, groups), M.expected_calibration_error(df, label, p, groups),
            df.groupBy(*groups).agg(M.brier(y, F.col(p)).alias("brier"), F.count(F.lit(1)).alias("n_test"))]


def evaluate_each(df: DataFrame, scores: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The metrics of several score columns, (name, label, score) each, with the name as ``score``: the rows are read and ranked once for all of them."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("score"), F.col(label).cast("int").alias("y"), F.col(p).cast("double").alias("p")) for name, label, p in scores]))
    long = df.select(each.alias("e")).select("e.*")
    out = df.sparkSession.createDataFrame([(name,) for name, _, _ in scores], "score string")
    for part in (M.confusion(long, "y", "p", groups=["score"]), *_measures(long, "y", "p", ["score"])):
        out = out.join(F.broadcast(part), "score", "left")  # one row for each score
    return out.withColumn("n_test", F.coalesce("n_test", F.lit(0).cast("bigint")))
