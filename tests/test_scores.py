"""The score of a logistic model as one expression beside the stages it stands for."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from kilnworks.operators import models as ML


def _fitted(spark):
    rows = [(i, float(i % 7), float(i % 5) * 3, 4.0, "abc"[i % 3] if i % 11 else None, int(i % 7 > 3 or i % 3 == 0)) for i in range(200)]
    train = spark.createDataFrame(rows, "id long, u double, v double, same double, kind string, y int")
    prep = ML.prepare(train, ["u", "v", "same"], ["kind"])
    return train, prep, ML.fit_model(train, prep, LogisticRegression(labelCol="y"))


def test_linear_score_is_that_of_the_stages(spark):
    train, prep, model = _fitted(spark)
    more = spark.createDataFrame([(900, 2.5, None, 4.0, "new", 0), (901, None, 1e9, 5.0, None, 1)], train.schema)
    got = {r.id: r.raw for r in ML.raw_scores(train.union(more), prep, model).select("id", "raw").collect()}
    want = {r.id: r.p for r in model.transform(prep.apply(train.union(more))).select("id", ML.positive().alias("p")).collect()}
    assert got.keys() == want.keys() and len(got) == 202
    assert max(abs(got[k] - want[k]) for k in want) < 1e-12
    # a value that no row of the fit had
    odd = train.limit(1).withColumn("kind", F.lit("never"))
    score = ML.linear_score(model, prep.numeric, prep.categorical)
    a, b = odd.select(score.alias("a")).first().a, model.transform(odd).select(ML.positive().alias("b")).first().b
    assert abs(a - b) < 1e-12


def test_logistic_scores_make_no_vectors(spark):
    train, prep, model = _fitted(spark)
    plan = ML.raw_scores(train, prep, model)._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan


def test_linear_score_refuses_missing_features(spark):
    train, prep, model = _fitted(spark)
    score = ML.linear_score(model, prep.numeric, prep.categorical)
    for bad in (F.lit(None).cast("double"), F.lit(float("nan"))):
        with pytest.raises(Exception, match="null or NaN"):
            train.withColumn("u", bad).select(score.alias("s")).collect()
