"""Models that grow in one task beside those that grow in passes over the cluster."""

from dataclasses import replace

import numpy as np
import pytest

from kilnworks.operators import boosting as B
from tests.test_boosting import _alike, _data, _frame, _plain, _told


def _hot(x, seed=1):
    """With five more features, of which one is at one in each row."""
    kind = np.random.default_rng(seed).integers(0, 5, size=len(x))
    return np.concatenate([x, np.eye(5)[kind]], axis=1), kind


def _specs():
    base = B.Spec(rounds=4, rate=0.3, leaves=9, least_rows=12)
    return [base, replace(base, leaves=64, depth=3, l2=1.0, least_hessian=3.0), replace(base, falling=(0,)), replace(base, resample=4), replace(base, fold=(1, 3)),
            replace(base, objective="quantile", alpha=0.25, rounds=3), replace(base, objective="quantile", alpha=0.5, resample=2, rounds=3)]


@pytest.mark.parametrize("most", [0, 10_000])
def test_both_ways_equal_the_plain_version(spark, monkeypatch, most):
    monkeypatch.setattr(B, "WHOLE_ROWS", most, raising=False)
    monkeypatch.setattr(B, "BLOCK_ROWS", 150)
    x, y, ids = _data(500, 21)
    x, kind = _hot(x)
    y = np.where(kind == 2, 1.0, y)
    for spec in (_specs()[0], _specs()[5]):
        target = y if spec.objective == "log_loss" else x[:, 0] + x[:, 2] + kind
        model = B.fit(_frame(spark, x, target, ids), [spec], bins=16)[0]
        start, trees, score = _plain(spec, B.binned(x, model.edges), target, ids)
        assert model.start == pytest.approx(start) and all(_alike(_told(a), b) for a, b in zip(model.trees, trees, strict=True))
        assert np.allclose(model.raw(x), score)


def test_one_task_agrees_with_passes(spark, monkeypatch):
    x, y, ids = _data(900, 22)
    x, _ = _hot(x)
    df = _frame(spark, x, y, ids).cache()
    specs = _specs()
    whole = B.fit(df, specs)
    monkeypatch.setattr(B, "WHOLE_ROWS", 0, raising=False)
    for a, b in zip(whole, B.fit(df, specs), strict=True):
        assert a.start == pytest.approx(b.start) and np.allclose(a.raw(x), b.raw(x)), a.spec


def test_few_rows_take_few_jobs(spark):
    """Each level of each tree was a job of its own over the cluster (F6, F11)."""
    x, y, ids = _data(400, 23)
    df = _frame(spark, x, y, ids)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few rows", "")
    try:
        B.fit(df, [B.Spec(rounds=10, rate=0.3, leaves=8, least_rows=10)])
        assert len(tracker.getJobIdsForGroup("few rows")) < 15
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_features_of_a_category_are_summed_as_one():
    kind = np.arange(60) % 4
    bins = np.stack([*np.eye(4, dtype=np.uint8)[kind].T, (np.arange(60) % 2).astype(np.uint8), (np.arange(60) % 7).astype(np.uint8)])
    sizes = [2] * 5 + [7]
    groups = B._groups(B._together(bins, sizes), sizes)
    assert sorted(groups) == [[0, 1, 2, 3], [4], [5]]
    v = np.random.default_rng(0).random(60)
    want = np.concatenate([np.bincount(b, v, n) for b, n in zip(bins, sizes)])
    assert np.allclose(B._Whole(B.Spec(), bins, np.zeros(60), np.arange(60), sizes, groups).sums(None, [v, np.ones(60)])[0], want)
