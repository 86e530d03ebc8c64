"""Boosted trees against a plain version that looks at every row for every split."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnworks.operators import boosting as B


def _data(n=500, seed=0):
    rnd = np.random.default_rng(seed)
    x = np.stack([rnd.normal(size=n), rnd.integers(0, 5, size=n), rnd.random(n), np.zeros(n)], axis=1).round(2)
    y = (rnd.random(n) < 1 / (1 + np.exp(-(x[:, 0] - (x[:, 1] - 2) * x[:, 2])))).astype(float)
    return x, y, rnd.integers(-(1 << 62), 1 << 62, size=n)


def _frame(spark, x, y, ids):
    return spark.createDataFrame([(a.tolist(), float(b), int(c)) for a, b, c in zip(x, y, ids)], "x array<double>, y double, h long").repartition(3)


def _quantile(values, w, alpha):
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(w[order])
    return values[order][min(np.searchsorted(upto, alpha * upto[-1] - 1e-9), len(values) - 1)]


def _plain(spec, bins, y, ids):
    """Start value and trees as nested (feature, cut, left, right) or leaf values."""
    w = B.weights(spec, ids)
    if spec.objective == "log_loss":
        start = float(np.log((w @ y) / (w.sum() - w @ y)))
    else:
        start = _quantile(y[w > 0], w[w > 0], spec.alpha)
    score, trees = np.full(len(y), start), []
    for _ in range(spec.rounds):
        if spec.objective == "log_loss":
            p = 1 / (1 + np.exp(-score))
            g, h = (p - y) * w, p * (1 - p) * w
        else:
            g, h = np.where(y < score, 1 - spec.alpha, -spec.alpha) * w, w

        def best(rows, low, high, depth):
            value = lambda m: float(np.clip(-g[m].sum() / (h[m].sum() + spec.l2), low, high))
            cost = lambda m, v: 2 * g[m].sum() * v + (h[m].sum() + spec.l2) * v * v
            found = (1e-12, None)
            for j in range(bins.shape[1]):
                for cut in range(int(bins[:, j].max()) + 1):
                    a, b = rows & (bins[:, j] <= cut), rows & (bins[:, j] > cut)
                    if min(w[a].sum(), w[b].sum()) < spec.least_rows or min(h[a].sum(), h[b].sum()) < spec.least_hessian or depth >= spec.depth:
                        continue
                    va, vb = value(a), value(b)
                    if j in spec.falling and va < vb:
                        continue
                    gain = cost(rows, value(rows)) - cost(a, va) - cost(b, vb)
                    if gain > found[0] + 1e-9:
                        found = (gain, (j, cut, a, b, (va + vb) / 2))
            return found

        nodes = [{"rows": np.ones(len(y), bool), "low": -np.inf, "high": np.inf, "depth": 0}]
        nodes[0]["best"] = best(nodes[0]["rows"], -np.inf, np.inf, 0)
        for _ in range(spec.leaves - 1):
            leaves = [n for n in nodes if "feature" not in n and n["best"][1]]
            if not leaves:
                break
            node = max(leaves, key=lambda n: n["best"][0])
            j, cut, a, b, middle = node["best"][1]
            node["feature"], node["cut"], node["kids"] = j, cut, []
            for rows, is_left in ((a, True), (b, False)):
                low, high = node["low"], node["high"]
                if j in spec.falling:
                    low, high = (max(low, middle), high) if is_left else (low, min(high, middle))
                kid = {"rows": rows, "low": low, "high": high, "depth": node["depth"] + 1}
                kid["best"] = best(rows, low, high, kid["depth"])
                node["kids"].append(kid)
                nodes.append(kid)

        def told(n):
            if "feature" in n:
                return (n["feature"], n["cut"], told(n["kids"][0]), told(n["kids"][1]))
            m = n["rows"]
            if spec.objective == "log_loss":
                v = float(np.clip(-g[m].sum() / (h[m].sum() + spec.l2), n["low"], n["high"])) * spec.rate
            else:
                v = _quantile((y - score)[m & (w > 0)], w[m & (w > 0)], spec.alpha) * spec.rate
            n["value"] = v
            return v

        trees.append(told(nodes[0]))
        for n in nodes:
            if "feature" not in n:
                score[n["rows"]] += n["value"]
    return start, trees, score


def _told(tree, node=0):
    if tree.feature[node] < 0:
        return tree.value[node]
    return (tree.feature[node], tree.cut[node], _told(tree, tree.left[node]), _told(tree, tree.right[node]))


def _alike(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return a[:2] == b[:2] and _alike(a[2], b[2]) and _alike(a[3], b[3])
    return not isinstance(a, tuple) and not isinstance(b, tuple) and a == pytest.approx(b, abs=1e-9)


def test_trees_equal_the_plain_version(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 150)
    monkeypatch.setattr(B, "KEEP_EVERY", 2)
    x, y, ids = _data()
    base = B.Spec(rounds=5, rate=0.3, leaves=7, least_rows=12)
    specs = [base, replace(base, leaves=64, depth=3, l2=1.0, least_hessian=3.0), replace(base, falling=(0,)), replace(base, resample=4), replace(base, fold=(1, 3)),
             replace(base, objective="quantile", alpha=0.25, rounds=3), replace(base, objective="quantile", alpha=0.5, resample=2, rounds=3)]
    target = np.where(np.arange(len(y)) % 2 == 0, y, x[:, 0] + x[:, 2])
    for rows, own in ((y, [s for s in specs if s.objective == "log_loss"]), (target, [s for s in specs if s.objective == "quantile"])):
        models = B.fit(_frame(spark, x, rows, ids), own, bins=16)
        bins = B.binned(x, models[0].edges)
        for spec, model in zip(own, models, strict=True):
            start, trees, score = _plain(spec, bins, rows, ids)
            assert model.start == pytest.approx(start) and len(model.trees) == len(trees)
            assert all(_alike(_told(a), b) for a, b in zip(model.trees, trees)), spec
            assert np.allclose(model.raw(x), score)


def test_resample_is_a_fit_with_its_weights(spark):
    """A model of a joint fit is the model of its own fit."""
    x, y, ids = _data(300, 3)
    df = _frame(spark, x, y, ids)
    specs = [B.Spec(rounds=4, rate=0.3, leaves=6, least_rows=5, resample=i) for i in range(3)]
    joint = B.fit(df, specs)
    alone = B.fit(df, [specs[2]])[0]
    assert np.allclose(joint[2].raw(x), alone.raw(x)) and not np.allclose(joint[0].raw(x), alone.raw(x))
    assert abs(B.weights(specs[0], _data(20_000)[2]).mean() - 1) < 0.03


def test_scores_fall_and_columns_match(spark):
    x, y, ids = _data(400, 5)
    models = B.fit(_frame(spark, x, y, ids), [B.Spec(rounds=20, rate=0.3, least_rows=5, falling=(0, 2))])
    grid = np.repeat(x[:40], 30, axis=0)
    for j in (0, 2):
        swept = grid.copy()
        swept[:, j] = np.tile(np.linspace(-3, 3, 30), 40)
        assert (np.diff(models[0].predict(swept).reshape(40, 30), axis=1) <= 1e-12).all()
    rows = _frame(spark, x, y, ids).select("x", B.score(models).alias("s")).collect()
    assert np.allclose([r.s[0] for r in rows], models[0].predict(np.array([r.x for r in rows])))


def test_few_rows(spark):
    df = _frame(spark, np.array([[1.0], [2.0]]), [0.0, 1.0], [1, 2])
    assert B.fit(df, [B.Spec(rounds=2)])[0].predict(np.array([[1.0]]))[0] == pytest.approx(0.5)
    with pytest.raises(ValueError, match="no rows"):
        B.fit(df.limit(0), [B.Spec(rounds=1)])
    assert df.limit(0).select(B.score([]).alias("s")).collect() == []


def test_order_of_doubles():
    v = np.array([-np.inf, -2.5, -1e-300, -0.0, 0.0, 3e-310, 7.0, np.inf])
    keys = B._ordered(v)
    assert (np.diff(keys.astype(object)) >= 0).all() and [B._double(int(k)) for k in keys] == [*v[:3], 0.0, 0.0, *v[5:]]


def test_only_splits_reach_the_driver(spark, monkeypatch):
    """What a pass brings to the driver depends on models and leaves, neither on tasks nor on bins."""
    import pickle

    from pyspark import RDD
    x, y, ids = _data(600, 9)
    got, collect = [], RDD.collect

    def counted(rdd):
        out = collect(rdd)
        got.append(len(pickle.dumps(out)))
        return out

    monkeypatch.setattr(RDD, "collect", counted)
    monkeypatch.setattr(B, "BLOCK_ROWS", 50)
    monkeypatch.setattr(B, "TASK_ROWS", 50, raising=False)
    base = B.Spec(rounds=2, rate=0.3, leaves=8, least_rows=10)
    models = B.fit(_frame(spark, x, y, ids).repartition(12), [base, replace(base, objective="quantile", alpha=0.5)])
    assert all(len(m.trees) == 2 for m in models) and max(got) < 6000


def test_quantile_of_crowded_and_of_few_residuals(spark, monkeypatch):
    """The exact quantile is found by digits alone, by the residuals themselves, and where most residuals are equal."""
    x, _, ids = _data(400, 11)
    y = np.where(np.arange(400) % 3 == 0, x[:, 0], 1.0)
    for few in (0, 10, 10_000):
        monkeypatch.setattr(B, "FEW", few, raising=False)
        model = B.fit(_frame(spark, x, y, ids), [B.Spec("quantile", alpha=0.2, rounds=1, leaves=3, least_rows=20)])[0]
        assert model.start == _quantile(y, np.ones(400), 0.2)
