"""Level prefixes, exact quantiles and as-of totals against brute force, with one key holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnworks.operators import asof, metrics, split
from kilnworks.operators.scale import exact_quantiles, id_levels, integer_levels, prefix_sums, rank_within, real_levels, text_levels, top_per_key


@pytest.fixture(scope="module")
def hot(spark):
    """Two of three rows sit on one key, and many of them share an instant."""
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.66 else f"k{rng.randrange(9)}", rng.randrange(40), rng.choice([0.0, 1.0, None]),
             rng.choice([-2.5, 0.0, 0.1, 1e-7, 3.0, 1e9]) * rng.random()) for i in range(900)]
    return rows, spark.createDataFrame(rows, "id bigint, k string, day int, won double, x double").withColumn(
        "d", F.date_add(F.lit("2020-01-01").cast("date"), F.col("day"))).repartition(4).cache()


def test_prior_totals_equal_theta_join(hot):
    rows, df = hot
    got = {r["id"]: (r["prior_w_s"], r["prior_w_n"]) for r in asof.prior_totals(
        df, ["k"], "d", asof.value_and_count("w", F.col("won"))).collect()}
    for i, k, day, _w, _x in rows:
        before = [w for _i, k2, d2, w, _x2 in rows if k2 == k and d2 < day and w is not None]
        assert got[i] == (sum(before), len(before))


def test_two_clock_prior_never_sees_equal_instants(spark):
    ev = spark.createDataFrame([("a", "2020-01-01 00:00:01", 1.0), ("a", "2020-01-01 00:00:02", 1.0), ("b", "2020-01-01 00:00:01", 1.0)],
                               "k string, t string, w double").withColumn("t", F.col("t").cast("timestamp"))
    pr = spark.createDataFrame([(1, "a", "2020-01-01 00:00:02"), (2, "a", "2020-01-01 00:00:03"), (3, "b", "2020-01-01 00:00:01"), (4, "c", "2021-01-01 00:00:00")],
                               "id int, k string, c string").withColumn("c", F.col("c").cast("timestamp"))
    out = asof.two_clock_prior(pr, ev, ["k"], "c", "t", {"n": F.lit(1)})
    assert {r["id"]: r["prior_n"] for r in out.collect()} == {1: 1.0, 2: 2.0, 3: 0.0, 4: 0.0}


@pytest.mark.parametrize("levels, order", [
    (lambda: real_levels(F.col("x")), lambda r: r[4]), (lambda: integer_levels(F.col("id") * 1_000_003), lambda r: r[0])])
def test_prefix_order_is_value_order(hot, levels, order):
    rows, df = hot
    n = len(levels())
    got = prefix_sums(df, [], levels(), {"rows": F.lit(1)}).orderBy(f"_l{n - 1}").collect()
    seen = 0
    for r in got:
        assert r["rows_before"] == seen
        seen += r["rows"]
    assert seen == len(rows)


def test_text_levels_give_a_total_order(hot):
    rows, df = hot
    got = prefix_sums(df, [], text_levels(F.col("id")), {"rows": F.lit(1)})
    assert sorted(r["rows_before"] for r in got.collect()) == list(range(len(rows)))


def test_exact_quantiles_interpolate(hot):
    rows, df = hot
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "x", {"q": 0.3, "top": 1.0}).collect()}
    for k in {r[1] for r in rows}:
        xs = sorted(r[4] for r in rows if r[1] == k)
        pos = 0.3 * (len(xs) - 1)
        lo = int(pos)
        want = xs[lo] + (xs[min(lo + 1, len(xs) - 1)] - xs[lo]) * (pos - lo)
        assert got[k]["q"] == pytest.approx(want, rel=1e-12, abs=1e-15) and got[k]["top"] == xs[-1]


def test_auc_counts_ties_half(hot):
    rows, df = hot
    ok = [(w, round(x, 1)) for _i, _k, _d, w, x in rows if w is not None]
    wins = sum((p > n) + 0.5 * (p == n) for w, p in ok if w == 1 for v, n in ok if v == 0)
    want = wins / (sum(w == 1 for w, _ in ok) * sum(w == 0 for w, _ in ok))
    got = metrics.roc_auc(df.withColumn("p", F.round("x", 1)), "won", "p").first()["auc"]
    assert got == pytest.approx(want, rel=1e-3)


def test_top_per_key_limits_before_the_shuffle(hot):
    _rows, df = hot
    plan = top_per_key(df, ["k"], [F.desc("x")], 3)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 1


def test_value_levels_stay_balanced(spark):
    """Values far below one, and values close together, spread over many cells, in order."""
    tiny = [1e-7 * (1 + k / 50_000) * (-1) ** k for k in range(50_000)] + [0.0, -0.0, 5e-324, 1e308, float("inf"), float("-inf"), 2.0, 4.0 - 4e-16]
    close = [1e6 + k * 1e-3 for k in range(50_000)]
    for values in (tiny, close):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        a, b, c = real_levels(F.col("v"))
        rows = df.select(a.alias("a"), b.alias("b"), c.alias("c")).distinct().collect()
        assert sorted(rows, key=lambda r: r.c) == sorted(rows)
        assert len({(r.a, r.b) for r in rows}) > 100 and max(sum(1 for r in rows if r.a == x) for x in {r.a for r in rows}) <= 50_000


def test_text_levels_follow_the_text(spark):
    ids = [f"SKU-000{k:06d}" for k in range(0, 3000, 7)] + ["SKU-", "SKU-0009", "SKU-é"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    levels = id_levels(df, "id")
    assert len(levels) > 2
    got = prefix_sums(df, [], levels, {"rows": F.lit(1)})
    assert [r[0] for r in got.orderBy("rows_before").select(f"_l{len(levels) - 1}").collect()] == sorted(ids)


def test_rows_are_split_within_each_label(spark):
    df = spark.createDataFrame([(k % 4 == 0, "same") for k in range(400)], "won boolean, x string")
    per = {(r.won, r.fold): r.n for r in split.stratified_rows(df, "won").groupBy("won", "fold").agg(F.count("*").alias("n")).collect()}
    assert per == {(True, "train"): 60, (True, "calibration"): 20, (True, "holdout"): 20, (False, "train"): 180, (False, "calibration"): 60, (False, "holdout"): 60}


def test_text_ids_reach_the_header_frame(spark):
    from kilnworks.operators.labels import header_frame
    base = [(f"Q-{k}", None if k % 5 else f"Q-{k + 1}", f"c{k % 3}", f"r{k % 2}", f"2020-01-{1 + k % 28:02d}", ["Closed Won", "Closed Lost"][k % 2], float(k)) for k in range(60)]
    df = spark.createDataFrame(base, "quotationID string, parentQuotationID string, customerID string, salesRepID string, quoteDate string, statusName string, grandTotal double")
    out = header_frame(df.withColumn("quoteDate", F.col("quoteDate").cast("date"))).collect()
    assert out and all(r.quotationID.startswith("Q-") and r.prior_count is not None for r in out)
    assert header_frame(df.drop("parentQuotationID").withColumn("quoteDate", F.col("quoteDate").cast("date"))).count() == 60


def test_nested_non_finite_values_refuse_the_write(spark, tmp_path):
    from kilnworks.sources.files import write_json_records
    for k, bad in enumerate(("named_struct('a', array(1D, double('NaN')))", "map('x', double('Infinity'))", "array(named_struct('b', float('-Infinity')))")):
        with pytest.raises(ValueError, match="non-finite"):
            write_json_records(spark.sql(f"SELECT 1 AS id, {bad} AS v"), f"{tmp_path}/{k}")
    write_json_records(spark.sql("SELECT 1 AS id, named_struct('a', array(1D, NULL)) AS v"), f"{tmp_path}/ok")


@pytest.mark.parametrize("most", [100_000, 100])
def test_rank_within_keys_of_any_size(spark, monkeypatch, most):
    """Ties share a rank, rows without a key go, and keys too large for one window get the same ranks from levels."""
    from kilnworks.operators import scale
    monkeypatch.setattr(scale, "WINDOW_ROWS", most)
    rng = random.Random(5)
    rows = [(None if i % 50 == 0 else 1 if i % 3 else i % 7, rng.choice([None, 1, 2, 3]), f"x{rng.randrange(200)}") for i in range(900)]
    df = spark.createDataFrame(rows, "k long, n int, t string")
    levels = text_levels(F.col("t"))
    got = rank_within(df, "k", {"__n": F.col("n"), "__b": levels[0], "__t": levels[1]}, "at").collect()
    place = {r["t"]: r["d"] for r in df.select("t", F.md5(F.col("t").cast("binary")).alias("d")).collect()}
    order = lambda n, t: (n is not None, n or 0, place[t], t)
    kept = [r for r in rows if r[0] is not None]
    assert sorted((r["k"], order(r["n"], r["t"]), r["at"]) for r in got) == sorted(
        (k, order(n, t), 1 + sum(k2 == k and order(n2, t2) < order(n, t) for k2, n2, t2 in kept)) for k, n, t in kept)
    assert got[0].asDict().keys() == {"k", "n", "t", "at"}


def test_work_orders_are_shuffled_once(spark, tmp_path):
    """Numbering the work orders of a job takes one shuffle by the job, and no join."""
    from kilnworks.sources.proxies import production_tables
    spark.range(90).selectExpr("id div 4 AS l_orderkey", "id * 3 AS l_partkey", "id * 5 AS l_suppkey", "cast(id % 4 + 1 AS int) AS l_linenumber", "2.0D AS l_quantity",
                               "10.0D AS l_extendedprice", "'N' AS l_returnflag", "timestamp'2024-01-01' AS l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(23).selectExpr("id AS o_orderkey", "timestamp'2024-01-01' AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    wo = production_tables(spark, str(tmp_path))["work_orders"]
    assert sorted(r["operation_id"] for r in wo.collect()) == sorted(f"{i // 4}-{i % 4 + 1}" for i in range(90))
    plan = wo._jdf.queryExecution().sparkPlan().toString() + wo._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and wo._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_totals_stand_beside_the_cells_without_a_join_by_group(spark):
    """Quantiles, KS and average precision take a group's total from its levels: no join deals all cells of a group to one task."""
    from kilnworks.operators import metrics as M
    from kilnworks.operators.scale import exact_quantiles
    rows = [(g, float((i * 37) % 101) / 8) for g in ("a", "b", None) for i in range(80 if g else 3)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.m for r in exact_quantiles(df, ["g"], "v", {"m": 0.3}).collect()}
    assert got == {k: pytest.approx(float(np.quantile([v for g, v in rows if g == k], 0.3))) for k in ("a", "b", None)}
    wide = spark.createDataFrame([(float(i % 17), float(i % 5)) for i in range(60)], "x double, z double")
    ks = M.ks_statistic(wide, wide.where("x < 8"), ["x", "z"])
    plan = (exact_quantiles(df, ["g"], "v", {"m": 0.3})._jdf.queryExecution().optimizedPlan().toString(), ks._jdf.queryExecution().optimizedPlan().toString())
    for text in plan:  # only the two joins that hand a level's offsets down
        assert text.count("Join Inner") == 2 and "Join LeftOuter" not in text
    assert {r.feature: round(r.ks, 6) for r in ks.collect()} == {"x": pytest.approx(1 - 32 / 60, abs=1e-6), "z": pytest.approx(_plain_ks([i % 5 for i in range(60)], [i % 5 for i in range(60) if i % 17 < 8]), abs=1e-6)}


def _plain_ks(a, b):
    return max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in a)


def test_scores_evaluated_together_are_those_evaluated_alone(spark):
    from kilnworks.operators import models as ML
    df = spark.createDataFrame([(i % 3 == 0, i % 2, ((i * 37) % 11) / 11, ((i * 13) % 7) / 7) for i in range(90)], "u boolean, y int, p double, q double").withColumn("u", F.col("u").cast("int"))
    each = {r.score: r.asDict() for r in ML.evaluate_each(df, [("one", "y", "p"), ("two", "u", "q")]).collect()}
    for name, y, p in (("one", "y", "p"), ("two", "u", "q")):
        alone = ML.evaluate(df, y, p).first().asDict()
        assert {k: pytest.approx(v) for k, v in alone.items()} == {k: v for k, v in each[name].items() if k != "score"}
    none = ML.evaluate_each(df.limit(0), [("one", "y", "p")]).select("score", "n_test", "brier").collect()
    assert [tuple(r) for r in none] == [("one", 0, None)]
