"""Hand-checked delay cases."""

import json
import math

import pytest
from pyspark.sql import functions as F

from kilnworks.functions import delay as D
from kilnworks.functions.rounding import exact_round, fixed
from kilnworks.operators import graph as R
from kilnworks.operators.delay import job_documents, lead_time_ratio


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def lit(x):
    return F.lit(x).cast("double")


def test_time_overrun(spark):
    got = spark.createDataFrame([(350.0, 480.0, 60.0, 100.0), (600.0, 480.0, 60.0, 100.0), (0.0, 480.0, 60.0, 100.0), (9.0, 480.0, 0.0, 100.0)],
                                "a double, e double, d double, q double").select(
        D.time_overrun(F.col("a"), F.col("e"), F.col("d"), F.col("q")).alias("r"),
        D.predicted_overrun_hours(F.col("a"), F.col("e"), F.col("d"), F.col("q"), lit(None)).alias("h")).collect()
    assert got[0]["r"] == pytest.approx(1.2153, abs=1e-4)
    assert got[1]["h"] == pytest.approx(8.6667, abs=1e-4)
    assert got[2]["r"] is None and got[3]["r"] is None and got[3]["h"] is None


def test_shortfall_and_weights(spark):
    assert one(spark, D.shortfall(lit(100.0), lit(40.0))) == 2.5
    assert math.isinf(one(spark, D.shortfall(lit(100.0), lit(0.0))))
    assert one(spark, D.shortfall(lit(10.0), lit(10.0))) is None
    w = {"time_overrun_ratio": 0.4387, "operator_pace_ratio": 0.3387, "material_shortfall_ratio": 0.1148, "supplier_reliability": 0.03}
    v = dict(zip(w, map(lit, (2.6667, 1.4, 1.3333, 1.5))))
    assert one(spark, D.composite(v, w)) == pytest.approx(1.99752, abs=1e-4)
    v["operator_pace_ratio"] = lit(None)
    assert one(spark, D.composite(v, w)) == pytest.approx((0.4387 * 2.6667 + 0.1148 * 1.3333 + 0.03 * 1.5) / (0.4387 + 0.1148 + 0.03))
    assert one(spark, D.composite({k: lit(None) for k in w}, w)) is None


@pytest.mark.parametrize("base, cascade, want", [(0.8, 1.3, 1.3), (1.8, 1.3, 2.1), (None, 1.3, 1.3), (0.8, None, 0.8)])
def test_overlay(spark, base, cascade, want):
    assert one(spark, D.overlay(lit(base), lit(cascade))) == pytest.approx(want)


def test_vendor_ratio(spark):
    df = spark.sql("""SELECT array(named_struct('ordered', TIMESTAMP'2024-08-01', 'deadline', TIMESTAMP'2024-08-15', 'received', TIMESTAMP'2024-08-22'),
        named_struct('ordered', TIMESTAMP'2024-08-01', 'deadline', TIMESTAMP'2024-08-01', 'received', TIMESTAMP'2024-08-22')) AS h""")
    assert df.select(lead_time_ratio(F.col("h")).alias("r")).first()["r"] == 1.5


@pytest.fixture(scope="module")
def cpm(spark):
    ops = spark.createDataFrame([("j", "a", 100.0), ("j", "b", 50.0), ("j", "c", 20.0), ("j", "d", 20.0), ("j", "e", 10.0),
                                 ("x", "a", 5.0), ("x", "b", 5.0), ("z", "a", 1.0), ("z", "a", 2.0)], "job_id string, operation_id string, expected double")
    edges = spark.createDataFrame([("j", "b", "a"), ("j", "d", "c"), ("j", "e", "nowhere"), ("x", "a", "b"), ("x", "b", "a")],
                                  "job_id string, operation_id string, pred_id string")
    return R.critical_path(ops, edges)


def test_critical_path(cpm):
    rows = {(r["job_id"], r["operation_id"]): r for r in cpm[0].collect()}
    assert rows["j", "a"]["project_minutes"] == 150 and rows["j", "a"]["critical"] and rows["j", "b"]["critical"]
    assert rows["j", "d"]["float_minutes"] == 110 and not rows["j", "d"]["critical"]
    assert not rows["x", "a"]["valid"] and rows["x", "a"]["earliest_start"] is None and not rows["z", "a"]["valid"]


def test_cascade_follows_critical_edges_only(spark, cpm):
    own = spark.createDataFrame([("j", "a", 1.30), ("j", "c", 2.0), ("x", "a", 9.0)], "job_id string, operation_id string, ratio double")
    got = [tuple(r) for r in R.cascade(cpm[1], own).select("job_id", "operation_id", "ratio", "source_id").collect()]
    assert got == [("j", "b", 1.3, "a")]


def test_fixed_point_text_matches_exact_binary_rounding(spark):
    values = [0.25, 0.15, 0.35, 2.675, 0.125, -0.04, 1.005, 7.75, 9.999, 0.0, 1234.5675]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", fixed(F.col("v"), 1).alias("one"), fixed(F.col("v"), 2).alias("two"), exact_round(F.col("v"), 2).alias("r")).collect()
    for r in got:
        assert (r["one"], r["two"], r["r"]) == (f"{r['v']:.1f}", f"{r['v']:.2f}", round(r["v"], 2))


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """A chain of 1,000 operations with a second way round, and a job with a cycle."""
    from kilnworks.operators import graph as R
    n = 1000
    rows = [("c", f"o{i}", float(i % 7)) for i in range(n)] + [("c", "side", 3000.0)] + [("y", f"k{i}", 1.0) for i in range(5)]
    links = [("c", f"o{i}", f"o{i - 1}") for i in range(1, n)] + [("c", "o900", "side")] + [("y", "k1", "k0"), ("y", "k2", "k1"), ("y", "k1", "k2"), ("y", "k4", "k3")]
    written, durable = [0], R.durable

    def counted(df):
        written[0] += 1
        return durable(df)

    monkeypatch.setattr(R, "durable", counted)
    timed, critical = R.critical_path(spark.createDataFrame(rows, "job_id string, operation_id string, expected double"),
                                      spark.createDataFrame(links, "job_id string, operation_id string, pred_id string"))
    got = {(r.job_id, r.operation_id): r for r in timed.collect()}
    assert written[0] <= 30  # eleven rounds of doubling, a few of frontiers
    upto = [sum(float(i % 7) for i in range(k)) for k in range(n + 1)]
    late = max(0.0, 3000.0 - upto[900])
    for i in (0, 1, 500, 899, 900, 999):
        assert got["c", f"o{i}"].earliest_start == upto[i] + (late if i >= 900 else 0)
        assert got["c", f"o{i}"].float_minutes == (late if i < 900 else 0)
    assert got["c", "side"].critical and got["c", "o0"].project_minutes == upto[n] + late
    assert not any(got["y", f"k{i}"].valid for i in range(5))
    assert {(r.operation_id, r.pred_id) for r in critical.collect()} >= {("o900", "side"), ("o999", "o998")}


def test_jobs_as_rows_agree_with_rounds(spark, monkeypatch):
    """Random jobs, some with cycles, repeated or empty ids, give the same times and cascades as rows and in rounds; as rows they are written twice for each."""
    import random
    rng = random.Random(11)
    ops = [(j, f"o{i}", float(rng.randrange(6))) for j in range(40) for i in range(rng.randrange(1, 9))]
    ops += [(1, "o0", 3.0), (2, "", 1.0), (3, None, 1.0), (None, "o1", 1.0), (4, "n", float("nan"))]
    links = [(rng.randrange(40), f"o{a}", f"o{b}") for a, b in ((rng.randrange(1, 9), rng.randrange(9)) for _ in range(300)) if b < a or rng.random() < 0.05] + [(None, "o1", "o1"), (5, None, "o0")]
    own = [(j, o, rng.choice([1.0, 1.3, 1.3, 2.0, float("inf"), float("nan"), None])) for j, o, _ in ops]
    made = [spark.createDataFrame(rows, f"job_id long, {cols}").cache() for rows, cols in (
        (ops, "operation_id string, expected double"), (links, "operation_id string, pred_id string"), (own, "operation_id string, ratio double"))]
    written, durable, seen = [0], R.durable, []

    def counted(df):
        written[0] += 1
        return durable(df)

    monkeypatch.setattr(R, "durable", counted)
    for most in (32, 0):
        monkeypatch.setattr(R, "SMALL_JOB", most)
        monkeypatch.setattr(R, "SMALL_LINKS", 1024 if most else 0)
        written[0] = 0
        timed, critical = R.critical_path(made[0], made[1])
        worst = R.cascade(critical, made[2])
        if most:
            assert written[0] == 4
        seen.append([sorted(map(str, df.collect())) for df in (timed, critical, worst)])
    assert seen[0] == seen[1] and all(seen[0])


def documents(spark):
    rows = [(1, f"1-{i}", "Cut" if i % 2 else None, "DEPENDENT", "DONE", 60.0, 50.5 if i % 3 else None, 10.0, 4.0, ops)
            for i, ops in ((1, [7]), (2, [7, 8]), (2, [7, 8]), (3, []), (4, None), (5, [8, None]), (10, [9]))]
    rows += [(2, "2-1", "Weld", "INDEPENDENT", "PENDING", 30.0, None, 5.0, 0.0, [8]), (None, "x-1", "Weld", "INDEPENDENT", "PENDING", 30.0, None, 5.0, 0.0, [8])]
    wo = spark.createDataFrame(rows, "job_id long, operation_id string, operation_name string, operation_type string, status string, expected double, actual double, "
                                     "job_quantity double, done_quantity double, operators array<long>")
    edges = spark.createDataFrame([(1, "1-2", "1-1"), (1, "1-3", "1-2"), (1, "1-3", "1-1"), (1, "1-3", "1-1")], "job_id long, operation_id string, pred_id string")
    entry = "array<struct<rn:int,operation_id:string,elapsed_minutes:bigint,scheduled_minutes:double>>"
    history = spark.createDataFrame([(7, [(1, "1-1", 40, 60.0), (2, "1-2", 20, 60.0)]), (8, [(1, "1-2", 9, 60.0)])], f"operator_id long, history {entry}")
    parts = spark.createDataFrame([(1, f"1-{i}", i, "bolt", 4.0, 2.0, None) for i in (3, 1, 2, 2)], "job_id long, lid string, component_id long, name string, required double, available double, vendor_name string")
    return job_documents(wo, edges, history, parts, part_size=3)


def test_documents_of_a_job(spark):
    got = {(r["job_id"], r["section"], r["part"]): json.loads(r["document"]) for r in documents(spark).collect()}
    assert {k: [e["operation_id"] for e in v] for k, v in got.items() if k[1] == "operations"} == {
        (1, "operations", 0): ["1-1", "1-10", "1-2", "1-2"], (1, "operations", 1): ["1-3", "1-4"], (1, "operations", 2): ["1-5"], (2, "operations", 0): ["2-1"]}
    seven, eight = [{"operation_id": "1-1", "elapsed_minutes": 40, "scheduled_minutes": 60}, {"operation_id": "1-2", "elapsed_minutes": 20, "scheduled_minutes": 60}], [
        {"operation_id": "1-2", "elapsed_minutes": 9, "scheduled_minutes": 60}]
    named = lambda e: None if e["operators"] is None else [(o["operator_id"], o["last_10_work_orders"]) for o in e["operators"]]
    first, second = got[1, "operations", 0], got[1, "operations", 1] + got[1, "operations", 2]
    # both rows of an operation name the operators of either
    assert [named(e) for e in first] == [[(7, seven)], [(9, None)], [(7, seven), (7, seven), (8, eight), (8, eight)], [(7, seven), (7, seven), (8, eight), (8, eight)]]
    assert [named(e) for e in second] == [None, None, [(None, None), (8, eight)]]
    assert [e["operator_count"] for e in first] == [1, 1, 2, 2] and [e["depends_on_operation_ids"] for e in second] == [["1-1", "1-2"], [], []]
    assert first[0] | {"operators": 0} == {"operation_id": "1-1", "operation_name": "Cut", "operation_type": "DEPENDENT", "status": "DONE", "depends_on_operation_ids": [],
                                           "expected_duration_minutes": 60, "actual_duration_minutes": 50, "job_quantity": 10, "current_done_quantity": 4, "operator_count": 1, "operators": 0}
    assert [e["component_id"] for p in (0, 1) for e in got.get((1, "components", p), [])] == [1, 2, 2, 3]


def test_last_orders_are_shuffled_once(spark):
    """Behind the join with the operators' last orders they were shuffled three times (F13)."""
    lines = documents(spark)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-*(0123456789)!")) for line in lines]
    at = next(i for i, line in enumerate(lines) if "Join" in line and "operator_id" in line)
    above, upto = [], depth[at]
    for line, d in zip(lines[at - 1::-1], depth[at - 1::-1]):
        if d < upto:
            above, upto = [*above, line], d
    assert sum("Exchange" in line for line in above) == 1
