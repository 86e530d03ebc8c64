"""Delay signals of jobs as rows beside those by joins, table by table."""

import random

from kilnworks.operators import delay as J
from kilnworks.operators import graph as R

WORK = "job_id long, operation_id string, operation_name string, operation_type string, expected double, actual double, job_quantity double, done_quantity double, operators array<long>"


def _tables(spark):
    rng = random.Random(5)
    ops = [(j, f"o{i}", rng.choice([None, "Cut"]), "DEPENDENT", rng.choice([60.0, 30.0, 0.0, None]), rng.choice([None, 0.0, 40.0, 90.0, 300.0]),
            10.0, rng.choice([0.0, 4.0, 10.0]), rng.choice([None, [], [1], [1, 2], [3, None]])) for j in range(60) for i in range(rng.randrange(1, 8))]
    some = (None, "DEPENDENT", 60.0, 90.0, 10.0, 5.0, [1, 2])
    ops += [(1, "o0", *some), (1, "o0", *some), (2, "", *some), (3, None, *some), (None, "o1", *some)]
    links = [(rng.randrange(60), f"o{a}", f"o{b}") for a, b in ((rng.randrange(1, 8), rng.randrange(8)) for _ in range(500)) if b < a or rng.random() < 0.02]
    links += [(1, "o1", "o0"), (3, None, "o0"), (3, "o1", None), (None, "o1", "o1"), (7, "o1", "nowhere"), (99, "o1", "o0")]
    parts = [(rng.randrange(58), rng.choice([1.0, 5.0]), rng.choice([0.0, 2.0, None]), rng.choice([None, 1.5, 0.5])) for _ in range(120)]
    pace = [(1, 1.25, 3), (2, 0.7, 1), (3, None, 0)]
    return [spark.createDataFrame(rows, kind).cache() for rows, kind in (
        (ops, WORK), (links, "job_id long, operation_id string, pred_id string"),
        (parts, "job_id long, required double, available double, vendor_ratio double"), (pace, "operator_id long, pace double, completed int"))]


def _rows(df):
    names = sorted(df.columns)
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*names).collect())


def test_signals_as_rows_agree_with_joins(spark, monkeypatch):
    """Jobs with cycles, repeated, empty or no ids, and rows of no job, have the same signals by either way."""
    tables = _tables(spark)
    seen = []
    for most in (32, 4, 0):
        monkeypatch.setattr(R, "SMALL_JOB", most)
        monkeypatch.setattr(R, "SMALL_LINKS", 1024 if most else 0)
        seen.append(_rows(J.delay_elements(*tables)))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == tables[0].count() + 6  # three rows of one id match each other


def test_operations_meet_in_one_shuffle_by_job(spark):
    """the operations of small jobs were shuffled for each join, with all their columns."""
    ops, edges, parts, pace = _tables(spark)
    plan = J.delay_elements(ops.filter("job_id IS NOT NULL"), edges, parts, pace)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # the paces of the operators and the materials of the job
