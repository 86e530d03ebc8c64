"""Evidence, lines and checks of a few jobs by hand."""

import pytest
from pyspark.sql import functions as F

from kilnworks.operators import evidence as E
from kilnworks.session import durable

ELEMENTS = ("job_id string, seq bigint, operation_id string, operation_label string, status string, actual double, expected double, mo_progress double, risk_score double, "
            "base_score double, predicted_overrun_hours double, is_delayed boolean, time_overrun_ratio double, operator_pace_ratio double, material_shortfall_ratio double, "
            "supplier_reliability double, critical_path_cascade_ratio double, predecessor_time_overrun_ratio double")
PARTS = "job_id string, lid string, component_id long, name string, required double, available double, vendor_ratio double, vendor_name string"


@pytest.fixture(scope="module")
def review(spark):
    inf = float("inf")
    rows = [("a", 1, "a-1", "Cut", "DONE", 90.0, 60.0, 0.5, 1.6, 1.2, 3.0, True, 1.5, 1.3, 0.5, 1.1, None, None),
            ("a", 2, "a-2", "Weld", "PENDING", None, 60.0, 0.5, 1.5, 1.1, 2.0, True, None, 0.9, 0.5, 1.1, 1.5, 1.5),
            ("b", 1, "b-1", "Cut", "PENDING", 3000.0, 60.0, 0.5, 2.0, 2.0, None, True, None, None, 0.0, None, None, 1.5),
            ("c", 1, "c-1", "Cut", "DONE", 90.0, 60.0, 0.1, inf, inf, 1.0, True, 1.5, None, inf, None, None, None),
            ("t", 1, "t-1", "Cut", "DONE", 90.0, 60.0, 0.5, 1.5, 1.5, 1.0, True, 1.5, None, 0.0, None, None, None),
            ("t", 1, "t-1", "Cut", "DONE", 120.0, 60.0, 0.5, 1.4, 1.4, 1.0, True, 2.0, None, 0.0, None, None, None)]
    parts = [("a", f"l{i}", i, f"bolt {i}", 10.0, 4.0, 1.1, f"vendor {i % 2}") for i in (4, 2, 3, 1)] + [("a", "l0", 2, "early", 9.0, 4.0, None, None), ("c", "l1", 9, None, 5.0, 0.0, None, None)]
    ev = E.build_evidence(spark.createDataFrame(rows, ELEMENTS).cache(), spark.createDataFrame(parts, PARTS).cache(), stored=True)
    return ev, durable(E.compose_lines(ev))


def issues(ev, lines, drafts=None):
    got = E.validate(ev, lines, ev["jobs"] if drafts is None else drafts).collect()
    return sorted((r.job_id, r.check, r.severity, r.ref or "") for r in got)


def test_parts_and_lines_of_a_job(review):
    ev, lines = review
    a = {r.job_id: r for r in ev["jobs"].collect()}["a"]
    assert [(c.label, c.shortfall) for c in a.named] == [("early", 5.0), ("bolt 1", 6.0), ("bolt 3", 6.0)] and (a.n_short, a.more) == (4, 1)
    assert a.vendors == ["vendor 0", "vendor 1"] and a.summary_operation == "a-1" and a.material == pytest.approx(9 / 4 + 3 * 10 / 4)
    got = [(r.line_index, r.operation_id, r.signal_key) for r in lines.filter("job_id = 'a'").orderBy("line_index").collect()]
    assert [g[0] for g in got] == list(range(5)) and {g[1:] for g in got} == {
        ("a-1", "time_overrun_ratio"), ("a-1", "operator_pace_ratio"), ("a-2", "critical_path_cascade_ratio"), (None, "material_shortfall_ratio"), (None, "supplier_reliability")}
    text = lines.filter("signal_key = 'material_shortfall_ratio'").first()
    assert text.detail == "a · early – 5 short; bolt 1 – 6 short; bolt 3 – 6 short; +1 more" and text.quoted["more_count"] == 1


CLEAN = [("b", "cascading_predecessor", "info", "b-1"), ("b", "implausible_duration", "warning", "b-1"), ("b", "no_fired_signal", "warning", "any"),
         ("b", "not_started_but_delayed", "warning", "b-1"), ("c", "non_finite", "warning", "c-1"), ("c", "non_finite", "warning", "c-1"), ("c", "non_finite", "warning", "c-1"),
         ("c", "non_finite", "warning", "job")]


def test_clean_lines_have_no_errors(review):
    ev, lines = review
    got = [i if i[1] != "no_fired_signal" else (*i[:3], "any") for i in issues(ev, lines) if i[0] != "t"]  # its two signals are alike
    assert got == CLEAN


def test_twice_an_operation_counts_twice(review):
    """Two rows of one operation: each line meets both, each quoted number what either says of it."""
    ev, lines = review
    got = [i[1] for i in issues(ev, lines) if i[0] == "t"]
    # two lines, of two signals each, with actual and delta off against the other's numbers
    assert got == ["quoted_number_mismatch"] * (2 * 2 * 2)


def test_each_spoilt_line_is_found(review):
    ev, lines = review
    own = lines.filter("job_id = 'a'")
    index = {(r.operation_id, r.signal_key): str(r.line_index) for r in own.collect()}
    key, op = F.col("signal_key"), F.col("operation_id")

    def found(changed):
        return [i[1:] for i in issues(ev, changed) if i[0] == "a"]

    assert found(own.filter(key != "operator_pace_ratio")) == [("omitted_signal", "error", "a-1")]
    assert found(own.filter(key != "supplier_reliability")) == [("omitted_signal", "error", "")]
    at = index["a-1", "time_overrun_ratio"]
    twice = own.withColumn("quoted", F.when(key == "time_overrun_ratio", F.transform_values("quoted", lambda k, v: F.when(k == "actual_hrs", v * 2).otherwise(v))).otherwise(F.col("quoted")))
    assert found(twice) == [("quoted_number_mismatch", "error", at), ("unquoted_number", "error", at)]
    other = own.withColumn("quoted", F.when(key == "time_overrun_ratio", F.map_concat("quoted", F.create_map(F.lit("days"), F.lit(2.0)))).otherwise(F.col("quoted")))
    assert found(other) == [("quoted_number_unknown", "error", at)]
    assert found(own.withColumn("headline", F.when(key == "time_overrun_ratio", "A strike").otherwise(F.col("headline")))) == [("forbidden_cause", "error", at)]
    assert ("signal_missing", "error", at) in found(own.withColumn("operation_id", F.when(key == "time_overrun_ratio", "a-9").otherwise(op)))
    wrong = own.withColumn("signal_key", F.when((key == "operator_pace_ratio"), "predecessor_time_overrun_ratio").otherwise(key))
    assert {("signal_not_fired", "error", index["a-1", "operator_pace_ratio"]), ("zero_weight_signal_shown", "error", index["a-1", "operator_pace_ratio"])} <= set(found(wrong))
    drafts = ev["jobs"].withColumn("summary_risk_score", F.when(F.col("job_id") == "a", 0.5).otherwise(F.col("summary_risk_score")))
    assert [i[1] for i in issues(ev, lines, drafts) if i[0] == "a"] == ["summary_mismatch", "threshold_inconsistent"]


def test_checks_take_few_shuffles(review):
    """every check joined lines and evidence again, with the texts of the lines."""
    ev, lines = review
    counts = E.validate(ev, lines, ev["jobs"]).groupBy("job_id", "check", "severity").count()
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 8
