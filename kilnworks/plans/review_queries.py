"""Registered review queries: evidence, why-lines, checks, status, digest."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnworks.functions import delay as D
from kilnworks.operators import delay as J
from kilnworks.operators import evidence as E
from kilnworks.plans.catalog import query
from kilnworks.session import durable
from kilnworks.sources import proxies as P
from kilnworks.sources.oracle_views import VIEWS

REF = "'WH/MO/' || job_id"
VIEWS["sig_raw"] = """
SELECT e.job_id, e.operation_id, e.seq, e.label, e.actual, e.expected, e.mo_progress >= 0.25 AS scorable, CASE WHEN isfinite(score) THEN score END AS score, CASE WHEN isfinite(base) THEN base END AS base,
 CASE WHEN time_overrun IS NULL THEN 0 ELSE 0.50::DOUBLE END + CASE WHEN pace IS NULL THEN 0 ELSE 0.35::DOUBLE END + CASE WHEN isfinite(shortfall) THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN supplier IS NULL THEN 0 ELSE 0.05::DOUBLE END AS wt,
 unnest([0, 1, 2, 3, 4, 5]) AS signal_order, unnest(['time_overrun_ratio', 'operator_pace_ratio', 'material_shortfall_ratio', 'supplier_reliability', 'critical_path_cascade_ratio', 'predecessor_time_overrun_ratio']) AS signal_key,
 unnest([time_overrun, pace, CASE WHEN isfinite(shortfall) THEN shortfall END, supplier, cascade, predecessor]) AS value, unnest([0.50, 0.35, 0.10, 0.05, 0, 0])::DOUBLE AS weight, unnest([1.0, 1.2, 0, 1.0, 1.2, 1.2])::DOUBLE AS floor_at
FROM elements e"""
VIEWS["sig"] = """
SELECT *, coalesce(value > floor_at, false) AS fired, CASE WHEN weight > 0 THEN weight * value / nullif(score * wt, 0) WHEN signal_key = 'critical_path_cascade_ratio' AND value IS NOT NULL AND score IS NOT NULL THEN greatest(score - coalesce(base, 0), 0) / nullif(score, 0) END AS contribution
FROM sig_raw"""
VIEWS["shorts"] = """
SELECT job_id, component_id, name, required, available, required - available AS shortfall, vendor_name, lid, row_number() OVER (PARTITION BY job_id ORDER BY lid) AS rn, count(*) OVER (PARTITION BY job_id) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY job_id, component_id ORDER BY lid) AS k FROM components WHERE available < required) WHERE k = 1"""
VIEWS["job_sum"] = """
SELECT job_id, bool_or(mo_progress >= 0.25) AS scorable, max(CASE WHEN mo_progress >= 0.25 AND isfinite(score) THEN score END) AS risk, max(CASE WHEN mo_progress >= 0.25 THEN predicted END) AS hours,
 bool_or(score > 1.0) FILTER (mo_progress >= 0.25 AND isfinite(score)) AS is_delayed, arg_max(operation_id, (score, -seq)) FILTER (mo_progress >= 0.25 AND isfinite(score)) AS worst FROM elements GROUP BY 1"""
VIEWS["job_sig"] = """
SELECT s.job_id, any_value(s.scorable) AS scorable, s.signal_key, any_value(s.signal_order) AS signal_order, CASE WHEN s.signal_key = 'supplier_reliability' THEN any_value(s.value) WHEN isfinite(coalesce(any_value(m.total), 0)) THEN coalesce(any_value(m.total), 0) END AS value,
 coalesce(max(CASE WHEN s.operation_id = j.worst THEN s.contribution END), max(CASE WHEN s.scorable THEN s.contribution END)) AS contribution
FROM sig s JOIN job_sum j ON j.job_id = s.job_id LEFT JOIN (SELECT job_id, sum(CASE WHEN available = 0 THEN 'inf'::DOUBLE ELSE required / available END) AS total FROM shorts GROUP BY 1) m ON m.job_id = s.job_id
WHERE s.signal_key IN ('material_shortfall_ratio', 'supplier_reliability') GROUP BY s.job_id, s.signal_key"""
VIEWS["job_vendors"] = """
SELECT job_id, string_agg(vendor_name, ', ' ORDER BY vendor_name) AS vendors FROM (SELECT DISTINCT job_id, vendor_name FROM components WHERE vendor_ratio IS NOT NULL AND vendor_name IS NOT NULL) GROUP BY 1"""
VIEWS["short_text"] = """
SELECT job_id, string_agg(name || ' – ' || CASE WHEN shortfall = floor(shortfall) THEN CAST(shortfall AS BIGINT)::VARCHAR ELSE format('{:.2f}', shortfall) END || ' short', '; ' ORDER BY rn) || CASE WHEN any_value(n) > 3 THEN '; +' || (any_value(n) - 3) || ' more' ELSE '' END AS t
FROM shorts WHERE rn <= 3 GROUP BY 1"""
VIEWS["why"] = """
SELECT job_id, operation_id, seq, signal_key, signal_order, contribution, CASE signal_key WHEN 'time_overrun_ratio' THEN label || ' · ' || format('{:.1f}', actual / 60) || ' hrs logged of ' || format('{:.1f}', expected / 60) || ' planned'
  WHEN 'operator_pace_ratio' THEN label || ' · operator pace ' || format('{:.2f}', value) || '× planned over recent completed jobs' ELSE label || ' · inherited critical-path overrun ' || format('{:.2f}', value) || '× planned' END AS detail,
  CASE WHEN signal_key = 'time_overrun_ratio' THEN '+' || format('{:.1f}', actual / 60 - expected / 60) || ' hrs' END AS delta
FROM sig WHERE scorable AND fired AND (signal_key IN ('time_overrun_ratio', 'operator_pace_ratio') OR (signal_key = 'critical_path_cascade_ratio' AND contribution > 0))
UNION ALL SELECT j.job_id, NULL, NULL, signal_key, signal_order, contribution, 'WH/MO/' || j.job_id || ' · ' || t, NULL FROM job_sig j JOIN short_text t ON t.job_id = j.job_id WHERE signal_key = 'material_shortfall_ratio' AND scorable AND value > 0
UNION ALL SELECT j.job_id, NULL, NULL, signal_key, signal_order, contribution, 'WH/MO/' || j.job_id || ' · vendors ' || vendors || ' average lead-time ratio ' || format('{:.2f}', value), NULL FROM job_sig j JOIN job_vendors v ON v.job_id = j.job_id WHERE signal_key = 'supplier_reliability' AND scorable AND value > 1"""
VIEWS["why_ranked"] = """
SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY coalesce(contribution, -1) DESC, signal_order, coalesce(seq, -1)) - 1 AS line_index FROM why"""


TOLD = ["job_id", "seq", "operation_id", "operation_name", "operation_type", "status", "expected", "actual", "job_quantity", "done_quantity", "operators"]


def evidence(spark, sf, stored=False):
    """Evidence tables, jobs named by their reference; ``stored`` where they are read many times."""
    t = P.production_tables(spark, sf, write_once=True, with_orders=True)
    keep = durable if stored else lambda df: df
    comp = keep(P.job_components(spark, sf, t))
    pace = J.operator_pace(J.operator_history(t["work_orders"], t["time_logs"]))
    told = [c for c in TOLD if stored or c != "status"]  # only the checks of stored evidence look at the status
    el = keep(J.delay_elements(t["work_orders"].select(*told), t["edges"], comp, pace))
    ref = F.concat(F.lit("WH/MO/"), F.col("job_id"))
    return E.build_evidence(el.withColumn("job_id", ref), comp.withColumn("job_id", ref), stored=stored)


def lines(spark, sf):
    ev = evidence(spark, sf, stored=True)
    return ev, durable(E.compose_lines(ev))


@query("h45_fire_test", "SELECT operation_id, signal_key, fired FROM sig")
def _(spark, sf):
    ev = evidence(spark, sf)
    return ev["signals"].filter("operation_id IS NOT NULL").select("operation_id", "signal_key", "fired")


@query("h46_contribution", "SELECT operation_id, signal_key, round(contribution, 5) AS contribution FROM sig WHERE contribution IS NOT NULL", digits=5)
def _(spark, sf):
    ev = evidence(spark, sf)
    return ev["signals"].filter("operation_id IS NOT NULL AND contribution IS NOT NULL").select("operation_id", "signal_key", "contribution")


@query("h47_non_finite", "SELECT operation_id, isfinite(shortfall) AS material_ok, isfinite(score) AS score_ok FROM elements")
def _(spark, sf):
    ev = evidence(spark, sf)
    return ev["operations"].select("operation_id", D.finite(F.col("material_shortfall_ratio")).isNotNull().alias("material_ok"),
                                   D.finite(F.col("risk_score")).isNotNull().alias("score_ok"))


@query("d44_job_summary", f"SELECT {REF} AS job_id, scorable, round(risk, 5) AS risk, round(hours, 5) AS hours, is_delayed, worst FROM job_sum", digits=5)
def _(spark, sf):
    ev = evidence(spark, sf)
    return ev["jobs"].select("job_id", "scorable", F.col("summary_risk_score").alias("risk"), F.col("summary_overrun_hours").alias("hours"),
                             F.col("summary_is_delayed").alias("is_delayed"), F.col("summary_operation").alias("worst"))


@query("d45_short_components", "SELECT job_id, component_id, name, round(shortfall, 6) AS shortfall, vendor_name FROM shorts")
def _(spark, sf):
    c = P.job_components(spark, sf, P.production_tables(spark, sf))
    return E.short_components(c).select("job_id", "component_id", "name", "shortfall", "vendor_name")


@query("f04_named_components", "SELECT job_id, t AS short_list FROM short_text")
def _(spark, sf):
    c = P.job_components(spark, sf, P.production_tables(spark, sf))
    top = E._top_short(E.short_components(c))
    return top.select("job_id", E.short_list_text(F.col("named"), F.col("more")).alias("short_list"))


@query("h49_why_lines", f"SELECT {REF} AS job_id, line_index, signal_key, operation_id, detail, delta FROM why_ranked")
def _(spark, sf):
    _ev, ln = lines(spark, sf)
    return ln.select("job_id", "line_index", "signal_key", "operation_id", "detail", "delta")


@query("e19_line_ranking", f"SELECT {REF} AS job_id, line_index, signal_key, operation_id, round(contribution, 5) AS contribution FROM why_ranked", digits=5)
def _(spark, sf):
    _ev, ln = lines(spark, sf)
    return ln.select("job_id", "line_index", "signal_key", "operation_id", "contribution")


# drafts are spoilt on purpose, by job number, so that every check has something to find
VIEWS["spoilt"] = """
SELECT *, CASE WHEN job_id % 10 = 3 AND signal_key = 'time_overrun_ratio' THEN 1 ELSE 0 END AS wrong_quote FROM why WHERE NOT (job_id % 10 = 4 AND signal_key = 'operator_pace_ratio')"""
NEAR = "len(list_filter([{t}], lambda t: len(list_filter([{v}], lambda v: abs(t - v) <= greatest(abs(v) * 0.02, 0.05))) = 0)) > 0"
VIEWS["misquoted"] = f"""
SELECT job_id, signal_key, {NEAR.format(t='ta, te, td', v='a, e, a - e')} AS clean_bad, {NEAR.format(t='ta, te, td', v='CASE WHEN job_id % 10 = 3 THEN a * 2 ELSE a END, e, a - e')} AS spoilt_bad
FROM (SELECT job_id, signal_key, actual / 60 AS a, expected / 60 AS e, format('{{:.1f}}', actual / 60)::DOUBLE AS ta, format('{{:.1f}}', expected / 60)::DOUBLE AS te, format('{{:.1f}}', actual / 60 - expected / 60)::DOUBLE AS td
 FROM sig WHERE scorable AND fired AND signal_key = 'time_overrun_ratio')"""
VIEWS["issues"] = f"""
SELECT job_id, 'quoted_number_mismatch' AS "check", 'error' AS severity FROM spoilt WHERE wrong_quote = 1
UNION ALL SELECT job_id, 'unquoted_number', 'error' FROM misquoted WHERE spoilt_bad AND NOT (job_id % 10 = 4 AND signal_key = 'operator_pace_ratio')
UNION ALL SELECT job_id, 'forbidden_cause', 'error' FROM spoilt WHERE regexp_matches(detail, '(?i)breakdown|quality hold|rework|approval|inspection|weather|strike')
UNION ALL SELECT job_id, 'omitted_signal', 'error' FROM sig WHERE job_id % 10 = 4 AND scorable AND fired AND signal_key = 'operator_pace_ratio'
UNION ALL SELECT job_id, 'summary_mismatch', 'error' FROM job_sum WHERE job_id % 10 = 5 AND risk IS NOT NULL
UNION ALL SELECT job_id, 'threshold_inconsistent', 'error' FROM job_sum WHERE job_id % 10 = 5 AND risk IS NOT NULL AND NOT is_delayed
UNION ALL SELECT job_id, 'implausible_duration', 'warning' FROM elements WHERE actual > 20 * expected
UNION ALL SELECT job_id, 'not_started_but_delayed', 'warning' FROM elements WHERE status = 'PENDING' AND score > 1.0 AND cascade IS NULL
UNION ALL SELECT job_id, 'cascading_predecessor', 'info' FROM elements WHERE predecessor > 1.2 AND cascade IS NULL
UNION ALL SELECT job_id, 'omitted_signal_unrenderable', 'warning' FROM job_sig WHERE signal_key = 'supplier_reliability' AND scorable AND value > 1 AND job_id NOT IN (SELECT job_id FROM job_vendors)
UNION ALL SELECT job_id, 'no_fired_signal', 'warning' FROM job_sum WHERE scorable AND coalesce(is_delayed, false) AND job_id NOT IN (SELECT job_id FROM spoilt)
UNION ALL SELECT job_id, 'non_finite', 'warning' FROM elements WHERE NOT isfinite(shortfall) UNION ALL SELECT job_id, 'non_finite', 'warning' FROM elements WHERE NOT isfinite(score) UNION ALL SELECT job_id, 'non_finite', 'warning' FROM elements WHERE NOT isfinite(base)
UNION ALL SELECT job_id, 'non_finite', 'warning' FROM job_sig WHERE signal_key = 'material_shortfall_ratio' AND value IS NULL"""


def spoilt_issues(spark, sf):
    ev, ln = lines(spark, sf)
    n = F.substring_index("job_id", "/", -1).cast("bigint") % 10
    bad = F.when((n == 3) & (F.col("signal_key") == "time_overrun_ratio"), F.transform_values(
        "quoted", lambda k, v: F.when(k == "actual_hrs", v * 2).otherwise(v))).otherwise(F.col("quoted"))
    ln = ln.filter(~((n == 4) & (F.col("signal_key") == "operator_pace_ratio"))).withColumn("quoted", bad)
    drafts = ev["jobs"].select("job_id", F.when(n == 5, F.col("summary_risk_score") * 2 + 1).otherwise(F.col("summary_risk_score")).alias("summary_risk_score"),
                               "summary_overrun_hours", "summary_is_delayed")
    return ev, E.validate(ev, ln, drafts)


@query("h50_insight_checks", f'SELECT {REF} AS job_id, "check", severity, count(*) AS n FROM issues GROUP BY 1, 2, 3')
def _(spark, sf):
    _ev, issues = spoilt_issues(spark, sf)
    return issues.groupBy("job_id", "check", "severity").agg(F.count(F.lit(1)).alias("n"))


STATUS = """CASE WHEN NOT j.scorable THEN 'suppressed_not_scorable' WHEN i.n > 0 THEN 'rejected' ELSE 'fallback_template' END"""
STATUS_SQL = f"""SELECT j.job_id, j.is_delayed, {STATUS} AS status FROM job_sum j LEFT JOIN (SELECT job_id, count(*) AS n FROM issues WHERE severity = 'error' GROUP BY 1) i ON i.job_id = j.job_id"""


@query("h51_insight_status", f"SELECT 'WH/MO/' || job_id AS job_id, status FROM ({STATUS_SQL})")
def _(spark, sf):
    ev, issues = spoilt_issues(spark, sf)
    return E.insight_status(ev["jobs"], issues).select("job_id", "status")


@query("d47_status_counts", f"SELECT status, count(*) AS n FROM ({STATUS_SQL}) GROUP BY 1")
def _(spark, sf):
    ev, issues = spoilt_issues(spark, sf)
    return E.insight_status(ev["jobs"], issues).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


CLEAN_ERRORS = """SELECT job_id, count(*) AS n FROM (SELECT job_id FROM why WHERE regexp_matches(detail, '(?i)breakdown|quality hold|rework|approval|inspection|weather|strike')
 UNION ALL SELECT job_id FROM misquoted WHERE clean_bad) GROUP BY 1"""


@query("j07_insight_rows", f"""SELECT 'WH/MO/' || j.job_id AS job_id, round(j.risk, 5) AS risk_score, round(j.hours, 5) AS overrun_hours, j.is_delayed, CASE WHEN NOT j.scorable THEN 'suppressed_not_scorable' WHEN e.n > 0 THEN 'rejected' ELSE 'fallback_template' END AS status,
 coalesce(w.n, 0) AS why_lines, coalesce(s.n, 0) AS short_components FROM job_sum j LEFT JOIN ({CLEAN_ERRORS}) e ON e.job_id = j.job_id LEFT JOIN (SELECT job_id, count(*) AS n FROM why GROUP BY 1) w ON w.job_id = j.job_id LEFT JOIN (SELECT job_id, count(*) AS n FROM shorts GROUP BY 1) s ON s.job_id = j.job_id""", digits=5)
def _(spark, sf):
    """The whole review: elements, evidence, lines, checks of the unspoilt drafts, status."""
    ev, ln = lines(spark, sf)
    issues = E.validate(ev, ln, ev["jobs"])
    out = E.insight_status(ev["jobs"], issues)
    n_lines = ln.groupBy("job_id").agg(F.count(F.lit(1)).alias("why_lines"))
    return out.join(n_lines, "job_id", "left").select(
        "job_id", F.col("summary_risk_score").alias("risk_score"), F.col("summary_overrun_hours").alias("overrun_hours"),
        F.col("summary_is_delayed").alias("is_delayed"), "status", F.coalesce("why_lines", F.lit(0)).alias("why_lines"),
        F.coalesce("n_short", F.lit(0)).alias("short_components"))


VIEWS["snaps"] = """
SELECT o_orderkey AS snapshot_id, o_custkey % 30 AS tenant, o_orderdate AS scored_at, o_orderstatus = 'P' AS is_delayed, CASE o_orderstatus WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status,
 row_number() OVER (PARTITION BY o_custkey % 30 ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders"""


@query("d46_snapshot_digest", """SELECT t.*, c.time_n, c.time_fired, c.time_mean, c.pace_n, c.pace_fired FROM (SELECT tenant, count(*) AS n_scored_jobs, count(CASE WHEN is_delayed THEN 1 END) AS delayed_jobs, count(CASE WHEN status = 'approved' THEN 1 END) AS approved_jobs FROM snaps WHERE rn <= 50 GROUP BY 1) t
 LEFT JOIN (SELECT tenant, count(ratio) AS time_n, count(CASE WHEN ratio > 1 THEN 1 END) AS time_fired, round(avg(ratio), 5) AS time_mean, count(CASE WHEN done_quantity > 0 THEN done_quantity END) AS pace_n, count(CASE WHEN done_quantity > 1.2 THEN 1 END) AS pace_fired
 FROM snaps JOIN work_orders ON job_id = snapshot_id JOIN own_overrun USING (operation_id) WHERE rn <= 50 GROUP BY 1) c USING (tenant)""", digits=5)
def _(spark, sf):
    o = P.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("snapshot_id"), (F.col("o_custkey") % 30).alias("tenant"), F.col("o_orderdate").alias("scored_at"),
        (F.col("o_orderstatus") == "P").alias("is_delayed"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected").alias("status"))
    a, e, d, q = (F.col(c) for c in ("actual", "expected", "done_quantity", "job_quantity"))
    none = F.lit(None).cast("double")
    ops = P.production_tables(spark, sf)["work_orders"].select(
        F.col("job_id").alias("snapshot_id"), D.time_overrun(a, e, d, q).alias("time_overrun_ratio"),
        F.when(d > 0, d).alias("operator_pace_ratio"), none.alias("material_shortfall_ratio"), none.alias("supplier_reliability"))
    g = E.snapshot_digest(o, ops)
    return g.select("tenant", "n_scored_jobs", "delayed_jobs", "approved_jobs", F.col("time_overrun_ratio_n").alias("time_n"),
                    F.col("time_overrun_ratio_fired").alias("time_fired"), F.col("time_overrun_ratio_mean").alias("time_mean"),
                    F.col("operator_pace_ratio_n").alias("pace_n"), F.col("operator_pace_ratio_fired").alias("pace_fired"))
