"""Registered production queries: roll-up, history, critical path, delay elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnworks.functions import delay as D
from kilnworks.functions import pii, text
from kilnworks.functions.timefn import localise, minutes_as_of
from kilnworks.operators import delay as J
from kilnworks.operators import graph as R
from kilnworks.operators.inventory import first_vendor
from kilnworks.plans.catalog import query
from kilnworks.sources import proxies as P

SALT = "kiln-salt"


def tables(spark, sf, with_orders=False):
    return P.production_tables(spark, sf, write_once=True, with_orders=with_orders)


@query("a05_production_scan", "SELECT operation_id, job_id, expected AS expected_duration, actual AS real_duration FROM work_orders WHERE status <> 'PENDING'")
def _(spark, sf):
    return P.production_tables(spark, sf)["work_orders"].filter(F.col("status") != "PENDING").select(
        "operation_id", "job_id", F.col("expected").alias("expected_duration"), F.col("actual").alias("real_duration"))


@query("a06_completed_since", "SELECT o_orderkey AS job_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS completed_at FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' AND o_orderstatus <> 'P'")
def _(spark, sf):
    P.table(spark, sf, "orders").createOrReplaceTempView("mo_completed")
    return spark.sql("""SELECT o_orderkey AS job_id, CAST(o_orderdate AS TIMESTAMP) AS completed_at FROM mo_completed
        WHERE (:since IS NULL OR o_orderdate > CAST(:since AS TIMESTAMP_NTZ)) AND o_orderstatus <> 'P'""", args={"since": "1998-01-01 00:00:00"})


@query("b16_job_scope", "SELECT o_orderkey AS id FROM orders WHERE 'WH/MO/' || o_orderkey IN ('WH/MO/5', 'WH/MO/77', 'WH/MO/4000')")
def _(spark, sf):
    jobs = P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("WH/MO/"), F.col("o_orderkey")).alias("reference"))
    return J.scope_jobs(jobs, ["WH/MO/5", "WH/MO/77", "WH/MO/4000"]).select("id")


@query("h11_localised_time", "SELECT o_orderkey, strftime((o_orderdate AT TIME ZONE 'Australia/Sydney') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f') AS utc FROM orders")
def _(spark, sf):
    return P.table(spark, sf, "orders").select("o_orderkey", localise(F.col("o_orderdate")).alias("utc"))


def hmac_sql(msg: str, key: str) -> str:
    raw = key.encode().ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw).hex(), bytes(b ^ 0x5C for b in raw).hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({msg}))))"


@query("h14_pseudonyms", f"SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN {hmac_sql('c_name', SALT)} END AS token, CASE WHEN c_custkey % 10 <> 0 THEN {hmac_sql('c_name', SALT)} END AS in_array FROM customer")
def _(spark, sf):
    name = F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.col("c_name"))
    return P.table(spark, sf, "customer").select(
        "c_custkey", pii.pseudonym(name, SALT).alias("token"), pii.pseudonyms(F.array(name), SALT)[0].alias("in_array"))


@query("h15_hash_bucket", f"SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 2 ELSE CAST('0x' || substr({hmac_sql('c_name', SALT)}, 1, 8) AS BIGINT) % 5 END AS bucket FROM customer")
def _(spark, sf):
    token = F.when(F.col("c_custkey") % 10 != 0, pii.pseudonym(F.col("c_name"), SALT))
    return P.table(spark, sf, "customer").select("c_custkey", pii.bucket(token).alias("bucket"))


@query("h16_skill_tier", "SELECT operator_id, CASE WHEN pace IS NULL THEN 2 WHEN pace <= .80 THEN 4 WHEN pace <= .95 THEN 3 WHEN pace <= 1.10 THEN 2 WHEN pace <= 1.30 THEN 1 ELSE 0 END AS tier FROM operator_pace")
def _(spark, sf):
    t = tables(spark, sf)
    return J.operator_pace(J.operator_history(t["work_orders"], t["time_logs"])).select("operator_id", pii.skill_tier(F.col("pace")).alias("tier"))


@query("h17_capacity", "SELECT operation_id, CASE WHEN step_id = 7 THEN NULL WHEN step_id % 2 = 0 THEN 2 ELSE 1 END AS capacity, CASE WHEN step_id <> 7 THEN round(step_id / CASE WHEN step_id % 2 = 0 THEN 2 ELSE 1 END, 6) END AS concurrency FROM work_orders")
def _(spark, sf):
    staff = F.when(F.col("step_id") == 7, F.array().cast("array<bigint>")).otherwise(F.col("operators"))
    cap = F.nullif(F.size(staff), F.lit(0))
    return P.production_tables(spark, sf)["work_orders"].select(
        "operation_id", cap.alias("capacity"), F.try_divide(F.col("step_id"), cap).alias("concurrency"))


@query("h18_minutes_as_of", """SELECT user_id, round(sum(CASE WHEN ts <= t THEN greatest((epoch_us(least(coalesce(e, t), t)) - epoch_us(ts)) / 60e6, 0) END), 4) AS minutes FROM (
 SELECT user_id, ts, CASE WHEN event_id % 5 <> 0 THEN ts + to_hours(CAST(event_id % 48 AS INTEGER)) END AS e, TIMESTAMP '2024-01-20' AS t FROM events) GROUP BY 1""", digits=4)
def _(spark, sf):
    ts = F.col("ts").cast("timestamp")
    end = F.when(F.col("event_id") % 5 != 0, F.timestamp_add("HOUR", (F.col("event_id") % 48).cast("int"), ts))
    return P.table(spark, sf, "events").groupBy("user_id").agg(
        F.sum(minutes_as_of(ts, end, F.lit("2024-01-20").cast("timestamp"))).alias("minutes"))


@query("h19_physical_fraction", "SELECT operation_id, round(done_quantity / job_quantity, 6) AS fraction FROM work_orders")
def _(spark, sf):
    return P.production_tables(spark, sf)["work_orders"].select(
        "operation_id", F.when(F.col("job_quantity") > 0, F.col("done_quantity") / F.col("job_quantity")).otherwise(0.0).alias("fraction"))


@query("c11_dependency_translation", """WITH d AS (SELECT w.operation_id, p.operation_id AS pred FROM work_orders w JOIN work_orders p ON p.job_id = w.job_id AND (p.step_id = w.step_id - 1 OR (w.step_id % 2 = 0 AND p.step_id = w.step_id - 3)))
 SELECT w.job_id, w.operation_id, count(d.pred) AS predecessors, min(d.pred) AS first_predecessor, max(d.pred) AS last_predecessor FROM work_orders w LEFT JOIN d USING (operation_id) GROUP BY 1, 2""")
def _(spark, sf):
    t = tables(spark, sf)
    steps = t["work_orders"].select("step_id").distinct()
    back = F.array_compact(F.array(F.col("step_id") - 1, F.when(F.col("step_id") % 2 == 0, F.col("step_id") - 3)))
    return J.predecessor_summary(t["work_orders"], steps.select("step_id", F.explode(back).alias("depends_on_id")))


@query("d42_operator_minutes", "SELECT operation_id, operator_id, CAST(sum(duration_minutes) AS BIGINT) AS elapsed_minutes FROM time_logs GROUP BY 1, 2")
def _(spark, sf):
    return J.operator_minutes(P.production_tables(spark, sf)["time_logs"])


@query("e10_operator_history", "SELECT operator_id, string_agg(operation_id, ',' ORDER BY rn) AS history FROM operator_last GROUP BY 1")
def _(spark, sf):
    t = tables(spark, sf)
    h = J.operator_history(t["work_orders"], t["time_logs"])
    return h.select("operator_id", F.concat_ws(",", F.transform("history", lambda x: x["operation_id"])).alias("history"))


@query("h38_operator_pace", "SELECT operator_id, round(pace, 6) AS pace, completed FROM operator_pace")
def _(spark, sf):
    t = tables(spark, sf)
    return J.operator_pace(J.operator_history(t["work_orders"], t["time_logs"]))


@query("e11_vendor_orders", "SELECT item_id, vendor_id, string_agg(po_id, ',' ORDER BY rn) AS history, count(received) AS received FROM vendor_pos GROUP BY 1, 2")
def _(spark, sf):
    t = P.production_tables(spark, sf)
    h = J.vendor_orders(first_vendor(P.stock_tables(spark, sf)["item_vendors"]), t["vendor_orders"], t["receipts"])
    return h.select("item_id", "vendor_id", F.concat_ws(",", F.transform("history", lambda x: x["po_id"])).alias("history"),
                    F.size(F.filter("history", lambda x: x["received"].isNotNull())).alias("received"))


@query("h40_vendor_lead_time", "SELECT item_id, round(ratio, 6) AS ratio FROM vendor_ratio")
def _(spark, sf):
    t = P.production_tables(spark, sf)
    h = J.vendor_orders(first_vendor(P.stock_tables(spark, sf)["item_vendors"]), t["vendor_orders"], t["receipts"])
    return h.select("item_id", J.lead_time_ratio(F.col("history")).alias("ratio"))


@query("d43_mo_progress", "SELECT job_id, round(mo_progress, 6) AS mo_progress FROM job_progress")
def _(spark, sf):
    return J.job_progress(P.production_tables(spark, sf)["work_orders"])


@query("h39_material_shortfall", "SELECT job_id, round(CASE WHEN shortfall < 1e12 THEN shortfall END, 6) AS shortfall, shortfall > 1e12 AS infinite, round(supplier, 6) AS supplier FROM job_materials")
def _(spark, sf):
    c = P.job_components(spark, sf, tables(spark, sf, with_orders=True))
    m = F.col("material_shortfall_ratio")
    return J.job_materials(c).select("job_id", D.finite(m).alias("shortfall"), (m == D.INF).alias("infinite"),
                                     F.col("supplier_reliability").alias("supplier"))


@query("h35_time_overrun", "SELECT operation_id, round(nullif(done_quantity, 0) / job_quantity, 6) AS work_done, round(ratio, 6) AS time_overrun FROM own_overrun JOIN work_orders USING (operation_id)")
def _(spark, sf):
    a, e, d, q = (F.col(c) for c in ("actual", "expected", "done_quantity", "job_quantity"))
    return P.production_tables(spark, sf)["work_orders"].select(
        "operation_id", D.work_done(d, q).alias("work_done"), D.time_overrun(a, e, d, q).alias("time_overrun"))


@query("h36_predicted_overrun", """SELECT operation_id, round(predicted, 5) AS hours, CASE WHEN nullif(actual, 0) IS NOT NULL AND nullif(done_quantity, 0) IS NOT NULL THEN 'quantity' WHEN pace IS NOT NULL THEN 'operator_pace' ELSE 'none' END AS basis
 FROM (SELECT w.*, p.pace, (coalesce(nullif(actual, 0) / (nullif(done_quantity, 0) / job_quantity), expected * pace) - expected) / 60 AS predicted FROM work_orders w LEFT JOIN op_pace p USING (operation_id))""", digits=5)
def _(spark, sf):
    t = tables(spark, sf)
    pace = J.operation_pace(t["work_orders"], J.operator_pace(J.operator_history(t["work_orders"], t["time_logs"])))
    f = t["work_orders"].join(pace, ["job_id", "operation_id"], "left")
    a, e, d, q, p = (F.col(c) for c in ("actual", "expected", "done_quantity", "job_quantity", "operator_pace_ratio"))
    return f.select("operation_id", D.predicted_overrun_hours(a, e, d, q, p).alias("hours"), D.overrun_basis(a, d, q, p).alias("basis"))


@query("h37_predecessor_overrun", "SELECT e.operation_id, round(max(o.ratio), 6) AS ratio FROM edges e JOIN own_overrun o ON o.operation_id = e.pred_id GROUP BY 1")
def _(spark, sf):
    t = tables(spark, sf)
    a, e, d, q = (F.col(c) for c in ("actual", "expected", "done_quantity", "job_quantity"))
    ops = t["work_orders"].withColumn("time_overrun_ratio", D.time_overrun(a, e, d, q))
    return J.predecessor_overrun(ops, t["edges"]).select("operation_id", F.col("predecessor_time_overrun_ratio").alias("ratio"))


@query("j02_critical_path", "SELECT operation_id, valid, project AS project_minutes, es AS earliest_start, ef AS earliest_finish, ls AS latest_start, lf AS latest_finish, float_minutes, critical FROM cpm")
def _(spark, sf):
    t = tables(spark, sf)
    timed, _edges = R.critical_path(t["work_orders"], t["edges"])
    return timed.drop("job_id")


@query("j02_critical_edges", "SELECT job_id, operation_id, pred_id FROM critical_edges")
def _(spark, sf):
    t = tables(spark, sf)
    return R.critical_path(t["work_orders"], t["edges"])[1].select("job_id", "operation_id", "pred_id")


@query("j03_cascade", "SELECT operation_id, round(ratio, 6) AS ratio, source_id, sources FROM cascade_max")
def _(spark, sf):
    t = tables(spark, sf)
    a, e, d, q = (F.col(c) for c in ("actual", "expected", "done_quantity", "job_quantity"))
    _timed, crit = R.critical_path(t["work_orders"], t["edges"])
    own = t["work_orders"].select("job_id", "operation_id", D.time_overrun(a, e, d, q).alias("ratio"))
    return R.cascade(crit, own).groupBy("operation_id").agg(
        F.max("ratio").alias("ratio"), F.min("source_id").alias("source_id"), F.count(F.lit(1)).alias("sources"))


# what is told of a work order, and what its signals follow from
TOLD = ["job_id", "operation_id", "operation_name", "operation_type", "expected", "actual", "job_quantity", "done_quantity", "operators"]


def elements(spark, sf):
    t = tables(spark, sf, with_orders=True)
    pace = J.operator_pace(J.operator_history(t["work_orders"], t["time_logs"]))
    return J.delay_elements(t["work_orders"].select(*TOLD), t["edges"], P.job_components(spark, sf, t), pace)


@query("j04_cascade_overlay", "SELECT operation_id, round(CASE WHEN score < 1e12 THEN score END, 5) AS risk_score, score > 1e12 AS infinite FROM elements", digits=5)
def _(spark, sf):
    f = elements(spark, sf)
    return f.select("operation_id", D.finite(F.col("risk_score")).alias("risk_score"), (F.col("risk_score") == D.INF).alias("infinite"))


@query("j05_job_rollup", """SELECT w.operation_id, w.job_id, w.status, len(CASE WHEN step_id % 2 = 0 THEN [1, 2] ELSE [1] END) AS operator_count, coalesce(e.n, 0) AS depends_on, e.lo AS first_dependency, coalesce(c.n, 0) AS components FROM work_orders w
 LEFT JOIN (SELECT operation_id, count(*) AS n, min(pred_id) AS lo FROM edges GROUP BY 1) e USING (operation_id) LEFT JOIN (SELECT job_id, count(*) AS n FROM components GROUP BY 1) c USING (job_id)""")
def _(spark, sf):
    """The flat form of the job document: operation rows with their links, component counts per job."""
    t = tables(spark, sf, with_orders=True)
    deps = t["edges"].groupBy("operation_id").agg(F.count(F.lit(1)).alias("depends_on"), F.min("pred_id").alias("first_dependency"))
    n = P.job_components(spark, sf, t).groupBy("job_id").agg(F.count(F.lit(1)).alias("components"))
    # the texts of the links come last, so only one shuffle carries them
    return t["work_orders"].join(n, "job_id", "left").join(deps, "operation_id", "left").select(
        "operation_id", "job_id", "status", F.size("operators").alias("operator_count"),
        F.coalesce("depends_on", F.lit(0)).alias("depends_on"), "first_dependency", F.coalesce("components", F.lit(0)).alias("components"))


LAST_TEN = """SELECT l.operator_id, list(struct_pack(operation_id := l.operation_id, elapsed_minutes := coalesce(m.elapsed, 0)::BIGINT, scheduled_minutes := l.expected::BIGINT) ORDER BY l.rn) AS last
 FROM operator_last l LEFT JOIN (SELECT operation_id, operator_id, sum(duration_minutes) AS elapsed FROM time_logs GROUP BY 1, 2) m ON m.operation_id = l.operation_id AND m.operator_id = l.operator_id GROUP BY 1"""


@query("j05_job_documents", f"""WITH h AS ({LAST_TEN}), o AS (SELECT w.operation_id, list(struct_pack(operator_id := w.operator_id, last_10_work_orders := h.last) ORDER BY w.operator_id) AS operators FROM wo_operators w LEFT JOIN h USING (operator_id) GROUP BY 1),
 d AS (SELECT operation_id, list(DISTINCT pred_id ORDER BY pred_id) AS preds FROM edges GROUP BY 1),
 p AS (SELECT w.job_id, (row_number() OVER (PARTITION BY w.job_id ORDER BY w.operation_id) - 1) // 3 AS part, w.operation_id, struct_pack(operation_id := w.operation_id, operation_name := operation_name, operation_type := operation_type, status := status,
  depends_on_operation_ids := coalesce(preds, []), expected_duration_minutes := expected::BIGINT, actual_duration_minutes := actual::BIGINT, job_quantity := job_quantity::BIGINT, current_done_quantity := done_quantity::BIGINT,
  operator_count := len(operators), operators := operators) AS e FROM work_orders w JOIN o USING (operation_id) LEFT JOIN d USING (operation_id)),
 c AS (SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY lid) - 1) // 3 AS part, lid, struct_pack(component_id := component_id, name := name, required_quantity := required::BIGINT, available_quantity := available::BIGINT, vendor := vendor_name) AS e FROM components)
 SELECT job_id, 'operations' AS section, part, to_json(list(e ORDER BY operation_id))::VARCHAR AS document FROM p GROUP BY 1, 3 UNION ALL SELECT job_id, 'components', part, to_json(list(e ORDER BY lid))::VARCHAR FROM c GROUP BY 1, 3""")
def _(spark, sf):
    """The nested roll-up of every job as JSON, in parts of three entries."""
    t = tables(spark, sf, with_orders=True)
    return J.job_documents(t["work_orders"], t["edges"], J.operator_history(t["work_orders"], t["time_logs"]), P.job_components(spark, sf, t), part_size=3)


@query("j06_delay_elements", """SELECT operation_id, round(time_overrun, 5) AS time_overrun_ratio, round(pace, 5) AS operator_pace_ratio, round(supplier, 5) AS supplier_reliability, round(predecessor, 5) AS predecessor_time_overrun_ratio,
 round(cascade, 5) AS critical_path_cascade_ratio, round(CASE WHEN base < 1e12 THEN base END, 5) AS base_score, round(predicted, 5) AS predicted_overrun_hours, round(mo_progress, 5) AS mo_progress, score > 1.0 AS is_delayed, critical, label AS operation_label FROM elements""", digits=5)
def _(spark, sf):
    return elements(spark, sf).select(
        "operation_id", "time_overrun_ratio", "operator_pace_ratio", "supplier_reliability", "predecessor_time_overrun_ratio",
        "critical_path_cascade_ratio", D.finite(F.col("base_score")).alias("base_score"), "predicted_overrun_hours", "mo_progress",
        "is_delayed", "critical", "operation_label")


@query("h41_composite_risk", """SELECT c_custkey, round((a * coalesce(x, 0) + b * coalesce(y, 0) + c * z) / (CASE WHEN x IS NULL THEN 0 ELSE a END + CASE WHEN y IS NULL THEN 0 ELSE b END + c), 5) AS score FROM (
 SELECT c_custkey, 0.40::DOUBLE AS a, 0.30::DOUBLE AS b, 0.15::DOUBLE AS c, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal / 1000 END AS x, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey / 500 END AS y, c_nationkey / 10 AS z FROM customer)""", digits=5)
def _(spark, sf):
    w = D.weights_from_bp({"time_overrun": F.lit(4000), "operator_skill": F.lit(3000), "seasonality": F.lit(1000), "material_availability": F.lit(1500)})
    k = F.col("c_custkey")
    v = {"time_overrun_ratio": F.when(k % 3 != 0, F.col("c_acctbal") / 1000), "operator_pace_ratio": F.when(k % 5 != 0, k / 500),
         "material_shortfall_ratio": F.col("c_nationkey") / 10}
    return P.table(spark, sf, "customer").select("c_custkey", D.composite(v, w).alias("score"))


@query("h43_delayed_flag", "SELECT operation_id, ratio > 1.0 AS is_delayed FROM own_overrun")
def _(spark, sf):
    a, e, d, q = (F.col(c) for c in ("actual", "expected", "done_quantity", "job_quantity"))
    return P.production_tables(spark, sf)["work_orders"].select(
        "operation_id", (D.time_overrun(a, e, d, q) > D.THRESHOLD).alias("is_delayed"))


@query("h44_scorable_gate", "SELECT job_id, mo_progress >= 0.25 AS scorable FROM job_progress")
def _(spark, sf):
    return J.job_progress(P.production_tables(spark, sf)["work_orders"]).select("job_id", (F.col("mo_progress") >= D.GATE).alias("scorable"))


@query("h48_operation_label", "SELECT operation_id, coalesce(operation_name, operation_type || ' · ' || substr(operation_id, 1, 8)) AS label FROM work_orders")
def _(spark, sf):
    return P.production_tables(spark, sf)["work_orders"].select("operation_id", D.label(
        F.col("operation_name"), F.lit(None).cast("string"), F.col("operation_type"), F.col("operation_id")).alias("label"))


@query("d48_outcome_label", """SELECT o_orderkey AS job_id, round((epoch_us(o_orderdate + INTERVAL 45 DAY) - epoch_us(f)) / 3.6e9, 4) AS hours_late, epoch_us(o_orderdate + INTERVAL 45 DAY) > epoch_us(f) AS was_late,
 round(CASE WHEN ok THEN act / ex END, 6) AS duration_overrun_ratio FROM orders LEFT JOIN (SELECT job_id, max(shipdate) AS f, sum(expected) AS ex, sum(actual) AS act, bool_and(actual IS NOT NULL) AS ok FROM work_orders GROUP BY 1) ON job_id = o_orderkey""")
def _(spark, sf):
    jobs = P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.timestamp_add(
        "DAY", F.lit(45), F.col("o_orderdate").cast("timestamp")).alias("completed_at"))
    wo = P.production_tables(spark, sf)["work_orders"].drop("scheduled_end")
    ends = P.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_shipdate").cast("timestamp").alias("scheduled_end"),
                                                 F.lit(None).cast("double").alias("expected"), F.lit(None).cast("double").alias("actual"), F.lit(True).alias("end_only"))
    both = wo.select("job_id", F.lit(None).cast("timestamp").alias("scheduled_end"), "expected", "actual", F.lit(False).alias("end_only"))
    per_end = ends.groupBy("job_id").agg(F.max("scheduled_end").alias("scheduled_end"))
    return J.outcome_labels(jobs, both.drop("scheduled_end").join(per_end, "job_id")).select(
        "job_id", "hours_late", "was_late", "duration_overrun_ratio")


@query("h52_job_key", "SELECT o_orderkey, CASE WHEN k = '' THEN 'job' ELSE k END || '-' || substr(sha256(ref), 1, 10) AS job_key FROM (SELECT o_orderkey, ref, trim(regexp_replace(ref, '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS k FROM (SELECT o_orderkey, '/WH/MO é ' || o_orderkey || '/' || o_orderpriority || '!' AS ref FROM orders))")
def _(spark, sf):
    ref = F.concat(F.lit("/WH/MO é "), F.col("o_orderkey"), F.lit("/"), F.col("o_orderpriority"), F.lit("!"))
    return P.table(spark, sf, "orders").select("o_orderkey", text.job_key(ref).alias("job_key"))


@query("h54_json_floats", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '\"inf\"' WHEN 1 THEN '\"-inf\"' WHEN 2 THEN NULL ELSE '0.5' END AS v FROM customer")
def _(spark, sf):
    k = F.col("c_custkey") % 4
    v = F.when(k == 0, D.INF).when(k == 1, -D.INF).when(k == 2, float("nan")).otherwise(0.5)
    return P.table(spark, sf, "customer").select("c_custkey", D.json_number(v).alias("v"))


@query("h55_hashed_words", r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) AS w FROM documents),
 n AS (SELECT doc_id, CAST('0x' || substr(md5(w), 31, 2) AS BIGINT) AS bucket, count(*) AS n FROM w WHERE w <> '' GROUP BY 1, 2)
 SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM n""")
def _(spark, sf):
    return text.hashed_words(P.table(spark, sf, "documents"), "doc_id", "text")
