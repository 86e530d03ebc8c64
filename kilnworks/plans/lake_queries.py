"""Registered source and sink queries: each writes what it derives, reads it back and returns it."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnworks.functions import delay as D
from kilnworks.functions import text
from kilnworks.operators import checks as K
from kilnworks.operators import metrics as M
from kilnworks.plans.catalog import query
from kilnworks.session import scratch_path
from kilnworks.sources import files as L
from kilnworks.sources import proxies as P


@query("a01_quote_export", """SELECT l.quotationLineItemID, l.quotationID::VARCHAR AS "quotationID", l.quantity, round(l.salesPrice, 6) AS "salesPrice", CAST(quoteDate AS VARCHAR) AS "quoteDate", 1 AS "revisionNumber", CAST(NULL AS DOUBLE) AS "lineTotal" FROM quote_lines l JOIN quotes USING (quotationID)""")
def _(spark, sf):
    """The combined export written as CSV without its optional columns, then read by name."""
    path = scratch_path(spark, "export")
    flat = P.quote_lines(spark, sf).join(P.quotes(spark, sf), "quotationID").drop("revisionNumber", "parentQuotationID", "listPrice")
    flat.write.option("header", True).csv(path)
    return L.read_quote_export(spark, path).select(
        "quotationLineItemID", "quotationID", "quantity", "salesPrice", "quoteDate", "revisionNumber", "lineTotal")


@query("a02_snapshot_csv", "SELECT snapshot_id, CAST(snapshot_date AS VARCHAR) AS snapshot_date, round(available_qty, 6) AS available_qty FROM snapshots")
def _(spark, sf):
    path = scratch_path(spark, "snapshots")
    P.snapshots(spark, sf).write.option("header", True).csv(path)
    return L.read_snapshots(spark, path).select("snapshot_id", "snapshot_date", F.col("available_qty").cast("double").alias("available_qty"))


@query("a07_cached_advisories", """SELECT id, '{"w":' || id || '}' AS insight FROM items WHERE id % 3 = 0""")
def _(spark, sf):
    i = P.stock_tables(spark, sf)["items"].withColumn("custom_elements", F.when(
        F.col("id") % 3 == 0, F.concat(F.lit('{"ai_delay":{"w":'), "id", F.lit("}}"))).when(F.col("id") % 3 == 1, '{"other":1}'))
    return L.cached_advisories(i, "ai_delay").select("id", "insight")


@query("a08_lake_parquet", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY 1", digits=4)
def _(spark, sf):
    path = L.lake_path(scratch_path(spark, "lake"), "demo", "m1", "silver", "lines")
    L.lake_write(P.table(spark, sf, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("decimal(18,4)")), path)
    return spark.read.parquet(path).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


PART = 1000


def snapshot_records(spark, sf):
    """Snapshot records with the allowed fields of their operations, at most a thousand operations to a record.

    A larger job has further records with a higher ``part``; nothing is left out.
    """
    t = P.production_tables(spark, sf)
    a, e, d, q = (F.col(c) for c in ("actual", "expected", "done_quantity", "job_quantity"))
    ops = t["work_orders"].withColumn("time_overrun_ratio", D.json_number(D.time_overrun(a, e, d, q)))
    one = F.struct("operation_id", "status", "time_overrun_ratio")
    part = F.floor((F.col("seq") - 1) / PART)
    per = ops.groupBy("job_id", part.alias("part")).agg(F.array_sort(F.collect_list(one)).alias("operations"))
    o = P.table(spark, sf, "orders")
    return o.join(per, o.o_orderkey == per.job_id).select(
        F.when(F.col("o_orderkey") % 9 == 0, "other.v1").otherwise("m3.snapshot.v1").alias("schema"),
        F.concat(F.lit("t"), F.col("o_custkey") % 5).alias("tenant"), text.job_key(F.concat(F.lit("WH/MO/"), "o_orderkey")).alias("job_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("scored_at"), F.lit(1.0).alias("delay_threshold"), "part", "operations",
        F.struct(F.lit("approved").alias("status"), (F.col("o_orderstatus") == "P").alias("is_delayed")).alias("insight"),
        F.date_format("o_orderdate", "yyyy-MM").alias("dt"))


@query("a09_json_records", "SELECT strftime(o_orderdate, '%Y-%m') AS dt, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "json")
    L.write_json_records(snapshot_records(spark, sf), path, partition="dt")
    return spark.read.json(path).groupBy("dt").agg(F.count(F.lit(1)).alias("n"))


@query("a10_snapshot_scan", "SELECT 't' || (o_custkey % 5) AS tenant, count(*) AS n, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS is_delayed FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def _(spark, sf):
    """Foreign records and broken lines beside the snapshots are passed over."""
    path = scratch_path(spark, "scan")
    L.write_json_records(snapshot_records(spark, sf).drop("dt"), path)
    P.table(spark, sf, "nation").select(F.concat(F.lit('{"schema": "m3.snapshot.v1", "tenant": '), "n_name").alias("value")).write.mode("append").text(path)
    return L.read_snapshot_records(spark, path).groupBy("tenant").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("insight.is_delayed")).alias("is_delayed"))


@query("a11_advisory_merge", """SELECT id, json_extract_string(j, '$.ai_stockout.risk')::BIGINT AS risk, json_extract_string(j, '$.demand_forecast_qty') AS demand, json_extract_string(j, '$.inventory.past_due_qty') AS past_due FROM (
 SELECT id, json_merge_patch(coalesce(custom_elements, '{}')::JSON, CASE WHEN id % 2 = 0 THEN ('{"ai_stockout": {"risk": ' || id || '}, "demand_forecast_qty": 41}')::JSON ELSE '{}'::JSON END) AS j FROM items)""")
def _(spark, sf):
    i = P.stock_tables(spark, sf)["items"]
    pay = i.filter(F.col("id") % 2 == 0).select("id", F.concat(
        F.lit('{"ai_stockout": {"risk": '), "id", F.lit('}, "demand_forecast_qty": 41}')).alias("payload"))
    m = L.merge_advisories(i, pay, "id")
    c = F.col("custom_elements")
    return m.select("id", F.get_json_object(c, "$.ai_stockout.risk").cast("bigint").alias("risk"),
                    F.get_json_object(c, "$.demand_forecast_qty").alias("demand"), F.get_json_object(c, "$.inventory.past_due_qty").alias("past_due"))


@query("a12_audit_append", """SELECT 'Smart Quote' AS module, 'score' AS action, 'Quotation' AS entity_type, CAST(quotationID AS VARCHAR) AS entity_id, '{"low_confidence":' || (p < .40 OR p > .95) || ',"hidden":' || (n < 5) || '}' AS metadata
 FROM (SELECT quotationID, (quotationID % 100) / 100.0 AS p, quotationID % 30 AS n FROM quotes) WHERE p < .40 OR p > .95 OR n < 5""")
def _(spark, sf):
    q = P.quotes(spark, sf).select("quotationID", (F.col("quotationID") % 100 / 100.0).alias("p"), (F.col("quotationID") % 30).alias("n"))
    q = q.withColumns({"low_confidence": (F.col("p") < .40) | (F.col("p") > .95), "hidden": F.col("n") < 5})
    rows = L.audit_rows(q, "Smart Quote", "score", "Quotation", "quotationID", F.col("low_confidence") | F.col("hidden"), ["low_confidence", "hidden"])
    path = scratch_path(spark, "audit")
    rows.write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("a13_idempotent_append", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS ids FROM orders")
def _(spark, sf):
    """Two overlapping loads; the second adds only ids the first did not bring."""
    o = P.table(spark, sf, "orders")
    path = scratch_path(spark, "seed")
    o.filter(F.col("o_orderkey") % 3 != 0).write.parquet(path)
    K.new_rows_only(o, spark.read.parquet(path), "o_orderkey").select(o.columns).write.mode("append").parquet(path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("ids"))


RELIABILITY = "SELECT '{t}' AS \"table\", bin, count(*) AS rows, round(avg({p}), 6) AS mean_probability, round(avg(y), 6) AS observed_rate FROM (SELECT *, {b} AS bin FROM scored) GROUP BY bin"


def _bins(p):
    return " + ".join(f"CASE WHEN {p} >= {e!r}::DOUBLE THEN 1 ELSE 0 END" for e in M.EDGES)


@query("a15_reliability_export", RELIABILITY.format(t="before", p="p2", b=_bins("p2")) + " UNION ALL " + RELIABILITY.format(t="after", p="p", b=_bins("p")))
def _(spark, sf):
    s = P.scored_lines(spark, sf)
    path = scratch_path(spark, "reliability")
    L.export_csv({"before": M.reliability_table(s, "y", "p2"), "after": M.reliability_table(s, "y", "p")}, path)
    back = spark.read.option("header", True).schema(
        "bin int, rows bigint, mean_probability double, observed_rate double, bin_lower double, bin_upper double, table string").csv(path)
    return back.select("table", "bin", "rows", "mean_probability", "observed_rate")


@query("g02_union_of_metrics", RELIABILITY.format(t="p", p="p", b=_bins("p")).replace("SELECT 'p'", "SELECT 'p'") + " UNION ALL " + RELIABILITY.format(t="p2", p="p2", b=_bins("p2")))
def _(spark, sf):
    s = P.scored_lines(spark, sf)
    a, b = M.reliability_table(s, "y", "p"), M.reliability_table(s, "y", "p2")
    return a.withColumn("table", F.lit("p")).unionByName(b.withColumn("table", F.lit("p2"))).drop("bin_lower", "bin_upper")


@query("g03_set_difference", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def _(spark, sf):
    li = P.table(spark, sf, "lineitem").filter(F.col("l_quantity") > 25).select(F.col("l_orderkey").alias("o_orderkey"))
    return K.new_rows_only(P.table(spark, sf, "orders"), li, "o_orderkey").select("o_orderkey")


@query("b24_bronze_allow_list", "SELECT job_id, string_agg(operation_id || ':' || status, ',' ORDER BY operation_id) AS operations, 5 AS fields FROM work_orders GROUP BY 1")
def _(spark, sf):
    """Operators ride along in the input and must not be in the output."""
    wo = P.production_tables(spark, sf)["work_orders"].withColumn("time_overrun_ratio", F.lit(None).cast("double"))
    every = F.struct("operation_id", "status", "operators", "expected", "actual", "time_overrun_ratio", "operation_name")
    per = wo.groupBy("job_id", F.floor((F.col("seq") - 1) / PART).alias("part")).agg(F.collect_list(every).alias("ops")).withColumn("ops", L.bronze_operations(F.col("ops")))
    n = len(per.schema["ops"].dataType.elementType.fields)
    pairs = F.array_sort(F.transform("ops", lambda o: F.struct(o["operation_id"].alias("i"), o["status"].alias("s"))))
    return per.select("job_id", F.array_join(F.transform(pairs, lambda o: F.concat(o["i"], F.lit(":"), o["s"])), ",").alias("operations"),
                      F.lit(n).alias("fields"))


@query("h58_advisory_payload", """SELECT quotationID, '{"ai_quote":{"win_probability_pct":' || CAST(quotationID % 100 AS VARCHAR) || ',"low_confidence":' || (quotationID % 100 < 40) || ',"display":' || (quotationID % 30 >= 5) || ',"model_version":"7"}}' AS payload FROM quotes""")
def _(spark, sf):
    pct = F.col("quotationID") % 100
    body = F.struct(pct.alias("win_probability_pct"), (pct < 40).alias("low_confidence"), (F.col("quotationID") % 30 >= 5).alias("display"), F.lit("7").alias("model_version"))
    return P.quotes(spark, sf).select("quotationID", F.to_json(F.struct(body.alias("ai_quote"))).alias("payload"))
