"""Registered stock queries: scans, checks, snapshots, targets, projections, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnworks.functions import inventory as V
from kilnworks.operators import checks as K
from kilnworks.operators import inventory as N
from kilnworks.operators import split as S
from kilnworks.operators.labels import decided_headers
from kilnworks.operators.scale import last_per_key
from kilnworks.plans.catalog import query
from kilnworks.sources import proxies as P

AS_OF = "2001-12-31 00:00:00"


@query("a04_inventory_scan", "SELECT p_partkey AS id, p_name AS item_name, p_type AS item_type, round(p_retailprice, 6) AS unit_cost FROM part WHERE p_size > 5")
def _(spark, sf):
    return P.table(spark, sf, "part").filter(F.col("p_size") > 5).select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("item_name"), F.col("p_type").alias("item_type"),
        F.col("p_retailprice").alias("unit_cost"))


@query("b05_code_resolution", """SELECT o_orderkey AS id, m.code FROM orders JOIN (VALUES ('F', 'CONFIRMED'), ('P', 'CLOSED_LOST'), ('O', 'QUOTATION_SENT')) m(id, code) ON m.id = o_orderstatus WHERE m.code IN ('CONFIRMED', 'SALES_ORDER_STATUS', 'CLOSED_LOST')""")
def _(spark, sf):
    """The code table is a literal of three rows, so it is broadcast."""
    codes = spark.createDataFrame([("F", "CONFIRMED"), ("P", "CLOSED_LOST"), ("O", "QUOTATION_SENT")], "sid string, code string")
    wanted = codes.filter(F.col("code").isin("CONFIRMED", "SALES_ORDER_STATUS", "CLOSED_LOST"))
    o = P.table(spark, sf, "orders")
    return o.join(F.broadcast(wanted), o.o_orderstatus == wanted.sid).select(F.col("o_orderkey").alias("id"), "code")


@query("b10_strict_boolean", "SELECT l_linestatus = 'F' AS flag, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    li = P.table(spark, sf, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", F.when(F.col("l_linenumber") % 2 == 0, " Yes").otherwise("TRUE"))
        .otherwise(F.when(F.col("l_linenumber") % 2 == 0, "0.0").otherwise("no ")).alias("flag"))
    return K.strict_boolean(li, "flag").groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("b11_numeric_coercion", "SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN round(value, 6) END, 0.0) AS value FROM events")
def _(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return P.table(spark, sf, "events").select("event_id", F.coalesce(raw.try_cast("double"), F.lit(0.0)).alias("value"))


@query("b12_column_defaults", "SELECT snapshot_id, 0.0::DOUBLE AS unit_cost, 'unknown' AS item_type, false AS use_rule_based, CAST(NULL AS VARCHAR) AS next_delivery FROM snapshots")
def _(spark, sf):
    df, _added = K.column_defaults(P.snapshots(spark, sf).select("snapshot_id"), ["unit_cost"], ["item_type"], ["use_rule_based"], ["next_delivery"])
    return df


@query("b13_nested_lookup", """SELECT id, CASE WHEN id % 4 = 0 THEN '40' END AS demand, CASE WHEN id % 4 = 1 THEN '7' END AS past_due, CASE WHEN id % 4 = 2 THEN '20' END AS risk FROM items""")
def _(spark, sf):
    c = F.col("custom_elements")
    return P.stock_tables(spark, sf)["items"].select(
        "id", V.custom_value(c, "demand_forecast_qty").alias("demand"), V.custom_value(c, "past_due_qty").alias("past_due"),
        V.custom_value(c, "external_risk_pct").alias("risk"))


@query("b14_row_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')")
def _(spark, sf):
    return K.search_rows(P.table(spark, sf, "part"), "RiNg", ["p_name", "p_brand", "p_type"]).select("p_partkey")


@query("b17_what_if_override", """SELECT snapshot_id, CASE WHEN item_id % 10 = 0 THEN 5.0 ELSE round(available_qty, 6) END AS available_qty, CASE WHEN item_id % 10 = 0 THEN item_id::DOUBLE ELSE round(rop, 6) END AS rop FROM snapshots""")
def _(spark, sf):
    s = P.snapshots(spark, sf)
    changes = P.table(spark, sf, "supplier").filter(F.col("s_suppkey") % 10 == 0).select(
        F.col("s_suppkey").alias("item_id"), F.lit(5.0).alias("available_qty"), F.col("s_suppkey").cast("double").alias("rop"))
    return K.override(s, changes, ["item_id"], ["available_qty", "reserved_qty", "rop"]).select("snapshot_id", "available_qty", "rop")


@query("b19_contract_coercion", """SELECT snapshot_id, round(available_qty, 6) AS available_qty, CAST(snapshot_date AS VARCHAR) AS snapshot_date, 'unknown' AS item_type, use_rule_based, CAST(NULL AS DOUBLE) AS lead_time FROM snapshots""")
def _(spark, sf):
    return K.coerce_contract(P.snapshots(spark, sf), {
        "snapshot_id": "string", "available_qty": "double", "snapshot_date": "date", "item_type": "string",
        "use_rule_based": "boolean", "lead_time": "double"})


@query("b21_quantity_validation", """SELECT 'negative_available_qty' AS rule, count(CASE WHEN available_qty - 40 < 0 THEN 1 END) AS violations FROM snapshots UNION ALL
 SELECT 'negative_open_qty', count(CASE WHEN open_qty < 0 THEN 1 END) FROM snapshots UNION ALL SELECT 'reliability_range', count(CASE WHEN calculated_vendor_reliability * 1.1 > 1 THEN 1 END) FROM snapshots""")
def _(spark, sf):
    s = P.snapshots(spark, sf).withColumns({"available_qty": F.col("available_qty") - 40,
                                            "calculated_vendor_reliability": F.col("calculated_vendor_reliability") * 1.1})
    return K.violation_counts(s, K.snapshot_rules(["available_qty", "open_qty"]))


@query("b22_injected_validation", """SELECT problem, count(*) AS n FROM (SELECT CASE WHEN a.stockout_flag OR a.available_qty <= 0 THEN 'origin_not_in_stock' WHEN b.snapshot_id IS NULL THEN 'no_outcome' END AS problem
 FROM snapshots a LEFT JOIN snapshots b ON a.item_id = b.item_id AND a.warehouse_id = b.warehouse_id AND b.snapshot_date = a.snapshot_date + 7 WHERE a.business_scenario_injected) WHERE problem IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return K.injected_mismatches(N.future_outcome(P.snapshots(spark, sf))).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("b23_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return K.duplicate_keys(P.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("c06_open_po_lines", "SELECT item_id, vendor_id, count(*) AS n, round(sum(open_qty), 4) AS open_qty FROM open_lines GROUP BY 1, 2", digits=4)
def _(spark, sf):
    t = P.stock_tables(spark, sf)
    return N.open_po_lines(t["purchase_orders"], t["purchase_order_lines"]).groupBy("item_id", "vendor_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("open_qty").alias("open_qty"))


@query("c07_components_with_status", "SELECT coalesce(status, 'Not Applicable') AS status, warehouse_id, count(*) AS n, sum(required_qty) AS required_qty FROM mo_components LEFT JOIN mos ON mos.id = mo_id GROUP BY 1, 2")
def _(spark, sf):
    t = P.stock_tables(spark, sf)
    mos = t["manufacturing_orders"].withColumnRenamed("id", "mo_id")
    return t["mo_components"].join(mos, "mo_id", "left").groupBy(
        F.coalesce("status", F.lit("Not Applicable")).alias("status"), "warehouse_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("required_qty").alias("required_qty"))


@query("c08_products_using_item", "SELECT l_partkey AS item_id, count(DISTINCT p.p_partkey % 500) AS n_products_using_item FROM lineitem LEFT JOIN part p ON p.p_partkey = l_orderkey % 2000 GROUP BY 1")
def _(spark, sf):
    t = P.stock_tables(spark, sf)
    return N.products_using(t["boms"], t["bom_components"])


@query("c09_first_vendor", "SELECT item_id, arg_min(vendor_id, (created_at, id)) AS vendor_id FROM item_vendors GROUP BY 1")
def _(spark, sf):
    return N.first_vendor(P.stock_tables(spark, sf)["item_vendors"]).select("item_id", "vendor_id")


@query("c12_exact_offset_join", """SELECT a.snapshot_id, b.stockout_flag AS flag_4w FROM snapshots a JOIN snapshots b ON a.item_id = b.item_id AND a.warehouse_id = b.warehouse_id AND b.snapshot_date = a.snapshot_date + 28""")
def _(spark, sf):
    s = P.snapshots(spark, sf)
    later = s.select("item_id", "warehouse_id", F.col("snapshot_date").alias("at"), F.col("stockout_flag").alias("flag_4w"))
    return s.withColumn("at", F.date_add("snapshot_date", 28)).join(later, ["item_id", "warehouse_id", "at"]).select("snapshot_id", "flag_4w")


@query("c13_fk_existence", "SELECT count(*) AS missing FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def _(spark, sf):
    li = P.table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "product_id")
    return K.orphans(li, P.table(spark, sf, "part").filter(F.col("p_size") > 10), "product_id", "p_partkey").agg(
        F.count(F.lit(1)).alias("missing"))


CHRONO = """WITH d AS (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT snapshot_date FROM snapshots)),
 c AS (SELECT snapshot_date, CASE WHEN i < greatest(1, floor(n * 0.70)) THEN 'train' WHEN i < least(greatest(greatest(1, floor(n * 0.70)) + 1, floor(n * (0.70 + 0.15))), n - 1) THEN 'calibration' ELSE 'test' END AS fold FROM d)"""


@query("c14_group_holdout", CHRONO + """, s AS (SELECT * FROM snapshots JOIN c USING (snapshot_date)), h AS (SELECT DISTINCT item_id FROM s WHERE item_id % 5 = 0)
 SELECT fold, count(*) AS n FROM s WHERE fold = 'test' OR item_id NOT IN (SELECT item_id FROM h) GROUP BY 1""")
def _(spark, sf):
    s = S.chronological_split(P.snapshots(spark, sf), "snapshot_date")
    return S.drop_holdout_history(s, ["item_id", "warehouse_id"], "business_scenario_injected", "snapshot_date").groupBy(
        "fold").agg(F.count(F.lit(1)).alias("n"))


@query("i08_chronological_split", CHRONO + " SELECT snapshot_id, fold FROM snapshots JOIN c USING (snapshot_date)")
def _(spark, sf):
    return S.chronological_split(P.snapshots(spark, sf), "snapshot_date").select("snapshot_id", "fold")


GROUP_SPLIT = """WITH l AS (SELECT l_orderkey AS quotationID, count(*) AS size FROM lineitem GROUP BY 1), g AS (SELECT quotationID, size, quoteDate FROM l JOIN quotes USING (quotationID)),
 s AS (SELECT quotationID, coalesce(sum(size) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen, sum(size) OVER () AS n FROM g)
 SELECT quotationID, CASE WHEN seen < 0.60 * n THEN 'train' WHEN seen < (0.60 + 0.20) * n THEN 'calibration' ELSE 'holdout' END AS fold FROM s"""


def _dated_lines(spark, sf):
    q = P.quotes(spark, sf).select("quotationID", "quoteDate", (F.col("statusName") == "Closed Won").cast("int").alias("won"))
    return P.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("quotationID")).join(q, "quotationID")


@query("e15_ordered_group_split", GROUP_SPLIT.format(order="quoteDate, quotationID"))
def _(spark, sf):
    return S.temporal_group_split(_dated_lines(spark, sf), "quotationID", "quoteDate").select("quotationID", "fold").distinct()


@query("i09_grouped_split", GROUP_SPLIT.format(order="md5('7-' || quotationID)"))
def _(spark, sf):
    """The seeded fallback order of the grouped split."""
    return S.hashed_group_split(_dated_lines(spark, sf), "quotationID", 7).select("quotationID", "fold").distinct()


@query("i09_three_way_split", GROUP_SPLIT.format(order="quoteDate, quotationID"))
def _(spark, sf):
    out, _how = S.three_way_split(_dated_lines(spark, sf), "quotationID", "quoteDate", "won")
    return out.select("quotationID", "fold").distinct()


@query("i10_stratified_split", """SELECT quotationID, CASE WHEN row_number() OVER (PARTITION BY won ORDER BY md5(quotationID::VARCHAR)) - 1 < floor(0.8 * count(*) OVER (PARTITION BY won)) THEN 'train' ELSE 'test' END AS fold FROM decided""")
def _(spark, sf):
    return S.stratified_group_split(decided_headers(P.quotes(spark, sf)), "quotationID", "won").select("quotationID", "fold")


@query("c15_preferred_lines", "SELECT item_id, count(*) AS n, round(sum(open_qty), 4) AS open_qty FROM preferred GROUP BY 1", digits=4)
def _(spark, sf):
    t = P.stock_tables(spark, sf)
    lines = N.preferred_lines(t["items"], N.open_po_lines(t["purchase_orders"], t["purchase_order_lines"]))
    return lines.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("open_qty").alias("open_qty"))


@query("c16_scored_snapshot", "SELECT snapshot_id, round(s_acctbal, 6) AS risk FROM snapshots LEFT JOIN supplier ON s_suppkey = item_id AND s_suppkey % 2 = 0")
def _(spark, sf):
    risks = P.table(spark, sf, "supplier").filter(F.col("s_suppkey") % 2 == 0).select(
        F.col("s_suppkey").alias("item_id"), (F.col("s_suppkey") % 3).alias("warehouse_id"), F.col("s_acctbal").alias("risk"))
    return P.snapshots(spark, sf).join(risks, ["item_id", "warehouse_id"], "left").select("snapshot_id", "risk")


@query("d06_vendor_history", "SELECT vendor_id, total, on_time, late, strftime(earliest, '%Y-%m-%d %H:%M:%S.%f') AS earliest FROM vendor_history")
def _(spark, sf):
    return N.vendor_history(P.stock_tables(spark, sf)["goods_received_notes"]).select("vendor_id", "total", "on_time", "late", "earliest")


@query("h13_grn_on_time", """SELECT vendor_id, count(CASE WHEN ok THEN 1 END) AS on_time, count(CASE WHEN NOT ok THEN 1 END) AS late, count(CASE WHEN ok IS NULL THEN 1 END) AS unknown FROM (
 SELECT vendor_id, CASE WHEN status IN ('Goods Received', 'Partially Received') THEN updated_at <= scheduled_delivery_date END AS ok FROM grns) GROUP BY 1""")
def _(spark, sf):
    ok = V.grn_on_time(F.col("status"), F.col("scheduled_delivery_date"), F.col("updated_at"))
    return P.stock_tables(spark, sf)["goods_received_notes"].withColumn("ok", ok).groupBy("vendor_id").agg(
        F.count_if("ok").alias("on_time"), F.count_if(~F.col("ok")).alias("late"), F.count_if(F.col("ok").isNull()).alias("unknown"))


@query("d07_vendor_reliability", """SELECT vendor_id, round(avg(CASE WHEN status IN ('Goods Received', 'Partially Received') THEN CASE WHEN updated_at <= scheduled_delivery_date THEN 1.0 ELSE 0.0 END END), 6) AS reliability FROM grns GROUP BY 1""")
def _(spark, sf):
    ok = V.grn_on_time(F.col("status"), F.col("scheduled_delivery_date"), F.col("updated_at"))
    return P.stock_tables(spark, sf)["goods_received_notes"].groupBy("vendor_id").agg(F.avg(ok.cast("double")).alias("reliability"))


@query("d08_open_po_rollup", "SELECT item_id, round(open_qty, 6) AS open_qty, strftime(open_po_deadline, '%Y-%m-%d %H:%M:%S.%f') AS open_po_deadline, round(open_po_vendor_reliability, 6) AS open_po_vendor_reliability FROM open_rollup")
def _(spark, sf):
    t = P.stock_tables(spark, sf)
    lines = N.preferred_lines(t["items"], N.open_po_lines(t["purchase_orders"], t["purchase_order_lines"]))
    return N.open_po_rollup(lines, N.vendor_history(t["goods_received_notes"]))


@query("d09_mo_demand", "SELECT item_id, has_draft, round(draft_qty, 6) AS draft_qty, round(reserved_qty, 6) AS reserved_qty, round(consumed_qty, 6) AS consumed_qty, mo_status FROM demand")
def _(spark, sf):
    t = P.stock_tables(spark, sf)
    return N.mo_demand(t["mo_components"], t["manufacturing_orders"]).select(
        "item_id", "has_draft", F.col("draft_mo_required_qty").alias("draft_qty"), "reserved_qty", "consumed_qty",
        F.when(F.col("in_progress"), "In Progress").when(F.col("confirmed"), "Confirmed").otherwise("Not Applicable").alias("mo_status"))


@query("d10_current_snapshot", """SELECT i.id AS item_id, i.item_name, i.default_warehouse_id AS warehouse_id, r_name AS warehouse_name, '2001-12-31' AS snapshot_date, i.item_type, i.available_quantity AS available_qty,
 round(coalesce(d.reserved_qty, 0), 6) AS reserved_qty, i.rop, coalesce(u.n, 0) AS n_products_using_item, CASE WHEN i.id % 4 = 0 THEN 40.0 ELSE i.forecasted_quantity END AS demand_forecast_qty,
 CASE WHEN i.id % 4 = 1 THEN 7.0::DOUBLE ELSE 0.0 END AS past_due_qty, round(coalesce(o.open_qty, 0), 6) AS open_qty, strftime(o.open_po_deadline, '%Y-%m-%d %H:%M:%S.%f') AS open_po_deadline, coalesce(v.lead_time_days, 0)::DOUBLE AS lead_time_days,
 coalesce(h.total, 0) AS vendor_total_completed_pos, coalesce(h.on_time, 0) AS vendor_on_time_pos, coalesce(h.late, 0) AS vendor_late_pos, round(h.reliability, 6) AS calculated_vendor_reliability,
 round(o.open_po_vendor_reliability, 6) AS open_po_vendor_reliability, CASE WHEN d.has_draft THEN 'Draft' ELSE 'Not Applicable' END AS draft_mo_status, round(coalesce(d.draft_qty, 0), 6) AS draft_mo_required_qty,
 coalesce(d.mo_status, 'Not Applicable') AS mo_status, round(coalesce(d.consumed_qty, 0), 6) AS consumed_qty, round(coalesce(greatest(floor(datediff('second', h.earliest, TIMESTAMP '2001-12-31') / 86400.0) / 30.0, 0), 0), 6) AS months_of_history,
 coalesce(greatest(floor(datediff('second', h.earliest, TIMESTAMP '2001-12-31') / 86400.0) / 30.0, 0), 0) < 6 AS use_rule_based, CASE WHEN i.id % 4 = 2 THEN 20.0::DOUBLE ELSE 0.0 END AS external_risk_pct
 FROM items i LEFT JOIN region ON r_regionkey = i.default_warehouse_id LEFT JOIN (SELECT item_id, arg_min(vendor_id, (created_at, id)) AS vendor_id, arg_min(lead_time_days, (created_at, id)) AS lead_time_days FROM item_vendors GROUP BY 1) v ON v.item_id = i.id
 LEFT JOIN vendor_history h ON h.vendor_id = v.vendor_id LEFT JOIN demand d ON d.item_id = i.id LEFT JOIN open_rollup o ON o.item_id = i.id
 LEFT JOIN (SELECT l_partkey AS item_id, count(DISTINCT p_partkey % 500) AS n FROM lineitem JOIN part ON p_partkey = l_orderkey % 2000 GROUP BY 1) u ON u.item_id = i.id WHERE i.default_warehouse_id IS NOT NULL""")
def _(spark, sf):
    return N.current_snapshots(P.stock_tables(spark, sf), AS_OF)


@query("d50_skipped_items", "SELECT count(*) AS items, count(CASE WHEN default_warehouse_id IS NULL THEN 1 END) AS skipped FROM items")
def _(spark, sf):
    return P.stock_tables(spark, sf)["items"].agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("default_warehouse_id").isNull()).alias("skipped"))


@query("h59_months_of_history", "SELECT vendor_id, round(greatest(floor(datediff('second', earliest, TIMESTAMP '2001-12-31') / 86400.0) / 30.0, 0), 6) AS months FROM vendor_history")
def _(spark, sf):
    days = F.floor((F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros("earliest")) / F.lit(86_400_000_000))
    return N.vendor_history(P.stock_tables(spark, sf)["goods_received_notes"]).select(
        "vendor_id", F.greatest(days / 30.0, F.lit(0.0)).alias("months"))


@query("d37_column_profile", """SELECT 'l_partkey' AS column_name, count(DISTINCT l_partkey) AS distinct_values FROM lineitem UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate) FROM lineitem
 UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity) FROM lineitem""")
def _(spark, sf):
    return K.distinct_counts(P.table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_returnflag", "l_quantity"))


@query("d38_source_readiness", """SELECT 'quotations' AS source, (SELECT count(*) FROM orders) AS rows, (SELECT count(DISTINCT o_orderdate) FROM orders) AS dates, (SELECT count(DISTINCT o_orderstatus) FROM orders) AS labels, '' AS missing, true AS trainable
 UNION ALL SELECT 'quotation_line_items', (SELECT count(*) FROM lineitem), (SELECT count(DISTINCT l_shipdate) FROM lineitem), (SELECT count(DISTINCT l_returnflag) FROM lineitem), 'l_region', false""")
def _(spark, sf):
    return K.readiness({
        "quotations": (P.table(spark, sf, "orders"), ["o_orderkey", "o_custkey"], "o_orderdate", "o_orderstatus"),
        "quotation_line_items": (P.table(spark, sf, "lineitem"), ["l_orderkey", "l_region"], "l_shipdate", "l_returnflag")})


@query("d39_history_sufficiency", "SELECT count(DISTINCT snapshot_date) AS weeks, count(DISTINCT stockout_flag) AS classes, count(DISTINCT snapshot_date) >= 80 AND count(DISTINCT stockout_flag) = 2 AS sufficient FROM snapshots")
def _(spark, sf):
    c = P.snapshots(spark, sf).agg(F.count_distinct("snapshot_date").alias("weeks"), F.count_distinct("stockout_flag").alias("classes"))
    return c.withColumn("sufficient", (F.col("weeks") >= 80) & (F.col("classes") == 2))


@query("e07_hazard_targets", "SELECT snapshot_id, target::INTEGER AS target, target_4w, target_9w FROM targets")
def _(spark, sf):
    return N.hazard_targets(P.snapshots(spark, sf)).select("snapshot_id", "target", "target_4w", "target_9w")


@query("e07_risk_set", "SELECT target::INTEGER AS target, count(*) AS n, count(target_4w) AS known_4w, count(target_9w) AS known_9w FROM targets WHERE target IS NOT NULL AND NOT stockout_flag GROUP BY 1")
def _(spark, sf):
    return N.supervised_frame(P.snapshots(spark, sf)).groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), F.count("target_4w").alias("known_4w"), F.count("target_9w").alias("known_9w"))


@query("e08_future_outcome", """SELECT a.snapshot_id, CAST(b.snapshot_date AS VARCHAR) AS future_outcome_date_1w, b.stockout_flag AS future_stockout_flag_1w FROM snapshots a LEFT JOIN snapshots b
 ON a.item_id = b.item_id AND a.warehouse_id = b.warehouse_id AND b.snapshot_date = a.snapshot_date + 7""")
def _(spark, sf):
    return N.future_outcome(P.snapshots(spark, sf)).select("snapshot_id", "future_outcome_date_1w", "future_stockout_flag_1w")


@query("e09_latest_snapshot", "SELECT arg_max(snapshot_id, snapshot_date) AS snapshot_id, item_id, warehouse_id FROM snapshots GROUP BY item_id, warehouse_id")
def _(spark, sf):
    return last_per_key(P.snapshots(spark, sf), ["item_id", "warehouse_id"], ["snapshot_date"]).select("snapshot_id", "item_id", "warehouse_id")


@query("f01_ranked_page", """SELECT item_id, round(risk, 6) AS risk, round(net, 6) AS net_available FROM (SELECT item_id, available_qty / nullif(demand_forecast_qty, 0) + item_id / 1000.0 AS risk, available_qty - reserved_qty AS net,
 row_number() OVER (PARTITION BY item_id ORDER BY snapshot_date DESC) AS rn FROM snapshots) WHERE rn = 1 ORDER BY risk DESC, item_id LIMIT 25 OFFSET 25""")
def _(spark, sf):
    """Second page of 25 in total order; each task keeps only the first two pages."""
    latest = last_per_key(P.snapshots(spark, sf), ["item_id"], ["snapshot_date"])
    risk = F.try_divide("available_qty", "demand_forecast_qty") + F.col("item_id") / 1000.0
    rows = latest.select("item_id", risk.alias("risk"), (F.col("available_qty") - F.col("reserved_qty")).alias("net_available"))
    return rows.orderBy(F.desc("risk"), "item_id").offset(25).limit(25)


@query("h12_rop_state", """SELECT snapshot_id, CASE WHEN available_qty > rop THEN 'Available' WHEN available_qty < rop THEN 'Below ROP' ELSE 'ROP Reached' END AS state, round(greatest(rop - available_qty, 0), 6) AS deficit FROM snapshots""")
def _(spark, sf):
    a, r = F.col("available_qty"), F.col("rop")
    return P.snapshots(spark, sf).select("snapshot_id", V.rop_state(a, r).alias("state"), V.rop_deficit(a, r).alias("deficit"))


@query("h20_safe_ratio", "SELECT snapshot_id, round(past_due_qty / nullif(reserved_qty, 0), 6) AS ratio FROM snapshots")
def _(spark, sf):
    return P.snapshots(spark, sf).select("snapshot_id", V.safe_ratio(F.col("past_due_qty"), F.col("reserved_qty")).alias("ratio"))


ENGINEERED = ["lead_time_days", "projected_without_po", "projected_with_po", "inventory_to_rop_ratio", "draft_mo_shortage_qty",
              "draft_mo_coverage_ratio", "material_shortfall_qty", "consumption_to_reservation_ratio", "days_until_po_delivery"]


@query("h21_engineered_features", "SELECT snapshot_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in ENGINEERED)
       + ", CAST(open_po_deadline AS VARCHAR) AS open_po_deadline FROM engineered")
def _(spark, sf):
    return V.engineer(P.snapshots(spark, sf)).select("snapshot_id", *ENGINEERED, "open_po_deadline")


PROJECTED = """SELECT *, snapshot_date + CAST(7 * w AS INTEGER) AS at, coalesce(open_po_deadline <= snapshot_date + CAST(7 * w AS INTEGER), false) AS arrived FROM engineered CROSS JOIN range(0, 9) t(w)"""
PLAIN = "greatest(available_qty - (demand_forecast_qty / 4 + planned_bom_qty + past_due_qty) * w + CASE WHEN arrived THEN open_qty ELSE 0 END, 0)"
RICH = """greatest(available_qty - demand_forecast_qty / 4 * w - CASE WHEN w > 0 THEN past_due_qty + planned_bom_qty + CASE WHEN draft_mo_status = 'Draft' THEN draft_mo_required_qty ELSE 0 END
 + CASE WHEN mo_status IN ('Confirmed', 'In Progress') THEN consumed_qty ELSE 0 END ELSE 0 END + CASE WHEN arrived THEN open_qty * coalesce(open_po_vendor_reliability, 1) ELSE 0 END, 0)"""


@query("h22_weekly_projection", f"""SELECT item_id, w AS week_index, round(sum({PLAIN}), 4) AS available_qty, round(sum(CASE WHEN arrived THEN 0 ELSE open_qty END), 4) AS open_qty,
 count(CASE WHEN NOT arrived THEN open_po_deadline END) AS deadlines FROM ({PROJECTED}) GROUP BY 1, 2""", digits=4)
def _(spark, sf):
    p = V.project(V.engineer(P.snapshots(spark, sf)))
    return p.groupBy("item_id", "week_index").agg(F.sum("available_qty").alias("available_qty"), F.sum("open_qty").alias("open_qty"),
                                                  F.count("open_po_deadline").alias("deadlines"))


@query("h23_expected_projection", f"""SELECT item_id, w AS week_index, round(sum({RICH}), 4) AS available_qty FROM ({PROJECTED}) GROUP BY 1, 2""", digits=4)
def _(spark, sf):
    return V.project_expected(V.engineer(P.snapshots(spark, sf))).groupBy("item_id", "week_index").agg(
        F.sum("available_qty").alias("available_qty"))


def _hazard(avail, opn):
    return f"""least(greatest(greatest(demand_forecast_qty + past_due_qty + planned_bom_qty - (greatest({avail} - reserved_qty, 0) + {opn}), 0)
 / greatest(demand_forecast_qty + past_due_qty + planned_bom_qty, rop, 1), 0), 1)"""


@query("h24_rule_hazard", f"SELECT snapshot_id, round({_hazard('available_qty', 'open_qty')}, 6) AS hazard, coalesce(months_of_history, 6) < 6 OR use_rule_based AS rule_based FROM snapshots")
def _(spark, sf):
    return P.snapshots(spark, sf).select("snapshot_id", V.rule_hazard().alias("hazard"), V.rule_based().alias("rule_based"))


@query("h25_rule_mask", "SELECT snapshot_id, coalesce(months_of_history, 6) < 6 OR coalesce(use_rule_based, false) AS rule_based FROM snapshots")
def _(spark, sf):
    return P.snapshots(spark, sf).select("snapshot_id", V.rule_based().alias("rule_based"))


RISKS = f"""SELECT snapshot_id, 1 - product(1 - CASE WHEN w < 4 THEN h ELSE 0 END) AS risk_30d, 1 - product(1 - h) AS risk_60d FROM (
 SELECT snapshot_id, w, {_hazard('({a})', '({o})')} AS h FROM ({PROJECTED})) GROUP BY 1"""
RISK_PLAIN = RISKS.replace("{a}", PLAIN).replace("{o}", "CASE WHEN arrived THEN 0 ELSE open_qty END")


@query("h30_survival_risk", f"SELECT snapshot_id, round(risk_30d, 6) AS risk_30d, round(risk_60d, 6) AS risk_60d FROM ({RISK_PLAIN})")
def _(spark, sf):
    origins = V.engineer(P.snapshots(spark, sf))
    return N.horizon_risks(origins, V.rule_hazard(), ["snapshot_id"], V.project(origins), ("risk_30d", "risk_60d"))


@query("h26_badges", f"""SELECT CASE WHEN risk_30d >= .66 THEN 'Red' WHEN risk_30d >= .33 THEN 'Amber' ELSE 'Green' END AS badge, count(*) AS n FROM ({RISK_PLAIN}) GROUP BY 1""")
def _(spark, sf):
    origins = V.engineer(P.snapshots(spark, sf))
    r = N.horizon_risks(origins, V.rule_hazard(), ["snapshot_id"], V.project(origins), ("risk_30d", "risk_60d"))
    return r.groupBy(V.badge(F.col("risk_30d")).alias("badge")).agg(F.count(F.lit(1)).alias("n"))


@query("d41_risk_bands", f"SELECT count(*) AS products, count(CASE WHEN risk_30d >= .66 THEN 1 END) AS high, count(CASE WHEN risk_30d >= .33 AND risk_30d < .66 THEN 1 END) AS medium, count(CASE WHEN risk_30d < .33 THEN 1 END) AS low FROM ({RISK_PLAIN})")
def _(spark, sf):
    origins = V.engineer(P.snapshots(spark, sf))
    r = N.horizon_risks(origins, V.rule_hazard(), ["snapshot_id"], V.project(origins), ("risk_30d", "risk_60d"))
    p = F.col("risk_30d")
    return r.agg(F.count(F.lit(1)).alias("products"), F.count_if(p >= .66).alias("high"),
                 F.count_if((p >= .33) & (p < .66)).alias("medium"), F.count_if(p < .33).alias("low"))


FLAGS = """SELECT *, available_qty < rop AS f1, draft_mo_status = 'Draft' AND draft_mo_required_qty > available_qty AS f2, mo_status IN ('Confirmed', 'In Progress') AND material_shortfall_qty > 0 AS f3,
 open_qty > 0 AND projected_without_po < rop AND (open_po_vendor_reliability < .75 OR open_po_vendor_reliability IS NULL) AS f4 FROM engineered"""


@query("h27_business_rules", f"""SELECT snapshot_id, f1 AS low_stock, f2 AS draft_mo_risk, f3 AS material_overrun_risk, f4 AS unreliable_po_coverage,
 concat_ws(',', CASE WHEN f1 THEN 'low_stock' END, CASE WHEN f2 THEN 'draft_mo_risk' END, CASE WHEN f3 THEN 'material_overrun_risk' END, CASE WHEN f4 THEN 'unreliable_po_coverage' END) AS reasons FROM ({FLAGS})""")
def _(spark, sf):
    flags = V.rule_flags()
    return V.engineer(P.snapshots(spark, sf)).select(
        "snapshot_id", *[f.alias(n) for n, f in flags.items()], F.concat_ws(",", V.rule_reasons(flags)).alias("reasons"))


@query("h28_suppression", """SELECT snapshot_id, d > 0 AND open_qty >= d AND coalesce(open_po_vendor_reliability, calculated_vendor_reliability, 0) > .95 AS suppressed FROM (
 SELECT *, greatest(rop - (available_qty - reserved_qty), 0) AS d FROM engineered)""")
def _(spark, sf):
    return V.engineer(P.snapshots(spark, sf)).select("snapshot_id", V.suppressed().alias("suppressed"))


@query("h29_alerts", f"""SELECT snapshot_id, m OR f1 OR f2 OR f3 OR f4 AS final_alert, concat_ws(',', CASE WHEN m THEN 'model_risk_30d' END, CASE WHEN f1 THEN 'low_stock' END, CASE WHEN f2 THEN 'draft_mo_risk' END,
 CASE WHEN f3 THEN 'material_overrun_risk' END, CASE WHEN f4 THEN 'unreliable_po_coverage' END) AS reasons FROM (SELECT f.*, risk_30d >= .33 AS m FROM ({FLAGS}) f JOIN ({RISK_PLAIN}) USING (snapshot_id))""")
def _(spark, sf):
    origins = V.engineer(P.snapshots(spark, sf))
    risks = N.horizon_risks(origins, V.rule_hazard(), ["snapshot_id"], V.project(origins), ("model_risk_30d", "model_risk_60d"))
    return N.compose_alerts(origins.join(risks, "snapshot_id")).select(
        "snapshot_id", "final_alert", F.concat_ws(",", "alert_reasons").alias("reasons"))
