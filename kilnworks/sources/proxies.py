"""Domain tables derived by Spark from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote headers: one row per order."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region")
    key = F.col("o_orderkey")
    return (o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
            .join(r, F.col("n_regionkey") == r.r_regionkey)
            .select(
        key.alias("quotationID"), F.col("o_custkey").alias("customerID"),
        F.col("o_orderpriority").alias("salesRepID"), F.col("c_mktsegment").alias("industry"),
        F.col("r_name").alias("region"), F.col("o_orderdate").cast("date").alias("quoteDate"),
        (key % 45).alias("leadTimeDays"),
        F.when(F.col("o_orderstatus") == "F", "Closed Won")
         .when(F.col("o_orderstatus") == "P", "Closed Lost").otherwise("Sent").alias("statusName"),
        F.col("o_totalprice").alias("grandTotal"),
        F.when((key % 5).isin(1, 2), key - 1).alias("parentQuotationID"),
        F.when(key % 5 <= 2, key % 5 + 1).otherwise(1).alias("revisionNumber"),
        F.when(key % 3 == 0, "Immediate Payment").when(key % 3 == 1, "15 days")
         .otherwise("21 days").alias("paymentTerms")))


def quote_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote lines: one row per line item, with cost and list price from the part."""
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_retailprice")
    raw = F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")
    sale = F.floor(raw * 100 + 0.5) / 100
    negotiated = F.floor(raw * 97 + 0.5) / 100
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("quotationLineItemID"),
        F.col("l_orderkey").alias("quotationID"), F.col("l_linenumber").alias("lineNumber"),
        F.col("l_partkey").alias("productID"), F.col("l_quantity").alias("quantity"),
        F.col("p_retailprice").alias("unitPrice"), sale.alias("salesPrice"),
        F.when(F.col("l_linenumber") % 4 == 0, negotiated).alias("negotiatedSalesPrice"),
        (F.lit(1.67) * F.col("p_retailprice")).alias("listPrice"),
        (F.col("l_discount") * 100).alias("discountPercent"),
        F.col("p_type").alias("materialSpec"), F.col("p_name").alias("productName"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly item x warehouse snapshots from line items, with real gaps in the week grid."""
    qty, item = F.col("l_quantity"), F.col("item_id")

    def at_line(n: int):
        return F.sum(F.when(F.col("l_linenumber") == n, qty).otherwise(0.0))

    g = (table(spark, sf_dir, "lineitem")
         .groupBy(F.col("l_suppkey").alias("item_id"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("snapshot_date"))
         .agg(F.sum(qty).alias("all_qty"), at_line(1).alias("q1"), at_line(3).alias("q3"), at_line(5).alias("q5"),
              at_line(7).alias("q7"), F.count_if(F.col("l_linenumber") == 6).alias("n6"),
              F.sum(F.when(F.col("l_returnflag") == "N", qty).otherwise(0.0)).alias("qn"),
              (F.count_if(F.col("l_discount") >= 0.05) / F.count(F.lit(1))).alias("rel"),
              (F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1))).alias("r_share")))
    return g.select(
        F.concat_ws("-", item, F.date_format("snapshot_date", "yyyyMMdd")).alias("snapshot_id"), "item_id",
        (item % 3).alias("warehouse_id"), "snapshot_date", F.col("all_qty").alias("available_qty"),
        (F.col("q1") * 0.5).alias("reserved_qty"), (20 + item % 30).cast("double").alias("rop"),
        (F.col("all_qty") * 0.8).alias("demand_forecast_qty"), F.col("qn").alias("open_qty"),
        F.when(item % 7 != 0, F.date_add("snapshot_date", (item % 21).cast("int"))).alias("open_po_deadline"),
        F.when(item % 11 != 0, F.col("rel")).alias("open_po_vendor_reliability"), (F.col("r_share") > 0.5).alias("stockout_flag"),
        F.col("q7").alias("past_due_qty"), (F.col("n6") * 5.0).alias("planned_bom_qty"),
        (7 + item % 10).cast("double").alias("lead_time_days"), (item % 4 * 10).cast("double").alias("external_risk_pct"),
        F.when(item % 3 == 0, "Draft").otherwise("Not Applicable").alias("draft_mo_status"), F.col("q5").alias("draft_mo_required_qty"),
        F.when(item % 4 == 0, "Confirmed").when(item % 4 == 1, "In Progress").when(item % 4 == 2, "Not Applicable")
         .otherwise("Done").alias("mo_status"), F.col("q3").alias("consumed_qty"),
        F.when(item % 13 != 0, (item % 12).cast("double")).alias("months_of_history"), (item % 17 == 0).alias("use_rule_based"),
        F.when(item % 2 == 0, 0.97).alias("calculated_vendor_reliability"), (item % 5 == 0).alias("business_scenario_injected"))


def stock_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Operational stock tables: items, purchase orders, receipts, manufacturing orders, bills."""
    part, li, o = (table(spark, sf_dir, n) for n in ("part", "lineitem", "orders"))
    pk, ok = F.col("p_partkey"), F.col("o_orderkey")
    due = F.timestamp_add("DAY", F.lit(60), F.col("o_orderdate").cast("timestamp"))
    t = {"items": part.select(
        pk.alias("id"), F.col("p_name").alias("item_name"), F.col("p_type").alias("item_type"), F.col("p_size").cast("double").alias("rop"),
        F.when(pk % 9 != 0, pk % 5).alias("default_warehouse_id"), (F.col("p_size") * 3.0).alias("available_quantity"),
        (pk % 100).cast("double").alias("forecasted_quantity"),
        F.when(pk % 4 == 0, '{"demand_forecast_qty": 40}').when(pk % 4 == 1, '{"inventory": {"past_due_qty": 7}}')
         .when(pk % 4 == 2, '{"ai_inventory": {"external_risk_pct": 20}}').alias("custom_elements"))}
    t["warehouses"] = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("warehouse_name"))
    t["item_vendors"] = li.groupBy(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("id")).agg(
        F.min("l_shipdate").alias("created_at")).withColumns({"vendor_id": F.col("id"), "lead_time_days": F.col("id") % 30})
    t["purchase_orders"] = o.select(
        ok.alias("id"), (F.col("o_custkey") % 100).alias("vendor_id"), F.when(ok % 4 != 0, ok % 5).alias("warehouse_id"),
        due.alias("scheduled_delivery_date"), F.when(F.col("o_orderstatus") == "F", "Received")
        .when(F.col("o_orderstatus") == "P", "Confirmed").otherwise("Sent").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"))
    t["purchase_order_lines"] = li.select(
        F.col("l_orderkey").alias("purchase_order_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("ordered_quantity"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(F.floor(F.col("l_quantity") / 2)).cast("double").alias("received_quantity"))
    t["goods_received_notes"] = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_orderkey").alias("purchase_order_id"), F.col("l_suppkey").alias("vendor_id"), due.alias("scheduled_delivery_date"),
        F.when(F.col("l_returnflag") == "R", "Goods Received").when(F.col("l_returnflag") == "A", "Partially Received")
         .otherwise("Pending").alias("status"), F.col("l_shipdate").cast("timestamp").alias("updated_at"))
    t["manufacturing_orders"] = o.select(
        ok.alias("id"), F.when(ok % 5 == 0, "Draft").when(ok % 5 == 1, "Confirmed").when(ok % 5 == 2, "In Progress")
        .when(ok % 5 == 3, "Done").otherwise("Cancelled").alias("status"), (ok % 5).alias("warehouse_id"))
    t["mo_components"] = li.select(
        F.col("l_orderkey").alias("mo_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("required_qty"),
        (F.col("l_quantity") * 0.5).alias("reserved_qty"), (F.col("l_quantity") * 0.75).alias("consumed_qty"))
    t["boms"] = part.select(pk.alias("id"), (pk % 500).alias("product_id"))
    t["bom_components"] = li.select((F.col("l_orderkey") % 2000).alias("bom_id"), F.col("l_partkey").alias("item_id"))
    return t


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with two deterministic scores and an outcome that depends on price."""
    from kilnworks.plans.frames import priced_lines
    f = priced_lines(quote_lines(spark, sf_dir))
    r, d = F.col("price_ratio"), F.col("discountPercent")
    return f.select(
        F.col("quotationLineItemID").alias("id"), "quotationID", "productID", "materialSpec", "quantity", "unitPrice",
        "price_ratio", "discountPercent", (F.floor(10000 / (1 + r) + 0.5) / 10000).alias("p"),
        (F.floor(10000 / (1 + r * 1.3 + d / 10) + 0.5) / 10000).alias("p2"),
        F.when(((r < 1) & (F.col("quotationID") % 3 != 0)) | (F.col("lineNumber") == 2), 1).otherwise(0).alias("y"))


def tenant_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (tenant, signal); every customer stands for a tenant."""
    from kilnworks.operators.weights import SIGNALS
    k, o = F.col("tenant"), F.col("s.ord")
    sig = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("signal"), F.lit(p).alias("prior_bp"),
                             F.lit(lo).alias("min_bp"), F.lit(hi).alias("max_bp")) for i, (n, p, lo, hi) in enumerate(SIGNALS)])
    priors = F.array(*[F.lit(p) for _, p, _, _ in SIGNALS])
    a, b = k * 37 % 3000, k * 11 % 900
    return (table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tenant"), F.explode(sig).alias("s"))
            .select("tenant", "s.*", (((k + o) % 4 != 0) & (k % 50 != 7)).alias("available"),
                    F.element_at(priors, ((o + k) % 5 + 1).cast("int")).alias("fitted_bp"),
                    F.when(o == 0, a).when(o == 1, -a).when(o == 3, b).when(o == 4, -b).otherwise(0).alias("adjust_bp")))


def _line_id():
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                       F.round(F.col("l_extendedprice") * 100).cast("bigint"))


def production_tables(spark: SparkSession, sf_dir: str, write_once: bool = False, with_orders: bool = False) -> dict[str, DataFrame]:
    """Work orders of jobs (orders), their dependencies, operators' logs, components and vendors.

    ``write_once`` stores the work orders, for jobs that read them many times; ``with_orders`` with what vendor orders and receipts
    need, which else join the orders again.
    """
    from kilnworks.session import durable
    from kilnworks.operators.scale import rank_within, text_levels
    li = table(spark, sf_dir, "lineitem")
    block, leaf = text_levels(_line_id())
    with_orders = write_once and with_orders
    kept = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", *["l_returnflag"] * with_orders)
    numbered = rank_within(kept, "l_orderkey", {"__step": F.col("l_linenumber"), "__block": block, "__leaf": leaf}, "seq")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("created_at"))
    if with_orders:  # lines and orders of a key are in one place anyway
        numbered = numbered.join(o.groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.collect_list(F.struct("created_at")).alias("__orders")), "l_orderkey", "left")
    if write_once:  # numbers and dates alone; the texts follow from them
        numbered = durable(numbered)
    numbered = numbered.withColumn("lid", _line_id())
    pc, qty = F.col("l_partkey") % 11, F.col("l_quantity")
    expected = 60 + 10 * qty
    worked = F.floor(expected * pc * (6 + F.col("l_suppkey") % 10) / 100) * F.when(F.col("l_partkey") % 101 == 0, 30).otherwise(1)
    step, sup, key = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_orderkey")
    wo = numbered.select(
        key.alias("job_id"), "seq", F.concat_ws("-", key, "seq").alias("operation_id"), step.alias("step_id"),
        F.col("l_partkey").alias("item_id"), "lid", qty.alias("job_quantity"), expected.alias("expected"),
        F.floor(qty * pc / 10).cast("double").alias("done_quantity"),
        F.when(pc == 0, F.when(sup % 2 == 0, 0.0)).otherwise(worked.cast("double")).alias("actual"),
        F.when(pc == 0, "PENDING").when(pc == 10, "DONE").otherwise("IN_PROGRESS").alias("status"),
        F.when(pc == 10, F.col("l_shipdate").cast("timestamp")).alias("actual_end"),
        F.when(F.col("seq") > 1, "DEPENDENT").otherwise("INDEPENDENT").alias("operation_type"),
        F.when(step == 1, "Cutting").when(step == 2, "Milling 2").when(step == 3, "Welding").when(step == 4, "Assembly")
         .when(step == 6, "Paint 6").when(step == 7, "Inspection").alias("operation_name"),
        F.when(step % 2 == 0, F.array(sup, sup + 7)).otherwise(F.array(sup)).alias("operators"))
    seq = F.col("seq")
    preds = F.array_compact(F.array(
        F.when(seq % 2 == 0, seq - 1), F.when((seq % 2 == 1) & (seq > 1), seq - 2), F.when(seq % 4 == 0, seq - 3),
        F.when((seq == 2) & (F.col("job_id") % 10 == 0), 99), F.when((seq == 1) & (F.col("job_id") % 97 == 0), 2)))
    edges = wo.select("job_id", "operation_id", F.explode(preds).alias("p")).select(
        "job_id", "operation_id", F.concat_ws("-", "job_id", "p").alias("pred_id"))
    half = F.floor(F.col("actual") / 2).cast("bigint")
    quarter = F.floor(F.col("actual") / 4).cast("bigint")
    logs = wo.filter(F.col("actual").isNotNull()).select("operation_id", F.explode("operators").alias("operator_id"), F.explode(
        F.when(F.col("step_id") % 3 == 0, F.array(half, quarter)).otherwise(F.array(half))).alias("duration_minutes"))
    ordered = numbered.withColumn("created_at", F.explode("__orders.created_at")) if with_orders else li.join(o, li.l_orderkey == o.o_orderkey)
    pos = ordered.select(
        _line_id().alias("po_id"), F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("vendor_id"), "created_at",
        F.when(step % 2 == 1, F.timestamp_add("DAY", F.lit(1), "created_at")).alias("sent_at"),
        F.timestamp_add("DAY", F.lit(60), "created_at").alias("scheduled_delivery_date"),
        F.when(F.col("l_returnflag") == "R", "Goods Received").when(F.col("l_returnflag") == "A", "Partially Received")
         .otherwise("Pending").alias("status"), F.col("l_shipdate").cast("timestamp").alias("updated_at"))
    receipts = pos.filter(F.col("updated_at") >= F.col("created_at")).select("po_id", F.col("po_id").alias("id"), "status", "updated_at")
    return {"work_orders": wo, "edges": edges, "time_logs": logs, "vendor_orders": pos, "receipts": receipts}


def job_components(spark: SparkSession, sf_dir: str, t: dict[str, DataFrame]) -> DataFrame:
    """Component rows of each job with stock and the lead-time ratio of their vendor."""
    from kilnworks.operators.delay import lead_time_ratio, vendor_orders
    from kilnworks.operators.inventory import first_vendor
    iv = first_vendor(stock_tables(spark, sf_dir)["item_vendors"])
    ratio = vendor_orders(iv, t["vendor_orders"], t["receipts"]).select(
        "item_id", "vendor_id", lead_time_ratio(F.col("history")).alias("vendor_ratio"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("vendor_name"))
    p = table(spark, sf_dir, "part").filter(F.col("p_partkey") % 50 != 0).select(
        F.col("p_partkey").alias("item_id"), F.concat_ws(" ", "p_name", "p_size").alias("name"), "p_size")
    return (t["work_orders"].join(p, "item_id").join(ratio.join(s, "vendor_id", "left"), "item_id", "left").select(
        "job_id", "lid", F.col("item_id").alias("component_id"), "name", F.col("job_quantity").alias("required"),
        F.when(F.col("item_id") % 13 == 0, 0.0).otherwise(F.col("p_size").cast("double")).alias("available"),
        "vendor_ratio", "vendor_name"))
