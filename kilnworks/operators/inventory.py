"""Snapshot jobs: current snapshots, future outcomes, supervised targets, scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnworks.functions import inventory as V
from kilnworks.operators.scale import top_per_key

KEY = ["item_id", "warehouse_id"]
# Purchase orders in these states are closed.
CLOSED_PO = ["closed", "cancelled", "canceled", "goods received", "received", "partially received - closed"]
MO_LABELS = {"DRAFT": "Draft", "CONFIRMED": "Confirmed", "IN_PROGRESS": "In Progress", "DONE": "Done",
             "CANCELLED": "Cancelled"}


def _lead_window():
    # one row per (item, warehouse, date): a key holds at most one row per calendar week
    return Window.partitionBy(*KEY).orderBy("snapshot_date")


def future_outcome(df: DataFrame) -> DataFrame:
    """Date and stock-out flag of the next row, only if it is exactly a week later."""
    w = _lead_window()
    nxt, flag = F.lead("snapshot_date").over(w), F.lead("stockout_flag").over(w)
    week = F.datediff(nxt, F.col("snapshot_date")) == 7
    return df.withColumns({"future_outcome_date_1w": F.when(week, nxt), "future_stockout_flag_1w": F.when(week, flag)})


def hazard_targets(df: DataFrame) -> DataFrame:
    """Next-week target and 4 and 9 week outcomes, censored where the weekly grid breaks."""
    w = _lead_window()
    flags, on_grid = [], []
    for k in range(1, 10):
        flags.append(F.lead("stockout_flag", k).over(w))
        on_grid.append(F.datediff(F.lead("snapshot_date", k).over(w), F.col("snapshot_date")) == 7 * k)
    out = df.withColumns({f"__f{k}": f for k, f in enumerate(flags, 1)} | {f"__g{k}": g for k, g in enumerate(on_grid, 1)})

    def horizon(n: int) -> Column:
        seen = [F.coalesce(F.col(f"__g{k}") & F.col(f"__f{k}").isNotNull(), F.lit(False)) for k in range(1, n + 1)]
        valid, hit = seen[0], F.col("__f1")
        for k in range(2, n + 1):
            valid, hit = valid & seen[k - 1], hit | F.col(f"__f{k}")
        return F.when(valid, hit)

    out = out.withColumns({"target": horizon(1).cast("int"), "target_4w": horizon(4), "target_9w": horizon(9)})
    return out.drop(*[f"__{x}{k}" for x in "fg" for k in range(1, 10)])


def supervised_frame(df: DataFrame) -> DataFrame:
    """Rows at risk (in stock now, next week observed) with engineered features."""
    return V.engineer(hazard_targets(df).filter(F.col("target").isNotNull() & ~F.col("stockout_flag")))


def vendor_history(grns: DataFrame) -> DataFrame:
    """Per vendor: completed, on-time and late purchase orders, first receipt.

    A purchase order counts once, by its last receipt against its last deadline.
    """
    got = grns.filter(F.lower("status").contains("received") & F.col("vendor_id").isNotNull()
                      & F.col("scheduled_delivery_date").isNotNull() & F.col("updated_at").isNotNull())
    per_po = got.groupBy("vendor_id", "purchase_order_id").agg(
        F.max("scheduled_delivery_date").alias("deadline"), F.max("updated_at").alias("received"))
    return per_po.groupBy("vendor_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("received") <= F.col("deadline")).alias("on_time"),
        F.min("received").alias("earliest")).withColumns({
            "late": F.col("total") - F.col("on_time"), "reliability": F.col("on_time") / F.col("total")})


def open_po_lines(pos: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines with quantity still to come on purchase orders that are not closed."""
    live = pos.filter(~F.coalesce(F.lower("status").isin(CLOSED_PO), F.lit(False))).select(
        F.col("id").alias("purchase_order_id"), "vendor_id", "warehouse_id", "scheduled_delivery_date")
    todo = F.greatest(V.zero("ordered_quantity") - V.zero("received_quantity"), F.lit(0.0))
    return lines.join(live, "purchase_order_id").withColumn("open_qty", todo).filter(F.col("open_qty") > 0)


def preferred_lines(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Open lines at the item's own warehouse (or with none) if it has any, else all of its lines."""
    own = items.select(F.col("id").alias("item_id"), "default_warehouse_id")
    here = F.col("warehouse_id").isNull() | (F.col("warehouse_id") == F.col("default_warehouse_id"))
    tagged = lines.join(own, "item_id").withColumn("here", F.coalesce(here, F.lit(False)))
    has = tagged.filter("here").select("item_id").distinct().withColumn("has_here", F.lit(True))
    return tagged.join(has, "item_id", "left").filter(F.col("here") | F.col("has_here").isNull()).drop("has_here")


def open_po_rollup(lines: DataFrame, vendors: DataFrame) -> DataFrame:
    """Per item: open quantity, first deadline, quantity-weighted reliability of known vendors."""
    rated = lines.join(vendors.select("vendor_id", "reliability"), "vendor_id", "left")
    known = F.col("reliability").isNotNull()
    return rated.groupBy("item_id").agg(
        F.sum("open_qty").alias("open_qty"), F.min("scheduled_delivery_date").alias("open_po_deadline"),
        F.try_divide(F.sum(F.when(known, F.col("reliability") * F.col("open_qty"))),
                     F.sum(F.when(known, F.col("open_qty")))).alias("open_po_vendor_reliability"))


def mo_demand(components: DataFrame, orders: DataFrame) -> DataFrame:
    """Per item: draft requirement, active reservations and consumption, strongest active status."""
    j = components.join(orders.select(F.col("id").alias("mo_id"), F.col("status").alias("mo")), "mo_id", "left")
    active = F.col("mo").isin("Confirmed", "In Progress")
    return j.groupBy("item_id").agg(
        F.max(F.col("mo") == "Draft").alias("has_draft"),
        F.sum(F.when(F.col("mo") == "Draft", F.col("required_qty"))).alias("draft_mo_required_qty"),
        F.sum(F.when(active, F.col("reserved_qty"))).alias("reserved_qty"),
        F.sum(F.when(active, F.col("consumed_qty"))).alias("consumed_qty"),
        F.bool_or(F.coalesce(F.col("mo") == "In Progress", F.lit(False))).alias("in_progress"),
        F.bool_or(F.coalesce(F.col("mo") == "Confirmed", F.lit(False))).alias("confirmed"))


def products_using(boms: DataFrame, bom_components: DataFrame) -> DataFrame:
    return (bom_components.filter(F.col("item_id").isNotNull())
            .join(boms.select(F.col("id").alias("bom_id"), "product_id"), "bom_id", "left")
            .groupBy("item_id").agg(F.count_distinct("product_id").alias("n_products_using_item")))


def first_vendor(item_vendors: DataFrame) -> DataFrame:
    """One vendor per item: the earliest (created_at, id)."""
    return top_per_key(item_vendors, ["item_id"], [F.asc("created_at"), F.asc("id")], 1).drop("rn")


def current_snapshots(t: dict[str, DataFrame], as_of: str) -> DataFrame:
    """One row per item at its default warehouse as of an explicit instant."""
    items, at = t["items"], F.lit(as_of).cast("timestamp")
    vendors = vendor_history(t["goods_received_notes"])
    open_lines = preferred_lines(items, open_po_lines(t["purchase_orders"], t["purchase_order_lines"]))
    primary = first_vendor(t["item_vendors"]).select("item_id", "vendor_id", "lead_time_days").join(vendors, "vendor_id", "left")
    wh = t["warehouses"].select(F.col("id").alias("warehouse_id"), "warehouse_name")
    base = (items.filter(F.col("default_warehouse_id").isNotNull())
            .withColumnRenamed("id", "item_id").withColumnRenamed("default_warehouse_id", "warehouse_id")
            .join(wh, "warehouse_id", "left").join(primary, "item_id", "left")
            .join(mo_demand(t["mo_components"], t["manufacturing_orders"]), "item_id", "left")
            .join(open_po_rollup(open_lines, vendors), "item_id", "left")
            .join(products_using(t["boms"], t["bom_components"]), "item_id", "left"))
    forecast = F.coalesce(F.col("forecasted_quantity").try_cast("double"), F.lit(0.0))

    def custom(name: str, default: Column) -> Column:
        raw = V.custom_value(F.col("custom_elements"), name)
        return F.when(raw.isNull(), default).otherwise(F.coalesce(raw.try_cast("double"), F.lit(0.0)))

    months = F.coalesce(F.greatest(F.floor(
        (F.unix_micros(at) - F.unix_micros(F.col("earliest").cast("timestamp"))) / F.lit(86_400_000_000)) / 30.0,
        F.lit(0.0)), F.lit(0.0))
    return base.select(
        "item_id", "item_name", "warehouse_id", "warehouse_name", F.to_date(at).alias("snapshot_date"), "item_type",
        F.coalesce(F.col("available_quantity").try_cast("double"), F.lit(0.0)).alias("available_qty"),
        V.zero("reserved_qty").alias("reserved_qty"), F.coalesce(F.col("rop").try_cast("double"), F.lit(0.0)).alias("rop"),
        F.coalesce("n_products_using_item", F.lit(0)).alias("n_products_using_item"),
        custom("demand_forecast_qty", forecast).alias("demand_forecast_qty"),
        custom("past_due_qty", F.lit(0.0)).alias("past_due_qty"), V.zero("open_qty").alias("open_qty"),
        "open_po_deadline", F.coalesce("lead_time_days", F.lit(0)).cast("double").alias("lead_time_days"),
        F.coalesce("total", F.lit(0)).alias("vendor_total_completed_pos"),
        F.coalesce("on_time", F.lit(0)).alias("vendor_on_time_pos"), F.coalesce("late", F.lit(0)).alias("vendor_late_pos"),
        F.col("reliability").alias("calculated_vendor_reliability"), "open_po_vendor_reliability",
        F.when(F.col("has_draft"), "Draft").otherwise("Not Applicable").alias("draft_mo_status"),
        V.zero("draft_mo_required_qty").alias("draft_mo_required_qty"),
        F.when(F.col("in_progress"), "In Progress").when(F.col("confirmed"), "Confirmed")
         .otherwise("Not Applicable").alias("mo_status"), V.zero("consumed_qty").alias("consumed_qty"),
        months.alias("months_of_history"), (months < V.RULE_BASED_MONTHS).alias("use_rule_based"),
        custom("external_risk_pct", F.lit(0.0)).alias("external_risk_pct"))


def horizon_risks(origins: DataFrame, hazard: Column, keys: list[str], projected: DataFrame,
                  names: tuple[str, str]) -> DataFrame:
    """30 and 60 day risk per snapshot from weekly hazards: one pass over nine rows each."""
    return projected.withColumn("__h", hazard).groupBy(*keys).agg(
        V.survival(F.col("__h"), F.col("week_index") < 4).alias(names[0]),
        V.survival(F.col("__h"), F.col("week_index") < 9).alias(names[1]))


def compose_alerts(scored: DataFrame) -> DataFrame:
    """Badges, rule flags, reasons, final alert and suppression beside the model risks."""
    flags = V.rule_flags()
    model = F.col("model_risk_30d") >= V.ALERT_AT
    reasons = V.rule_reasons(flags)
    return scored.withColumns({
        "badge_30d": V.badge(F.col("model_risk_30d")), "badge_60d": V.badge(F.col("model_risk_60d")),
        "is_rule_based": V.rule_based(), "business_rule_override": F.size(reasons) > 0,
        "business_rule_flags": F.create_map(*[x for n, f in flags.items() for x in (F.lit(n), f)]),
        "final_alert": model | (F.size(reasons) > 0),
        "alert_reasons": F.concat(F.when(model, F.array(F.lit("model_risk_30d"))).otherwise(
            F.array().cast("array<string>")), reasons),
        "suppressed": V.suppressed()})
