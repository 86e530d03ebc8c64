"""Column expressions for stock: features, projections, hazards and alert rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the alert policy.
UNRELIABLE_BELOW = 0.75
SUPPRESS_ABOVE = 0.95
ALERT_AT = 0.33
RED_AT = 0.66
RULE_BASED_MONTHS = 6.0
FORECAST_WEEKS = 4.0
RULES = ["low_stock", "draft_mo_risk", "material_overrun_risk", "unreliable_po_coverage"]
NUMERIC = ["available_qty", "reserved_qty", "rop", "demand_forecast_qty", "open_qty", "past_due_qty",
           "planned_bom_qty", "lead_time_days", "external_risk_pct", "open_po_vendor_reliability",
           "calculated_vendor_reliability", "draft_mo_required_qty", "consumed_qty", "months_of_history"]


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def floor0(c: Column) -> Column:
    """Clip below at zero, keeping null."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def safe_ratio(n: Column, d: Column) -> Column:
    return F.try_divide(n, F.nullif(d, F.lit(0.0)))


def rop_state(available: Column, rop: Column) -> Column:
    r = F.coalesce(rop, F.lit(0.0))
    return F.when(available > r, "Available").when(available < r, "Below ROP").otherwise("ROP Reached")


def rop_deficit(available: Column, rop: Column) -> Column:
    return F.greatest(F.coalesce(rop, F.lit(0.0)) - available, F.lit(0.0))


def with_schema_columns(df: DataFrame) -> DataFrame:
    add = {c: F.lit(None).cast("double") for c in NUMERIC if c not in df.columns}
    add |= {c: F.lit("unknown") for c in ("draft_mo_status", "mo_status") if c not in df.columns}
    if "open_po_deadline" not in df.columns:
        add["open_po_deadline"] = F.lit(None).cast("date")
    return df.withColumns(add) if add else df


def engineer(df: DataFrame) -> DataFrame:
    """Derived features; purchase-order facts count only while quantity is open."""
    df = with_schema_columns(df)
    open_now = zero("open_qty") > 0
    base_lead = F.coalesce(F.col("base_lead_time_days"), F.col("lead_time_days")) \
        if "base_lead_time_days" in df.columns else F.col("lead_time_days")
    risk = zero("external_risk_pct")
    weekly = zero("demand_forecast_qty") / FORECAST_WEEKS
    due = weekly + zero("planned_bom_qty") + zero("past_due_qty")
    avail, opn, rop = F.col("available_qty"), F.col("open_qty"), F.col("rop")
    overrun = floor0(F.col("consumed_qty") - F.col("reserved_qty"))
    free = floor0(avail - F.col("reserved_qty"))
    deadline = F.when(open_now, F.col("open_po_deadline"))
    adjusted = base_lead * (1 + risk / 100)
    return df.withColumns({
        "open_po_deadline": deadline,
        "open_po_vendor_reliability": F.when(open_now, F.col("open_po_vendor_reliability")),
        "base_lead_time_days": base_lead, "adjusted_lead_time_days": adjusted,
        "lead_time_days": F.when(risk > 0, adjusted).otherwise(base_lead),
        "weekly_demand_qty": weekly,
        "inventory_to_rop_ratio": safe_ratio(avail, rop), "available_minus_rop": avail - rop,
        "projected_without_po": avail - due, "projected_with_po": avail + opn - due,
        "po_needed_for_coverage": F.coalesce(open_now & (avail - due < rop), F.lit(False)).cast("double"),
        "draft_mo_shortage_qty": floor0(F.col("draft_mo_required_qty") - avail),
        "draft_mo_coverage_ratio": safe_ratio(avail, F.col("draft_mo_required_qty")),
        "material_overrun_qty": overrun, "unreserved_available_qty": free,
        "material_shortfall_qty": floor0(overrun - free),
        "consumption_to_reservation_ratio": safe_ratio(F.col("consumed_qty"), F.col("reserved_qty")),
        "days_until_po_delivery": F.datediff(deadline, F.col("snapshot_date")).cast("double"),
    })


def _weeks(df: DataFrame, weeks: int) -> DataFrame:
    df = df.withColumn("week_index", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))))
    return df.withColumn("snapshot_date", F.date_add("snapshot_date", F.col("week_index") * 7))


def _after_arrival(df: DataFrame, available: Column, arrived: Column, reliability: Column) -> DataFrame:
    return df.withColumns({
        "available_qty": F.greatest(available, F.lit(0.0)),
        "open_qty": F.when(arrived, 0.0).otherwise(zero("open_qty")),
        "open_po_deadline": F.when(~arrived, F.col("open_po_deadline")),
        "open_po_vendor_reliability": F.when(~arrived, reliability)})


def project(df: DataFrame, weeks: int = 9) -> DataFrame:
    """Each snapshot at the start of the next ``weeks`` weekly intervals."""
    df = _weeks(df, weeks)
    arrived = F.coalesce(F.col("open_po_deadline") <= F.col("snapshot_date"), F.lit(False))
    demand = zero("demand_forecast_qty") / FORECAST_WEEKS + zero("planned_bom_qty") + zero("past_due_qty")
    left = zero("available_qty") - demand * F.col("week_index") + F.when(arrived, zero("open_qty")).otherwise(0.0)
    return _after_arrival(df, left, arrived, F.col("open_po_vendor_reliability"))


def project_expected(df: DataFrame, weeks: int = 9) -> DataFrame:
    """Richer projection: known one-time demand after week 0, receipts weighted by reliability."""
    df = _weeks(df, weeks)
    arrived = F.coalesce(F.col("open_po_deadline") <= F.col("snapshot_date"), F.lit(False))
    rel = F.when(F.col("open_po_vendor_reliability").isNotNull(),
                 F.least(F.greatest(F.col("open_po_vendor_reliability"), F.lit(0.0)), F.lit(1.0)))
    draft = F.when(F.lower(F.trim("draft_mo_status")) == "draft", zero("draft_mo_required_qty")).otherwise(0.0)
    active = F.when(F.lower(F.trim("mo_status")).isin("confirmed", "in progress"), zero("consumed_qty")).otherwise(0.0)
    once = F.when(F.col("week_index") > 0, zero("past_due_qty") + zero("planned_bom_qty") + draft + active).otherwise(0.0)
    receipt = F.when(arrived, zero("open_qty") * F.coalesce(rel, F.lit(1.0))).otherwise(0.0)
    left = zero("available_qty") - zero("demand_forecast_qty") / FORECAST_WEEKS * F.col("week_index") - once + receipt
    return _after_arrival(df, left, arrived, rel).withColumn("reserved_qty", zero("reserved_qty"))


def rule_hazard() -> Column:
    supply = F.greatest(zero("available_qty") - zero("reserved_qty"), F.lit(0.0)) + zero("open_qty")
    demand = zero("demand_forecast_qty") + zero("past_due_qty") + zero("planned_bom_qty")
    short = F.greatest(demand - supply, F.lit(0.0))
    return F.least(F.greatest(short / F.greatest(demand, zero("rop"), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))


def rule_based() -> Column:
    """Unknown history is not short history; an explicit flag always counts."""
    return (F.coalesce(F.col("months_of_history"), F.lit(RULE_BASED_MONTHS)) < RULE_BASED_MONTHS) | \
        F.coalesce(F.col("use_rule_based"), F.lit(False))


def badge(p: Column) -> Column:
    return F.when(p >= RED_AT, "Red").when(p >= ALERT_AT, "Amber").otherwise("Green")


def rule_flags() -> dict[str, Column]:
    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    rel = F.col("open_po_vendor_reliability")
    flags = [F.col("available_qty") < F.col("rop"),
             (F.lower(F.trim("draft_mo_status")) == "draft") & (F.col("draft_mo_required_qty") > F.col("available_qty")),
             F.lower(F.trim("mo_status")).isin("confirmed", "in progress") & (F.col("material_shortfall_qty") > 0),
             (F.col("open_qty") > 0) & (F.col("projected_without_po") < F.col("rop"))
             & ((rel < UNRELIABLE_BELOW) | rel.isNull())]
    return {n: sure(f) for n, f in zip(RULES, flags)}


def rule_reasons(flags: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in flags.items()]))


def suppressed() -> Column:
    deficit = F.greatest(zero("rop") - (zero("available_qty") - zero("reserved_qty")), F.lit(0.0))
    rel = F.coalesce(F.col("open_po_vendor_reliability"), F.col("calculated_vendor_reliability"), F.lit(0.0))
    return (deficit > 0) & (zero("open_qty") >= deficit) & (rel > SUPPRESS_ABOVE)


def survival(hazard: Column, within: Column) -> Column:
    """1 - product of (1 - hazard) over the rows ``within``; an aggregate."""
    return 1 - F.product(F.when(within, 1 - hazard).otherwise(F.lit(1.0)))


def custom_value(custom: Column, name: str) -> Column:
    """A key of a free-form JSON column, at top level or below one of its namespaces."""
    # The namespaces looked into, in order.
    paths = [f"$.{name}", f"$.inventory.{name}", f"$.m2_inventory.{name}", f"$.ai_inventory.{name}"]
    return F.coalesce(*[F.get_json_object(custom, p) for p in paths])


def grn_on_time(status: Column, scheduled: Column, moved: Column) -> Column:
    known = scheduled.isNotNull() & moved.isNotNull() & status.isin("Goods Received", "Partially Received")
    return F.when(known, moved <= scheduled)
