"""Production jobs: roll-up of work orders, history of operators and vendors, delay elements.

Tables stay flat: one row per operation, per (operation, operator), per component.
What belongs to a whole job (components, progress) is computed once per job and
joined, never repeated per operation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnworks.functions import delay as D
from kilnworks.operators import graph as G
from kilnworks.operators.graph import cascade, critical_path
from kilnworks.operators.scale import id_levels, rank_within, top_per_key
from kilnworks.session import durable

HISTORY = 10
#: Operators up to which their paces are sent to the tasks: two numbers for each.
FEW_OPERATORS = 500_000
RECEIVED = ["Goods Received", "Partially Received"]


def scope_jobs(jobs: DataFrame, references: list[str] | None) -> DataFrame:
    return jobs if references is None else jobs.filter(F.col("reference").isin(references))


def operator_minutes(logs: DataFrame) -> DataFrame:
    return logs.groupBy("operation_id", "operator_id").agg(
        F.sum(F.coalesce("duration_minutes", F.lit(0))).alias("elapsed_minutes"))


def operator_history(work_orders: DataFrame, logs: DataFrame) -> DataFrame:
    """Last ten work orders of every operator, latest finished first, as one array per operator.

    Each task keeps ten rows per operator before the shuffle, so a busy operator
    costs no more than an idle one.
    """
    each = work_orders.select(F.explode("operators").alias("operator_id"), "operation_id", "operation_type",
                              F.col("expected").alias("scheduled_minutes"), "actual_end")
    last = top_per_key(each, ["operator_id"], [F.desc_nulls_last("actual_end"), F.asc("operation_id")], HISTORY)
    last = last.join(operator_minutes(logs), ["operation_id", "operator_id"], "left").withColumn(
        "elapsed_minutes", F.coalesce("elapsed_minutes", F.lit(0)))
    entry = F.struct("rn", "operation_id", "elapsed_minutes", "scheduled_minutes", "actual_end", "operation_type")
    return last.groupBy("operator_id").agg(F.array_sort(F.collect_list(entry)).alias("history"))


def operator_pace(history: DataFrame) -> DataFrame:
    """Mean elapsed over scheduled of each operator's finished orders, and how many there are."""
    usable = F.filter("history", lambda h: h["actual_end"].isNotNull() & (F.coalesce(h["scheduled_minutes"], F.lit(0)) != 0))
    ratios = F.transform(usable, lambda h: h["elapsed_minutes"] / h["scheduled_minutes"])
    total = F.aggregate(ratios, F.lit(0.0), lambda a, r: a + r)
    n = F.size(ratios)
    return history.select("operator_id", F.try_divide(total, n).alias("pace"), n.alias("completed"))


def operation_pace(work_orders: DataFrame, pace: DataFrame) -> DataFrame:
    """Mean pace over the operators of each operation; those without history do not count."""
    return _paces(work_orders, pace).groupBy("job_id", "operation_id").agg(
        F.avg("pace").alias("operator_pace_ratio"), F.coalesce(F.sum("completed"), F.lit(0)).alias("completed_work_orders"))


def _paces(work_orders: DataFrame, pace: DataFrame) -> DataFrame:
    """job_id, operation_id, pace and completed orders of each operator of each operation."""
    pace = durable(pace)
    if pace.count() <= FEW_OPERATORS:
        pace = F.broadcast(pace)
    each = work_orders.select("job_id", "operation_id", F.explode("operators").alias("operator_id"))
    return each.join(pace, "operator_id", "left").select("job_id", "operation_id", "pace", "completed")


def vendor_orders(item_vendor: DataFrame, orders: DataFrame, receipts: DataFrame) -> DataFrame:
    """Last ten purchase orders of each item from its vendor, newest first, as one array per item."""
    mine = orders.join(item_vendor.select("item_id", "vendor_id"), ["item_id", "vendor_id"])
    last = top_per_key(mine, ["item_id", "vendor_id"], [F.desc("created_at"), F.desc("po_id")], HISTORY)
    got = receipts.filter(F.col("status").isin(RECEIVED)).groupBy("po_id").agg(
        F.min_by("updated_at", "id").alias("received"))
    entry = F.struct("rn", "po_id", F.coalesce("sent_at", "created_at").alias("ordered"),
                     F.col("scheduled_delivery_date").alias("deadline"), "received")
    return last.join(got, "po_id", "left").groupBy("item_id", "vendor_id").agg(
        F.array_sort(F.collect_list(entry)).alias("history"))


def lead_time_ratio(history: Column) -> Column:
    """Mean of delivery time over promised time; orders with a gap or no window do not count."""
    def span(a: Column, b: Column) -> Column:
        return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(86_400_000_000.0)

    usable = F.filter(history, lambda h: h["ordered"].isNotNull() & h["deadline"].isNotNull() & h["received"].isNotNull()
                      & (h["deadline"] != h["ordered"]))
    ratios = F.transform(usable, lambda h: span(h["ordered"], h["received"]) / span(h["ordered"], h["deadline"]))
    return F.try_divide(F.aggregate(ratios, F.lit(0.0), lambda a, r: a + r), F.size(ratios))


def predecessor_summary(work_orders: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Per work order: how many work orders of its own job must be done first, and the first and last of them.

    Dependencies name steps of the bill; each step's work orders are summarised per
    job before the join, so steps with many work orders do not multiply.
    """
    steps = work_orders.groupBy("job_id", F.col("step_id").alias("depends_on_id")).agg(
        F.count(F.lit(1)).alias("n"), F.min("operation_id").alias("lo"), F.max("operation_id").alias("hi"))
    own = work_orders.select("job_id", "step_id").distinct()
    need = own.join(dependencies, "step_id").join(steps, ["job_id", "depends_on_id"]).groupBy("job_id", "step_id").agg(
        F.sum("n").alias("predecessors"), F.min("lo").alias("first_predecessor"), F.max("hi").alias("last_predecessor"))
    return work_orders.join(need, ["job_id", "step_id"], "left").select(
        "job_id", "operation_id", F.coalesce("predecessors", F.lit(0)).alias("predecessors"),
        "first_predecessor", "last_predecessor")


def job_progress(operations: DataFrame) -> DataFrame:
    return operations.groupBy("job_id").agg(_progress("").alias("mo_progress"))


def _progress(inside: str) -> Column:
    return F.try_divide(*D.progress_parts(*[F.col(inside + c) for c in ("expected", "done_quantity", "job_quantity")]))


def job_materials(components: DataFrame) -> DataFrame:
    """Per job: shortfall over all its component rows and mean lead-time ratio of its vendors."""
    return components.groupBy("job_id").agg(
        F.sum(F.coalesce(D.shortfall(F.col("required"), F.col("available")), F.lit(0.0))).alias("material_shortfall_ratio"),
        F.avg("vendor_ratio").alias("supplier_reliability"))


def predecessor_overrun(operations: DataFrame, edges: DataFrame) -> DataFrame:
    """Worst known time overrun among the direct predecessors within the job."""
    own = operations.groupBy("job_id", F.col("operation_id").alias("pred_id")).agg(F.max("time_overrun_ratio").alias("time_overrun_ratio"))
    return edges.select("job_id", "operation_id", "pred_id").join(own, ["job_id", "pred_id"]).groupBy("job_id", "operation_id").agg(
        F.max("time_overrun_ratio").alias("predecessor_time_overrun_ratio"))


def _signals_by_jobs(ops: DataFrame, edges: DataFrame, components: DataFrame, pace: DataFrame) -> DataFrame:
    """:func:`_signals_by_joins` of jobs that fit into a row."""
    return G.signals_by_jobs(ops.drop("operators"), edges, _paces(ops, pace), {"mo_progress": _progress("node.")}, job_materials(components))


def _signals_by_joins(ops: DataFrame, edges: DataFrame, components: DataFrame, pace: DataFrame) -> DataFrame:
    """Operations of jobs of any size with each of their signals."""
    timed, crit = critical_path(ops, edges)
    inherited = cascade(crit, ops.select("job_id", "operation_id", F.col("time_overrun_ratio").alias("ratio")))
    worst = inherited.groupBy("job_id", "operation_id").agg(
        F.max("ratio").alias("critical_path_cascade_ratio"), F.min("source_id").alias("cascade_source"))
    return (ops.drop("operators").join(operation_pace(ops, pace), ["job_id", "operation_id"], "left")
            .join(predecessor_overrun(ops, edges), ["job_id", "operation_id"], "left")
            .join(timed, ["job_id", "operation_id"], "left").join(worst, ["job_id", "operation_id"], "left")
            .join(job_materials(components), "job_id", "left").join(job_progress(ops), "job_id", "left"))


def delay_elements(operations: DataFrame, edges: DataFrame, components: DataFrame, pace: DataFrame,
                   weights: dict | None = None, threshold: float = D.THRESHOLD) -> DataFrame:
    """Every delay signal, the composite risk with its cascade overlay and the delayed flag, per operation.

    Jobs of at most ``SMALL_JOB`` operations and ``SMALL_LINKS`` edges meet as one row each with all that their signals need; larger ones
    are joined table by table. ``operations`` are read several times; store them first where they are dear to make. Their operators
    are not handed on, nor are the name and type that the label follows from.
    """
    weights = weights or D.DEFAULT_WEIGHTS
    ops = operations.withColumns({
        "time_overrun_ratio": D.time_overrun(F.col("actual"), F.col("expected"), F.col("done_quantity"), F.col("job_quantity")),
        "operation_label": D.label(F.col("operation_name"), F.lit(None).cast("string"), F.col("operation_type"), F.col("operation_id"))}).drop("operation_name", "operation_type")
    large = G.large_jobs({G.SMALL_JOB: ops, G.SMALL_LINKS: edges})
    lost = ops.filter(F.col("job_id").isNull())  # match nothing
    if large.isEmpty() and lost.isEmpty():
        f = _signals_by_jobs(ops, edges, components, pace)
    else:
        few, many = ([df.join(large, "job_id", how) for df in (ops, edges, components)] for how in ("left_anti", "left_semi"))
        many[0] = many[0].unionByName(lost)
        f = _signals_by_jobs(*few, pace).unionByName(_signals_by_joins(*many, pace))
    f = f.withColumn("material_shortfall_ratio", F.coalesce("material_shortfall_ratio", F.lit(0.0)))
    base = D.composite({k: F.col(k) for k in D.DEFAULT_WEIGHTS}, weights)
    f = f.withColumns({"base_score": base, "predicted_overrun_hours": D.predicted_overrun_hours(
        F.col("actual"), F.col("expected"), F.col("done_quantity"), F.col("job_quantity"), F.col("operator_pace_ratio")),
        "overrun_basis": D.overrun_basis(F.col("actual"), F.col("done_quantity"), F.col("job_quantity"), F.col("operator_pace_ratio"))})
    f = f.withColumn("risk_score", D.overlay(F.col("base_score"), F.col("critical_path_cascade_ratio")))
    return f.withColumn("is_delayed", F.col("risk_score") > threshold)


def outcome_labels(jobs: DataFrame, work_orders: DataFrame) -> DataFrame:
    """Label of each completed order: planned finish, hours late, duration ratio if every actual is known."""
    per = work_orders.groupBy("job_id").agg(
        F.max("scheduled_end").alias("planned_finish"), F.coalesce(F.sum("expected"), F.lit(0)).alias("expected_minutes"),
        F.bool_and(F.col("actual").isNotNull()).alias("complete"), F.sum("actual").alias("actual_sum"))
    late = (F.unix_micros("completed_at") - F.unix_micros("planned_finish")) / F.lit(3.6e9)
    out = jobs.join(per, "job_id", "left").withColumn("hours_late", late)
    actual = F.when(F.col("complete"), F.col("actual_sum"))
    return out.withColumns({"was_late": F.col("hours_late") > 0, "actual_minutes": actual,
                            "duration_overrun_ratio": F.try_divide(actual, F.nullif(F.col("expected_minutes"), F.lit(0)))})


# --- job documents ----------------------------------------------------------
PART = 200
#: Operations whose documents one task puts together.
TASK_OPERATIONS = 100_000


def _placed(rows: DataFrame, key: str, part_size: int) -> DataFrame:
    """Rows with a job and a key, with ``__at``, how many of the job's rows stand before it in the order of ``key``, and ``part``.

    ``rows`` are read three times; they are to be cheap to read.
    """
    ranked = rank_within(rows, "job_id", {f"__l{i}": c for i, c in enumerate(id_levels(rows, key))}, "__at").filter(F.col(key).isNotNull())
    return ranked.withColumn("__at", F.col("__at") - 1).withColumn("part", F.floor(F.col("__at") / part_size))


def _items(placed: DataFrame, entry: Column) -> DataFrame:
    """job_id, part, items: the entries of each part in order."""
    inside = F.array_sort(F.collect_list(F.struct("__at", entry.alias("entry"))))
    return placed.groupBy("job_id", "part").agg(F.transform(inside, lambda x: x["entry"]).alias("items"))


def job_documents(work_orders: DataFrame, edges: DataFrame, history: DataFrame, components: DataFrame, part_size: int = PART) -> DataFrame:
    """job_id, section, part, document: the nested roll-up of every job as JSON.

    Section ``operations`` lists operations with their predecessors and operators, each operator with the last ten work
    orders; section ``components`` lists the job's components once. A job of any size is read by putting its parts one behind the
    other, so no row holds more than ``part_size`` entries.
    """
    whole = lambda c: F.col(c).cast("bigint").alias(c)
    last = F.transform("history", lambda h: F.struct(h["operation_id"].alias("operation_id"), h["elapsed_minutes"].cast("bigint").alias("elapsed_minutes"),
                                                     h["scheduled_minutes"].cast("bigint").alias("scheduled_minutes")))
    before = edges.groupBy("operation_id").agg(F.sort_array(F.collect_set("pred_id")).alias("depends_on_operation_ids"))
    ops = _placed(work_orders.join(before, "operation_id", "left"), "operation_id", part_size)
    # rows of one operation share its operators and are told apart by their copy
    same = Window.partitionBy("job_id", "operation_id")
    told = ["operation_name", "operation_type", "status", "expected", "actual", "job_quantity", "done_quantity", "operators"]
    ops = ops.withColumns({"__copy": F.row_number().over(same.orderBy(*told)), "__operators": F.flatten(F.collect_list("operators").over(same))})
    plain = F.struct("operation_id", "operation_name", "operation_type", "status", F.coalesce("depends_on_operation_ids", F.array().cast("array<string>")).alias("depends_on_operation_ids"),
                     F.col("expected").cast("bigint").alias("expected_duration_minutes"), F.col("actual").cast("bigint").alias("actual_duration_minutes"),
                     whole("job_quantity"), F.col("done_quantity").cast("bigint").alias("current_done_quantity"), F.size("operators").alias("operator_count"))
    at = ["job_id", "part", "__at", "__copy"]
    ops = durable(ops.select(*at, plain.alias("plain"), "__operators"))
    # the last orders of the operators are only joined to numbers, and go to the parts in one shuffle
    asked = ops.select(*at, F.explode("__operators").alias("operator_id")).join(history.select("operator_id", last.alias("last")), "operator_id", "left")
    asked = asked.select(*at, F.struct("operator_id", F.col("last").alias("last_10_work_orders")).alias("operator"))
    both = ops.select(*at, "plain").unionByName(asked, allowMissingColumns=True)
    # repeated orders pack well in a shuffle and not in memory, so partitions are counted in operations
    usual = int(work_orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(max(usual, -(-ops.count() // TASK_OPERATIONS)), "job_id", "part")
    each = both.groupBy(*at).agg(F.any_value("plain", ignoreNulls=True).alias("plain"), F.array_sort(F.collect_list("operator")).alias("named"))
    entry = F.struct(*[F.col(f"plain.{f}").alias(f) for f in ops.schema["plain"].dataType.names], F.when(F.size("named") > 0, F.col("named")).alias("operators"))
    part = F.struct("component_id", "name", F.col("required").cast("bigint").alias("required_quantity"), F.col("available").cast("bigint").alias("available_quantity"),
                    F.col("vendor_name").alias("vendor"))
    sections = {"operations": _items(each, entry), "components": _items(_placed(durable(components), "lid", part_size), part)}
    keep = {"ignoreNullFields": "false"}
    rows = [df.select("job_id", F.lit(name).alias("section"), "part", F.to_json("items", keep).alias("document")) for name, df in sections.items()]
    return rows[0].unionByName(rows[1])
