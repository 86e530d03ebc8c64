"""Review of scored jobs: signal evidence, why-lines, checks of the lines, status.

Input is the flat result of :func:`kilnworks.operators.delay.delay_elements` and
the component rows. All tables are keyed by job (and operation), so any number of
jobs is reviewed in one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnworks.functions import delay as D
from kilnworks.functions.rounding import fixed
from kilnworks.operators.scale import WINDOW_ROWS, integer_levels, prefix_sums, real_levels, top_per_key
from kilnworks.session import durable

# Headlines, wording and limits of the checks.
HEADLINES = {
    "time_overrun_ratio": "Actual time logged has exceeded expected duration",
    "operator_pace_ratio": "Assigned operator has a history of overrunning",
    "material_shortfall_ratio": "Required material is short in the warehouse",
    "supplier_reliability": "Supplier for a short component has a late-delivery history",
    "critical_path_cascade_ratio": "A critical-path predecessor is overrunning",
}
FORBIDDEN_CAUSES = "(?i)breakdown|quality hold|rework|approval|inspection|weather|strike"
NOT_STARTED = ["PENDING", "READY", "NOT_STARTED", "TO_DO"]
NUMERAL = r"[-+]?\d+(?:\.\d+)?"
NAMED_COMPONENTS = 3
QUOTE_TOLERANCE, QUOTE_FLOOR = 0.02, 0.05
UNIT_MISMATCH = 20.0
JOB_SIGNALS = ["material_shortfall_ratio", "supplier_reliability"]
OP_LINES = ["time_overrun_ratio", "operator_pace_ratio", "critical_path_cascade_ratio"]


def short_components(components: DataFrame) -> DataFrame:
    """Short components of each job, each once by id; the first row wins."""
    short = components.filter(F.col("available") < F.col("required"))
    first = short.groupBy("job_id", "component_id").agg(
        F.min(F.struct("lid", "name", "required", "available", "vendor_name", "vendor_ratio")).alias("c"))
    return first.select("job_id", "component_id", "c.*").withColumn("shortfall", F.col("required") - F.col("available"))


def _signals(weights: dict[str, float]) -> dict[str, dict[str, Column]]:
    """What is told of each signal of an operation, from its own columns."""
    value = {k: D.finite(F.col(k)) for k in D.SIGNALS}
    score = D.finite(F.col("risk_score"))
    base = D.finite(F.col("base_score"))
    total = reduce(lambda a, b: a + b, [F.when(value[k].isNotNull() & F.lit(w > 0), F.lit(float(w))).otherwise(0.0)
                                        for k, w in weights.items()])
    out = {}
    for i, k in enumerate(D.SIGNALS):
        w = float(weights.get(k, 0.0))
        share = F.lit(None).cast("double")
        if w > 0:
            share = D.finite(w * value[k] / F.nullif(score * total, F.lit(0.0)))
        elif k == "critical_path_cascade_ratio":
            extra = F.greatest(score - F.coalesce(base, F.lit(0.0)), F.lit(0.0))
            share = F.when(value[k].isNotNull(), extra / F.nullif(score, F.lit(0.0)))
        affects = F.lit(w > 0)
        if k == "critical_path_cascade_ratio":
            affects = affects | F.coalesce(share > 0, F.lit(False))
        out[k] = {"signal_key": F.lit(k), "signal_order": F.lit(i), "value": value[k], "weight": F.lit(w), "fired": D.fired(k, value[k]),
                  "contribution": share, "affects_score": affects, "non_finite": F.col(k).isNotNull() & value[k].isNull()}
    return out


def _one(columns: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(name) for name, c in columns.items()])


OF_SIGNAL = ["job_id", "operation_id", "seq", "operation_label", "actual", "expected", "scorable"]


def _signal_rows(ops: DataFrame, weights: dict[str, float]) -> DataFrame:
    return ops.withColumn("s", F.explode(F.array(*[_one(c) for c in _signals(weights).values()]))).select(*OF_SIGNAL, "s.*")


def _job_signals(weights: dict[str, float]) -> dict[str, dict[str, Column]]:
    """What is told of each signal of a job, from the columns of :func:`_jobs` and :func:`job_parts`."""
    raw = {"material_shortfall_ratio": F.coalesce("material", F.lit(0.0)), "supplier_reliability": F.col("supplier")}
    out = {}
    for k in JOB_SIGNALS:
        value, w = D.finite(raw[k]), float(weights.get(k, 0.0))
        out[k] = {"signal_key": F.lit(k), "signal_order": F.lit(D.SIGNALS.index(k)), "value": value, "weight": F.lit(w), "fired": D.fired(k, value),
                  "contribution": F.col(f"share_{k}"), "affects_score": F.lit(w > 0), "non_finite": raw[k].isNotNull() & value.isNull()}
    return out


def _job_signal_rows(jobs: DataFrame, weights: dict[str, float]) -> DataFrame:
    null = {"operation_id": "string", "seq": "bigint", "operation_label": "string", "actual": "double", "expected": "double"}
    each = jobs.filter(F.col("job_id").isNotNull()).withColumn("s", F.explode(F.array(*[_one(c) for c in _job_signals(weights).values()])))
    return each.withColumns({c: F.lit(None).cast(kind) for c, kind in null.items()}).select(*OF_SIGNAL, "s.*")


def _jobs(ops: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The summary of each job, and the shares of the job's signals: those of its worst operation, else the best known. One shuffle by the job."""
    signals = _signals(weights)
    score, yes = D.finite(F.col("risk_score")), F.col("scorable")
    rows = ops.select("job_id", "operation_id", "seq", "scorable", "is_delayed", score.alias("score"), D.finite(F.col("predicted_overrun_hours")).alias("hours"),
                      signals["supplier_reliability"]["value"].alias("supplier"), *[signals[k]["contribution"].alias(k) for k in JOB_SIGNALS])
    counts = yes & F.col("score").isNotNull()
    worst = F.max_by("operation_id", F.when(counts, F.struct("score", -F.col("seq"))))
    rows = rows.withColumn("worst", worst.over(Window.partitionBy("job_id")))
    own = F.col("operation_id") == F.col("worst")
    return rows.groupBy("job_id").agg(
        F.bool_or(yes).alias("scorable"), F.max(F.when(yes, F.col("score"))).alias("summary_risk_score"),
        F.max(F.when(yes, F.col("hours"))).alias("summary_overrun_hours"),
        F.bool_or(F.when(counts, F.col("is_delayed"))).alias("summary_is_delayed"), worst.alias("summary_operation"),
        F.count(F.lit(1)).alias("operations"), F.min_by("supplier", F.when(F.col("supplier").isNotNull(), F.col("seq"))).alias("supplier"),
        *[F.coalesce(F.max(F.when(own, F.col(k))), F.max(F.when(yes, F.col(k)))).alias(f"share_{k}") for k in JOB_SIGNALS])


def job_parts(components: DataFrame) -> DataFrame:
    """Per job its short components (each once by id; the first row wins): summed ratio, how many, the first three and how many more;
    and the vendors its supplier mean was taken over, sorted. One shuffle by the job."""
    short = F.coalesce(F.col("available") < F.col("required"), F.lit(False))
    known = D.finite(F.col("vendor_ratio")).isNotNull() & F.col("vendor_name").isNotNull()
    row = F.struct("lid", "name", "required", "available")
    per = components.filter(short | known).select("job_id", "component_id", F.when(short, row).alias("c"), F.when(known, F.col("vendor_name")).alias("v"))
    per = per.repartition("job_id").groupBy("job_id", "component_id").agg(F.min("c").alias("c"), F.collect_set("v").alias("v"))
    per = per.withColumn("rn", F.row_number().over(Window.partitionBy("job_id").orderBy(F.col("c").isNull(), F.asc("c.lid"))))
    text = F.col("component_id").cast("string")
    entry = F.struct("rn", F.coalesce("c.name", text).alias("label"), text.alias("component_id"), (F.col("c.required") - F.col("c.available")).alias("shortfall"))
    per = per.groupBy("job_id").agg(
        F.sum(D.shortfall(F.col("c.required"), F.col("c.available"))).alias("material"), F.count("c").alias("n_short"),
        F.array_sort(F.collect_list(F.when(F.col("c").isNotNull() & (F.col("rn") <= NAMED_COMPONENTS), entry))).alias("named"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("v")))).alias("vendors"))
    return per.select("job_id", "material", "n_short", F.when(F.size("named") > 0, F.col("named")).alias("named"),
                      F.greatest(F.col("n_short") - NAMED_COMPONENTS, F.lit(0)).alias("more"), F.when(F.size("vendors") > 0, F.col("vendors")).alias("vendors"))


def build_evidence(elements: DataFrame, components: DataFrame, weights: dict[str, float] | None = None,
                   threshold: float = D.THRESHOLD, stored: bool = False) -> dict[str, DataFrame]:
    """Tables ``operations``, ``signals`` (job-scoped ones with a null operation) and ``jobs`` (with their short components and vendors).

    ``stored`` writes the jobs, for reviews that read them many times.
    """
    weights = weights or D.DEFAULT_WEIGHTS
    ops = elements.withColumn("scorable", F.coalesce(F.col("mo_progress") >= D.GATE, F.lit(False)))
    jobs = _jobs(ops, weights).join(job_parts(components), "job_id", "left")
    if stored:
        jobs = durable(jobs)
    score = D.finite(F.col("risk_score"))
    wrong = ops.filter(score.isNotNull() & (F.col("is_delayed") != (score > threshold)))
    return {"operations": ops, "signals": _signal_rows(ops, weights).unionByName(_job_signal_rows(jobs, weights)), "jobs": jobs,
            "threshold_conflicts": wrong.select("job_id", "operation_id")}


def _top_short(short: DataFrame) -> DataFrame:
    """The first three short components of each job and how many more there are."""
    named = top_per_key(short, ["job_id"], [F.asc("lid")], NAMED_COMPONENTS).groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("rn", F.coalesce("name", F.col("component_id").cast("string")).alias("label"),
                                             F.col("component_id").cast("string").alias("component_id"), "shortfall"))).alias("named"))
    return named.join(short.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")), "job_id").withColumn(
        "more", F.greatest(F.col("n") - NAMED_COMPONENTS, F.lit(0)))


def short_list_text(named: Column, more: Column) -> Column:
    parts = F.transform(named, lambda c: F.concat(c["label"], F.lit(" – "), D.quantity_text(c["shortfall"]), F.lit(" short")))
    rest = F.when(more > 0, F.array(F.concat(F.lit("+"), more.cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return F.concat_ws("; ", F.concat(parts, rest))


def _number_map(*pairs: tuple[str, Column]) -> Column:
    return F.create_map(*[x for n, c in pairs for x in (F.lit(n), c.cast("double"))])


def _due_lines(ev: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """What a line is due for: fired signals that move the score of a scorable job, with all that their text needs."""
    ops, jobs = ev["operations"], ev["jobs"]
    told = ["signal_key", "signal_order", "value", "contribution"]

    def due(df: DataFrame, signals: dict[str, dict[str, Column]], ready: dict[str, Column]) -> DataFrame:
        each = [F.when(F.col("scorable") & s["fired"] & s["affects_score"] & ready.get(k, F.lit(True)), _one({c: s[c] for c in told})) for k, s in signals.items()]
        return df.withColumn("s", F.explode(F.array(*each))).filter(F.col("s").isNotNull())

    signals = {k: s for k, s in _signals(weights).items() if k in OP_LINES}
    own = due(ops.filter(F.col("operation_id").isNotNull() & F.col("job_id").isNotNull()), signals,
              {"time_overrun_ratio": F.col("actual").isNotNull() & F.col("expected").isNotNull()})
    shared = due(jobs.filter(F.col("job_id").isNotNull()), _job_signals(weights),
                 {"material_shortfall_ratio": F.col("named").isNotNull(), "supplier_reliability": F.col("vendors").isNotNull()})
    own = own.select("job_id", "operation_id", "seq", "operation_label", "actual", "expected", "s.*")
    return own.unionByName(shared.select("job_id", "named", "more", "vendors", "s.*"), allowMissingColumns=True)


def compose_lines(ev: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """Why-lines of scorable jobs in total order, each with the numbers it quotes. The order is told before the texts are made."""
    can = _due_lines(ev, weights or D.DEFAULT_WEIGHTS)
    most = F.col("operations") * len(OP_LINES) + len(JOB_SIGNALS)
    can = _rank_by_window(can) if ev["jobs"].filter(most > WINDOW_ROWS).isEmpty() else rank_lines(can)
    head = F.create_map(*[x for k, v in HEADLINES.items() for x in (F.lit(k), F.lit(v))])[F.col("signal_key")]
    a, e, v = F.col("actual") / 60.0, F.col("expected") / 60.0, F.col("value")
    k, name, job = F.col("signal_key"), F.col("operation_label"), F.col("job_id").cast("string")
    dot = F.lit(" · ")
    time_text = F.concat(name, dot, fixed(a, 1), F.lit(" hrs logged of "), fixed(e, 1), F.lit(" planned"))
    pace_text = F.concat(name, dot, F.lit("operator pace "), fixed(v, 2), F.lit("× planned over recent completed jobs"))
    down_text = F.concat(name, dot, F.lit("inherited critical-path overrun "), fixed(v, 2), F.lit("× planned"))
    sup_text = F.concat(job, F.lit(" · vendors "), F.array_join("vendors", ", "), F.lit(" average lead-time ratio "), fixed(v, 2))
    short_text = F.concat(job, dot, short_list_text(F.col("named"), F.col("more")))
    is_time, is_pace, is_cascade, is_mat = (k == x for x in (*OP_LINES, "material_shortfall_ratio"))
    shorts = F.map_from_entries(F.transform("named", lambda c: F.struct(F.concat(F.lit("shortfall:"), c["component_id"]), c["shortfall"])))
    more = F.when(F.col("more") > 0, _number_map(("more_count", F.col("more")))).otherwise(F.create_map().cast("map<string,double>"))
    of_op = k.isin(OP_LINES)
    return can.select(
        "job_id", "operation_id", "seq", "signal_key", "signal_order", F.when(of_op, "operation").otherwise("job").alias("scope"), head.alias("headline"),
        F.when(is_time, time_text).when(is_pace, pace_text).when(is_cascade, down_text).when(is_mat, short_text).otherwise(sup_text).alias("detail"),
        F.when(is_time, F.concat(F.lit("+"), fixed(a - e, 1), F.lit(" hrs"))).alias("delta"), "contribution",
        F.when(is_time, _number_map(("actual_hrs", a), ("expected_hrs", e), ("delta_hrs", a - e)))
         .when(is_pace, _number_map(("pace_ratio", v))).when(is_cascade, _number_map(("cascade_ratio", v)))
         .when(is_mat, F.map_concat(shorts, more)).otherwise(_number_map(("mean_lead_time_ratio", v))).alias("quoted"),
        F.when(of_op, F.array(name)).otherwise(F.concat(F.array(job), F.when(is_mat, F.transform("named", lambda c: c["label"])).otherwise(F.col("vendors")))).alias("names"),
        "line_index")


def _line_order() -> tuple[Column, Column]:
    return -F.coalesce("contribution", F.lit(-1.0)), F.col("signal_order") * F.lit(2**40) + F.coalesce("seq", F.lit(-1)) + 1


def _rank_by_window(lines: DataFrame) -> DataFrame:
    """:func:`rank_lines` where no job has many lines."""
    key, rest = _line_order()
    key = F.when(key == 0, F.lit(0.0)).otherwise(key)  # as in real_levels
    return lines.withColumn("line_index", (F.rank().over(Window.partitionBy("job_id").orderBy(key, rest)) - 1).cast("bigint"))


def rank_lines(lines: DataFrame) -> DataFrame:
    """Line index within the job: contribution descending, signal order, operation order."""
    key, rest = _line_order()
    levels = [*real_levels(key), *integer_levels(rest)]
    order = prefix_sums(lines, ["job_id"], levels, {"rows": F.lit(1)})
    at = len(real_levels(key)) - 1
    idx = order.select("job_id", F.col(f"_l{at}").alias("__k"), F.col(f"_l{len(levels) - 1}").alias("__p"), F.col("rows_before").alias("line_index"))
    keyed = lines.withColumns({"__k": levels[at], "__p": rest})
    return keyed.join(idx, ["job_id", "__k", "__p"]).drop("__k", "__p")


def within_tolerance(actual: Column, expected: Column) -> Column:
    return F.abs(actual - expected) <= F.greatest(F.abs(expected) * QUOTE_TOLERANCE, F.lit(QUOTE_FLOOR))


def _told_number(s: Column, key: Column, name: Column) -> Column:
    """What a line on signal ``key`` may quote as ``name``, from the evidence alone; null for nothing. ``s`` as in :func:`_evidence_groups`."""
    a, e = s["actual"] / 60.0, s["expected"] / 60.0
    time = F.when(name == "actual_hrs", a).when(name == "expected_hrs", e).when(name == "delta_hrs", a - e)
    named = F.get(F.filter(s["named"], lambda c: F.concat(F.lit("shortfall:"), c["component_id"]) == name), F.lit(0))["shortfall"]
    short = F.when(name == "more_count", F.when(s["more"] > 0, s["more"].cast("double"))).otherwise(named)
    of_op = (F.when((key == "time_overrun_ratio") & a.isNotNull() & e.isNotNull(), time)
             .when((key == "operator_pace_ratio") & (name == "pace_ratio"), s["operator_pace_ratio"])
             .when((key == "critical_path_cascade_ratio") & (name == "cascade_ratio"), s["critical_path_cascade_ratio"]))
    of_job = F.when(key == "material_shortfall_ratio", short).when((key == "supplier_reliability") & (name == "mean_lead_time_ratio"), s["supplier_reliability"])
    return F.when(s["of_job"], of_job).otherwise(of_op)


def _evidence_groups(ev: dict[str, DataFrame], lines: DataFrame, weights: dict[str, float]) -> DataFrame:
    """job_id, operation_id, ``sigs`` and ``lines``: all that is known and all that is said of an operation, or of the job itself (null operation)."""
    signals, shared = _signals(weights), _job_signals(weights)
    own = _one({k: signals[k]["value"] for k in D.SIGNALS} | {"cascades": signals["critical_path_cascade_ratio"]["affects_score"], "of_job": F.lit(False)}
               | {c: F.col(c) for c in ("actual", "expected", "scorable")})
    known = ev["operations"].filter(F.col("job_id").isNotNull()).select("job_id", "operation_id", own.alias("s"))
    job = _one({k: shared[k]["value"] for k in JOB_SIGNALS} | {"of_job": F.lit(True)} | {c: F.col(c) for c in ("scorable", "named", "more", "vendors")})
    known = known.unionByName(ev["jobs"].filter(F.col("job_id").isNotNull()).select("job_id", job.alias("s")), allowMissingColumns=True)
    # texts are looked through before the shuffle
    text = F.concat_ws(" ", "headline", "detail", F.coalesce("delta", F.lit("")))
    longest = F.array_sort("names", lambda a, b: F.length(b) - F.length(a))
    bare = F.aggregate(longest, text, lambda t, n: F.replace(t, n, F.lit(" ")))
    numerals = F.transform(F.regexp_extract_all(bare, F.lit(NUMERAL), F.lit(0)), lambda x: x.cast("double"))
    stray = F.exists(numerals, lambda x: ~F.exists(F.map_values("quoted"), lambda v: within_tolerance(x, v)))
    said = F.struct("signal_key", "line_index", F.map_entries("quoted").alias("quoted"), F.coalesce(stray, F.lit(False)).alias("stray"),
                    F.coalesce(text.rlike(FORBIDDEN_CAUSES), F.lit(False)).alias("forbidden"))
    both = known.unionByName(lines.select("job_id", "operation_id", said.alias("l")), allowMissingColumns=True)
    return both.repartition("job_id").groupBy("job_id", "operation_id").agg(F.collect_list("s").alias("sigs"), F.collect_list("l").alias("lines"))


def _found(check: str, severity: str, ref: Column) -> Column:
    return F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), ref.cast("string").alias("ref"))


def _line_issues(sigs: Column, line: Column, weights: dict[str, float]) -> Column:
    """Issues of one line, once for each signal it may be about."""
    key, at = line["signal_key"], line["line_index"]
    value = lambda s: reduce(lambda c, k: c.when(key == k, s[k]), D.SIGNALS, F.when(F.lit(False), F.lit(0.0)))
    floor = reduce(lambda c, k: c.when(key == k, F.lit(float(D.BASELINES[k]))), D.SIGNALS, F.when(F.lit(False), F.lit(0.0)))
    weighty = [k for k in D.SIGNALS if weights.get(k, 0.0) > 0]
    moves = lambda s: key.isin(weighty) | ((key == "critical_path_cascade_ratio") & F.coalesce(s["cascades"], F.lit(False)))
    about = F.filter(sigs, lambda s: F.when(s["of_job"], key.isin(JOB_SIGNALS)).otherwise(key.isin(D.SIGNALS)))
    n = F.size(about)
    none = F.array().cast("array<struct<check:string,severity:string,ref:string>>")
    times = lambda yes, n, check: F.when(yes, F.array_repeat(_found(check, "error", at), n)).otherwise(none)

    def of_quote(q: Column) -> Column:
        numbers = F.filter(F.transform(sigs, lambda s: _told_number(s, key, q["key"])), lambda x: x.isNotNull())
        off = F.filter(numbers, lambda x: ~within_tolerance(q["value"], x))
        return F.when(F.size(numbers) == 0, F.array(_found("quoted_number_unknown", "error", at))).otherwise(
            F.transform(off, lambda x: _found("quoted_number_mismatch", "error", at)))

    quotes = F.flatten(F.transform(line["quoted"], of_quote))
    return F.concat(
        times(n == 0, F.lit(1), "signal_missing"), times(line["stray"], n, "unquoted_number"), times(line["forbidden"], F.greatest(n, F.lit(1)), "forbidden_cause"),
        F.transform(F.filter(about, lambda s: ~F.coalesce(value(s) > floor, F.lit(False))), lambda s: _found("signal_not_fired", "error", at)),
        F.transform(F.filter(about, lambda s: ~moves(s)), lambda s: _found("zero_weight_signal_shown", "error", at)),
        F.coalesce(F.flatten(F.array_repeat(quotes, n)), none))


def _omissions(s: Column, shown: Column, operation: Column, weights: dict[str, float]) -> Column:
    """Signals that fired and moved the score, and no line tells of."""
    timed = s["actual"].isNotNull() & s["expected"].isNotNull()
    ready = {"time_overrun_ratio": timed, "material_shortfall_ratio": s["named"].isNotNull(), "supplier_reliability": s["vendors"].isNotNull()}
    found = []
    for k in (*OP_LINES, *JOB_SIGNALS):
        moves = F.coalesce(s["cascades"], F.lit(False)) if k == "critical_path_cascade_ratio" else F.lit(weights.get(k, 0.0) > 0)
        due = s["scorable"] & D.fired(k, s[k]) & moves & (s["of_job"] == F.lit(k in JOB_SIGNALS)) & ~F.array_contains(shown, k)
        found.append(F.when(due, F.when(ready.get(k, F.lit(True)), _found("omitted_signal", "error", operation)).otherwise(
            _found("omitted_signal_unrenderable", "warning", operation))))
    return F.array_compact(F.array(*found))


def _listed(df: DataFrame, found: Column) -> DataFrame:
    return df.select("job_id", F.explode(found).alias("i")).select("job_id", "i.*")


def _where(checks: list[tuple[Column, Column]]) -> Column:
    """The issues whose condition holds."""
    return F.array_compact(F.array(*[F.when(when, found) for when, found in checks]))


def validate(ev: dict[str, DataFrame], lines: DataFrame, drafts: DataFrame, threshold: float = D.THRESHOLD, weights: dict[str, float] | None = None) -> DataFrame:
    """Every check of the drafted lines and summaries against the evidence, as one issues table.

    ``drafts``: job_id, summary_risk_score, summary_overrun_hours, summary_is_delayed. Evidence and lines of an operation meet in one
    group and one shuffle; checks of the operations, of the jobs and of the summaries take a pass each.
    """
    weights = weights or D.DEFAULT_WEIGHTS
    out = []
    groups = _evidence_groups(ev, lines, weights)
    shown = F.transform("lines", lambda x: x["signal_key"])
    wrong = F.flatten(F.transform("lines", lambda x: _line_issues(F.col("sigs"), x, weights)))
    # nothing that fired and moved the score may be left out
    omitted = F.flatten(F.transform("sigs", lambda s: _omissions(s, shown, F.col("operation_id"), weights)))
    out.append(_listed(groups, F.concat(wrong, omitted)))

    # the drafted summary agrees with the evidence and the threshold
    d = drafts.alias("d").join(ev["jobs"].alias("e"), "job_id")
    late, none = F.col("d.summary_is_delayed"), F.lit(None)
    checks = []
    for c in ("summary_risk_score", "summary_overrun_hours"):
        x, y = F.col(f"d.{c}"), F.col(f"e.{c}")
        off = (x.isNull() != y.isNull()) | F.coalesce(~within_tolerance(x, y), F.lit(False))
        checks.append((off, _found("summary_mismatch", "error", none)))
    checks.append((~late.eqNullSafe(F.col("e.summary_is_delayed")), _found("summary_mismatch", "error", none)))
    checks.append((late != (F.col("d.summary_risk_score") > threshold), _found("threshold_inconsistent", "error", none)))
    out.append(_listed(d, _where(checks)))

    op = F.col("operation_id")
    odd = (F.col("expected") != 0) & (F.col("actual") > UNIT_MISMATCH * F.col("expected"))
    inherits = D.fired("critical_path_cascade_ratio", D.finite(F.col("critical_path_cascade_ratio")))
    idle = F.upper("status").isin(NOT_STARTED) & F.col("is_delayed") & ~inherits
    before = D.fired("predecessor_time_overrun_ratio", D.finite(F.col("predecessor_time_overrun_ratio")))
    lost = [F.col(c).isNotNull() & D.finite(F.col(c)).isNull() for c in ("risk_score", "base_score", "predicted_overrun_hours")]
    out.append(_listed(ev["operations"], _where([
        (odd, _found("implausible_duration", "warning", op)), (idle, _found("not_started_but_delayed", "warning", op)),
        (before & ~inherits, _found("cascading_predecessor", "info", op)), *[(x, _found("non_finite", "warning", op)) for x in lost],
        *[(s["non_finite"], _found("non_finite", "warning", F.coalesce(op, F.lit("job")))) for s in _signals(weights).values()]])))
    out.append(_listed(ev["jobs"].filter(F.col("job_id").isNotNull()), _where(
        [(s["non_finite"], _found("non_finite", "warning", F.lit("job"))) for s in _job_signals(weights).values()])))

    quiet = d.filter(late & F.col("e.scorable")).select("job_id").join(lines.select("job_id").distinct(), "job_id", "left_anti")
    ranked = ev["signals"].filter(F.col("value").isNotNull() & F.col("scorable") & (F.col("affects_score") | F.col("operation_id").isNull()))
    top = ranked.groupBy("job_id").agg(F.max_by("operation_id", F.struct(F.coalesce("contribution", F.lit(-1.0)), "value")).alias("ref"))
    out.append(quiet.join(top, "job_id", "left").select("job_id", F.lit("no_fired_signal").alias("check"), F.lit("warning").alias("severity"), F.col("ref").cast("string").alias("ref")))
    return reduce(lambda a, b: a.unionByName(b), out)


def insight_status(jobs: DataFrame, issues: DataFrame) -> DataFrame:
    """Status per job; with no judge in this system a clean draft is published as the template."""
    bad = issues.filter("severity = 'error'").groupBy("job_id").agg(F.count(F.lit(1)).alias("errors"))
    j = jobs.join(bad, "job_id", "left")
    status = (F.when(~F.col("scorable"), "suppressed_not_scorable").when(F.col("errors") > 0, "rejected").otherwise("fallback_template"))
    return j.withColumns({"status": status, "errors": F.coalesce("errors", F.lit(0))})


def snapshot_digest(snapshots: DataFrame, operations: DataFrame, keep: int = 50) -> DataFrame:
    """Per tenant over its last snapshots: delayed and approved counts, firing and mean per weighted signal.

    Only the newest ``keep`` snapshots are the feature; each task drops the rest before the shuffle.
    """
    last = top_per_key(snapshots, ["tenant"], [F.desc("scored_at"), F.desc("snapshot_id")], keep)
    counts = last.groupBy("tenant").agg(
        F.count(F.lit(1)).alias("n_scored_jobs"), F.count_if("is_delayed").alias("delayed_jobs"),
        F.count_if(F.col("status").isin("approved", "approved_with_warnings")).alias("approved_jobs"))
    ops = last.select("tenant", "snapshot_id").join(operations, "snapshot_id")
    aggs = []
    for k in D.DEFAULT_WEIGHTS:
        v = D.finite(F.col(k))
        aggs += [F.count(v).alias(f"{k}_n"), F.count_if(v > D.BASELINES[k]).alias(f"{k}_fired"), F.avg(v).alias(f"{k}_mean")]
    return counts.join(ops.groupBy("tenant").agg(*aggs), "tenant", "left")
