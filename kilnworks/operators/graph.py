"""Graph jobs: revision families, critical path, cascade."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnworks.session import durable

MAX_JUMPS = 64
#: Operations, and links, of a job up to which it is worked out as one row.
SMALL_JOB, SMALL_LINKS = 32, 1024
#: Overrun above which a cascade begins.
BASELINE = 1.20


def family_roots(df: DataFrame, id_col: str, parent_col: str, root_col: str = "root") -> DataFrame:
    """Root of every row by pointer jumping: the distance covered doubles per round.

    A parent that is not itself a row ends the chain and is the root. Only rows
    that have a parent take part; a chain that never ends is a cycle.
    """
    hop = df.filter(F.col(parent_col).isNotNull()).select(
        F.col(id_col).alias("node"), F.col(parent_col).alias("up"))
    hop = durable(hop)
    for _ in range(MAX_JUMPS):
        nxt = hop.select(F.col("node").alias("mid"), F.col("up").alias("further"))
        step = hop.join(nxt, hop.up == nxt.mid, "left").select(
            "node", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved"))
        step = durable(step)
        if step.filter("moved").isEmpty():
            roots = step.select(F.col("node").alias(id_col), F.col("up").alias("__root"))
            joined = df.join(roots, id_col, "left")
            return joined.withColumn(root_col, F.coalesce("__root", id_col)).drop("__root")
        if not step.filter(F.col("node") == F.col("up")).isEmpty():
            break
        hop = step.drop("moved")
    raise ValueError(f"{parent_col} chains contain a cycle")


def _distinct_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends are operations of the same job, each once."""
    ids = nodes.select("job_id", "operation_id")
    known = edges.select("job_id", "operation_id", "pred_id").distinct().join(ids, ["job_id", "operation_id"], "left_semi")
    return known.join(ids.withColumnRenamed("operation_id", "pred_id"), ["job_id", "pred_id"], "left_semi")


def _chains(links: DataFrame, waits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(side, job, node, up, length): nodes with one predecessor, the nearest node before them that has none or several, and the way from its start.

    Pointers double, so rounds grow with the logarithm of the longest chain. A pointer that still
    moves after as many rounds as the largest job could need goes round in a cycle; its node is left out.
    """
    keys = ["side", "job_id"]
    single = links.join(waits.filter("waits = 1").withColumnRenamed("node", "dst"), [*keys, "dst"]).select(
        *keys, F.col("dst").alias("node"), F.col("src").alias("up"))
    sizes = nodes.select(*keys, F.col("node").alias("up"), F.col("duration").alias("length"))
    hop = durable(single.join(sizes, [*keys, "up"]).select(*keys, "node", "up", "length"))
    longest = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    for _ in range(max(1, longest.bit_length() + 1)):
        further = hop.select(*keys, F.col("node").alias("up"), F.col("up").alias("up2"), F.col("length").alias("more"))
        hop = durable(hop.join(further, [*keys, "up"], "left").select(*keys, "node", F.coalesce("up2", "up").alias("up"),
                                                                      (F.col("length") + F.coalesce("more", F.lit(0.0))).alias("length"), F.col("up2").isNotNull().alias("moved")))
        if hop.filter("moved").isEmpty():
            break
        hop = hop.drop("moved")
    ends = hop.select(*keys, F.col("node").alias("up"))
    return hop.join(ends, [*keys, "up"], "left_anti").select(*keys, "node", "up", "length")


def _paths_by_chains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(side, job, node, reach) where jobs are large.

    Chains are walked by doubling first, which leaves the nodes that none or several others precede. Those
    advance one frontier per round, for all jobs and both directions at once: nodes whose predecessors are all
    done report their length to the next ones. A node never reached lies on or behind a cycle and has a null reach.
    """
    keys = ["side", "job_id"]
    links = durable(edges.select(F.lit("f").alias("side"), "job_id", F.col("pred_id").alias("src"),
                                 F.col("operation_id").alias("dst")).unionByName(
        edges.select(F.lit("b").alias("side"), "job_id", F.col("operation_id").alias("src"), F.col("pred_id").alias("dst"))))
    waits = durable(links.groupBy(*keys, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("waits")))
    both = durable(nodes.select(F.explode(F.array(F.lit("f"), F.lit("b"))).alias("side"), "job_id",
                                F.col("operation_id").alias("node"), "duration").join(waits, [*keys, "node"], "left").fillna(0, ["waits"]))
    chains = durable(_chains(links, waits, both))
    # every way into a node with several predecessors starts at the end of a chain
    heads = chains.select(*keys, F.col("node").alias("src"), "up", F.col("length").alias("before"))
    into = links.join(both.filter("waits > 1").select(*keys, F.col("node").alias("dst")), [*keys, "dst"]).join(
        both.select(*keys, F.col("node").alias("src"), "duration"), [*keys, "src"]).join(heads, [*keys, "src"], "left")
    ways = durable(into.groupBy(*keys, F.coalesce("up", "src").alias("src"), "dst").agg(F.max(F.col("duration") + F.coalesce("before", F.lit(0.0))).alias("length")))
    counts = ways.groupBy(*keys, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("ways"))
    state = durable(both.filter("waits <> 1").join(counts, [*keys, "node"], "left").select(
        *keys, "node", F.coalesce("ways", F.lit(0)).alias("waits"), F.lit(0.0).alias("reach")))
    done = None
    while True:
        frontier = state.filter("waits = 0").select(*keys, "node", "reach")
        done = frontier if done is None else done.unionByName(frontier)
        pending = state.filter("waits > 0")
        if pending.isEmpty() or frontier.isEmpty():
            break
        sent = frontier.select(*keys, F.col("node").alias("src"), "reach")
        got = ways.join(sent, [*keys, "src"]).groupBy(*keys, F.col("dst").alias("node")).agg(
            F.count(F.lit(1)).alias("n"), F.max(F.col("reach") + F.col("length")).alias("length"))
        state = durable(pending.join(got, [*keys, "node"], "left").select(
            *keys, "node", (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits"),
            F.greatest("reach", F.coalesce("length", F.lit(0.0))).alias("reach")))
    ends = durable(done)
    along = chains.join(ends.select(*keys, F.col("node").alias("up"), "reach"), [*keys, "up"]).select(*keys, "node", (F.col("reach") + F.col("length")).alias("reach"))
    known = ends.unionByName(along)
    return both.join(known, [*keys, "node"], "left").select(*keys, "node", "duration", "reach")


def _paths_by_frontiers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(side, job, node, reach) by frontiers alone: few and light rounds where jobs are small.

    One frontier per round, for all jobs and both directions at once: nodes whose
    predecessors are all done report their length to their successors. Every edge
    is used once per direction. A node never reached lies on or behind a cycle and
    has a null reach.
    """
    links = edges.select(F.lit("f").alias("side"), "job_id", F.col("pred_id").alias("src"),
                         F.col("operation_id").alias("dst")).unionByName(
        edges.select(F.lit("b").alias("side"), "job_id", F.col("operation_id").alias("src"),
                     F.col("pred_id").alias("dst")))
    waits = links.groupBy("side", "job_id", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("waits"))
    both = nodes.select(F.explode(F.array(F.lit("f"), F.lit("b"))).alias("side"), "job_id",
                        F.col("operation_id").alias("node"), "duration")
    state = durable(both.join(waits, ["side", "job_id", "node"], "left").select(
        "side", "job_id", "node", "duration", F.coalesce("waits", F.lit(0)).alias("waits"), F.lit(0.0).alias("reach")))
    done = None
    while True:
        frontier = state.filter("waits = 0")
        done = frontier if done is None else done.unionByName(frontier)
        pending = state.filter("waits > 0")
        if frontier.isEmpty() or pending.isEmpty():
            break
        sent = frontier.select("side", "job_id", F.col("node").alias("src"), (F.col("reach") + F.col("duration")).alias("length"))
        got = links.join(sent, ["side", "job_id", "src"]).groupBy("side", "job_id", F.col("dst").alias("node")).agg(
            F.count(F.lit(1)).alias("n"), F.max("length").alias("length"))
        state = durable(pending.join(got, ["side", "job_id", "node"], "left").select(
            "side", "job_id", "node", "duration", (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits"),
            F.greatest("reach", F.coalesce("length", F.lit(0.0))).alias("reach")))
    stuck = pending.withColumn("reach", F.lit(None).cast("double"))
    return done.unionByName(stuck).select("side", "job_id", "node", "duration", "reach")


def _longest_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(side, job, node, reach): longest path into a node (side f) and out of it (side b), own length excluded.

    No path is longer than its job, so frontiers alone take at most as many rounds as the largest job has
    operations; beyond ``SMALL_JOB`` of them chains are walked by doubling. Both ways give the same rows.
    """
    largest = nodes.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    return (_paths_by_frontiers if largest <= SMALL_JOB else _paths_by_chains)(nodes, edges)


def large_jobs(limits: dict[int, DataFrame]) -> DataFrame:
    """The jobs that have more rows in a table than its limit."""
    marks = [F.lit(i).alias("part") for i in range(len(limits))]
    rows = None
    for mark, df in zip(marks, limits.values()):
        part = df.select("job_id", mark)
        rows = part if rows is None else rows.unionByName(part)
    over = [F.count_if(F.col("part") == i) > most for i, most in enumerate(limits)]
    per = rows.groupBy("job_id").agg(*[c.alias(f"over{i}") for i, c in enumerate(over)])
    return durable(per.filter(" OR ".join(f"over{i}" for i in range(len(over)))).select("job_id"))


def _job_rows(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """job_id, nodes, links: a row for each job with a number, its nodes as they come and its links once each."""
    one = lambda df: F.struct(*[c for c in df.columns if c != "job_id"])
    rows = nodes.select("job_id", one(nodes).alias("node")).unionByName(links.select("job_id", one(links).alias("link")), allowMissingColumns=True)
    return rows.filter(F.col("job_id").isNotNull()).groupBy("job_id").agg(F.collect_list("node").alias("nodes"), F.collect_set("link").alias("links"))


def _reach(src: np.ndarray, dst: np.ndarray, duration: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest way to each node, own length excluded, and whether it is on or behind no cycle."""
    waits = np.bincount(dst, minlength=len(duration))
    reach, done = np.zeros(len(duration)), np.zeros(len(duration), dtype=bool)
    while len(frontier := np.flatnonzero((waits == 0) & ~done)):
        done[frontier] = True
        now = np.zeros(len(duration), dtype=bool)
        now[frontier] = True
        sent = now[src]
        np.maximum.at(reach, dst[sent], reach[src[sent]] + duration[src[sent]])
        waits = waits - np.bincount(dst[sent], minlength=len(duration))
        src, dst = src[~sent], dst[~sent]
    return reach, done


def _lists(sizes: np.ndarray, **fields: pa.Array | np.ndarray) -> pa.ListArray:
    made = pa.StructArray.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in fields.values()], names=list(fields))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), made)


def _places(job: np.ndarray, ids: list) -> tuple[dict, list[int]]:
    """The last place of each id within its job, and the places of nodes that repeat an id of their job or have none."""
    place, wrong = {}, []
    for i, at in enumerate(zip(job.tolist(), ids)):
        if at in place or not ids[i]:
            wrong.append(i)
        place[at] = i
    return place, wrong


class _Timed(NamedTuple):
    start: np.ndarray
    tail: np.ndarray
    valid: np.ndarray  # of the job
    project: np.ndarray  # of the job
    tight: np.ndarray  # the numbers of the critical links


def _timed(n: int, job: np.ndarray, duration: np.ndarray, wrong: list[int], of: np.ndarray, src: np.ndarray, dst: np.ndarray) -> _Timed:
    """Times of the nodes of ``n`` jobs and their critical links; an end of a link that is no node is -1."""
    bad = np.zeros(n, dtype=bool)
    bad[job[wrong]] = True
    kept = np.flatnonzero((src >= 0) & (dst >= 0) & ~bad[of])
    src, dst = src[kept], dst[kept]
    start, forth = _reach(src, dst, duration)
    tail, back = _reach(dst, src, duration)
    valid = ~bad & (np.bincount(job[~(forth & back)], minlength=n) == 0)
    project = np.zeros(n)
    np.maximum.at(project, job, start + duration)
    slack = project[job] - tail - duration - start
    critical = valid[job] & (np.abs(slack) <= 1e-7)
    tight = critical[src] & critical[dst] & (np.abs(start[src] + duration[src] - start[dst]) <= 1e-7)
    return _Timed(start, tail, valid, project, kept[tight])


def _numbers(values: Iterable[int]) -> np.ndarray:
    return np.fromiter(values, dtype=np.int64)


def _timed_jobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Times of the operations and critical links of each job, for rows of :func:`_job_rows`."""
    for batch in batches:
        jobs, nodes, links = batch.columns
        n = len(jobs)
        sizes, each = pc.list_value_length(nodes).to_numpy(zero_copy_only=False), nodes.flatten()
        ids, duration, job = each.field(0).to_pylist(), each.field(1).to_numpy(zero_copy_only=False), np.repeat(np.arange(n), sizes)
        place, wrong = _places(job, ids)
        flat, of = links.flatten(), np.repeat(np.arange(n), pc.list_value_length(links).to_numpy(zero_copy_only=False))
        dst, src = (_numbers(place.get(at, -1) for at in zip(of.tolist(), flat.field(i).to_pylist())) for i in (0, 1))
        t = _timed(n, job, duration, wrong, of, src, dst)
        at = pa.array(t.tight)
        yield pa.record_batch([jobs, pa.array(t.valid), pa.array(t.project), _lists(sizes, operation_id=each.field(0), duration=duration, start=t.start, tail=t.tail),
                               _lists(np.bincount(of[t.tight], minlength=n), operation_id=flat.field(0).take(at), pred_id=flat.field(1).take(at))],
                              names=["job_id", "valid", "project", "nodes", "critical"])


TIMES = ("earliest_start", "earliest_finish", "latest_start", "latest_finish", "float_minutes")


def time_columns() -> dict[str, Column]:
    """The columns of :func:`critical_path` from duration, es, tail, project and valid."""
    ok = F.col("valid")
    lf = F.col("project") - F.col("tail")
    slack = lf - F.col("duration") - F.col("es")
    return {"project_minutes": F.when(ok, F.col("project")).otherwise(0.0),
            "earliest_start": F.when(ok, F.col("es")), "earliest_finish": F.when(ok, F.col("es") + F.col("duration")),
            "latest_start": F.when(ok, lf - F.col("duration")), "latest_finish": F.when(ok, lf),
            "float_minutes": F.when(ok, F.greatest(slack, F.lit(0.0))), "critical": ok & (F.abs(slack) <= 1e-7)}


def _times(t: DataFrame) -> DataFrame:
    return t.select("job_id", "operation_id", "valid", *[c.alias(name) for name, c in time_columns().items()])


def _path_by_jobs(operations: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`critical_path` of jobs that fit into a row: one shuffle by the job, and the rounds of a job within its row."""
    kind = {c: df.schema[c].dataType.simpleString() for df in (edges, operations) for c in df.columns}
    nodes = operations.select("job_id", "operation_id", duration().alias("duration"))
    made = durable(_job_rows(nodes, edges.select("job_id", "operation_id", "pred_id")).mapInArrow(
        _timed_jobs, f"job_id {kind['job_id']}, valid boolean, project double, "
        f"nodes array<struct<operation_id: {kind['operation_id']}, duration: double, start: double, tail: double>>, "
        f"critical array<struct<operation_id: {kind['operation_id']}, pred_id: {kind['pred_id']}>>"))
    each = made.select("job_id", "valid", "project", F.explode("nodes").alias("n"))
    timed = _times(each.select("job_id", "n.operation_id", "valid", "project", "n.duration", F.col("n.start").alias("es"), "n.tail"))
    return timed, made.select("job_id", F.explode("critical").alias("e")).select("job_id", "e.operation_id", "e.pred_id")


def duration() -> Column:
    """Planned minutes that count on a path."""
    e = F.col("expected").cast("double")
    return F.when((e > 0) & (e != float("inf")), e).otherwise(0.0)


def critical_path(operations: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Earliest and latest times, float and critical flag per operation; critical edges.

    ``operations``: job_id, operation_id, expected. Jobs with a repeated or empty id
    or a dependency cycle come back with ``valid`` false and no times. Jobs of at most ``SMALL_JOB``
    operations and ``SMALL_LINKS`` edges are worked out as one row each, larger ones in rounds over all of them.
    """
    large = large_jobs({SMALL_JOB: operations, SMALL_LINKS: edges})
    if large.isEmpty():
        return _path_by_jobs(operations, edges)
    few = _path_by_jobs(*[df.join(large, "job_id", "left_anti") for df in (operations, edges)])
    many = _path_by_rounds(*[df.join(large, "job_id", "left_semi") for df in (operations, edges)])
    return few[0].unionByName(many[0]), few[1].unionByName(many[1])


def _path_by_rounds(operations: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`critical_path` of jobs of any size."""
    nodes = operations.select("job_id", "operation_id", duration().alias("duration"))
    per = nodes.groupBy("job_id", "operation_id").agg(F.max("duration").alias("duration"), F.count(F.lit(1)).alias("n"))
    per = durable(per.withColumn("bad_id", (F.col("n") > 1) | (F.coalesce("operation_id", F.lit("")) == "")))
    bad = per.filter("bad_id").select("job_id").distinct()
    good = per.join(bad, "job_id", "left_anti").select("job_id", "operation_id", "duration")
    kept = durable(_distinct_edges(good, edges))
    paths = durable(_longest_paths(good, kept))
    jobs = paths.groupBy("job_id").agg(
        F.max(F.when(F.col("side") == "f", F.col("reach") + F.col("duration"))).alias("project"),
        F.bool_and(F.col("reach").isNotNull()).alias("valid"))
    heads = paths.filter("side = 'f'").select("job_id", F.col("node").alias("operation_id"), "duration", F.col("reach").alias("es"))
    tails = paths.filter("side = 'b'").select("job_id", F.col("node").alias("operation_id"), F.col("reach").alias("tail"))
    t = heads.join(tails, ["job_id", "operation_id"]).join(jobs, "job_id")
    timed = _times(t)
    none = F.lit(None).cast("double")
    wrong = operations.join(bad, "job_id", "left_semi").select(
        "job_id", "operation_id", F.lit(False).alias("valid"), F.lit(0.0).alias("project_minutes"),
        *[none.alias(c) for c in TIMES],
        F.lit(False).alias("critical"))
    timed = durable(timed.unionByName(wrong))
    ends = timed.filter("critical").select("job_id", "operation_id", "earliest_start", "earliest_finish")
    preds = ends.select("job_id", F.col("operation_id").alias("pred_id"), F.col("earliest_finish").alias("pred_finish"))
    crit = kept.join(ends, ["job_id", "operation_id"]).join(preds, ["job_id", "pred_id"]).filter(
        F.abs(F.col("pred_finish") - F.col("earliest_start")) <= 1e-7).select("job_id", "operation_id", "pred_id")
    return timed, crit


def _worst(hot: set[tuple[float, Any]], links: list[tuple[Any, Any]]) -> dict[Any, tuple[tuple, set]]:
    """By operation the worst of the overruns (ratio, source) behind it along links (to, from), as (is it no number, ratio), and its sources."""
    after, best = {}, {}
    for to, source in links:
        after.setdefault(source, []).append(to)
    for ratio, source in hot:
        worth = (ratio != ratio, ratio)  # not a number is above all numbers, as in Spark
        seen, ahead = set(), list(after.get(source, ()))
        while ahead:
            if (to := ahead.pop()) in seen:
                continue
            seen.add(to)
            ahead += after.get(to, ())
            top = best.setdefault(to, (worth, set()))
            if top[0] != worth and not (worth[0] and top[0][0]):
                if worth < top[0]:
                    continue
                best[to] = top = (worth, set())
            top[1].add(source)
    return best


def _worst_jobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The worst overruns behind each operation of a job, for rows of :func:`_job_rows`."""
    for batch in batches:
        out = []
        for job, hot, links in zip(*[c.to_pylist() for c in batch.columns]):
            best = _worst({(h["ratio"], h["pred_id"]) for h in hot}, [(e["operation_id"], e["pred_id"]) for e in links] if hot else [])
            out += [(job, to, ratio, source) for to, ((_, ratio), sources) in best.items() for source in sources]
        names = ["job_id", "operation_id", "ratio", "source_id"]
        types = [batch.column(0).type, batch.column(2).type.value_type.field("operation_id").type, pa.float64(), batch.column(1).type.value_type.field("pred_id").type]
        yield pa.record_batch([pa.array(list(v), t) for v, t in zip(zip(*out) if out else [()] * 4, types)], names=names)


def _hot(own: DataFrame, baseline: float) -> DataFrame:
    return own.filter((F.col("ratio") > baseline) & (F.col("ratio") != float("inf"))).select("job_id", F.col("operation_id").alias("pred_id"), F.col("ratio").cast("double").alias("ratio"))


def cascade(critical_edges: DataFrame, own: DataFrame, baseline: float = BASELINE) -> DataFrame:
    """Worst overrun inherited along critical edges, one row per (operation, source at that ratio).

    ``own``: job_id, operation_id, ratio. Jobs of at most ``SMALL_LINKS`` edges and as many overruns are
    worked out as one row each, larger ones in rounds.
    """
    hot, edges = _hot(own, baseline), critical_edges.select("job_id", "operation_id", "pred_id")
    large = large_jobs({SMALL_LINKS: hot.unionByName(edges, allowMissingColumns=True)})
    kind = {c: edges.schema[c].dataType.simpleString() for c in edges.columns}

    def by_jobs(hot: DataFrame, edges: DataFrame) -> DataFrame:
        both = _job_rows(hot, edges).filter((F.size("nodes") > 0) & (F.size("links") > 0))
        return durable(both.mapInArrow(_worst_jobs, f"job_id {kind['job_id']}, operation_id {kind['operation_id']}, ratio double, source_id {kind['pred_id']}"))

    if large.isEmpty():
        return by_jobs(hot, edges)
    few = by_jobs(*[df.join(large, "job_id", "left_anti") for df in (hot, edges)])
    return few.unionByName(_cascade_by_rounds(*[df.join(large, "job_id", "left_semi") for df in (edges, hot)]))


def _cascade_by_rounds(critical_edges: DataFrame, hot: DataFrame) -> DataFrame:
    """:func:`cascade` of jobs of any size. A round passes on only what changed, so it
    ends after the longest critical chain.
    """
    edges = durable(critical_edges)
    hot = hot.select("job_id", "pred_id", "ratio", F.col("pred_id").alias("source_id"))
    cols = ["job_id", "operation_id", "ratio", "source_id"]
    best = edges.join(hot, ["job_id", "pred_id"]).select(*cols, F.lit(1).alias("fresh"))
    best = durable(_keep_worst(best))
    while not (changed := best.filter("fresh = 1")).isEmpty():
        sent = changed.select("job_id", F.col("operation_id").alias("pred_id"), "ratio", "source_id")
        got = edges.join(sent, ["job_id", "pred_id"]).select(*cols, F.lit(1).alias("fresh"))
        best = durable(_keep_worst(best.withColumn("fresh", F.lit(0)).unionByName(got)))
    return best.drop("fresh")


def _keep_worst(rows: DataFrame) -> DataFrame:
    """Per operation the rows at its greatest ratio, each once; known rows are not fresh."""
    each = rows.groupBy("job_id", "operation_id", "ratio", "source_id").agg(F.min("fresh").alias("fresh"))
    top = rows.groupBy("job_id", "operation_id").agg(F.max("ratio").alias("ratio"))
    return each.join(top, ["job_id", "operation_id", "ratio"], "left_semi")


def _job_signals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each operation, for rows of :func:`signals_by_jobs`; one of several operations of one id comes once for each of them."""
    for batch in batches:
        n = batch.num_rows
        lists = {c: batch.column(c) for c in ("nodes", "links", "paces")}
        each, flat, paces = (c.flatten() for c in lists.values())
        job, of, paced = (np.repeat(np.arange(n), pc.list_value_length(c).to_numpy(zero_copy_only=False)) for c in lists.values())
        ids, of_job = each.field("operation_id").to_pylist(), job.tolist()
        place, wrong = _places(job, ids)
        known = [at for at in place if at[1] is not None]  # no id matches none
        named = {at: place[at] for at in known}
        code = _numbers(named.get(at, -1) for at in zip(of_job, ids))
        own = each.field("time_overrun_ratio")
        ratio, has = own.to_numpy(zero_copy_only=False), own.is_valid().to_numpy(zero_copy_only=False) & (code >= 0)

        to, source = flat.field("operation_id").to_pylist(), flat.field("pred_id").to_pylist()
        dst, src = (_numbers(named.get(at, -1) for at in zip(of.tolist(), x)) for x in (to, source))
        planned = each.field("expected").to_numpy(zero_copy_only=False)
        lasts = np.where(planned.astype(float) <= 0, 0.0, planned)  # as duration() has it: no number is above all numbers
        lasts[~each.field("expected").is_valid().to_numpy(zero_copy_only=False) | np.isinf(lasts)] = 0.0
        t = _timed(n, job, lasts, wrong, of, src, dst)

        most = np.full(len(ids), -np.inf)
        np.maximum.at(most, code[has], ratio[has])
        is_known = np.bincount(code[has], minlength=len(ids)) > 0
        sent = (src >= 0) & (dst >= 0)
        sent[sent] = is_known[src[sent]]
        before = np.full(len(ids), -np.inf)
        np.maximum.at(before, dst[sent], most[src[sent]])
        preceded = np.bincount(dst[sent], minlength=len(ids)) > 0

        mean, total = paces.field("pace"), paces.field("completed")
        at = _numbers(named.get(k, -1) for k in zip(paced.tolist(), paces.field("operation_id").to_pylist()))
        sums = []
        for values in (mean, total):
            ok = (at >= 0) & values.is_valid().to_numpy(zero_copy_only=False)
            sums += [np.bincount(at[ok], values.to_numpy(zero_copy_only=False)[ok].astype(float), len(ids)), np.bincount(at[ok], minlength=len(ids))]
        staffed = np.bincount(at[at >= 0], minlength=len(ids)) > 0

        inherited, sources = np.full(len(ids), np.nan), [None] * len(ids)
        cascaded = np.zeros(len(ids), dtype=bool)
        hot = (has & ~(ratio <= BASELINE) & (ratio != np.inf)).tolist()
        first, owned = np.searchsorted(job, np.arange(n + 1)).tolist(), of.tolist()
        for j, some in groupby(t.tight.tolist(), key=lambda i: owned[i]):
            begun = {(float(ratio[i]), ids[i]) for i in range(first[j], first[j + 1]) if hot[i]}
            if begun:
                for end, ((_, worst), behind) in _worst(begun, [(to[i], source[i]) for i in some]).items():
                    k = named[j, end]
                    inherited[k], sources[k], cascaded[k] = worst, min(behind), True

        def taken(values: np.ndarray | list, there: np.ndarray, kind: pa.DataType) -> pa.Array:
            """What stands at the place of each row's id; null without one, or where there is nothing."""
            there = np.append(there, False)[code[rows]]
            held = pa.array(values, kind).take(pa.array(np.where(there, code[rows], 0)))
            return pc.if_else(pa.array(there), held, pa.scalar(None, kind))

        rows = np.repeat(np.arange(len(ids)), np.where(code >= 0, np.bincount(code[code >= 0], minlength=len(ids))[code], 1) if len(ids) else [])
        every = np.ones(len(ids), dtype=bool)
        made = {c: batch.column(c).take(pa.array(job[rows])) for c in batch.schema.names if c not in lists}
        made |= {f.name: each.field(f.name).take(pa.array(rows)) for f in each.type}
        made |= {"operator_pace_ratio": taken(sums[0] / np.maximum(sums[1], 1), sums[1] > 0, pa.float64()),
                 "completed_work_orders": taken(sums[2].astype(np.int64), staffed, pa.int64()),
                 "predecessor_time_overrun_ratio": taken(before, preceded, pa.float64()),
                 "critical_path_cascade_ratio": taken(inherited, cascaded, pa.float64()),
                 "cascade_source": taken(sources, cascaded, each.field("operation_id").type),
                 "valid": taken(t.valid[job], every, pa.bool_()), "project": taken(t.project[job], every, pa.float64()),
                 "duration": taken(lasts, every, pa.float64()), "es": taken(t.start, every, pa.float64()), "tail": taken(t.tail, every, pa.float64())}
        yield pa.record_batch(list(made.values()), names=list(made))


def signals_by_jobs(operations: DataFrame, edges: DataFrame, paces: DataFrame, of_job: dict[str, Column], beside: DataFrame) -> DataFrame:
    """Operations of jobs that fit into a row with their times, the pace of their operators and the overruns before them, in one shuffle by the job.

    ``operations``: job_id, operation_id, expected, time_overrun_ratio and any others; ``paces``: job_id, operation_id, pace and completed of each operator.
    ``of_job`` are aggregates of a job's operations (as fields of ``node``), ``beside`` has further columns of a job. Rows are those
    that joins by job and operation of :func:`critical_path`, :func:`cascade` and the others would give.
    """
    one = lambda df: F.struct(*[c for c in df.columns if c != "job_id"])
    nodes, links = operations.withColumn("expected", F.col("expected").cast("double")), edges.select("job_id", "operation_id", "pred_id")
    rows = None
    for name, df in (("node", nodes), ("link", links), ("paced", paces)):
        part = df.filter(F.col("job_id").isNotNull()).select("job_id", one(df).alias(name))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    per = rows.groupBy("job_id").agg(F.collect_list("node").alias("nodes"), F.collect_set("link").alias("links"), F.collect_list("paced").alias("paces"),
                                     *[c.alias(name) for name, c in of_job.items()]).join(beside, "job_id", "left")
    kinds = [f for f in per.schema if f.name not in ("nodes", "links", "paces")] + list(nodes.drop("job_id").schema)
    kinds += [T.StructField(c, T.DoubleType()) for c in ("operator_pace_ratio", "predecessor_time_overrun_ratio", "critical_path_cascade_ratio", "project", "duration", "es", "tail")]
    kinds += [T.StructField("completed_work_orders", T.LongType()), T.StructField("valid", T.BooleanType()), T.StructField("cascade_source", nodes.schema["operation_id"].dataType)]
    order = [f.name for f in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (b.select(order) for b in _job_signals(batches))

    made = per.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in kinds]))
    made = made.withColumns({name: F.when(F.col("valid").isNotNull(), c) for name, c in time_columns().items()})
    return made.drop("duration", "project", "es", "tail")
