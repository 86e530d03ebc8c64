"""Line dedup: a suffix array over line ids by distributed prefix doubling.

A text is the sequence of its lines that hold a word. Round k gives every suffix whose first 2^k
lines occur more than once a rank by these lines; the next round ranks pairs of ranks that lie 2^k
lines apart. Only distinct pairs that occur more than once are sorted (range exchange, so equal
pairs of a hot line are one row), and a suffix whose prefix is unique leaves for good.

The runs judged are the shortest of at least ``least_words`` words at each first line and at each last
line. The suffixes that share one form an interval of the suffix array with a common prefix of at least
that length, recognised by two overlapping ranks. The first in (id, text, line) order stays; the lines of
the others are deleted. Together they cover the maximal repeated runs: the shortest run up to the last
line of one lies in it, and so does the shortest run from every line before that. Every deleted line so
has an earlier copy, and by following earlier copies one that stays.

Lines are compared as they are, by 64-bit hashes. Lines without a word take no part; one between two
deleted lines of a run goes with them. Runs do not cross texts, and texts with fewer than
``least_words`` words lose nothing. Null texts stay null; rows that agree in id and text are one
document (all get its result); a null id sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.llm.common import parallelism, prepare, renamed, tidy
from kilnworks.session import durable

LEAST_WORDS = 50
#: Runs (a few numbers each) up to which they are broadcast to the texts; beyond it the join shuffles.
BROADCAST_RUNS = 300_000
_SPACE = bytes([32, 9, 10, 11, 12, 13])


def _key(id_col: str, text_col: str) -> list:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("\x00null"))).alias("k2")]


def suffixes(docs: DataFrame, least_words: int, id_col: str, text_col: str) -> DataFrame:
    """k1, k2, i, h (line hash), m (lines up to ``least_words`` words; 0 if the text ends before) and most.

    Runs of m to ``most`` lines are judged: behind m, those that without line i have fewer words than count.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, places, hashes, needs, mosts = [], [], [], [], [], []
            for a, b, text in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)):
                lines = [x for x in text.as_buffer().to_pybytes().split(b"\n") if x.strip(_SPACE)] if text.is_valid else []
                if not lines:
                    continue
                upto = np.cumsum([len(x.split()) for x in lines])
                if upto[-1] < least_words:
                    continue
                before = np.concatenate([[0], upto[:-1]])
                end = np.searchsorted(upto, before + least_words) + 1
                places.append(np.arange(len(lines), dtype=np.int32))
                needs.append(np.where(end <= len(lines), end - places[-1], 0).astype(np.int32))
                last = np.append(end[1:] - 1, len(lines))
                mosts.append(np.where(needs[-1] > 0, np.maximum(np.minimum(last, len(lines)) - places[-1], needs[-1]), 0).astype(np.int32))
                hashes.append(np.array([xxhash.xxh3_64_intdigest(x) for x in lines], dtype=np.uint64).view(np.int64))
                k1.append(np.full(len(lines), a))
                k2.append(np.full(len(lines), b))
            if k1:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in (k1, k2, places, hashes, needs, mosts)],
                                      names=["k1", "k2", "i", "h", "m", "most"])

    return docs.select(*_key(id_col, text_col), F.col(text_col).alias("x")).mapInArrow(tidy(run), "k1 long, k2 long, i int, h long, m int, most int")


def _ranked(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The distinct keys that occur more than once, with a rank in their order (increasing, with gaps)."""
    often = pairs.groupBy(*by).agg(F.count("*").alias("often")).where("often > 1").select(*by)
    n = parallelism(pairs.sparkSession)
    return durable(often.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("new", F.monotonically_increasing_id()))


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k1, k2, i, m: runs of lines (numbered among lines with a word) that an earlier document or line has."""
    prepare(docs.sparkSession)
    lines = durable(suffixes(docs, least_words, id_col, text_col).dropDuplicates(["k1", "k2", "i"]))
    ranks = lines.join(_ranked(lines, ["h"]), "h").withColumnRenamed("new", "rank")
    level, step, windows = 0, 1, None
    active = durable(ranks.select("k1", "k2", "i", "m", "most", "rank"))
    while not active.isEmpty():
        # a run of m lines, step <= m < 2 step, is told by the ranks at its start and step lines before its end
        later = active.select("k1", "k2", F.col("i").alias("j"), F.col("rank").alias("tail"))
        own = active.where((F.col("m") > 0) & (F.col("most") >= step) & (F.col("m") < 2 * step))
        sizes = F.sequence(F.greatest("m", F.lit(step)), F.least("most", F.lit(2 * step - 1)))
        own = own.withColumn("m", F.explode(sizes)).withColumn("j", F.col("i") + F.col("m") - step)
        found = own.join(later, ["k1", "k2", "j"]).select(F.lit(level).alias("level"), "m", F.col("rank").alias("head"), "tail", "k1", "k2", "i")
        windows = found if windows is None else windows.unionAll(found)
        # suffixes with a run already judged still lend their ranks to others
        paired = durable(active.withColumn("j", F.col("i") + step).join(later, ["k1", "k2", "j"]).select("k1", "k2", "i", "m", "most", "rank", "tail"))
        if paired.where(F.col("most") >= 2 * step).isEmpty():
            break
        active = durable(paired.join(_ranked(paired, ["rank", "tail"]), ["rank", "tail"]).select("k1", "k2", "i", "m", "most", F.col("new").alias("rank")))
        level, step = level + 1, 2 * step
    if windows is None:
        return lines.where("false").select("k1", "k2", "i", "m")
    windows = durable(windows)
    interval = ["level", "m", "head", "tail"]
    first = durable(windows.groupBy(*interval).agg(F.min(F.struct("k1", "k2", "i")).alias("first"), F.count("*").alias("often")).where("often > 1"))
    same = (F.col("first.k1") == F.col("k1")) & (F.col("first.k2") == F.col("k2")) & (F.col("first.i") == F.col("i"))
    return windows.join(first, interval).where(~same).select("k1", "k2", "i", "m")


def maximal_runs(runs: DataFrame) -> DataFrame:
    """k1, k2, starts, ends: the joined runs of each document, ends behind the last line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for row in batch.column(2).to_pylist():
                i = np.array([r["i"] for r in row])
                upto = np.maximum.accumulate(np.array([r["i"] + r["m"] for r in row]))
                new = np.concatenate([[True], i[1:] >= upto[:-1]])
                starts.append(i[new])
                ends.append(upto[np.concatenate([new[1:], [True]])])
            kind = pa.list_(pa.int32())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(starts, kind), pa.array(ends, kind)], names=["k1", "k2", "starts", "ends"])

    # a text's runs are at most twice as many as its lines
    return runs.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("r")).mapInArrow(
        tidy(run), "k1 long, k2 long, starts array<int>, ends array<int>")


def _without(text: str, starts: list[int], ends: list[int]) -> str:
    lines = text.encode().split(b"\n")
    gone = np.zeros(len(lines) + 1, dtype=bool)
    numbered = [n for n, x in enumerate(lines) if x.strip(_SPACE)]
    for a, b in zip(starts, ends):
        gone[numbered[a]:numbered[b - 1] + 1] = True
    return b"\n".join(x for n, x in enumerate(lines) if not gone[n]).decode()


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its columns, the text without the deleted lines, and line_starts, line_ends (null if nothing went).

    Input columns of these two names are kept as ``in_line_starts`` and ``in_line_ends``.
    """
    runs = durable(maximal_runs(repeated_runs(docs, least_words, id_col, text_col)))
    n = runs.agg(F.sum(F.size("starts") + 1)).first()[0] or 0
    cut = runs.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("starts").alias("line_starts"), F.col("ends").alias("line_ends"))
    key1, key2 = _key(id_col, text_col)
    docs = renamed(docs, ["line_starts", "line_ends"])
    plain = docs.columns
    joined = docs.select(*plain, key1.alias("__own1"), key2.alias("__own2")).join(
        F.broadcast(cut) if n <= BROADCAST_RUNS else cut, (F.col("__own1") == F.col("__k1")) & (F.col("__own2") == F.col("__k2")), "left").select(
        *plain, "line_starts", "line_ends")
    at = plain.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts, ends = batch.column(at), batch.column(len(plain)), batch.column(len(plain) + 1)
            if starts.null_count < len(starts):
                texts = pa.array([x.as_py() if not a.is_valid else _without(x.as_py(), a.as_py(), b.as_py()) for x, a, b in zip(texts, starts, ends)], texts.type)
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return joined.mapInArrow(tidy(run), joined.schema)
