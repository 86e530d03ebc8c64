"""Repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

Every byte covered by a ``LENGTH``-byte string that starts anywhere else is removed. Not every suffix
is sorted. A window of ``LENGTH`` bytes names one of its first ``REACH`` positions, its *anchor*: the
one whose 16-byte hash is smallest (the first of equal ones). Equal windows name the same anchor, so
only suffixes at anchors, one in about ``REACH / 2`` positions, need to be compared; at least
``LENGTH - REACH + 1`` bytes behind the anchor are common to them (the *group* of an anchor). Anchors
alone in their group are done. An anchor with the ``lo..hi`` bytes in front that its windows reach, and
the bytes behind, is a *context*; contexts that occur twice are repeated as a whole.

What is left are contexts that agree in part. They are sorted, once by what follows the anchor and
once by what precedes it: tasks make sorted runs for each range of strings, front-coded (the length
shared with the string before, then the rest), and each range merges its runs with a loser tree whose
comparisons start behind the prefix known to be common. Neighbours give the longest match behind and
in front, and intervals of windows that are surely repeated. Where these do not settle all windows of
a context, the group's windows are counted by their hashes.

Texts are UTF-8 bytes; null is empty; rows that repeat a text are copies of each other; matches never
cross texts. Texts are told apart, and contexts and windows compared for equality, by 64-bit hashes
within a group of equal 201-byte hashes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.llm.common import prepare, release, tidy
from kilnworks.session import durable

LENGTH, REACH, GRAM = 400, 200, 16
BEHIND = LENGTH - REACH + 1
#: Strings of one range of the merge; of them, so many are sampled for the bounds of ranges.
RANGE_ITEMS, SAMPLED = 20_000, 16
#: Rows (a few numbers each) up to which a table is broadcast to the texts; beyond it the join shuffles.
BROADCAST_ROWS = 1_500_000
#: Bytes of strings that a task sorts at once.
RUN_BYTES = 64 << 20
_BLOCK = 1 << 19
_LOW = np.uint64((1 << 20) - 1)

_U = np.uint64
_BASE = 0xD1342543DE82EF95
_LETTER = np.random.default_rng(400).integers(0, 1 << 64, size=256, dtype=np.uint64)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.ones(size, dtype=np.uint64)
        done = 1
        while done < size:
            step = min(done, size - done)
            p[done:done + step] = p[:step] * _U(pow(base, done, 1 << 64))
            done += step
        out.append(p)
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class Hashes:
    """Hashes of any substring of one text."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(14, int(len(data)).bit_length())
        power, self.inverse = _powers(size)
        self.upto = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_LETTER[data] * power[:len(data)], out=self.upto[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return _mix((self.upto[start + size] - self.upto[start]) * self.inverse[start])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, least and most bytes in front, hash of what is behind, and hash of the context."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    hashes = Hashes(data)
    found = []
    for at in range(0, n, _BLOCK):
        starts = min(_BLOCK, n - at)
        m = starts + REACH - 1
        a, b = hashes.upto[at:at + m], hashes.upto[at + GRAM:at + GRAM + m]
        h = (_mix((b - a) * hashes.inverse[at:at + m]) & ~_LOW) | np.arange(m, dtype=np.uint64)
        padded = np.full(-(-m // REACH) * REACH, ~_U(0))
        padded[:m] = h
        rows = padded.reshape(-1, REACH)
        forward = np.minimum.accumulate(rows, axis=1).ravel()
        backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(backward[:starts], forward[REACH - 1:REACH - 1 + starts])
        first = np.flatnonzero(np.diff(least, prepend=~least[0]))
        last = np.append(first[1:], starts) - 1
        p = (least[first] & _LOW).astype(np.int64)
        found.append((p + at, p - last, p - first))
    p, lo, hi = (np.concatenate(c) for c in zip(*found))
    key = hashes.of(p, BEHIND)
    context = hashes.of(p - hi, hi - lo + LENGTH) + _mix((lo * 256 + hi).astype(np.uint64) + _U(1))
    return p, lo, hi, key, context


def _pack(p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return p << 16 | lo << 8 | hi


def _parts(x: int) -> tuple[int, int, int]:
    return x >> 16, x >> 8 & 255, x & 255


def _bytes(column: pa.Array) -> Iterator[bytes]:
    for x in column:
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def _all_anchors(texts: DataFrame) -> DataFrame:
    """r (text), at (packed position, lo, hi), key, context: a row for each anchor of each row of ``texts``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r, data in zip(batch.column(0).to_pylist(), _bytes(batch.column(1))):
                p, lo, hi, key, context = anchors(np.frombuffer(data, dtype=np.uint8))
                if len(p):
                    out.append((np.full(len(p), r), _pack(p, lo, hi), key.view(np.int64), context.view(np.int64)))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], names=["r", "at", "key", "context"])

    return texts.mapInArrow(tidy(run), "r long, at long, key long, context long")


def common(a: bytes, b: bytes, h: int) -> int:
    """Length of the common prefix, known to be at least h."""
    most = min(len(a), len(b))
    step = 16
    while h < most:
        if a[h:h + step] == b[h:h + step]:
            h += step
            step = min(step * 4, 256)
        elif step == 1:
            return h
        else:
            step = max(1, step // 4)
            most = min(most, h + 4 * step) if step > 1 else most
    return min(h, len(a), len(b))


def front_coded(strings: list[bytes]) -> tuple[list[int], bytes]:
    """Of sorted strings, the length shared with the one before, and all the rests."""
    shared, rests, last = [], [], b""
    for s in strings:
        h = common(last, s, 0)
        shared.append(h)
        rests.append(s[h:])
        last = s
    return shared, b"".join(rests)


class _Run:
    """One front-coded run, read from its start."""

    __slots__ = ("shared", "sizes", "rests", "marks", "k", "at", "string", "known")

    def __init__(self, shared, sizes, rests, marks):
        self.shared, self.sizes, self.rests, self.marks = shared, sizes, rests, marks
        self.k, self.at, self.string, self.known = -1, 0, b"", 0
        self.next()

    def next(self) -> None:
        """The next string; ``known`` is its common prefix with the last winner, which was its predecessor."""
        self.k += 1
        if self.k == len(self.shared):
            self.string = None
            return
        h = self.shared[self.k]
        self.string = self.string[:h] + self.rests[self.at:self.at + self.sizes[self.k] - h]
        self.at += self.sizes[self.k] - h
        self.known = h


def merged(runs: list[_Run]) -> Iterator[tuple[bytes, int, object]]:
    """All strings in order, each with its common prefix with the one before.

    A loser tree. ``known`` of a run's string is its common prefix with the last string given out, or,
    for a loser that still waits in the tree, with the winner it lost to. Of two strings the one that
    shares more with the last output is smaller; only if both share the same are bytes compared, from
    there on.
    """
    size = 1
    while size < len(runs):
        size *= 2

    def play(a: _Run | None, b: _Run | None) -> tuple[_Run | None, _Run | None]:
        """Winner and loser."""
        if a is None or a.string is None:
            return b, a
        if b is None or b.string is None:
            return a, b
        if a.known != b.known:
            return (a, b) if a.known > b.known else (b, a)
        h = common(a.string, b.string, a.known)
        x, y = a.string, b.string
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            b.known = h
            return a, b
        a.known = h
        return b, a

    losers: list[_Run | None] = [None] * size
    level: list[_Run | None] = list(runs) + [None] * (size - len(runs))
    for run in runs:
        run.known = 0
    places = {id(run): k for k, run in enumerate(runs)}
    node_of = size
    while len(level) > 1:
        up = []
        for k in range(0, len(level), 2):
            winner, loser = play(level[k], level[k + 1])
            losers[(node_of + k) // 2] = loser
            up.append(winner)
        level, node_of = up, node_of // 2
    winner = level[0]
    while winner is not None and winner.string is not None:
        yield winner.string, winner.known, winner.marks[winner.k]
        run = winner
        run.next()
        node = (size + places[id(run)]) // 2
        while node:
            run, losers[node] = play(run, losers[node])
            node //= 2
        winner = run


def _strings(data: bytes, at: int, key: bytes) -> tuple[bytes, bytes]:
    """The two orders' strings of one context: group, then bytes behind and in front, or the reverse."""
    p, lo, hi = _parts(at)
    behind, before = data[p:p + LENGTH - lo], data[p - hi:p][::-1]
    return key + behind + before, key + before + behind


def _matches(order: int, a: tuple, b: tuple, h: int) -> tuple[int, int]:
    """Common bytes behind and in front of two neighbours of one group; a, b: (string, lo, hi)."""
    (s, lo1, hi1), (t, lo2, hi2) = a, b
    first = (LENGTH - lo1, LENGTH - lo2) if order == 0 else (hi1, hi2)
    x = min(h - 8, *first)
    y = common(s[8 + first[0]:], t[8 + first[1]:], 0)
    return (x, y) if order == 0 else (y, x)


_RUN_SCHEMA = "ord int, part int, shared binary, sizes binary, rests binary, marks binary, ats binary"
_PAIR_SCHEMA = "kind int, ord int, part int, key long, context long, at long, behind int, front int, string binary"


def _fetched(texts: DataFrame, wanted: DataFrame, n: int, run, schema: str) -> DataFrame:
    """``run`` over (text, items) of the texts that ``wanted`` (r, d, items) names; copies of a text are passed over."""
    small = F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted
    return texts.join(small, ["r", "d"]).select("x", "items").mapInArrow(tidy(run), schema)


def _sorted_pairs(texts: DataFrame, items: DataFrame) -> DataFrame:
    """key, context, ord, behind, front: each context with its neighbours in both orders."""
    spark = texts.sparkSession
    n = items.count()
    parts = max(1, -(-n // RANGE_ITEMS))
    lists = lambda rows: rows.groupBy("r", "d").agg(F.collect_list(F.struct("key", "context", "at")).alias("items"))  # noqa: E731  as many as a text has anchors

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [_strings(d, i["at"], (i["key"] & (1 << 64) - 1).to_bytes(8, "big")) for d, row in zip(_bytes(batch.column(0)), batch.column(1).to_pylist()) for i in row]
            yield pa.record_batch([pa.array([x for x, _ in both], pa.binary()), pa.array([y for _, y in both], pa.binary())], names=["s0", "s1"])

    bounds: list[list[bytes]] = [[], []]
    if parts > 1:
        every = max(1, n // (parts * SAMPLED))
        rows = _fetched(texts, lists(items.where(F.pmod(F.xxhash64("context"), F.lit(every)) == 0)), n // every, sampled, "s0 binary, s1 binary").distinct().collect()
        for order in (0, 1):  # about SAMPLED strings for each range
            s = sorted(bytes(r[order]) for r in rows)
            bounds[order] = sorted({s[k * len(s) // parts] for k in range(1, parts)}) if s else []

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for order in (0, 1):
                held[order].sort()
                strings = [h[0] for h in held[order]]
                ends = [*[bisect_left(strings, b) for b in bounds[order]], len(strings)]
                at = 0
                for part, to in enumerate(ends):
                    if to > at:
                        shared, rests = front_coded(strings[at:to])
                        own = held[order][at:to]
                        rows.append((order, part, np.array(shared, "<i4").tobytes(), np.array([len(s) for s in strings[at:to]], "<i4").tobytes(), rests,
                                     np.array([h[1] for h in own], "<i8").tobytes(), np.array([h[2] for h in own], "<i8").tobytes()))
                    at = to
                held[order].clear()
            kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _RUN_SCHEMA.split(", ")])

        for batch in batches:
            for data, row in zip(_bytes(batch.column(0)), batch.column(1).to_pylist()):
                for i in row:
                    both = _strings(data, i["at"], (i["key"] & (1 << 64) - 1).to_bytes(8, "big"))
                    held[0].append((both[0], i["context"], i["at"]))
                    held[1].append((both[1], i["context"], i["at"]))
                    size += 2 * len(both[0])
            if size > RUN_BYTES:
                yield from flush()
                size = 0
        yield from flush()

    def merge(table: pa.Table) -> pa.Table:
        order, part = table.column("ord")[0].as_py(), table.column("part")[0].as_py()
        own = []
        for row in table.to_pylist():
            marks = list(zip(np.frombuffer(row["marks"], "<i8").tolist(), np.frombuffer(row["ats"], "<i8").tolist()))
            own.append(_Run(np.frombuffer(row["shared"], "<i4").tolist(), np.frombuffer(row["sizes"], "<i4").tolist(), row["rests"], marks))
        rows, last = [], None
        for string, h, (context, at) in merged(own):
            _, lo, hi = _parts(at)
            key = int.from_bytes(string[:8], "big", signed=True)
            if last is None:
                rows.append((1, order, part, key, context, at, 0, 0, string))
            elif last[1] == context and last[3] == key:
                continue  # the same context, read from another copy of its text
            elif h >= 8:
                x, y = _matches(order, (last[0], *_parts(last[2])[1:]), (string, lo, hi), h)
                rows.append((0, order, part, key, last[1], last[2], x, y, None))
                rows.append((0, order, part, key, context, at, x, y, None))
            last = (string, context, at, key)
        if last is not None:
            rows.append((2, order, part, last[3], last[1], last[2], 0, 0, last[0]))
        kinds = [pa.int32()] * 3 + [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]
        out = pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _PAIR_SCHEMA.split(", ")])
        rows.clear()
        release()
        return out

    dealt = _fetched(texts, lists(items), n, runs, _RUN_SCHEMA)
    pairs = durable(dealt.groupBy("ord", "part").applyInArrow(merge, _PAIR_SCHEMA))
    # neighbours across ranges: two strings of each range
    ends = sorted((r["ord"], r["part"], r["kind"], bytes(r["string"]), r["key"], r["context"], r["at"]) for r in pairs.where("kind > 0").collect())
    across = []
    for a, b in zip(ends, ends[1:]):
        if a[0] == b[0] and a[1] != b[1] and a[4] == b[4] and a[5] != b[5]:
            x, y = _matches(a[0], (a[3], *_parts(a[6])[1:]), (b[3], *_parts(b[6])[1:]), common(a[3], b[3], 0))
            across += [(a[4], a[5], a[0], a[6], x, y), (b[4], b[5], b[0], b[6], x, y)]
    schema = "key long, context long, ord int, at long, behind int, front int"
    return pairs.where("kind = 0").select("key", "context", "ord", "at", "behind", "front").unionAll(spark.createDataFrame(across, schema))


def _settled(pairs: DataFrame) -> DataFrame:
    """key, context, at, least, most (windows that may be repeated), spans (windows that are) and open (may be more)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, context, at, behind, front, near in zip(*(c.to_pylist() for c in batch.columns)):
                _, lo, hi = _parts(at)
                least, most = max(lo, LENGTH - (behind or 0)), min(hi, front or 0)
                spans = sorted((max(lo, LENGTH - n["behind"]), min(hi, n["front"])) for n in near)
                known, upto = [], least - 1
                for a, b in spans:
                    if a > b:
                        continue
                    known.append({"a": a, "b": b})
                    if a <= upto + 1:
                        upto = max(upto, b)
                out.append((key, context, at, least, most, known, upto < most))
            kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.bool_()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["key", "context", "at", "least", "most", "spans", "open"])

    # at most four neighbours each, and two for each range bound
    near = pairs.groupBy("key", "context").agg(F.min("at").alias("at"), F.max(F.when(F.col("ord") == 0, F.col("behind"))).alias("behind"),
                                               F.max(F.when(F.col("ord") == 1, F.col("front"))).alias("front"),
                                               F.collect_set(F.struct("behind", "front")).alias("near"))
    return near.mapInArrow(tidy(run), "key long, context long, at long, least int, most int, spans array<struct<a:int,b:int>>, open boolean")


def _counted(texts: DataFrame, items: DataFrame) -> DataFrame:
    """key, context, o: windows (o bytes in front) that another context of the group has too; items: r, d, key, context, at, least, most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, row in zip(_bytes(batch.column(0)), batch.column(1).to_pylist()):
                hashes = Hashes(np.frombuffer(data, dtype=np.uint8))
                for i in row:
                    o = np.arange(i["least"], i["most"] + 1)
                    h = hashes.of(_parts(i["at"])[0] - o, LENGTH)
                    out.append((np.full(len(o), i["key"]), np.full(len(o), i["context"]), o.astype(np.int32), h.view(np.int64)))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], names=["key", "context", "o", "h"])

    n = items.count()
    lists = items.groupBy("r", "d").agg(F.collect_list(F.struct("key", "context", "at", "least", "most")).alias("items"))
    windows = durable(_fetched(texts, lists, n, run, "key long, context long, o int, h long"))
    often = durable(windows.groupBy("key", "o", "h").agg(F.min("context").alias("c0"), F.max("context").alias("c1")).where("c0 < c1").select("key", "o", "h"))
    return windows.join(often, ["key", "o", "h"]).select("key", "context", "o").distinct()


def repeated_spans(texts: DataFrame) -> DataFrame:
    """r, starts, ends, across: disjoint spans of repeated bytes of each text; ``texts``: d (id), r (text), x.

    ``across``: the bytes behind the anchor of a repeated string stand in another text as well.
    """
    found = durable(_all_anchors(texts.select("r", "x")))
    often = found.groupBy("key").agg(F.count("*").alias("n"), (F.min("r") < F.max("r")).alias("across")).where("n > 1").select("key", "across")
    shared = durable(found.join(durable(often), "key"))
    contexts = durable(shared.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(F.struct("r", "at")).alias("one")))
    split = contexts.groupBy("key").agg(F.count("*").alias("m"), F.sum((F.col("n") == 1).cast("int")).alias("alone")).where("m > 1 and alone > 0").select("key")
    one_row = texts.groupBy("r").agg(F.min("d").alias("d"))
    items = durable(contexts.join(durable(split), "key").select("key", "context", "n", "one.r", "one.at").join(one_row, "r"))
    whole = contexts.where("n > 1").select("key", "context", F.array(F.struct(F.lit(0).alias("a"), F.lit(REACH).alias("b"))).alias("spans"))
    if not items.isEmpty():
        settled = durable(_settled(_sorted_pairs(texts, items.select("r", "d", "key", "context", "at"))))
        alone = items.where("n = 1").select("key", "context")
        whole = whole.unionAll(settled.where(F.size("spans") > 0).join(alone, ["key", "context"], "left_semi").select("key", "context", "spans"))
        unclear = durable(settled.where("open").join(alone, ["key", "context"], "left_semi").select("key").distinct())
        if not unclear.isEmpty():
            doubt = durable(items.select("r", "d", "key", "context").join(settled.select("key", "context", "at", "least", "most").where("least <= most"), ["key", "context"])
                            .join(unclear, "key", "left_semi"))
            more = _counted(texts, doubt).join(alone, ["key", "context"], "left_semi")
            whole = whole.unionAll(more.select("key", "context", F.array(F.struct(F.col("o").alias("a"), F.col("o").alias("b"))).alias("spans")))
    spans = shared.join(durable(whole), ["key", "context"]).select("r", "at", "spans", "across")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r, row, across in zip(*(batch.column(k).to_pylist() for k in range(3))):
                a = np.array([s["a"] for s in row])
                upto = np.maximum.accumulate(np.array([s["b"] for s in row]))
                new = np.concatenate([[True], a[1:] > upto[:-1]])
                rows.append((r, a[new], upto[np.concatenate([new[1:], [True]])], across))
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["r", "starts", "ends", "across"])

    p, lo, hi = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(255), F.col("at").bitwiseAND(255)
    bytes_ = F.transform("spans", lambda s: F.struct((p - F.least(hi, s["b"])).alias("a"), (p - F.greatest(lo, s["a"]) + LENGTH).alias("b")))
    each = spans.select("r", "across", F.explode(bytes_).alias("s")).groupBy("r").agg(F.sort_array(F.collect_set("s")).alias("s"), F.max("across").alias("across"))
    return each.mapInArrow(tidy(joined), "r long, starts array<long>, ends array<long>, across boolean")  # as many as a text has bytes


def removed_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, starts, ends (removed spans), kept (remaining bytes) and elsewhere of every row.

    ``elsewhere``: another row has the same text, or the ``LENGTH - REACH + 1`` bytes behind the anchor of a repeated
    string; false if nothing is removed, or only what the text repeats by itself.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("r"), F.col(text_col).alias("x"))
    known = texts.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "r", "x").where(F.octet_length("x") >= LENGTH)
    spans = repeated_spans(known)
    copies = known.groupBy("r").agg((F.count("*") > 1).alias("copied"))
    spans = durable(spans.join(copies, "r").withColumn("across", F.col("across") | F.col("copied")).drop("copied"))
    n = spans.agg(F.sum(F.size("starts") + 1)).first()[0] or 0
    own = texts.join(F.broadcast(spans) if n <= BROADCAST_ROWS else spans, "r", "left").select("doc_id", "x", "starts", "ends", F.coalesce("across", F.lit(False)).alias("elsewhere"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            size, kept = [], []
            for data, a, b in zip(_bytes(batch.column(1)), starts, ends):
                size.append(len(data))
                kept.append(b"".join([data[i:j] for i, j in zip([0, *b], [*a, len(data)])]) if a else data)
            kind = pa.list_(pa.int64())
            yield pa.record_batch([batch.column(0), pa.array(size, pa.int64()), pa.array([a or [] for a in starts], kind), pa.array([b or [] for b in ends], kind),
                                   pa.array(kept, pa.binary()), batch.column(4)], names=["doc_id", "n_bytes", "starts", "ends", "kept", "elsewhere"])

    return own.mapInArrow(tidy(run), "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary, elsewhere boolean")

