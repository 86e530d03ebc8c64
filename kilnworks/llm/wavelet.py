"""Token files as wavelet matrices: one compressed row per shard, with rank and select.

A shard holds the ids of whole documents one after the other. Its wavelet matrix has one bit plane
for each bit of an id, most significant first; a plane stores, for the order the planes above leave,
that bit of every id, and the number of ones before each block of 512 bits. From the planes alone
follow the id at a position (``access``), how often an id occurs before a position (``rank``), and
where its k-th occurrence is (``select``).

File format: Parquet (zstd), a row per shard with ``shard`` (task << 20 | running number),
``n_tokens``, ``n_bits``, ``doc_ids``, ``doc_ends`` (ids up to and with each document),
``zeros`` (zero bits of each plane), ``planes`` (packed bits, first bit highest) and ``ranks``
(little-endian unsigned 32-bit counts). A document is never divided between shards.

Null text is an empty document; a null ``doc_id`` sorts first; rows that repeat are documents of
their own; an empty table gives no shard.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zlib
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from kilnworks.llm.common import gathered, parallelism, prepare, sized, tidy
from kilnworks.llm.encode import encoder
from kilnworks.session import durable

BLOCK = 512
#: Ids of one shard, a longer document excepted; bounds what a task holds.
SHARD_IDS = 1 << 21
#: Words that a worker remembers with their ids.
REMEMBERED = 600_000
#: Shard numbers of one task.
SHARD_GROUP = 1 << 20

SHARD = ("shard long, n_tokens long, n_bits int, doc_ids array<long>, doc_ends array<long>, zeros array<long>, "
         "planes array<binary>, ranks array<binary>")
_SHARD_ARROW = pa.schema([("shard", pa.int64()), ("n_tokens", pa.int64()), ("n_bits", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                          ("doc_ends", pa.list_(pa.int64())), ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())),
                          ("ranks", pa.list_(pa.binary()))])


class WaveletMatrix:
    """Bit planes of one sequence, built from ids or taken from a stored shard."""

    def __init__(self, n: int, n_bits: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.n_bits, self.zeros = n, n_bits, zeros
        self.planes = [np.frombuffer(p, dtype=np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, dtype="<u4") for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, n_bits: int) -> "WaveletMatrix":
        planes, ranks, zeros = [], [], []
        order = ids.astype(np.uint16 if n_bits <= 16 else np.uint32)
        for level in range(n_bits - 1, -1, -1):
            bits = (order & order.dtype.type(1 << level)).view(np.int16 if n_bits <= 16 else np.int32) != 0
            packed = np.packbits(bits)
            whole = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), dtype=np.uint8)
            whole[:len(packed)] = packed
            ones = np.bitwise_count(whole.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint32)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype("<u4").tobytes())
            planes.append(packed.tobytes())
            low = order.take(np.flatnonzero(~bits))
            zeros.append(len(low))
            order = np.concatenate([low, order.take(np.flatnonzero(bits))])
        return cls(len(ids), n_bits, zeros, planes, ranks)

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        block = i // BLOCK
        a, b = block * (BLOCK // 8), i // 8
        plane = self.planes[level]
        count = int(self.ranks[level][block]) + int(np.bitwise_count(plane[a:b]).sum())
        return count + (int(plane[b] >> (8 - i % 8)).bit_count() if i % 8 else 0)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8] >> (7 - i % 8)) & 1

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.n_bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        start = 0
        for level in range(self.n_bits):
            a, b = self._ones(level, start), self._ones(level, end)
            if value >> (self.n_bits - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, value: int, end: int) -> int:
        """Occurrences of an id before a position."""
        if value >> self.n_bits:
            return 0
        start, stop = self._range(value, end)
        return stop - start

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of an id; -1 if there are fewer."""
        if value >> self.n_bits:
            return -1
        start, stop = self._range(value, self.n)
        if not 0 <= k < stop - start:
            return -1
        i = start + k
        for level in range(self.n_bits - 1, -1, -1):
            one = value >> (self.n_bits - 1 - level) & 1
            target = i - self.zeros[level] if one else i
            lo, hi = 0, self.n - 1
            while lo < hi:  # the position whose bit is the target-th of its kind
                mid = (lo + hi) // 2
                ones = self._ones(level, mid + 1)
                if (ones if one else mid + 1 - ones) > target:
                    hi = mid
                else:
                    lo = mid + 1
            i = lo
        return i

    def decode(self) -> np.ndarray:
        """All ids in order, from the lowest plane up."""
        values = np.zeros(self.n, dtype=np.uint32 if self.n_bits > 16 else np.uint16)
        for level in range(self.n_bits - 1, -1, -1):
            bits = np.unpackbits(self.planes[level], count=self.n).view(bool)
            above = np.empty_like(values)
            above[np.flatnonzero(~bits)] = values[:self.zeros[level]]
            above[np.flatnonzero(bits)] = values[self.zeros[level]:] | values.dtype.type(1 << (self.n_bits - 1 - level))
            values = above
        return values


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, n_bits: int = 16, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Encode whole texts and write the shards, in ascending order of ids.

    Ranges of ids are dealt to tasks; rows with one id are ordered by their text, so that a run
    repeats alike after a lost executor.
    """
    spark = prepare(docs.sparkSession)
    keyed = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("x"))
    dealt = (keyed.repartitionByRange(parallelism(spark), F.col("d"), F.crc32(F.coalesce("x", F.lit(""))))
             .sortWithinPartitions("d", F.crc32(F.coalesce("x", F.lit(""))), "x"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, True, REMEMBERED)
        base, serial = TaskContext.get().partitionId() * SHARD_GROUP, 0
        held: list[np.ndarray] = []
        docs_in: list = []
        ends: list[int] = []
        n = 0

        def shard() -> pa.RecordBatch:
            m = WaveletMatrix.build(np.concatenate(held), n_bits)
            row = [[base | serial], [m.n], [n_bits], [docs_in], [ends], [m.zeros], [[p.tobytes() for p in m.planes]],
                   [[r.tobytes() for r in m.ranks]]]
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, _SHARD_ARROW.types)], schema=_SHARD_ARROW)

        for batch in gathered(batches):
            flat, bounds = own.batch(batch.column(1))
            at = 0
            for d, to in zip(batch.column(0).to_pylist(), bounds.tolist()):
                ids = np.append(flat[at:to], flat.dtype.type(end_id))
                at = to
                if held and n + len(ids) > SHARD_IDS:
                    yield shard()
                    held, docs_in, ends, n, serial = [], [], [], 0, serial + 1
                held.append(ids)
                n += len(ids)
                docs_in.append(d)
                ends.append(n)
        if held:
            yield shard()

    dealt.mapInArrow(build, SHARD).write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(path)


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and shard of every document, from the files alone."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                ids = WaveletMatrix(row["n_tokens"], row["n_bits"], row["zeros"], row["planes"], row["ranks"]).decode().astype("<u4")
                ends = np.array(row["doc_ends"], dtype=np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64()),
                                       pa.array(np.full(len(ends), row["shard"]))], names=["doc_id", "s", "n_tokens", "ids_crc32", "shard"])

    shards = read_shards(spark, path)
    docs = shards.mapInArrow(tidy(digest), "doc_id long, s long, n_tokens long, ids_crc32 long, shard long")
    return docs.join(_before(shards), "shard").select("doc_id", (F.col("b") + F.col("s")).alias("start"), "n_tokens", "ids_crc32", "shard")


def _before(shards: DataFrame) -> DataFrame:
    """shard, b: ids of all shards before it. Shards are summed in groups of ``SHARD_GROUP`` numbers, so no window holds them all."""
    group = F.floor(F.col("shard") / SHARD_GROUP).alias("g")
    sizes = durable(shards.select("shard", group, "n_tokens"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("g").agg(F.sum("n_tokens").alias("n"))  # a row for about a task's shards
    upto = groups.select("g", F.coalesce(F.sum("n").over(earlier.orderBy("g")), F.lit(0)).alias("before"))
    own = sizes.select("shard", "g", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("within"))
    return own.join(F.broadcast(upto), "g").select("shard", (F.col("before") + F.col("within")).alias("b"))


def _matrix(batch: pa.RecordBatch, k: int) -> "WaveletMatrix":
    return WaveletMatrix(*(batch.column(c)[k].as_py() for c in ("n_tokens", "n_bits", "zeros", "planes", "ranks")))


def token_counts(spark: SparkSession, path: str, tokens: Sequence[int]) -> DataFrame:
    """token, doc_id, n, first: how often each document has a token, and its first place there; from ranks and selects, without decoding."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                m, ids, ends = _matrix(batch, k), batch.column("doc_ids")[k].as_py(), batch.column("doc_ends")[k].as_py()
                rows = []
                for token in tokens:
                    seen, start = 0, 0
                    if m.rank(token, m.n):
                        for d, end in zip(ids, ends):
                            upto = m.rank(token, end)
                            if upto > seen:
                                rows.append((token, d, upto - seen, m.select(token, seen) - start))
                            seen, start = upto, end
                yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)], names=["token", "doc_id", "n", "first"])

    return read_shards(spark, path).mapInArrow(count, "token long, doc_id long, n long, first long")


def document_tokens(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, place, token of the documents ``wanted`` (doc_id) names, by access to their ids alone; documents of one id follow each other."""
    shards = read_shards(spark, path)
    asked = (shards.select("shard", F.explode("doc_ids").alias("doc_id")).join(sized(wanted.select(F.col("doc_id").cast("long")).distinct()), "doc_id")
             .groupBy("shard").agg(F.collect_set("doc_id").alias("asked")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                m, asked_ids, start = _matrix(batch, k), set(batch.column("asked")[k].as_py()), 0
                for d, end in zip(batch.column("doc_ids")[k].as_py(), batch.column("doc_ends")[k].as_py()):
                    if d in asked_ids:
                        yield pa.record_batch([pa.array([d] * (end - start), pa.int64()), pa.array(range(end - start), pa.int64()),
                                               pa.array([m.access(i) for i in range(start, end)], pa.int64())], names=["doc_id", "place", "token"])
                    start = end

    return shards.join(asked, "shard").mapInArrow(fetch, "doc_id long, place long, token long")
