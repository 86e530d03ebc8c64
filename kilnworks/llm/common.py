"""Shared pieces of the corpus operators: session settings, row keys and checked columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnworks.session import configure, durable

# buffers go back to the system at once, as a worker lives through many stages
pa.set_memory_pool(pa.system_memory_pool())

#: Rows of one Arrow batch: whole texts of a batch are in a Python worker at once.
ARROW_ROWS, ARROW_BYTES = 256, 16 << 20
#: Rows (of a few numbers each) up to which a table is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
WORDS = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of every corpus job; Arrow batches are kept short for long texts."""
    configure(spark)
    for key, value in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) != str(value):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, to be broadcast if it has been counted to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(rows: DataFrame, out: str) -> DataFrame:
    """Rows with a number from 0 on without gaps, in the order in which they stand in partitions; no window over all rows."""
    rows = durable(rows.withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33).alias("__part")
    counts = rows.groupBy(part).agg(F.count("*").alias("n"))  # one row for each partition
    before = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    placed = rows.select("*", part).join(F.broadcast(before), "__part")
    return placed.withColumn(out, F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m", "__part", "__before")


def parallelism(spark: SparkSession) -> int:
    """Partitions for a range exchange: what the cluster sets for shuffles."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_key(text: str = "text") -> list[Column]:
    """Two 64-bit hashes that stand for one whole text; null has a key of its own."""
    whole = F.coalesce(F.col(text), F.lit("\x00null"))
    return [F.xxhash64(whole).alias("t1"), F.xxhash64(F.lit(7919), whole).alias("t2")]


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together up to a number of rows or bytes, for work that gains from repeated words."""
    held: list[pa.RecordBatch] = []
    n = weight = 0
    for batch in batches:
        held.append(batch)
        n, weight = n + batch.num_rows, weight + batch.nbytes
        if n >= rows or weight >= size:
            yield pa.concat_batches(held)
            held, n, weight = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which freed memory goes back to the system, as the worker waits for tasks of later stages."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def release() -> None:
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def words(text: Column | str) -> Column:
    """The words of a text, split at ASCII white space; none for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(c, F.lit("")), WORDS), lambda w: w != "")


def renamed(df: DataFrame, own: Iterable[str], prefix: str = "in_") -> DataFrame:
    """Input columns that bear the name of an output column get a prefix, so none is lost."""
    own = {c.lower() for c in own}
    taken = {c.lower() for c in df.columns} | own
    out = []
    for c in df.columns:
        name = c
        if c.lower() in own:
            name = f"{prefix}{c}"
            while name.lower() in taken:
                name = f"_{name}"
            taken.add(name.lower())
        out.append(F.col(f"`{c}`").alias(name))
    return df.select(*out)
