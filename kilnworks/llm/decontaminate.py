"""Benchmark decontamination by SimHash of item-sized windows.

Native: SQL functions only. Words are lower-case runs of letters and digits; a shingle is five words (a
shorter item is one shingle). A window as long as an item is laid over a text at every start where enough of
the window's shingles, in whatever order, occur in that item for the similarity to be reached.
Each window and each item has a 64-bit SimHash, every shingle weighing as often as it
occurs. A fingerprint is cut into ``RADIUS + 1`` blocks; two within the radius agree in at least one
block, so joining on (item, block number, block) finds all of them. What is within the radius is
verified by the exact weighted Jaccard similarity of the shingles (sum of smaller counts over sum of
larger counts). The radius is wide, as at a similarity of 0.8 about 10 of 64 bits differ, so blocks of three and four bits
tell little apart; what bounds the pairs is that a window only meets the items it was laid for.

Benchmarks are matched in blocks of items, each broadcast only within a counted size. Null texts and
items, and those without a word, match nothing; rows that repeat give one result; a null id is kept. Copies of
a text are looked at once. A very long text is one row of shingles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.llm.common import prepare, sized, text_key
from kilnworks.llm.shingle_sql import letter_words, with_shingles
from kilnworks.session import durable

SHINGLE, LEAST_PERCENT, RADIUS = 5, 80, 19
#: Shingles of a block of items that is broadcast (a few numbers each).
BLOCK_ROWS = 1_000_000
#: Contaminated texts whose keys are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def _fingerprint(shingles: str):
    """Bit b is set if the shingles with it outweigh those without it."""
    return F.expr(f"""aggregate(sequence(0, 63), 0L, (acc, b) ->
        acc | if(2 * aggregate({shingles}, 0L, (n, h) -> n + (shiftrightunsigned(h, b) & 1L)) > size({shingles}), shiftleft(1L, b), 0L))""")


def _blocks(radius: int):
    """(block number, bits) of a fingerprint; sizes differ by one bit at most."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.explode(F.array(*[F.struct(F.lit(k).alias("block"), F.expr(f"shiftrightunsigned(f, {a}) & {(1 << (b - a)) - 1}L").alias("bits"))
                               for k, (a, b) in enumerate(zip(cuts, cuts[1:]))])).alias("at")


def _first_block(radius: int):
    """The first block in which the fingerprints f and g agree."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.coalesce(*[F.when(F.expr(f"shiftrightunsigned(f ^ g, {a}) & {(1 << (b - a)) - 1}L") == 0, F.lit(k)) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))])


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """item_id, n (words), k (words of its shingles) and s (shingle hashes, in order) of every item."""
    words = benchmark.select(F.col(id_col).alias("item_id"), letter_words(F.col(text_col)).alias("w")).where(F.size("w") > 0).dropDuplicates(["item_id", "w"])
    full = with_shingles(words.where(F.size("w") >= k), "w", k, "s").select("item_id", F.size("w").alias("n"), F.lit(k).alias("k"), "s")
    for short in range(1, k):
        full = full.unionAll(with_shingles(words.where(F.size("w") == short), "w", short, "s").select("item_id", F.lit(short).alias("n"), F.lit(short).alias("k"), "s"))
    return full


def _starts(k: int, percent: int):
    """Starts of windows of n words (of nw) with enough of the places ``at``, each told by its first place."""
    own = f"least(n, nw) - {k - 1}"  # shingles of a window
    need = f"greatest(1, cast(ceil({percent} * (n - {k - 1} + {own}) / {100 + percent}) as int))"
    first = f"greatest(0, get(at, j + {need} - 1) - ({own}) + 1, coalesce(get(at, j - 1) + 1, 0))"
    last = "least(get(at, j), greatest(0, nw - n))"
    return F.expr(f"""if(size(at) < {need}, array(), flatten(transform(sequence(0, greatest(0, size(at) - {need})),
        j -> if({first} <= {last}, sequence({first}, {last}), array()))))""")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = LEAST_PERCENT, radius: int = RADIUS,
          k: int = SHINGLE) -> DataFrame:
    """doc_id, t1, t2 (key of its text), item_id, window_start, shared, total: the best window of each pair.

    ``shared / total`` is the similarity; ties go to the first window.
    """
    prepare(docs.sparkSession)
    items = durable(items_of(benchmark, k=k).withColumn("f", _fingerprint("s")).withColumn("item", F.xxhash64("item_id", "s")))
    places = durable(items.select("item", "n", "k", F.explode("s").alias("h")).distinct())
    n_blocks = max(1, -(-places.count() // BLOCK_ROWS))
    sizes = [r["k"] for r in items.select("k").distinct().collect()]  # at most k numbers
    rows = docs.select(F.col(id_col).alias("doc_id"), *text_key(text_col), F.col(text_col).alias("x"))
    texts = rows.select("t1", "t2", letter_words(F.col("x")).alias("w"))
    windows = None
    for size in sorted(sizes):
        shingled = with_shingles(texts, "w", size, "s").select("t1", "t2", F.size("w").alias("nw"), "s")
        own = places.where(F.col("k") == size).select("item", "n", "h", F.pmod("item", F.lit(n_blocks)).alias("part"))
        for part in range(n_blocks):
            # one row for each shingle of the block's items: at most about BLOCK_ROWS
            known = F.broadcast(own.where(F.col("part") == part).select("item", "n", "h"))
            # the outer form: for the inner one Spark would first test, on the text, whether there is any shingle
            hits = shingled.select("t1", "t2", "nw", F.posexplode_outer("s").alias("p", "h")).join(known, "h")
            # a text's places of an item's shingles are at most as many as its words
            laid = hits.groupBy("t1", "t2", "nw", "n", "item").agg(F.sort_array(F.collect_set("p")).alias("at"))
            found = laid.select("t1", "t2", F.lit(size).alias("k"), "n", "item", _starts(size, percent).alias("starts")).where(F.size("starts") > 0)
            windows = found if windows is None else windows.unionAll(found)
    none = F.lit(None).cast("long")
    if windows is None:
        return rows.where("false").select("doc_id", "t1", "t2", none.alias("item_id"), F.lit(0).alias("window_start"), none.alias("shared"), none.alias("total"))
    windows = durable(windows)
    by_text = windows.groupBy("t1", "t2").agg(F.collect_list(F.struct("k", "n", "item", "starts")).alias("asked"))  # as many as a text has items
    n_windows = windows.agg(F.sum(F.size("starts") + 1)).first()[0] or 0
    asked = by_text.select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), "asked")
    held = rows.select("t1", "t2", "x").join(F.broadcast(asked) if n_windows <= BROADCAST_ROWS else asked, (F.col("t1") == F.col("__t1")) & (F.col("t2") == F.col("__t2")))
    held = durable(held.groupBy("t1", "t2").agg(F.first("x").alias("x"), F.first("asked").alias("asked")))  # a text once, however many copies it has
    best = None
    for size in sorted(sizes):
        one = with_shingles(held.select("t1", "t2", F.filter("asked", lambda a: a["k"] == size).alias("asked"), letter_words(F.col("x")).alias("w")).where(F.size("asked") > 0),
                            "w", size, "s")
        one = one.select("t1", "t2", "s", F.explode("asked").alias("a")).select("t1", "t2", "s", "a.n", "a.item", F.explode("a.starts").alias("start"))
        # the shingles of a window are a slice of those of its text
        one = one.select("t1", "t2", "n", "item", "start", F.slice("s", F.col("start") + 1, F.greatest(F.lit(1), F.col("n") - (size - 1))).alias("s"))
        one = one.withColumn("f", _fingerprint("s")).withColumn("at", _blocks(radius)).select("*", "at.block", "at.bits").drop("at")
        of = (items.where(F.col("k") == size).select("n", "item", "item_id", F.col("f").alias("g"), F.col("s").alias("si"), F.col("f"), _blocks(radius))
              .select("n", "item", "item_id", "g", "si", "at.block", "at.bits"))
        of = F.broadcast(of) if of.limit(BLOCK_ROWS + 1).count() <= BLOCK_ROWS else of
        near = one.join(of, ["n", "item", "block", "bits"])
        # of the blocks in which two fingerprints agree the first one speaks for the pair
        agree = F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= radius
        near = near.where(agree & (F.col("block") == _first_block(radius))).select("t1", "t2", "item", "item_id", "start", "s", "si")
        # distinct shingles on both sides meet by hash; only those that occur more than once are counted
        shared = F.expr("""if(size(array_distinct(s)) = size(s) and size(array_distinct(si)) = size(si), cast(size(array_intersect(s, si)) as bigint),
            aggregate(array_intersect(s, si), 0L, (a, h) -> a + least(size(filter(s, y -> y = h)), size(filter(si, y -> y = h)))))""")
        same = near.withColumn("shared", shared).withColumn("total", F.size("s") + F.size("si") - F.col("shared")).where(100 * F.col("shared") >= percent * F.col("total"))
        rank = F.struct((F.col("shared") / F.col("total")).alias("share"), (-F.col("start")).alias("first"), "shared", "total")
        part = same.groupBy("t1", "t2", "item").agg(F.first("item_id").alias("item_id"), F.max(rank).alias("b"))
        best = part if best is None else best.unionAll(part)
    best = durable(best.select("t1", "t2", "item_id", (-F.col("b.first")).alias("window_start"), F.col("b.shared").alias("shared"), F.col("b.total").alias("total")))
    return rows.select("doc_id", "t1", "t2").distinct().join(sized(best), ["t1", "t2"]).select("doc_id", "t1", "t2", "item_id", "window_start", "shared", "total")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Rows whose text holds no benchmark item, with all their columns."""
    found = durable(leaks(docs.select(F.lit(0).cast("long").alias("doc_id"), text_col), benchmark, text_col=text_col, **options).select("t1", "t2").distinct())
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    found = found.select(F.col("t1").alias("__leak1"), F.col("t2").alias("__leak2"))
    key1, key2 = text_key(text_col)
    return docs.join(found, (key1 == F.col("__leak1")) & (key2 == F.col("__leak2")), "left_anti")
