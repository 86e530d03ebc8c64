"""Building blocks that stay exact when one key holds a large share of the rows.

A running total, a global rank or an exact percentile written as one window
sends a whole key (or the whole table) through one task. Here the order is cut
into levels, as in a radix sort: each level has a bounded number of values below
its parent, so every window partition is bounded however large a key grows, and
the totals of the earlier siblings on each level add up to the exact prefix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join on same-named keys in which null matches null."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = None
    for k in keys:
        part = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = part if cond is None else cond & part
    joined = left.join(renamed, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*[f"__r_{k}" for k in keys])


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate as scalar subqueries."""
    names = one_row.columns
    packed = one_row.select(F.struct(*names).alias("s")).scalar()
    return df.withColumns({n: packed.getField(n) for n in names})


def with_group_totals(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Group totals beside every row: aggregate (combined map-side) and join back."""
    totals = df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()])
    return join_on(df, totals, list(keys))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                rank_name: str = "rn") -> DataFrame:
    """First k rows per key. Spark limits each key to k rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(w)).filter(F.col(rank_name) <= k)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ordering per key, as a combinable aggregate."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.max(F.struct(*order, *rest)).alias("__last")
    return df.groupBy(*keys).agg(packed).select(*keys, "__last.*").select(*df.columns)


# --- order levels -----------------------------------------------------------
def integer_levels(c: Column) -> list[Column]:
    """Two levels for ids: blocks of 2^20, then the id."""
    c = c.cast("bigint")
    return [F.floor(c / F.lit(2**20)), c]


def text_levels(c: Column) -> list[Column]:
    """Two levels for a text id in (md5, id) order: 65,536 even blocks, then the id."""
    digest = F.md5(c.cast("string").cast("binary"))
    return [F.substring(digest, 1, 4), F.concat(digest, c.cast("string"))]


def real_levels(c: Column) -> list[Column]:
    """Three levels for a double: exponent and 1024 steps within it, 2^21 steps within those, the value.

    Each level is a non-decreasing function of the value, as the steps are those of the
    number's own binary form, so values crowd no cell however small or close they are: at
    most 2^21 distinct values lie below a cell. Equal values share a cell, so copies of one
    value add nothing. Minus zero counts as zero; an infinity is the outermost cell.
    """
    c = c.cast("double")
    c = F.when(c == 0, F.lit(0.0)).otherwise(c)
    size = F.least(F.abs(c), F.lit(1.7976931348623157e308))
    exponent = F.greatest(F.floor(F.log2(F.greatest(size, F.lit(5e-324)))), F.lit(-1074)).cast("int")
    half = (-exponent / 2).cast("int")  # two factors, as 2^1074 is beyond the largest double
    steps = (size * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), -exponent - half) - 1) * F.lit(1024.0)
    coarse = F.floor(steps)
    fine = F.floor((steps - coarse) * F.lit(2.0**21))
    sign = F.signum(c).cast("bigint")
    return [sign * ((exponent.cast("bigint") + 1100) * 1026 + coarse + 1), sign * fine, c]


def ordered_text_levels(df: DataFrame, c: Column, width: int = 3, most: int = 6) -> list[Column]:
    """Levels for a text in its own order: steps of three characters behind what all values share, then the text.

    How much is shared follows from the smallest and the largest value.
    """
    c = c.cast("string")
    ends = df.agg(F.min(c).alias("a"), F.max(c).alias("b"), F.max(F.length(c)).alias("n")).first()
    a, b, longest = ends["a"] or "", ends["b"] or "", ends["n"] or 0
    same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    steps = min(most, max(0, -(-(longest - same) // width) - 1))
    return [*[F.coalesce(F.substring(c, same + 1 + k * width, width), F.lit("")) for k in range(steps)], c]


def id_levels(df: DataFrame, name: str) -> list[Column]:
    """Levels of an id column in its own order: blocks for whole numbers, characters for anything else."""
    if isinstance(df.schema[name].dataType, T.IntegralType):
        return integer_levels(F.col(name))
    return ordered_text_levels(df, F.col(name))


def instant_levels(c: Column) -> list[Column]:
    """Two levels for an instant: blocks of a thousand seconds, then the microsecond."""
    micros = F.unix_micros(c.cast("timestamp"))
    return [F.floor(micros / F.lit(1_000_000_000)), micros]


def prefix_sums(df: DataFrame, keys: Sequence[str], levels: Sequence[Column],
                measures: dict[str, Column], totals: bool = False) -> DataFrame:
    """Per distinct (keys, levels) cell: each measure and its sum over all earlier cells.

    Output columns: keys, ``_l0.._ln``, ``<measure>`` (the cell's own total) and
    ``<measure>_before``, with ``totals`` also ``<measure>_total``, the sum over the key. ``measures`` are
    row expressions; rows are summed into cells before anything is ordered.
    """
    names = [f"_l{i}" for i in range(len(levels))]
    tagged = df.select(*keys, *[lv.alias(n) for lv, n in zip(levels, names)],
                       *[e.alias(m) for m, e in measures.items()])
    cells = tagged.groupBy(*keys, *names).agg(*[F.sum(m).alias(m) for m in measures])
    return _prefix_of_cells(cells, list(keys), names, list(measures), totals)


def _prefix_of_cells(cells: DataFrame, keys: list[str], names: list[str],
                     measures: list[str], totals: bool = False) -> DataFrame:
    offsets: DataFrame | None = None
    for depth in range(1, len(names) + 1):
        upto = names[:depth]
        total = cells if depth == len(names) else (
            cells.groupBy(*keys, *upto).agg(*[F.sum(m).alias(m) for m in measures]))
        parent = keys + upto[:-1]
        w = (Window.partitionBy(*parent) if parent else Window.partitionBy()) \
            .orderBy(upto[-1]).rowsBetween(Window.unboundedPreceding, -1)
        level = total.withColumns({f"{m}_before": F.coalesce(F.sum(m).over(w), F.lit(0))
                                   for m in measures})
        sums = [f"{m}_total" for m in measures] if totals else []
        if depth == 1 and totals:  # of the first level's few cells; they go down with the offsets
            level = level.withColumns({t: F.sum(m).over(Window.partitionBy(*keys)) for m, t in zip(measures, sums)})
        if offsets is not None:
            up = offsets.select(*parent, *[F.col(f"{m}_before").alias(f"{m}_up") for m in measures], *sums)
            level = join_on(level, up, parent, "inner")
            level = level.withColumns({f"{m}_before": F.col(f"{m}_before") + F.col(f"{m}_up")
                                       for m in measures}).drop(*[f"{m}_up" for m in measures])
        offsets = level
    return offsets


#: Rows of a key up to which its order is told by one sorted window.
WINDOW_ROWS = 100_000


def rank_within(df: DataFrame, key: str, order: dict[str, Column], name: str) -> DataFrame:
    """Rows with a key, and ``name``: one more than the rows of the same key that stand before it in ``order``; ties share a rank.

    Each row is shuffled once, by its key; what it is ordered by is worked out behind the shuffle. Keys of more than
    ``WINDOW_ROWS`` rows are ranked in levels by :func:`prefix_sums`, so ``order`` must have levels as that needs them.
    """
    rows = df.filter(F.col(key).isNotNull())
    crowded = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > WINDOW_ROWS).select(key)

    def in_window(part: DataFrame) -> DataFrame:
        w = Window.partitionBy(key).orderBy(*order)
        return part.repartition(key).withColumns(order).withColumn(name, F.rank().over(w).cast("bigint")).drop(*order)

    if crowded.isEmpty():
        return in_window(rows)
    crowded = F.broadcast(crowded)  # at most one key for each WINDOW_ROWS rows
    many = rows.join(crowded, key, "left_semi").withColumns(order)
    before = prefix_sums(many, [key], [F.col(c) for c in order], {"rows": F.lit(1)}).select(
        key, *[F.col(f"_l{i}").alias(c) for i, c in enumerate(order)], (F.col("rows_before") + 1).cast("bigint").alias(name))
    return in_window(rows.join(crowded, key, "left_anti")).unionByName(join_on(many, before, [key, *order], "inner").drop(*order))


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str,
                    probs: dict[str, float], weight: str | None = None) -> DataFrame:
    """Linear-interpolated exact quantiles per group (or over all rows when no group).

    ``weight`` holds how many rows a row stands for.

    Values are counted first, the counts ranked with :func:`prefix_sums`, and the
    two neighbours of each position picked by rank, so no task holds a group.
    """
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v)).select(*groups, v.alias("__v"), (F.lit(1) if weight is None else F.col(weight)).alias("__w"))
    levels = real_levels(F.col("__v"))
    ranked = prefix_sums(rows, groups, levels, {"n": F.col("__w")}, totals=True)
    return quantiles_of_ranked(ranked.withColumnRenamed(f"_l{len(levels) - 1}", "__v"), groups, probs)


def quantiles_of_ranked(ranked: DataFrame, groups: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per group of ranked cells: groups, ``__v``, ``n`` (rows), ``n_before`` and ``n_total``.

    The total stands beside each cell, so the cells of a group never meet in one task.
    """
    ranked = ranked.withColumn("__total", F.col("n_total"))
    picks = []
    for name, p in probs.items():
        pos = (F.col("__total") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            inside = (F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n"))
            picks.append(F.max(F.when(inside, F.col("__v"))).alias(f"__{name}_{side}"))
    picked = ranked.groupBy(*groups).agg(F.max("__total").alias("__total"), *picks)
    out = []
    for name, p in probs.items():
        pos = (F.col("__total") - 1) * F.lit(float(p))
        frac = pos - F.floor(pos)
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        out.append((lo + (hi - lo) * frac).alias(name))
    return picked.select(*groups, *out)


def group_and_overall(df: DataFrame, key: str, overall: str = "_global") -> DataFrame:
    """Every row once under its key and once under ``overall``, ready to aggregate."""
    return df.withColumn(key, F.explode(F.array(F.col(key).cast("string"), F.lit(overall))))
