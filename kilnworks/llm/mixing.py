"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a share of the mix by its weight, at most ``most`` times its own words; what is
above is shared again by weight until no source is above. A document is then expected
``target / source words`` times. The whole part of that number is taken for sure; the fractions
are rounded by the pivotal method: two documents pass words from one to the other, by chance and
without bias, until one of them is taken or not. A pass moves words, not copies, so the words
that a source expects are kept whatever the sizes.

Documents are paired in blocks of about ``UNITS``, from the longest to the shortest, so that what a
block leaves over tends to be short. Each block leaves at most one open document; those of ``UNITS``
blocks meet in the next level, until a source has one, which falls by chance. A source thus misses
its target by less than that document's words. A source with a third of all rows is as many blocks
as it needs. Chance comes from the seed, the level and the block, and blocks from a hash of
the row, so reruns agree on any cluster.

Null texts have no words; their rows and those of a source without words are taken zero times (``taken`` counts
words). A null source is a source of its own and stands last. Rows that repeat (id, source and text) are one
unit: of n rows that expect p each, floor(n * p) are taken and the rest of the fraction is rounded once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.llm.common import numbered, prepare, sized
from kilnworks.session import durable

WEIGHTS, PERCENT, MOST, SEED = (5, 2, 1), 150, 2, 20240611
#: Documents of a block, and blocks whose open documents meet in one group of the next level.
UNITS = 2048
_ROWS = 1 << 12


def count_words(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``s``, the place of each in code point order (null last), without a global window over them."""
    order = F.col("source").asc_nulls_last()
    return numbered(sources.repartitionByRange(order).sortWithinPartitions(order), "s")


def targets(sources: DataFrame, weights=WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """source, source_size, s, weight and target of every row of ``sources`` (source, source_size).

    Sources at their cap leave and the level of the others rises, round by round; only sums come to the driver.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("s", F.lit(len(weights))) + 1).cast("int"))
    rows = durable(ranked(sources).withColumns({"weight": weight, "cap": F.col("source_size") * most}))
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, n_full = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > F.col("cap")
        r = rows.agg(F.count(F.when(full, 1)).alias("n"), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)).alias("caps"),
                     F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("w")).first()
        if r.n == n_full or not r.w:
            target = F.when(full, F.col("cap").cast("double")).otherwise(F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double")))
            return rows.select("source", "source_size", "s", "weight", target.alias("target"))
        level, n_full = (percent * total / 100 - r.caps) / r.w, r.n


def pivotal(sizes: np.ndarray, parts: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """``parts`` rounded in pairs from front to back: all are 0 or 1 but for at most one; the sum of sizes * parts is kept."""
    out, size, u = parts.tolist(), sizes.tolist(), chance.tolist()
    a = -1
    for b, x in enumerate(out):
        if x <= 0.0 or x >= 1.0:
            continue
        if a < 0:
            a = b
            continue
        xa, sa, sb = out[a], size[a], size[b]
        up, down = min((1.0 - xa) * sa, x * sb), min(xa * sa, (1.0 - x) * sb)
        if u[b] * (up + down) < down:  # words pass from b to a
            xa, x = (1.0, x - up / sb) if (1.0 - xa) * sa <= x * sb else (xa + up / sa, 0.0)
        else:
            xa, x = (0.0, x + down / sb) if xa * sa <= (1.0 - x) * sb else (xa - down / sa, 1.0)
        out[a], out[b] = (0.0 if y < 1e-12 else 1.0 if y > 1 - 1e-12 else y for y in (xa, x))
        a = a if 0.0 < out[a] < 1.0 else b if 0.0 < out[b] < 1.0 else -1
    return np.array(out, dtype=float)


def _level(rows: DataFrame, level: int, seed: int) -> DataFrame:
    def settle(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "h", "doc_id", "t"], ascending=[False, True, True, True], kind="stable", na_position="first")
        chance = np.random.default_rng((seed, level, int(key[0]), int(key[1]))).random(len(group))
        return group.assign(part=pivotal(group["size"].to_numpy(float), group["part"].to_numpy(float), chance))

    return durable(rows.groupBy("s", "block").applyInPandas(settle, rows.schema))


def _units(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("\x00null")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), count_words(text_col).alias("size"), text.alias("t"))
    return rows.groupBy("doc_id", "source", "size", "t").agg(F.count("*").alias("n"))


def mix_units(docs: DataFrame, weights=WEIGHTS, percent: int = PERCENT, most: int = MOST, seed: int = SEED, id_col: str = "doc_id",
              source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, size, t (text hash), n (rows), source_size, target, base, extra: of the n rows ``extra`` are taken base + 1 times, the others base times."""
    prepare(docs.sparkSession)
    units = durable(_units(docs, id_col, source_col, text_col))
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units"))
    shares = targets(totals.select("source", "source_size"), weights, percent, most).withColumnRenamed("source", "src")
    shares = durable(shares.join(totals.select(F.col("source").alias("src2"), "units"), F.col("src").eqNullSafe(F.col("src2")))
                     .withColumn("blocks", F.ceil(F.col("units") / UNITS)).drop("src2", "units"))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = units.join(sized(shares), F.col("source").eqNullSafe(F.col("src"))).drop("src").withColumn("base", F.floor(times)).withColumn(
        "part", F.col("n") * (times - F.col("base")))
    rows = rows.withColumn("ones", F.when(F.col("size") > 0, F.floor(F.col("part") + 1e-9)).otherwise(0)).withColumn("h", F.xxhash64("doc_id", "t"))
    rows = rows.withColumn("part", F.when(F.col("size") > 0, F.greatest(F.col("part") - F.col("ones"), F.lit(0.0))).otherwise(0.0))
    rows = durable(rows.withColumn("block", F.pmod("h", "blocks")).drop("blocks", "weight"))
    blocks = shares.agg(F.max("blocks")).first()[0] or 0
    is_open = (F.col("part") > 0) & (F.col("part") < 1)
    done, left, level = [rows.where(~is_open)], rows.where(is_open), 0
    while blocks:
        after = _level(left, level, seed)
        done.append(after.where(~is_open))
        left, level = after.where(is_open).withColumn("block", F.floor(F.col("block") / UNITS)), level + 1
        blocks = 0 if blocks == 1 else -(-blocks // UNITS)
    chance = F.pmod(F.xxhash64(F.lit(seed), "s", "h"), F.lit(1 << 30)) / float(1 << 30)
    done.append(left.withColumn("part", F.when(chance < F.col("part"), 1.0).otherwise(0.0)))  # at most one document of a source
    whole = done[0]
    for rows in done[1:]:
        whole = whole.unionByName(rows)
    return whole.withColumn("extra", F.col("ones") + F.col("part").cast("long")).select("doc_id", "source", "size", "t", "n", "source_size", "target", "base", "extra")


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row of ``docs``."""
    rows = mix_units(docs, **how)
    high = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _ROWS)))
    low = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(_ROWS - 1), F.col("n") - 1 - F.col("high") * _ROWS)))
    each = rows.withColumn("high", high).withColumn("low", low)
    copies = F.col("base") + F.when(F.col("high") * _ROWS + F.col("low") < F.col("extra"), 1).otherwise(0)
    return (each.withColumn("copies", copies.cast("long"))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken, numbered by ``mix_copy``.

    Rows that agree in id, source and text are given by one of them; an input column ``mix_copy`` gives way.
    """
    rows = mix_units(docs, id_col=id_col, source_col=source_col, text_col=text_col, **how)
    times = rows.select(F.struct("doc_id", "source", "t").alias("__k"), (F.col("n") * F.col("base") + F.col("extra")).alias("__n")).where("__n > 0")
    key = F.struct(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                   F.xxhash64(F.coalesce(F.col(text_col), F.lit("\x00null"))).alias("t"))
    own = docs.withColumn("__k0", key).dropDuplicates(["__k0"])
    joined = own.join(times, F.col("__k0").eqNullSafe(F.col("__k"))).withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return joined.drop("__k0", "__k", "__n")
