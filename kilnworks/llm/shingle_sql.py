"""Word shingles with SQL functions alone, as arrays of 64-bit hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_LETTERS = r"[^\p{L}\p{N}]+"


def letter_words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_LETTERS), lambda w: w != "")


def with_shingles(df: DataFrame, words: str, k: int, out: str) -> DataFrame:
    """Add the hashes of the k-word shingles of an array of words, in order; none if it is shorter.

    Hashes of m and n neighbouring words give those of m + n, so k words take log k passes.
    """
    hashed = {1: f"{out}_1"}
    df = df.withColumn(hashed[1], F.transform(words, lambda w: F.xxhash64(w)))
    widths, size, rest = [], 1, k
    while 2 * size <= k:
        widths.append((size, size))
        size *= 2
    have, rest = size, k - size
    while rest:
        step = 1 << (rest.bit_length() - 1)
        widths.append((have, step))
        have, rest = have + step, rest - step
    for a, b in widths:
        hashed[a + b] = f"{out}_{a + b}"
        n = F.greatest(F.size(hashed[1]) - (a + b - 1), F.lit(0))
        df = df.withColumn(hashed[a + b], F.zip_with(F.slice(hashed[a], 1, n), F.slice(hashed[b], a + 1, n), lambda x, y: F.xxhash64(x, y)))
    return df.withColumn(out, F.col(hashed[k])).drop(*[c for w, c in hashed.items()])
