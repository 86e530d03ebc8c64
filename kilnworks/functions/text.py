"""Text keys and hashed word vectors from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 256


def job_key(c: Column) -> Column:
    """File-safe form of a reference with the first ten hex digits of its sha256."""
    readable = F.btrim(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))
    readable = F.when(readable == "", "job").otherwise(readable)
    return F.concat(readable, F.lit("-"), F.substring(F.sha2(c.cast("binary"), 256), 1, 10))


def hashed_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bucket, weight): word counts hashed by md5 into 256 buckets, scaled to unit length.

    The vector stays in sparse rows; words are counted before anything is grouped
    by document.
    """
    # The characters the split treats as white space.
    blank = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    words = F.filter(F.split(F.lower(F.col(text)), blank), lambda w: w != "")
    each = df.select(key, F.explode(words).alias("w"))
    bucket = F.conv(F.substring(F.md5(F.col("w").cast("binary")), 31, 2), 16, 10).cast("int")
    counts = each.groupBy(key, bucket.alias("bucket")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))  # at most 256 rows
    return counts.select(key, "bucket", (F.col("n") / norm).alias("weight"))
