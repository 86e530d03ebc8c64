"""A training corpus in five stages, each written and read again.

toxicity (texts that the positive-unlabelled scorer marks at 0.7 go), line dedup (later copies of
repeated runs of at least 50 words go, and documents that are nothing but such copies), near duplicates
(one document of each group of similarity 0.8 over five-word shingles stays), benchmark
decontamination (documents that hold a benchmark item go) and packing (pieces of at most 2048 ids).

Null and empty texts pass all filters and are packed as their end id alone; ``n_chars`` follows the
text where lines went. Extra columns pass through until the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnworks.llm import decontaminate, linedup, minhash, packing
from kilnworks.llm import toxicity as pu
from kilnworks.llm.common import read
from kilnworks.session import scratch_path

#: Scores of a fitted model have no counterpart in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pu.without_toxic(docs, pu.fit(docs, read(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = linedup.dedup_lines(docs)
    emptied = F.col("line_starts").isNotNull() & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    shorter = F.when(F.col("line_starts").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    left = rows.where(~emptied).withColumn("n_chars", shorter).drop("line_starts", "line_ends")
    return left.toDF(*docs.columns)  # columns of documents that bear these names come back under them


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is a table in the shared folder before the next one starts."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
