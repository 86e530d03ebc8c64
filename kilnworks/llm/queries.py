"""The corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnworks.llm import bytededup, decontaminate, langid, lexical, licences, linedup, minhash, mixing, oracles, packing, phrases, quality, toxicity, wavelet
from kilnworks.llm.common import read
from kilnworks.session import scratch_path

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def wrap(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@_query("op4_wavelet_tokens")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, written as wavelet matrices and read back."""
    docs = read(spark, sf_dir, "documents")
    path = scratch_path(spark, "wavelet")
    wavelet.write_shards(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return wavelet.document_digests(spark, path)


@_query("op8_vector_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens."""
    return packing.pack_texts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


@_query("op8_instruction_packing")
def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation whole, in sequences within limits on tokens, segments and learned tokens."""
    examples = packing.conversation_examples(read(spark, sf_dir, "conversations"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack_examples(examples, "id", "n_tokens", "n_loss", capacity=5120, max_segments=6, max_loss=4096)


@_query("op5_toxicity_pu")
def toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return (toxicity.score(docs, scorer).withColumn("held_out", toxicity.held_out())
            .select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted")))


@_query("op6_kneser_ney_langid")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    docs = read(spark, sf_dir, "documents")
    rows = langid.identify(docs, toxicity.in_training())
    return rows.select("doc_id", (~F.col("in_training")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


@_query("op7_minhash_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


@_query("op2_licence_scan", oracles.licences())
def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's best licence notice."""
    return licences.scan(read(spark, sf_dir, "documents"))


@_query("op3_quality_rules", oracles.quality(quality.MAX_DOCUMENTS, quality.LEAST_WORDS, quality.LEAST_PERCENT))
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    return quality.judge(read(spark, sf_dir, "documents"))


@_query("op9_simhash_decontamination", oracles.leaked())
def leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    found = decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("window_start").cast("long").alias("window_start"), "shared", "total")


@_query("op1_line_dedup", oracles.deduplicated_lines(linedup.LEAST_WORDS))
def deduplicated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's deleted lines, and what is left of it."""
    rows = linedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate(F.zip_with("line_starts", "line_ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda n, x: n + x)
    return rows.select("doc_id", F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"), F.md5("text").alias("kept_md5"))


@_query("op10_suffix_merge_dedup")
def without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's repeated bytes, and what is left of it."""
    rows = bytededup.removed_bytes(read(spark, sf_dir, "documents"))
    sizes = F.zip_with("starts", "ends", lambda a, b: b - a)
    return rows.select("doc_id", "n_bytes", F.aggregate(sizes, F.lit(0).cast("long"), lambda n, x: n + x).alias("n_removed"),
                       F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "elsewhere")


@_query("op11_pivotal_mix")
def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often every document is taken for the mix."""
    return mixing.mix(read(spark, sf_dir, "documents"))


@_query("op12_quotient_phrases", oracles.phrases(phrases.LEAST, phrases.COVER, phrases.TOP))
def collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language's strongest phrases."""
    return phrases.mine(read(spark, sf_dir, "documents"))


@_query("op13_norm_bucket_search", oracles.searched(lexical.TOP))
def ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's best documents."""
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
