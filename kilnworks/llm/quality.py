"""Quality rules: counts of each text, and lines that many documents of a host share.

Native: SQL functions only. A line is normalised (lower case, white space collapsed), hashed, and
counted in the distinct documents of its host that contain it: a text's lines are counted once for
the text and weighted by its documents, so copies count without being laid out line by line. Rows that agree in id and
text are one document. Lines in more than ``max_documents`` documents of a host count as removed. A document is depleted if fewer than
``least_words`` words, or less than ``least_percent`` percent of its words, are left.

Null or empty texts have no word and fail the base rules; rows that repeat get equal results; a null
host is a host of its own. Lines without a word are left alone. A very long text is one row: its counts take memory in proportion to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnworks.llm.common import WORDS, prepare, sized, text_key, words
from kilnworks.llm.shingle_sql import with_shingles
from kilnworks.session import durable

MAX_DOCUMENTS, LEAST_WORDS, LEAST_PERCENT = 100, 20, 30
WINDOW = 8


def repeated_words(df: DataFrame, words_col: str, out: str, size: int = WINDOW) -> DataFrame:
    """Words in windows that occur twice or more in the same text, each counted once."""
    df = with_shingles(df, words_col, size, "q_w")
    df = df.withColumn("q_dup", F.size("q_w") != F.size(F.array_distinct("q_w")))
    df = df.withColumn("q_s", F.when(F.col("q_dup"), F.sort_array(F.transform("q_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = F.expr("""sort_array(transform(filter(q_s, (s, j) -> (j > 0 and s.h = coalesce(get(q_s, j - 1).h, ~s.h))
                     or s.h = coalesce(get(q_s, j + 1).h, ~s.h)), s -> s.i))""")
    df = df.withColumn("q_p", F.when(F.col("q_dup"), same))
    covered = F.expr(f"aggregate(transform(q_p, (p, j) -> least({size}, coalesce(get(q_p, j + 1), p + {size}) - p)), 0L, (a, x) -> a + x)")
    return df.withColumn(out, F.when(F.col("q_dup"), covered).otherwise(F.lit(0)).cast("long")).drop("q_w", "q_dup", "q_s", "q_p")


def _lines(text: str) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def base_counts(docs: DataFrame) -> DataFrame:
    """The counts of every row of ``docs`` (doc_id, host, text), beside its keys."""
    df = docs.select("doc_id", "host", "text", *text_key()).withColumn("w", words("text"))
    df = df.withColumn("lines", _lines("text"))
    df = df.select("doc_id", "host", "t1", "t2", "w", F.size("w").cast("long").alias("n_words"),
                   F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                   F.coalesce(F.regexp_count("text", F.lit("[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
                   (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    return repeated_words(df, "w", "n_repeat_words").drop("w")


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_documents: int = MAX_DOCUMENTS,
          least_words: int = LEAST_WORDS, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """Counts, removed_lines, removed_words, base_failed and kept of every row."""
    prepare(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("\x00null")).alias("host"), F.col(text_col).alias("text"))
    line = F.trim(F.regexp_replace(F.lower(F.col("l")), WORDS, " "))
    # the outer form: for the inner one Spark would first test, on the text, whether there is any line
    each = (own.select("host", *text_key(), F.explode_outer(_lines("text")).alias("l")).where("l IS NOT NULL").withColumn("l", line)
            .select("host", "t1", "t2", F.xxhash64("l").alias("h"), (F.length("l") - F.length(F.replace("l", F.lit(" "), F.lit(""))) + 1).alias("n")))
    texts = durable(each.groupBy("host", "t1", "t2", "h").agg(F.first("n").cast("long").alias("n"), F.count("*").alias("times")))
    # rows that repeat a text repeat its lines: how often is known from the copies
    copies = durable(own.select("host", "doc_id", *text_key()).groupBy("host", "t1", "t2", "doc_id").agg(F.count("*").alias("rows"))
                     .groupBy("host", "t1", "t2").agg(F.sum("rows").alias("copies"), F.count("*").alias("documents")))
    several = copies.where("documents > 1").select("host", "t1", "t2", "documents")
    weighted = texts.select("host", "t1", "t2", "h").join(sized(several), ["host", "t1", "t2"], "left")
    common = durable(weighted.groupBy("host", "h").agg(F.sum(F.coalesce("documents", F.lit(1))).alias("documents"))
                     .where(F.col("documents") > max_documents).select("host", "h"))
    removed = (texts.join(common, ["host", "h"]).groupBy("host", "t1", "t2").agg(F.sum("times").alias("lines"), F.sum(F.col("n") * F.col("times")).alias("words"))
               .join(copies, ["host", "t1", "t2"])
               .select("host", "t1", "t2", F.expr("lines div copies").alias("removed_lines"), F.expr("words div copies").alias("removed_words")))
    rows = base_counts(own).join(removed, ["host", "t1", "t2"], "left").fillna(0, ["removed_lines", "removed_words"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (left < least_words) | (100 * left < least_percent * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                       (~failed & ~depleted).alias("kept"), "removed_lines", "removed_words")
