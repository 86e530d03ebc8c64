"""Toxicity by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts (P) and texts whose label is hidden (U). With the class prior pi,
the risk of a scorer is ``pi R_P(+) + max(0, R_U(-) - pi R_P(-))``: what toxic texts hide among U is
taken out of the negative part, which is kept from going below zero by stepping back along it. The
loss is logistic, so the sigmoid of a linear scorer estimates the probability of the toxic class.

Features are the distinct words of a whole text, lower case, and the distinct beginnings of words of
four to six characters (marked by an asterisk), which inflected forms share. Feature counts cover all rows of both
samples and are made on the executors; features that are more frequent in P by ``LEAST_Z`` standard errors
enter the model, all of them (at least ``LEAST_WORDS``). Both samples are bounded: the ``MAX_POSITIVE`` confirmed and
``MAX_UNLABELLED`` labelled rows with the smallest hashed ids; the prior counts all labelled rows.

Null or empty texts have no word and get the score of the bias alone. Labels that are null are left
out, an id labelled twice is toxic if one row says so, a text that repeats counts each time. Without
a confirmed toxic text (or without any text) the score is 0 everywhere. A very long text is scored by its
distinct words, as any other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnworks.llm.common import prepare, tidy
from kilnworks.session import durable

MAX_POSITIVE, MAX_UNLABELLED = 8_000, 16_000
LEAST_Z, LEAST_WORDS, REMEMBERED = 4.0, 8, 100_000
STEMS = (4, 5, 6)
_WORD = re.compile(r"[^\W_]+")


def in_training(doc_id: str = "doc_id") -> Column:
    """Rows that labels may be learned from; a null id counts as empty."""
    return ~held_out(doc_id)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def of_word(word: str) -> list[str]:
    return [word, *[f"{word[:k]}*" for k in STEMS if len(word) >= k]]


def features(text: str | None) -> list[str]:
    return sorted({f for w in set(_WORD.findall(text.lower())) for f in of_word(w)}) if text else []


@dataclass
class Scorer:
    prior: float = 0.0
    bias: float = -np.inf
    weights: dict[str, float] = field(default_factory=dict)
    seen: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def _weighted(self, words: set[str]) -> set[str]:
        """Weighted features of words; which of them a word has is remembered."""
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        found: set[str] = set()
        for w in words:
            own = self.seen.get(w)
            if own is None:
                own = self.seen[w] = tuple(f for f in of_word(w) if f in self.weights)
            if own:
                found.update(own)
        return found

    def score(self, text: str | None) -> float:
        found = self._weighted(set(_WORD.findall(text.lower()))) if text else ()
        z = self.bias + sum(sorted(self.weights[w] for w in found))
        return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0


class Rows:
    """0/1 rows, as the places of the ones."""

    def __init__(self, places: list[np.ndarray]):
        self.n = len(places)
        self.sizes = np.array([len(p) for p in places], dtype=np.int64)
        self.places = np.concatenate([*places, np.empty(0, dtype=np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), self.sizes)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.places], minlength=self.n)

    def gradient(self, by_row: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.places, weights=by_row[self.row], minlength=width)


def nn_pu(p: Rows, u: Rows, width: int, prior: float, steps: int = 600, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk (Adam over both whole samples)."""
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    with np.errstate(over="ignore"):
        for t in range(1, steps + 1):
            zp, zu = p.times(w[:-1]) + w[-1], u.times(w[:-1]) + w[-1]
            sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            to_p, to_u = prior * (sp - 1) / p.n, su / u.n
            of_p = -prior * sp / p.n
            if negative >= 0:
                by_p, by_u = to_p + of_p, to_u
            else:  # the non-negative correction: step back along the negative part
                by_p, by_u = -of_p, -to_u
            g = np.append(p.gradient(by_p, width) + u.gradient(by_u, width), by_p.sum() + by_u.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Scorer:
    """Learn from the rows that ``in_training`` allows."""
    prepare(docs.sparkSession)
    known = (labels.select(F.col(id_col).alias("d"), F.col(label_col).cast("int").alias("y")).where(F.col("d").isNotNull() & F.col("y").isNotNull())
             .where(in_training("d")).groupBy("d").agg(F.max("y").alias("y")))
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n_toxic:
        return Scorer()
    prior = min(max(n_toxic / n, 1e-4), 1 - 1e-4)
    order = F.xxhash64("d")
    role = lambda rows, most, is_p: rows.orderBy(order, "d").limit(most).select("d", F.lit(is_p).alias("p"))
    # at most max_positive + max_unlabelled ids
    chosen = F.broadcast(role(known.where("y = 1"), max_positive, 1).unionAll(role(known, max_unlabelled, 0)))
    texts = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("x")).join(chosen, "d").select("p", "x")

    def distinct_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["p", "words"])

    sample = durable(texts.mapInArrow(tidy(distinct_features), "p int, words array<string>"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            both = [(w, held[1][w], held[0][w]) for w in held[0].keys() | held[1].keys()]
            held[0].clear(), held[1].clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*both), (pa.string(), pa.int64(), pa.int64()))], names=["w", "np", "nu"])

        for batch in batches:
            for p, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[p].update(found)
            if len(held[0]) + len(held[1]) > 100_000:
                yield flush()
        if held[0] or held[1]:
            yield flush()

    sizes = {r["p"]: r["n"] for r in sample.groupBy("p").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Scorer()
    counts = sample.mapInArrow(tidy(counted), "w string, np long, nu long").groupBy("w").agg(F.sum("np").alias("np"), F.sum("nu").alias("nu"))
    a, b = F.col("np") / sizes[1], F.col("nu") / sizes[0]
    pooled = (F.col("np") + F.col("nu") + 1) / (sizes[1] + sizes[0] + 2)
    z = F.round((a - b) / F.sqrt(pooled * (1 - pooled) * (1 / sizes[1] + 1 / sizes[0])), 9)
    ranked = durable(counts.withColumn("z", z).where(F.col("np") > 0).select("w", "z"))
    # as many as the bounded sample tells apart
    vocabulary = sorted({r["w"] for r in ranked.where(F.col("z") >= LEAST_Z).select("w").unionAll(
        ranked.orderBy(F.col("z").desc(), "w").limit(LEAST_WORDS).select("w")).collect()})
    place = {w: k for k, w in enumerate(vocabulary)}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.array([place[w] for w in found if w in place], dtype="<u4").tobytes() for found in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(own, pa.binary())], names=["p", "k"])

    # the bounded sample, as four bytes for each feature of a text
    rows = sorted((r["p"], bytes(r["k"])) for r in sample.mapInArrow(tidy(places), "p int, k binary").collect())
    x = {role: Rows([np.frombuffer(k, dtype="<u4") for p, k in rows if p == role]) for role in (0, 1)}
    w, bias = nn_pu(x[1], x[0], len(vocabulary), prior)
    return Scorer(prior, bias, {word: float(v) for word, v in zip(vocabulary, w) if abs(v) > 1e-6})


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([scorer.score(x) for x in batch.column(1).to_pylist()], pa.float64())],
                                  names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("x")).mapInArrow(tidy(run), "doc_id long, score double")


def without_toxic(docs: DataFrame, scorer: Scorer, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """Rows whose score is below the threshold, with all their columns."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([scorer.score(x) < threshold for x in batch.column(at).to_pylist()], pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(tidy(run), docs.schema)
