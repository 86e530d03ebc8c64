"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of order ``ORDER`` over the characters of its words (lower-case runs of
letters, with a sign for the start and one for the end); contexts do not cross words. The highest
order, and n-grams at the start of a word, use counts; the lower ones the number of distinct
characters in front. The discount of an order is n1 / (n1 + 2 n2). Counts come from all training
texts, as map-side sums and one grouped sum.

The fitted models are arrays sorted by the 64-bit hash of an n-gram, with its discounted probability
and the weight it leaves to the shorter context, for each language that has it: they hold all n-grams
and grow with those of the training texts. If a caller gives ``max_ngrams``, a language keeps its most
frequent n-grams; what others had goes to the shorter context, so each model still sums to one. A text gets the language of lowest cross-entropy per character; a cross-entropy above the
``REJECT_ABOVE`` quantile of that language's training texts marks it as rejected.

Null texts and texts without a letter are ``und`` with score 0. Ties go to the first language in
code-point order. Training rows with null text or language teach nothing. Without training rows
everything is ``und``. A very long text counts with all its words, in training and in prediction.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilnworks.llm.common import gathered, prepare
from kilnworks.session import durable

ORDER, START, END = 5, "\x02", "\x03"
REJECT_ABOVE, SHARPNESS, REMEMBERED = 0.999, 20.0, 500_000


def _not_letters() -> str:
    """Ranges of the characters that are alphanumeric but neither letters nor digits, such as ½ or Ⅷ."""
    odd = [c for c in range(sys.maxunicode + 1) if chr(c).isalnum() and not chr(c).isalpha() and not chr(c).isdecimal()]
    starts = [c for k, c in enumerate(odd) if not k or odd[k - 1] != c - 1]
    ends = [c for k, c in enumerate(odd) if k + 1 == len(odd) or odd[k + 1] != c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


#: Runs of Unicode letters (category L).
_LETTERS = re.compile(rf"[^\W\d_{_not_letters()}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.uint64(pow(int(_BASE), k, 1 << 64)) for k in range(ORDER)]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram of an order that ends at each position; the first ones are not n-grams."""
    h = np.zeros(len(codes), dtype=np.uint64)
    for k in range(order):
        h[k:] += codes[:len(codes) - k] * _POWERS[k]
    return _mix(h)


def _gram_hashes(grams: pa.ChunkedArray, dropped: int) -> np.ndarray:
    """Hashes of n-grams, or of what is left without their last characters."""
    size = pc.utf8_length(grams).to_numpy().astype(np.int64)
    codes = _codes("".join(grams.to_pylist()))
    start = np.cumsum(size) - size
    from_end = np.repeat(start + size - 1 - dropped, size) - np.arange(len(codes))
    parts = np.where(from_end >= 0, codes * np.array(_POWERS)[np.maximum(from_end, 0)], np.uint64(0))
    return _mix(np.add.reduceat(parts, start))


@dataclass
class Cells:
    """A value by n-gram and language, held only where the language has the n-gram."""
    starts: np.ndarray  # first cell of each n-gram, and the end
    column: np.ndarray  # language of each cell
    values: np.ndarray
    other: float
    width: int

    def __getitem__(self, rows) -> np.ndarray:
        """The values of all languages, a row for each n-gram asked for."""
        rows = np.asarray(rows)
        first = self.starts[rows.reshape(-1)]
        sizes = self.starts[rows.reshape(-1) + 1] - first
        out = np.full((len(first), self.width), self.other, dtype=np.float32)
        cell = np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
        out[np.repeat(np.arange(len(first)), sizes), self.column[cell]] = self.values[cell]
        return out.reshape(*rows.shape, self.width)


@dataclass
class Models:
    langs: list[str]
    keys: np.ndarray  # sorted hashes of n-grams
    alpha: Cells  # discounted probability
    gamma: Cells  # weight of the shorter context behind this n-gram; 1 where it was not seen
    gamma0: np.ndarray  # the same of the empty context
    floor: float

    def word_costs(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Natural-log probability of each word in each language, and its characters."""
        codes = _codes("".join([START + w + END for w in found]))
        sizes = np.array([len(w) + 2 for w in found])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        within = np.arange(len(codes)) - np.repeat(starts, sizes)
        p = np.full((len(codes), len(self.langs)), self.floor)
        behind = np.broadcast_to(self.gamma0, p.shape)
        for order in range(1, ORDER + 1):
            h = _hashes(codes, order)
            grams, which = np.unique(h, return_inverse=True)
            place = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
            known = np.flatnonzero(self.keys[place] == grams)
            alphas, gammas = np.zeros((len(grams), len(self.langs)), np.float32), np.ones((len(grams), len(self.langs)), np.float32)
            alphas[known], gammas[known] = self.alpha[place[known]], self.gamma[place[known]]
            alpha = alphas[which]
            p = np.where((within >= order - 1)[:, None], alpha + behind * p, p)
            gamma = np.where((within >= order - 1)[:, None], gammas[which], 1)
            behind = np.vstack([np.ones((1, len(self.langs))), gamma[:-1]])
        cost = np.log(p)
        cost[starts] = 0
        return np.add.reduceat(cost, starts, axis=0), sizes - 1


class _Worker:
    """Remembers the costs of words it has met."""

    def __init__(self, models: Models):
        self.models, self.place = models, {}
        self.costs = np.empty((0, len(models.langs) + 1), dtype=np.float32)
        self.used = 0

    def _learn(self, new: list[str]) -> None:
        size = max(1, 200_000 // max(10, len(self.models.langs)))  # words whose costs in all languages are in memory at once
        for a in range(0, len(new), size):
            part = new[a:a + size]
            cost, chars = self.models.word_costs(part)
            if self.used + len(part) > len(self.costs):
                more = np.empty((max(1 << 14, 2 * len(self.costs), self.used + len(part)), self.costs.shape[1]), dtype=np.float32)
                more[:self.used] = self.costs[:self.used]
                self.costs = more
            self.costs[self.used:self.used + len(part)] = np.column_stack([cost, chars])
            self.place.update(zip(part, range(self.used, self.used + len(part))))
            self.used += len(part)

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """Summed log-probability by language, and characters, of each text."""
        if self.used > REMEMBERED:
            self.place.clear()
            self.used = 0
        found = [_LETTERS.findall(text.lower()) if text else [] for text in texts]
        at = [self.place.get(w, -1) for words in found for w in words]
        if -1 in at:
            every = [w for words in found for w in words]
            self._learn(list({w for w, i in zip(every, at) if i < 0}))
            at = [self.place[w] if i < 0 else i for w, i in zip(every, at)]
        sizes = np.array([len(words) for words in found])
        out = np.zeros((len(texts), len(self.models.langs) + 1))
        full = np.flatnonzero(sizes)
        if len(full):
            starts = (np.cumsum(sizes) - sizes)[full]
            out[full] = np.add.reduceat(self.costs[np.array(at)].astype(np.float64), starts, axis=0)
        return out


def _ngrams(train: DataFrame) -> DataFrame:
    """lang, g, c: longest n-grams at each character of all training texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                grams: Counter = Counter()
                for word, c in counts.items():
                    padded = START + word + END
                    for j in range(2, len(padded) + 1):
                        grams[padded[max(0, j - ORDER):j]] += c
                yield pa.record_batch([pa.array([lang] * len(grams)), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())],
                                      names=["lang", "g", "c"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    held.setdefault(lang, Counter()).update(_LETTERS.findall(text.lower()))
            if sum(map(len, held.values())) > 400_000:
                yield from flush()
        yield from flush()

    return train.mapInArrow(count, "lang string, g string, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))


def _most_frequent(table: DataFrame, most: int) -> DataFrame:
    """At most so many n-grams of each language, by count."""
    # an n-gram's count class: exact below 1024, by octave shares above, so a language has few classes
    rank = F.when(F.col("c") < 1024, F.col("c").cast("double")).otherwise(1024 + F.floor(64 * F.log2(F.col("c") / 1024)))
    classes = table.groupBy("lang", rank.alias("r")).agg(F.count("*").alias("m"))
    running = F.sum("m").over(Window.partitionBy("lang").orderBy(F.col("r").desc()))
    lowest = classes.select("lang", "r", running.alias("upto")).where(F.col("upto") <= most).groupBy("lang").agg(F.min("r").alias("low"))
    return table.join(lowest, "lang").where(rank >= F.col("low")).drop("low")


def fit(train: DataFrame, max_ngrams: int | None = None) -> Models | None:
    """Models of all languages of ``train`` (lang, text), of all their n-grams unless the caller sets a limit."""
    prepare(train.sparkSession)
    raw = durable(_ngrams(train.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")))
    langs = sorted(r["lang"] for r in raw.select("lang").distinct().collect())
    if not langs:
        return None
    size = F.length("g")
    level = raw.where(size == ORDER)
    orders = [level.select("lang", "g", "c", F.lit(ORDER).alias("n"))]
    for n in range(ORDER - 1, 0, -1):
        shorter = level.groupBy("lang", F.expr("substring(g, 2)").alias("g")).agg(F.count("*").alias("c")).where(~F.col("g").startswith(START))
        level = shorter.unionAll(raw.where(size == n)) if n > 1 else shorter
        level = level.where(size == n)
        orders.append(level.select("lang", "g", "c", F.lit(n).alias("n")))
    table = orders[0]
    for t in orders[1:]:
        table = table.unionAll(t)
    table = durable(table)
    discount = table.groupBy("lang", "n").agg(F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2"))
    discount = discount.select("lang", "n", F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5)).alias("d"))
    context = table.groupBy("lang", F.expr("substring(g, 1, n - 1)").alias("ctx")).agg(F.sum("c").alias("total"))
    kept = ((table if max_ngrams is None else _most_frequent(table, max(1, max_ngrams))).join(discount, ["lang", "n"])
            .withColumn("ctx", F.expr("substring(g, 1, n - 1)")).join(context, ["lang", "ctx"])
            .select("lang", "g", "n", (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("a")))
    index = (F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1).cast("int")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                grams = pa.chunked_array([batch.column(1)])
                yield pa.record_batch([batch.column(0), pa.array(_gram_hashes(grams, 0).view(np.int64)), pa.array(_gram_hashes(grams, 1).view(np.int64)),
                                       batch.column(2), batch.column(3)], names=["l", "own", "behind", "inner", "a"])

    # the driver gets numbers only, 25 bytes for each n-gram of a language
    rows = kept.select(index.alias("l"), "g", (F.col("n") > 1).alias("inner"), F.col("a").cast("float").alias("a")).mapInArrow(
        hashed, "l int, own long, behind long, inner boolean, a float").toArrow()
    if not rows.num_rows:
        return None
    column, share, inner = (rows.column(c).to_numpy() for c in ("l", "a", "inner"))
    own, behind = (rows.column(c).to_numpy().view(np.uint64) for c in ("own", "behind"))
    del rows
    keys = np.unique(np.concatenate([own, behind[inner]]))
    # a cell for each n-gram and language, numbered by both
    width = len(langs)
    at_own = np.searchsorted(keys, own) * width + column
    at_behind = np.searchsorted(keys, behind[inner]) * width + column[inner]
    cells = np.unique(np.concatenate([at_own, at_behind]))
    starts, held = np.searchsorted(cells, np.arange(len(keys) + 1) * width), (cells % width).astype(np.int32)
    alpha = np.zeros(len(cells), dtype=np.float32)
    alpha[np.searchsorted(cells, at_own)] = share
    gamma = 1 - np.bincount(np.searchsorted(cells, at_behind), weights=share[inner], minlength=len(cells))
    gamma0 = 1 - np.bincount(column[~inner], weights=share[~inner], minlength=width)
    # every character seen, the end sign, and one place for all others
    alphabet = table.where("n = 1").select("g").distinct().count() + 1
    return Models(langs, keys, Cells(starts, held, alpha, 0, width), Cells(starts, held, np.clip(gamma, 1e-6, 1).astype(np.float32), 1, width),
                  np.clip(gamma0, 1e-6, 1), 1 / alphabet)


def predict(docs: DataFrame, models: Models | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with lang_pred, score, cross_entropy (null for und) of every row."""
    prepare(docs.sparkSession)
    own = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__x"))
    schema = own.drop("__x").schema.add("lang_pred", "string").add("score", "double").add("cross_entropy", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _Worker(models) if models else None
        for batch in gathered(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            lang, score, entropy = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
            sums = worker.sums(texts) if worker else []
            for k, row in enumerate(sums):
                if row[-1]:
                    h = -row[:-1] / row[-1]
                    best = int(np.argmin(h))
                    lang[k], entropy[k] = models.langs[best], float(h[best])
                    score[k] = float(1 / np.exp(-SHARPNESS * (h - h[best])).sum())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang), pa.array(score, pa.float64()), pa.array(entropy, pa.float64())],
                                             names=schema.names)

    return own.mapInArrow(run, schema)


def identify(docs: DataFrame, training, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """doc_id, in_training, lang_pred, score, cross_entropy and rejected of every row.

    ``training`` is the condition for rows that models may learn from.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), training.alias("in_training"))
    models = fit(base.where("in_training"))
    rows = durable(predict(base, models, ["doc_id", "in_training", "lang"]))
    limits = (rows.where(F.col("in_training") & (F.col("lang") == F.col("lang_pred"))).groupBy("lang_pred")
              .agg(F.percentile_approx("cross_entropy", REJECT_ABOVE, 100_000).alias("most")))
    return (rows.join(F.broadcast(limits), "lang_pred", "left")  # a row for each learned language
            .select("doc_id", "in_training", "lang_pred", "score", "cross_entropy",
                    F.coalesce(F.col("cross_entropy") > F.col("most"), F.col("lang_pred") == "und").alias("rejected")))
