"""Ranked lexical search of whole documents by inner products, pruned by the lengths of impact vectors.

Items are searched in blocks whose terms fit a bound, each block against all documents. A document
becomes the vector of its impacts on the block's terms; the score of an item is the inner product with the
item's own vector. Vectors are put into buckets by length. The longest ones are searched first and
give each item a threshold, the score that its first ``top`` documents reach. The tasks then walk
through the rest from long to short vectors: by Cauchy-Schwarz an item is through with a bucket, and with all
behind it, once length times length is below the threshold. Inside a bucket only documents that
share one of the item's weightiest coordinates are looked at, those without which the threshold is
out of reach; what the others could add at most is bounded by the lengths of the rests and by the bucket's largest
impacts. Survivors are scored in 64-bit integers, and the thresholds rise with them.

Bounds are doubles with a margin; no score comes from them. Each task sends at most ``top`` documents for an item,
so a hot term meets in no task.

Null and empty texts have no term: such documents are not counted and such items find nothing. Rows that repeat
are documents, or items, of their own. Of equal scores the smaller id is first, a null id last. Other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnworks.llm.common import gathered, prepare
from kilnworks.session import durable

TOP = 20
#: Items and distinct terms of a block of items: what is sent to the tasks.
BLOCK_ITEMS, BLOCK_TERMS = 4096, 1 << 20
#: Vectors that are searched first, and vectors of a bucket in a task, whose lengths differ by at most ``STEP``.
FIRST, BUCKET, STEP = 1 << 13, 1024, 0.8
_LAST = (1 << 63) - 1
_MARGIN = 1 + 1e-9


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in order, and how many each text has."""
    plain = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.split_pattern(pc.replace_substring_regex(plain, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "), " ")
    flat = lists.flatten()
    full = pc.not_equal(flat, "")
    ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return flat.filter(full), np.diff(ends)


class Items:
    """A block of items as sparse vectors over their own terms."""

    def __init__(self, ids: list, texts: list):
        terms, sizes = terms_of(pa.array(texts, pa.string()))
        coded = terms.dictionary_encode()
        self.ids, self.terms = ids, coded.dictionary
        ends = np.cumsum(sizes)
        self.vectors = [np.unique(x, return_counts=True) for x in np.split(coded.indices.to_numpy().astype(np.int64), ends[:-1])] if ids else []


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """Blocks of items, one at a time in the driver."""
    ids, texts, seen = [], [], set()
    for row in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("x")).toLocalIterator():
        ids.append(row.i)
        texts.append(row.x)
        seen.update(terms_of(pa.array([row.x], pa.string()))[0].to_pylist())
        if len(ids) == BLOCK_ITEMS or len(seen) >= BLOCK_TERMS:
            yield Items(ids, texts)
            ids, texts, seen = [], [], set()
    if ids:
        yield Items(ids, texts)


def _counted(docs: DataFrame, known: pa.Array) -> DataFrame:
    """doc_id, n, terms, tfs of the documents with a term; only the known terms are kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            flat, n = terms_of(batch.column(1))
            ids = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(n)), n)[ids >= 0]
            cells, tfs = np.unique(doc * len(known) + ids[ids >= 0], return_counts=True)
            offsets = pa.array(np.searchsorted(cells, np.arange(len(n) + 1) * len(known)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (cells % max(1, len(known)), tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    return durable(docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>"))


def _document_counts(vectors: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each known term is; one row for each term and task before they are added."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    rows = vectors.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return out


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, terms and numbers of the two list columns ``terms`` and ``tfs``."""
    terms, tfs = batch.column("terms"), batch.column("tfs")
    offsets = terms.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)


def _fractions(offsets: np.ndarray, tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tfs) // (1000 * tfs + 12 * np.repeat(m, np.diff(offsets)))


def _row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[offsets])


def _impacts(vectors: DataFrame, weights: np.ndarray) -> DataFrame:
    """The vectors with a known term, with m, their length and its bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, terms, tfs = _arrays(batch)
            impact = weights[terms] * _fractions(offsets, tfs, batch.column("m").to_numpy()).astype(float) ** 2
            length = np.sqrt([impact[a:b].sum() for a, b in pairwise(offsets.tolist())])
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "m", "terms", "tfs")), pa.array(length, pa.float64())], names=["doc_id", "m", "terms", "tfs", "length"])

    return durable(vectors.select("doc_id", "m", "terms", "tfs").mapInArrow(run, "doc_id long, m long, terms array<int>, tfs array<int>, length double")
                   .where("length > 0").withColumn("bucket", F.floor(F.log2("length") * 8).cast("int")))


class _Found:
    """The best documents of an item so far."""

    def __init__(self, least: int, top: int):
        self.least, self.top = least, top
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = (scores > 0) & (scores >= self.least)
        scores, ids = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.ids, ids[keep]])
        order = np.lexsort((ids, -scores))[:self.top]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.top:
            self.least = max(self.least, int(self.scores[-1]))


class _Bucket:
    """Vectors of similar length, from long to short, with lists of the documents of each term."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, n_terms: int):
        self.ids, self.length = batch.column("doc_id").to_numpy(), batch.column("length").to_numpy()
        self.offsets, self.terms, tfs = _arrays(batch)
        fraction = _fractions(self.offsets, tfs, batch.column("m").to_numpy())
        self.whole = weights[self.terms] * fraction
        impact = np.sqrt(weights[self.terms]) * fraction
        order = np.argsort(self.terms, kind="stable")
        self.docs, self.impact = np.repeat(np.arange(len(self.ids)), np.diff(self.offsets))[order], impact[order]
        self.starts = np.searchsorted(self.terms[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms)
        some = np.flatnonzero(np.diff(self.starts))
        self.most[some] = np.maximum.reduceat(self.impact, self.starts[some]) if len(some) else 0

    def search(self, terms: np.ndarray, times: np.ndarray, root: np.ndarray, scratch: np.ndarray, found: _Found) -> bool:
        """Add the documents of the bucket that may be among the best; False once no shorter vector can be."""
        own = times * root[terms]
        length = math.sqrt((own ** 2).sum())
        if length * self.length[0] * _MARGIN + 1 < found.least:
            return False
        near = int(np.searchsorted(-self.length, -(found.least - 1) / (length * _MARGIN), side="right")) if found.least > 1 else len(self.ids)
        most = own * self.most[terms]
        order = np.argsort(-most, kind="stable")
        order = order[most[order] > 0]
        # what coordinates from k on can add: by the lengths of the rests, and by the bucket's largest impacts
        rest = np.sqrt(np.concatenate([np.cumsum((own[order] ** 2)[::-1])[::-1], [0.0]]))
        largest = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0.0]])
        bound = np.minimum(rest * self.length[0], largest) * _MARGIN + 1
        k = int(np.argmax(bound < max(found.least, 2)))
        focus = order[:k]
        if not k:
            return True
        slices = [slice(self.starts[t], self.starts[t + 1]) for t in terms[focus]]
        docs = np.concatenate([self.docs[s] for s in slices])
        impact = np.concatenate([self.impact[s] for s in slices])
        part = np.bincount(docs, np.repeat(own[focus], [s.stop - s.start for s in slices]) * impact, len(self.ids))
        square = np.bincount(docs, impact ** 2, len(self.ids))
        left = np.minimum(rest[k] * np.sqrt(np.maximum(self.length ** 2 - square, 0.0) + self.length ** 2 * 1e-9), largest[k])
        alive = np.flatnonzero((part > 0) & ((part + left) * _MARGIN + 1 >= found.least))
        alive = alive[alive < near]
        if len(alive):
            scratch[terms] = times
            a, b = self.offsets[alive], self.offsets[alive + 1]
            at = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum())
            values = scratch[self.terms[at]] * self.whole[at]
            found.add(_row_sums(values, np.concatenate([[0], np.cumsum(b - a)])), self.ids[alive])
            scratch[terms] = 0
        return True


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of a task's vectors, which come from long to short."""
    for batch in gathered(batches, rows=BUCKET):
        length, at = batch.column("length").to_numpy(), 0
        while at < len(length):
            to = max(at + 1, min(at + BUCKET, int(np.searchsorted(-length, -STEP * length[at], side="right"))))
            yield pa.concat_batches([batch.slice(at, to - at)])
            at = to


def _best(impacts: DataFrame, items: Items, weights: np.ndarray, least: np.ndarray, top: int) -> DataFrame:
    """q, doc_id, score: for each item the best documents of all, ranked; ``least`` are scores that are known to be reached."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_Found(int(x), top) for x in least]
        active, root = [q for q, (terms, _) in enumerate(items.vectors) if len(terms)], np.sqrt(weights)
        scratch = np.zeros(len(weights), np.int64)
        for batch in _cut(batches):
            bucket = _Bucket(batch, weights, len(weights))
            active = [q for q in active if bucket.search(*items.vectors[q], root, scratch, found[q])]
            if not active:
                break
        for q, f in enumerate(found):
            if len(f.ids):
                yield pa.record_batch([pa.array([q] * len(f.ids), pa.int32()), pa.array(f.ids, pa.int64()), pa.array(f.scores, pa.int64())], names=["q", "doc_id", "score"])

    rows = impacts.sortWithinPartitions(F.desc("length")).mapInArrow(run, "q int, doc_id long, score long")
    return durable(_ranked(rows, top).drop("rank"))


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    place = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)


def _searched(docs: DataFrame, items: Items, top: int, id_type: T.DataType) -> DataFrame | None:
    known = items.terms
    if not len(known):
        return None
    vectors = _counted(docs, known)
    size = vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    if not size.n:
        return None
    counts = _document_counts(vectors, len(known))
    weights = np.array([math.floor(1000 * math.log((2 * size.n + 2) / (2 * df + 1))) for df in counts.tolist()], dtype=np.int64)
    m = F.expr(f"100 - 25 + ((25 * n * {size.n}L) div {size.l}L)")
    impacts = _impacts(vectors.where(F.size("terms") > 0).withColumn("m", m), weights)
    buckets = impacts.groupBy("bucket").agg(F.count("*").alias("n")).orderBy(F.desc("bucket")).collect()  # eight for each doubling of the length
    first, seen = None, 0
    for row in buckets:
        first, seen = row.bucket, seen + row.n
        if seen >= FIRST:
            break
    if first is None:
        return None
    least = np.zeros(len(items.ids), np.int64)
    best = _best(impacts.where(F.col("bucket") >= first), items, weights, least, top)
    if first > buckets[-1].bucket:
        full = best.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= top)
        for row in full.collect():  # one number for each item
            least[row.q] = row.least
        root = np.sqrt(weights)
        own = [math.sqrt(((times * root[terms]) ** 2).sum()) for terms, times in items.vectors]
        shortest = min((max(0.0, (least[q] - 1) / (x * _MARGIN)) for q, x in enumerate(own) if x > 0), default=0.0)
        rest = impacts.where((F.col("bucket") < first) & (F.col("length") >= shortest))
        best = best.unionByName(_best(rest, items, weights, least, top))
    names = docs.sparkSession.createDataFrame(list(enumerate(items.ids)), T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item_id", id_type)]))
    return (_ranked(best, top).join(F.broadcast(names), "q")
            .select("item_id", "rank", F.when(F.col("doc_id") != _LAST, F.col("doc_id")).alias("doc_id"), "score"))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score: the ``top`` documents of each item with a score above 0."""
    spark = prepare(docs.sparkSession)
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = items.schema[item_col].dataType
    found = [rows for block in _blocks(items, item_col, item_text_col) if (rows := _searched(own, block, top, id_type)) is not None]
    if not found:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", id_type), *T.StructType.fromDDL("rank int, doc_id long, score long")]))
    whole = found[0]
    for rows in found[1:]:
        whole = whole.unionByName(rows)
    return whole
