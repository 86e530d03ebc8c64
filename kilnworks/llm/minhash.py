"""Near duplicates by one-permutation MinHash with optimal densification.

A document's set is its distinct shingles of ``k`` words (the whole sequence if it has fewer). One
hash of each shingle gives both its bin and its value; a bin keeps its smallest value; an empty bin
borrows from the first filled bin in a random order of its own (optimal densification). Bands
of ``ROWS`` bins each make bucket keys. At a similarity of 0.85 a pair misses all buckets with a
chance of about 2e-7; below 0.85, bands of ``SHORT_ROWS`` bins are used, and at 0.8 it is 4e-9.

Documents with equal sets are one class from the start. In each bucket the class that shares most
buckets with others is the centre of a star: centre and member are compared on their full sets, so pairs grow with the members,
not with their square. Two members may be similar though one of them is not similar to the centre.
Such pairs are found by what sets them off from a third set: the symmetric difference of two sets is
that of their differences from it, so similar members share all but ``most_apart`` of these
differences, and the first one they share, from the rarest on, stands early in both (prefix filter). The third set
is the centre, changed to what more than half of the members have. Members already in one component are
not paired, as a link between them changes nothing.

Null texts and texts without a word have an empty set, are linked with nothing and stay. Rows that
repeat (one id, one text) are in one class. A null id never names a component that has another id. A very long text is one set, which its task holds.
Sets are compared as 64-bit shingle hashes; classes are named by 64-bit set hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.llm.common import prepare, tidy
from kilnworks.llm.graph import components
from kilnworks.session import durable

BINS, ROWS, SHORT_ROWS = 384, 8, 6
#: Rows (of a few numbers each) up to which a table is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Members of a star that one task compares with its centre.
STAR_ROWS = 512

_U = np.uint64
_ODD = np.random.default_rng(20240229).integers(1, 1 << 63, size=16 + ROWS + BINS, dtype=np.uint64) * _U(2) + _U(1)
_PROBE = np.argsort(np.random.default_rng(5).random((BINS, BINS)), axis=1)  # each bin's own order of donors
_PLACE = np.argsort(_PROBE, axis=1).astype(np.int16)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def word_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of whole texts (A-Z in lower case), and where each text's words end."""
    plain = pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))
    lists = pc.split_pattern(pc.replace_substring_regex(plain, r"[\t-\r]", " "), " ")
    flat = lists.flatten()
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(full)])[bounds[1:]]
    coded = flat.dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in _bytes(coded.dictionary)), dtype=np.uint64, count=len(coded.dictionary))
    return (known[coded.indices.to_numpy()] if len(known) else np.empty(0, np.uint64))[full], ends


def _bytes(words: pa.Array) -> list[bytes]:
    if not len(words):
        return []
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py().encode().split(b" ")
    return joined if len(joined) == len(words) else [w.encode() for w in words.to_pylist()]


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, ends = word_lists(texts)
    n = len(words) - k + 1
    whole = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(k):
        whole += words[j:j + max(n, 0)] * _ODD[j]
    whole = _mix(whole)
    out, at = [], 0
    for to in ends.tolist():
        if to - at >= k:
            out.append(np.unique(whole[at:to - k + 1]))
        elif to > at:  # fewer words than a shingle: the whole sequence, apart from others by its length
            out.append(_mix((words[at:to] * _ODD[:to - at]).sum(dtype=np.uint64, keepdims=True) + _ODD[15:16] * _U(to - at)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at = to
    return out


def densified(shingles: np.ndarray) -> np.ndarray:
    """One value for each bin of a non-empty sorted set."""
    bins = ((shingles >> _U(32)) * _U(BINS) >> _U(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    filled = bins[first]
    values = np.zeros(BINS, dtype=np.uint64)
    values[filled] = shingles[first]
    if len(filled) == BINS:
        return values
    has = np.zeros(BINS, dtype=bool)
    has[filled] = True
    empty = np.flatnonzero(~has)
    if len(filled) < 48:
        values[empty] = values[filled[_PLACE[empty][:, filled].argmin(axis=1)]]
        return values
    donor, t = np.empty(BINS, dtype=np.int64), 0
    while len(empty):
        source = _PROBE[empty, t]
        got = has[source]
        donor[empty[got]] = source[got]
        empty = empty[~got]
        t += 1
    rest = np.flatnonzero(~has)
    values[rest] = values[donor[rest]]
    return values


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """Bucket keys, one for each band, of rows of bin values."""
    bands = signatures.reshape(len(signatures), BINS // rows, rows)
    return _mix((bands * _ODD[16:16 + rows]).sum(axis=2, dtype=np.uint64) + _ODD[16 + ROWS:16 + ROWS + BINS // rows])


def set_name(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sized(df: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has been counted to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _signed(texts: DataFrame, k: int, rows: int) -> DataFrame:
    """doc_id, t, n, c (class; null for an empty set) and bands of every row of ``texts`` (doc_id, t, x)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2), k)
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(np.stack([densified(s) for s in full]), rows).view(np.int64)) if full else iter(())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                                   pa.array([set_name(s) if len(s) else None for s in sets], pa.int64()),
                                   pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64()))], names=["doc_id", "t", "n", "c", "bands"])

    return texts.mapInArrow(tidy(run), "doc_id long, t long, n long, c long, bands array<long>")


def _full_sets(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """c, s (shingle hashes) of the wanted classes (doc_id, c), one row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, s) for c, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k)) if len(s) and set_name(s) == c]
            yield pa.record_batch([pa.array([c for c, _ in rows], pa.int64()), pa.array([s.view(np.int64) for _, s in rows], pa.list_(pa.int64()))],
                                  names=["c", "s"])

    # a null id cannot be looked up, so it is spelled as a number of its own on both sides
    own = lambda df: df.withColumn("d", F.coalesce(F.col("doc_id"), F.lit(-(1 << 62)))).drop("doc_id")
    rows = own(texts).join(_sized(own(wanted)), "d").select("c", "x").mapInArrow(tidy(run), "c long, s array<long>")
    return rows


def most_apart(sizes, percent: int):
    """Largest symmetric difference of two similar sets, by the sum of their sizes."""
    return F.floor(sizes * (100 - percent) / (100 + percent))


def _side_by_side(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, sa, sb: the sets of both ends; a centre with many members is dealt to many tasks."""
    shares = edges.groupBy("a").agg(F.ceil(F.count("*") / STAR_ROWS).cast("long").alias("shares"))
    dealt = edges.join(_sized(shares), "a").select("a", "b", F.pmod(F.xxhash64("b"), "shares").alias("share"))
    members = sets.withColumnsRenamed({"c": "b", "s": "sb"}).join(_sized(dealt), "b")
    centres = (sets.withColumnsRenamed({"c": "a", "s": "sa"}).join(_sized(shares), "a")
               .select("a", "sa", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share")))
    return members.join(centres, ["a", "share"])


def _verified(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the edges whose sets are similar enough."""
    pairs = _side_by_side(edges, sets).withColumn("i", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return pairs.where(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")


def _reach(n, percent: int):
    """How many of a member's leading differences are looked at: one more than can be its own."""
    return most_apart(n + F.floor(n * 100 / percent), percent) + 1


def _stars(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a (centre), b, n (size of b), linked, and apart: the differences of b from its centre."""
    both = _side_by_side(edges, sets).select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("n"),
                                             F.concat(F.array_except("sb", "sa"), F.array_except("sa", "sb")).alias("apart"))
    return both.select("a", "b", "n", (F.size("apart") <= most_apart(F.col("na") + F.col("n"), percent)).alias("linked"), "apart")


def _from_common(own: DataFrame) -> DataFrame:
    """``own`` with the differences from what most members of a star have, instead of those from its centre.

    What more than half of the members have and the centre lacks, or the other way round, sets the centre apart, not them.
    """
    often = own.select("a", F.explode("apart").alias("e")).groupBy("a", "e").agg(F.count("*").alias("often"))
    sizes = own.groupBy("a").agg(F.count("*").alias("m"))
    turned = durable(often.join(_sized(durable(sizes)), "a").where("2 * often > m").groupBy("a").agg(F.collect_list("e").alias("turned")))
    rows = own.join(_sized(turned), "a", "left")
    apart = F.when(F.col("turned").isNull(), F.col("apart")).otherwise(F.concat(F.array_except("apart", "turned"), F.array_except("turned", "apart")))
    return durable(rows.withColumn("apart", apart).drop("turned"))


def _members_alike(stars: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """a, b: members of one star, of different components, that may be similar."""
    own = stars.join(labels.withColumnRenamed("c", "b"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    mixed = own.groupBy("a").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.mode("label", deterministic=True).alias("main")).where("l0 < l1").select("a", "main")
    own = _from_common(durable(own.join(_sized(durable(mixed)), "a").select("a", "b", "n", "label", "apart", (F.col("label") != F.col("main")).alias("apart_from_main"))))
    # differences that no other member has come first in the order of rarity, and meet nobody
    each = own.select("a", "b", F.explode("apart").alias("e"))
    often = durable(each.groupBy("a", "e").agg(F.count("*").alias("often")).where("often > 1"))
    shared = (each.join(_sized(often), ["a", "e"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("often", "e"))).alias("o"))
              .join(own.select("a", "b", "n", "label", "apart_from_main", F.size("apart").alias("apart")), ["a", "b"]))
    first = shared.select("a", "b", "n", "label", "apart_from_main", "apart", (F.col("apart") - F.size("o")).alias("alone"), F.posexplode("o").alias("i", "o"))
    first = durable(first.select("a", "b", "n", "label", "apart_from_main", "apart", (F.col("alone") + F.col("i")).alias("i"), F.col("o.e").alias("e"))
                    .where(F.col("i") < _reach(F.col("n"), percent)))
    # two members of different components: one at least is outside the component that most members are in
    each = first.where("apart_from_main").drop("apart_from_main")
    other = first.select("a", "e", *[F.col(c).alias(f"{c}2") for c in ("b", "n", "label", "apart", "i")])
    most = most_apart(F.col("n") + F.col("n2"), percent)
    # what stands before the first shared difference is a member's own; that is at most its half of what may be apart
    early = (2 * F.col("i") <= F.col("apart") - F.col("apart2") + most) & (2 * F.col("i2") <= F.col("apart2") - F.col("apart") + most)
    near = each.join(other, ["a", "e"]).where((F.col("label") != F.col("label2")) & early)
    # no shared difference at all: what is apart adds up. If it is few enough for any two members, it is so for
    # each of them with the one for which this is greatest, so that one stands for all
    room = F.col("n") * (100 - percent) - F.size("apart") * (100 + percent)
    best = own.groupBy("a").agg(F.max_by(F.struct("b", "n", "label", F.size("apart").alias("apart")), F.struct(room, "b")).alias("r"))
    best = best.select("a", F.col("r.b").alias("b2"), F.col("r.n").alias("n2"), F.col("r.label").alias("label2"), F.col("r.apart").alias("apart2"))
    rest = own.withColumn("apart", F.size("apart")).join(_sized(durable(best)), "a").where((F.col("label") != F.col("label2")) & (F.col("apart") + F.col("apart2") <= most))
    pair = [F.least("b", "b2").alias("a"), F.greatest("b", "b2").alias("b")]
    return near.select(*pair).unionAll(rest.select(*pair)).distinct()


def _grouped(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, t, n, c) and the component (label) of each class, with its smallest id: c, doc_id, label."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_hash(text_col).alias("t"), F.col(text_col).alias("x"))
    rows = durable(_signed(texts, k, ROWS if percent >= 85 else SHORT_ROWS))
    classes = durable(rows.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")))
    entries = classes.select("c", F.explode("bands").alias("bucket"))
    shared = durable(entries.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket"))
    open_ = durable(entries.join(_sized(shared), "bucket"))
    sets = durable(_full_sets(texts, classes.join(open_.select("c").distinct(), "c", "left_semi").select("doc_id", "c"), k).dropDuplicates(["c"]))
    labels = None
    if not open_.isEmpty():
        # the class that meets others in most buckets tends to be the one the others were made from
        often = open_.groupBy("c").agg(F.count("*").alias("often"))
        centre = F.max(F.struct("often", F.bitwise_not("c").alias("c"))).getField("c")
        centres = durable(open_.join(_sized(durable(often)), "c").groupBy("bucket").agg(F.bitwise_not(centre).alias("a")))
        edges = durable(open_.join(_sized(centres), "bucket").where(F.col("c") != F.col("a")).select("a", F.col("c").alias("b")).distinct())
        stars = durable(_stars(edges, sets, percent))
        links = stars.where("linked").select("a", "b")
        labels = components(links)
        pairs = durable(_members_alike(stars, labels, percent))
        if not pairs.isEmpty():
            labels = components(links.unionAll(durable(_verified(pairs, sets, percent))))
    named = classes.select("c", "doc_id")
    if labels is None:
        return rows, named.withColumn("label", F.col("c"))
    return rows, durable(named.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c")))


def _text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("\x00null")))


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows, classes = _grouped(docs, k, percent, id_col, text_col)
    least = classes.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = durable(classes.select("c", "label").join(least, "label").select("c", "component_id"))
    out = rows.select("doc_id", "n", "c").join(named, "c", "left")
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with all their columns: of each component the one with the smallest id (then text hash; null last).

    Rows without a word stay. A row that repeats (id and text) stays once.
    """
    rows, classes = _grouped(docs, k, percent, id_col, text_col)
    own = durable(rows.where("c is not null").select("doc_id", "t", "c").join(classes.select("c", "label"), "c").groupBy("label", "doc_id", "t").agg(F.count("*").alias("n")))
    last = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    first = durable(own.groupBy("label").agg(F.min(F.struct(last.alias("d"), "t")).alias("first")))
    judged = own.join(first, "label").withColumn("stays", (F.col("first.d") == last) & (F.col("first.t") == F.col("t")))
    mark = lambda df: df.select(F.col("doc_id").alias("__d"), F.col("t").alias("__t"))
    gone, again = durable(mark(judged.where("not stays"))), durable(mark(judged.where("stays and n > 1")))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__d")) & (_text_hash(text_col) == F.col("__t"))
    left = docs.join(_sized(gone), same, "left_anti")
    if again.isEmpty():
        return left
    return left.join(_sized(again), same, "left_anti").unionAll(left.join(_sized(again), same, "left_semi").dropDuplicates([id_col, text_col]))
