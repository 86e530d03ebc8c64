"""Phrases that hold together, counted exactly in counting quotient filters.

Texts (A-Z in lower case) are cut into pieces at ``[.,;:!?]`` and line ends, and pieces into words. The
texts of a task are laid out in shards of a few MB: codes of the shard's own words, in order, for
each language. Word counts come from the shards; words with fewer than ``least`` occurrences in their language
cannot be part of a phrase that has as many, so only the others get an id, which no other
language shares. The ids are sent to the tasks if they have been counted to be few, else joined to the shards' words. Each
task then counts the n-grams of its shards in sorted filters, cut into ranges of leading bits; the filters
of a range are merged over all tasks. Pairs of words are counted first: a longer phrase is only counted where all its neighbours
are frequent pairs. A range holds about ``RANGE_ENTRIES`` words of text, so
no task has more, however often one phrase occurs: a task sends one entry for it.

Frequent n-grams, their cuts, the longer ones that hold them and the ranks are Spark tables from there on.

Null texts have no words; a null language is ``und``. Rows that repeat count as often as they stand. A very long
text is one shard. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilnworks.llm import quotient
from kilnworks.llm.common import gathered, numbered, prepare, sized
from kilnworks.session import durable

LEAST, LONGEST, COVER, TOP = 30, 4, 80, 2000
#: Bytes of text of a shard, words of text for each range of a filter, and entries a task holds before it sends them.
SHARD_BYTES, RANGE_ENTRIES, HELD_ENTRIES = 4 << 20, 1 << 20, 1 << 19
#: Words with an id up to which the dictionary is sent to the tasks; beyond it the ids are joined to each shard's words.
SENT_WORDS = 500_000
#: Frequent pairs of words (eight bytes each) up to which they are sent to the tasks to spare longer n-grams.
SENT_PAIRS = 4_000_000
_BREAK = "\x0b"


def word_stream(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words of all texts in order, -1 where a piece ends, and the words they stand for."""
    plain = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    plain = pc.replace_substring(pc.replace_substring_regex(plain, r"[.,;:!?\n-\r]+", f" {_BREAK} "), "\t", " ")
    flat = pc.split_pattern(pc.binary_join_element_wise(plain, *(pa.scalar(x, pa.large_string()) for x in (_BREAK, " "))), " ").flatten()
    coded = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
    words = coded.dictionary
    codes = coded.indices.to_numpy()
    if not len(words):
        return np.empty(0, np.int32), words
    real = pc.not_equal(words, _BREAK).to_numpy(zero_copy_only=False)
    place = np.where(real, np.cumsum(real) - 1, -1).astype(np.int32)
    return place[codes], words.filter(pa.array(real))


def _squeezed(codes: np.ndarray) -> bytes:
    return len(codes).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(codes.astype("<i4").tobytes(), asbytes=True)


def _unsqueezed(data: pa.Scalar) -> np.ndarray:
    view = memoryview(data.as_buffer())
    size = 4 * int.from_bytes(view[:8], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(view[8:], decompressed_size=size), dtype="<i4") if size else np.empty(0, np.int32)


def shards(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """shard, lang, words, counts, codes: the texts of each task as codes of the shard's own words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for batch in gathered(batches, rows=1 << 30, size=SHARD_BYTES):
            langs = batch.column(0)
            for lang in pc.unique(langs):
                codes, words = word_stream(batch.column(1).filter(pc.equal(langs, lang)))
                counts = np.bincount(codes[codes >= 0], minlength=len(words)).astype(np.int64)
                name += 1
                yield pa.record_batch([pa.array([name], pa.int64()), pa.array([lang.as_py()], pa.string()), pa.array([words.to_pylist()], pa.list_(pa.string())),
                                       pa.array([counts], pa.list_(pa.int64())), pa.array([_squeezed(codes)], pa.binary())],
                                      names=["shard", "lang", "words", "counts", "codes"])

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return durable(rows.mapInArrow(run, "shard long, lang string, words array<string>, counts array<long>, codes binary"))


def _of_shards(laid: DataFrame) -> DataFrame:
    return (laid.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("i", "w"))
            .select("shard", "lang", "i", F.col("w.words").alias("word"), F.col("w.counts").alias("c")))


def dictionary(laid: DataFrame, least: int) -> DataFrame:
    """lang, word, f, id of the words with at least ``least`` occurrences in their language."""
    often = _of_shards(laid).groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    return durable(numbered(often, "id"))


def _by_language(known: DataFrame) -> dict[str, tuple[pa.Array, np.ndarray]]:
    """Words and ids of each language, of a dictionary counted to be small."""
    rows = known.select("lang", "word", "id").toArrow().combine_chunks()
    out = {}
    for lang in pc.unique(rows.column("lang")):
        own = rows.filter(pc.equal(rows.column("lang"), lang))
        out[lang.as_py()] = own.column("word").combine_chunks().cast(pa.string()), own.column("id").to_numpy()
    return out


def counters(laid: DataFrame, known: DataFrame, n_words: int, n_known: int, bits: int, sizes: range, pairs: np.ndarray | None = None) -> DataFrame:
    """n, place, filter: the merged filters of the n-grams of known words, for the n in ``sizes``.

    With ``pairs`` (sorted numbers ``first << 32 | second``) only n-grams all of whose neighbours are among them.
    """
    prefix = max(0, (-(-n_words // RANGE_ENTRIES) - 1).bit_length())
    all_keys = {n: quotient.Keys(n, bits) for n in sizes}
    frequent_pairs = None if pairs is None else laid.sparkSession.sparkContext.broadcast(pairs)
    prefixes = {n: min(prefix, k.left) for n, k in all_keys.items()}
    held = HELD_ENTRIES

    def rows_of(n: int, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
        keys, p = all_keys[n], prefixes[n]
        place = (left >> np.uint64(keys.left - p)).astype(np.int64) if p else np.zeros(len(left), np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield int(place[a]), quotient.encode(keys, p, left[a:b], right[a:b], counts[a:b])

    def batch_of(n: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([n] * len(rows), pa.int32()), pa.array([p for p, _ in rows], pa.int64()), pa.array([f for _, f in rows], pa.binary())],
                               names=["n", "place", "filter"])

    def added(pending: dict[int, list], stream: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Count the n-grams of a stream of ids; filters go out once a task holds many entries."""
        tied = (stream[:-1] >= 0) & (stream[1:] >= 0)
        if frequent_pairs is not None and not len(frequent_pairs.value):
            tied[:] = False
        elif frequent_pairs is not None:
            at = np.flatnonzero(tied)
            both = (stream[at] << 32) | stream[at + 1]
            tied[at] = frequent_pairs.value[np.minimum(np.searchsorted(frequent_pairs.value, both), len(frequent_pairs.value) - 1)] == both
        for n, keys in all_keys.items():
            fits = tied[:max(0, len(tied) - n + 2)]
            for k in range(1, n - 1):
                fits = fits & tied[k:len(tied) - n + 2 + k]
            starts = np.flatnonzero(fits)
            if len(starts):
                left, right = keys.pack([stream[starts + k] for k in range(n)])
                pending[n].append(keys.summed(left, right, np.ones(len(left), np.int64)))
            if sum(len(x[0]) for x in pending[n]) > 2 * held:
                pending[n] = [keys.summed(*(np.concatenate(x) for x in zip(*pending[n], strict=True)))]
                if len(pending[n][0][0]) > held:
                    yield batch_of(n, list(rows_of(n, *pending[n].pop())))

    def rest(pending: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for n, keys in all_keys.items():
            if pending[n]:
                yield batch_of(n, list(rows_of(n, *keys.summed(*(np.concatenate(x) for x in zip(*pending[n], strict=True))))))

    def count_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[int, list] = {n: [] for n in all_keys}
        for batch in batches:
            for codes, places, ids in zip(*(batch.column(i) for i in range(3)), strict=True):
                stream, at = _unsqueezed(codes), places.values.to_numpy()
                known_ids = np.full(max(int(stream.max(initial=-1)), int(at.max(initial=-1))) + 2, -1, dtype=np.int64)  # the last one stands for a break
                known_ids[at] = ids.values.to_numpy()
                yield from added(pending, known_ids[stream])
        yield from rest(pending)

    def count_sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[int, list] = {n: [] for n in all_keys}
        for batch in batches:
            for lang, words, codes in zip(*(batch.column(i) for i in range(3)), strict=True):
                if lang.as_py() in sent.value:
                    names, ids = sent.value[lang.as_py()]
                    at = pc.fill_null(pc.index_in(words.values, value_set=names), len(ids)).to_numpy()
                    known_ids = np.append(np.append(ids, -1)[at], -1)
                    yield from added(pending, known_ids[_unsqueezed(codes)])
        yield from rest(pending)

    def merge(table: pa.Table) -> pa.Table:
        n, place = table.column(0)[0].as_py(), table.column(1)[0].as_py()
        keys = all_keys[n]
        parts = [quotient.decode(keys, place, f.as_py()) for f in table.column(2)]
        whole = keys.summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return pa.table({"n": pa.array([n], pa.int32()), "place": [place], "filter": pa.array([quotient.encode(keys, prefixes[n], *whole)], pa.binary())})

    parts = "n int, place long, filter binary"
    if n_known <= SENT_WORDS:
        sent = laid.sparkSession.sparkContext.broadcast(_by_language(known))
        counted = laid.select("lang", "words", "codes").mapInArrow(count_sent, parts)
    else:
        ids = (_of_shards(laid).join(known.select("lang", "word", "id"), ["lang", "word"]).groupBy("shard")
               .agg(F.collect_list(F.struct("i", "id")).alias("x")).select("shard", F.col("x.i").alias("at"), F.col("x.id").alias("ids")))
        counted = laid.select("shard", "codes").join(ids, "shard").select("codes", "at", "ids").mapInArrow(count_joined, parts)
    return durable(counted.groupBy("n", "place").applyInArrow(merge, parts))


def frequent(filters: DataFrame, bits: int, longest: int, least: int) -> DataFrame:
    """ids, n, a of the n-grams counted at least ``least`` times."""
    all_keys = {n: quotient.Keys(n, bits) for n in range(2, longest + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, place, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                keys = all_keys[n.as_py()]
                left, right, counts = quotient.decode(keys, place.as_py(), data.as_py())
                often = counts >= least
                ids = np.stack(keys.unpack(left[often], right[often]), axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * keys.n, pa.int32()), pa.array(ids.reshape(-1), pa.int64()))
                yield pa.record_batch([lists, pa.array([keys.n] * len(ids), pa.int32()), pa.array(counts[often], pa.int64())], names=["ids", "n", "a"])

    return durable(filters.mapInArrow(run, "ids array<long>, n int, a long"))


def _scored(found: DataFrame, known: DataFrame) -> DataFrame:
    """ids, a, l, r, score: the lowest-scoring cut of each phrase."""
    counts = durable(found.select(F.col("ids").alias("key"), F.col("a").alias("f")).unionAll(known.select(F.array("id").alias("key"), "f")))
    counts = sized(counts, 200_000)
    cuts = found.select("ids", "a", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.withColumns({"lk": F.slice("ids", F.lit(1), F.col("k")), "rk": F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))})
    cuts = cuts.join(counts.select(F.col("key").alias("lk"), F.col("f").alias("l")), "lk").join(counts.select(F.col("key").alias("rk"), F.col("f").alias("r")), "rk")
    score = F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) div CAST(CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)) AS DECIMAL(20,0))")
    least = cuts.withColumn("score", score).groupBy("ids").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return least.select("ids", "a", "m.l", "m.r", "m.score")


def _covered(found: DataFrame, cover: int) -> DataFrame:
    """ids of the phrases that stand inside a longer one nearly always."""
    inside = F.expr("flatten(transform(sequence(2, n - 1), m -> transform(sequence(1, n - m + 1), i -> slice(ids, i, m))))")
    longer = found.where("n > 2").select(F.explode(inside).alias("ids"), F.col("a").alias("longer")).groupBy("ids").agg(F.max("longer").alias("longer"))
    enough = F.expr(f"CAST(100 AS DECIMAL(5,0)) * CAST(longer AS DECIMAL(19,0)) >= CAST({cover} AS DECIMAL(5,0)) * CAST(a AS DECIMAL(19,0))")
    return found.join(longer, "ids").where(enough).select("ids")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, cover: int = COVER, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first ``top`` phrases of each language."""
    prepare(docs.sparkSession)
    laid = shards(docs, lang_col, text_col)
    sizes = durable(laid.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("n")))
    known = dictionary(laid, least)
    n_words, n_known = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], known.count()
    bits = max(1, n_known.bit_length())
    found = frequent(counters(laid, known, n_words, n_known, bits, range(2, 3)), bits, longest, least)
    if longest > 2:
        # a longer phrase is frequent only if all pairs of neighbours in it are; if those are too many to send, all are counted
        pairs = None
        if found.count() <= SENT_PAIRS:
            pairs = np.sort(found.select((F.shiftleft(F.col("ids")[0], 32) + F.col("ids")[1]).alias("p")).toArrow().column("p").to_numpy())
        longer = counters(laid, known, n_words, n_known, bits, range(3, longest + 1), pairs)
        found = found.unionAll(frequent(longer, bits, longest, least))
    kept = _scored(found, known).join(_covered(found, cover), "ids", "left_anti")
    named = (kept.select("*", F.posexplode("ids").alias("i", "id")).join(sized(known.select("id", "lang", "word")), "id").groupBy("ids", "a", "l", "r", "score")
             .agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    # Spark cuts each task's rows to ``top`` for a language before they meet
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
