"""Vector bin packing of tokenised examples into training sequences.

An example is a vector (tokens, segments, loss-bearing tokens); a sequence holds at most
``capacity`` tokens, ``max_segments`` segments and ``max_loss`` loss-bearing tokens. An open sequence
repeatedly takes, of the kinds of example that still fit, the one with the largest dot product of its
vector and the room left (both as shares of the limits); ties go to the longer kind, then to the one
with fewer loss-bearing tokens.

Examples that may be cut (``cut=True``) are cut to close a sequence without padding: a document gives
full sequences of its own and one remainder, remainders are packed, and the last, partly filled
sequence of a pool is divided at powers of two, which need no padding. With ``cut=False`` an example
keeps together, and one beyond a limit gets a sequence of its own.

Null texts are empty; a null id is kept; rows that repeat are examples of their own; an empty table
gives no row. A task packs what it reads in pools of bounded size, so no shuffle is needed and a
repeated task gives the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.llm.common import gathered, prepare, tidy
from kilnworks.llm.encode import encoder

#: Ids that one pool of remainders holds before it is packed.
POOL_IDS = 1 << 22

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def best_fit(tokens: np.ndarray, loss: np.ndarray, capacity: int, max_segments: int, max_loss: int, cut: bool) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (example, from, to); every example id is in one piece.

    Kinds are the distinct (tokens, loss) pairs, so a step looks at kinds, not at examples. Cutting
    spreads loss-bearing tokens in proportion, so it is only used where all ids bear loss.
    """
    if not len(tokens):
        return []
    kinds, of = np.unique(np.stack([tokens, loss], axis=1), axis=0, return_inverse=True)
    of = of.ravel()
    kt, kl = kinds[:, 0].astype(np.int64), kinds[:, 1].astype(np.int64)
    by_kind = np.argsort(of, kind="stable")[::-1]
    left = np.bincount(of, minlength=len(kinds))
    top = np.cumsum(left[::-1])[::-1]  # by_kind lists the last kind first
    heads = np.append(top[1:], 0)
    share = np.stack([kt / capacity, np.full(len(kt), 1 / max_segments), kl / max_loss])
    tie = kt * (max_loss + 1) - kl
    rank = np.argsort(np.argsort(tie, kind="stable"), kind="stable") * 1e-9
    open_, out, remaining = [], [], len(tokens)
    parts: dict[int, tuple[int, int]] = {}  # what is left of an example that was cut
    rt, rs, rl = capacity, max_segments, max_loss
    pending: list[tuple[int, int, int]] = []
    while remaining or pending:
        if pending:  # the rest of an example that closed the last sequence
            e, a, b = pending.pop()
            open_.append((e, a, b))
            rt, rs, rl = rt - (b - a), rs - 1, rl - (b - a)
            if not remaining:
                break
        fits = (left > 0) & (kt <= rt) & (kl <= rl) if rs else np.zeros(len(kt), dtype=bool)
        if fits.any():
            room = np.array([rt / capacity, rs / max_segments, rl / max_loss])
            score = np.where(fits, room @ share + rank, -1.0)
            k = int(np.argmax(score))
            e = int(by_kind[heads[k]])
            heads[k] += 1
            left[k] -= 1
            remaining -= 1
            open_.append((e, 0, int(kt[k])))
            rt, rs, rl = rt - int(kt[k]), rs - 1, rl - int(kl[k])
            if rt and rs:
                continue
        elif cut and rt and rs and rl and open_:
            k = int(np.flatnonzero(left > 0)[-1])
            e = int(by_kind[heads[k]])
            heads[k] += 1
            left[k] -= 1
            remaining -= 1
            room_ids = min(rt, rl)
            open_.append((e, 0, room_ids))
            pending.append((e, room_ids, int(kt[k])))
        elif not open_:  # beyond a limit on its own
            k = int(np.flatnonzero(left > 0)[-1])
            open_.append((int(by_kind[heads[k]]), 0, int(kt[k])))
            heads[k] += 1
            left[k] -= 1
            remaining -= 1
        out.append(open_)
        open_, rt, rs, rl = [], capacity, max_segments, max_loss
    if open_:
        out.append(open_)
    return out


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """One sequence divided into sequences whose lengths are powers of two."""
    total = sum(b - a for _, a, b in pieces)
    out, rest = [], list(pieces)
    for bit in range(total.bit_length() - 1, -1, -1):
        size, own = (1 << bit) & total, []
        while size:
            e, a, b = rest.pop(0)
            if b - a > size:
                rest.insert(0, (e, a + size, b))
                b = a + size
            own.append((e, a, b))
            size -= b - a
        if own:
            out.append(own)
    return out


def pack_texts(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, max_segments: int = 256, max_loss: int | None = None,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of whole texts in sequences; all ids of a text bear loss."""
    prepare(docs.sparkSession)
    limit_loss = capacity if max_loss is None else max_loss
    full = min(capacity, limit_loss)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, False)
        base, serial = TaskContext.get().partitionId() << 32, 0
        pool: list[tuple] = []  # doc_id, start, ids, ids of the document
        held = 0
        rows: list[tuple] = []

        def put(sequence: list[tuple]) -> None:
            nonlocal serial
            offset = 0
            for d, start, ids, doc_tokens in sequence:
                rows.append((d, start, len(ids), zlib.crc32(ids.tobytes()), doc_tokens, base | serial, offset, len(ids)))
                offset += len(ids)
            serial += 1

        def drain(last: bool) -> None:
            nonlocal pool, held
            sizes = np.array([len(p[2]) for p in pool], dtype=np.int64)
            sequences = best_fit(sizes, sizes, capacity, max_segments, limit_loss, True)
            rest: list[tuple] = []
            for n, s in enumerate(sequences):
                open_end = n == len(sequences) - 1 and sum(b - a for _, a, b in s) < full
                if open_end and not last:  # goes on in the next pool
                    rest = [(pool[e][0], pool[e][1] + a, pool[e][2][a:b], pool[e][3]) for e, a, b in s]
                    continue
                for part in powers_of_two(s) if open_end else [s]:
                    put([(pool[e][0], pool[e][1] + a, pool[e][2][a:b], pool[e][3]) for e, a, b in part])
            pool, held = rest, sum(len(p[2]) for p in rest)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in PIECE.split(", ")])

        for batch in gathered(batches):
            flat, bounds = own.batch(batch.column(1))
            at = 0
            for d, to in zip(batch.column(0).to_pylist(), bounds.tolist()):
                ids = np.append(flat[at:to], flat.dtype.type(end_id))
                at = to
                whole = len(ids) // full * full
                for a in range(0, whole, full):
                    put([(d, a, ids[a:a + full], len(ids))])
                if whole < len(ids):
                    pool.append((d, whole, ids[whole:].copy(), len(ids)))
                    held += len(ids) - whole
                if held > POOL_IDS:
                    drain(False)
            if rows:
                yield flush()
        drain(True)
        if rows:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("x")).mapInArrow(tidy(pack), PIECE)


def pack_examples(examples: DataFrame, id_col: str, tokens_col: str, loss_col: str, capacity: int = 2048, max_segments: int = 64,
                  max_loss: int = 1024) -> DataFrame:
    """Uncut examples (instruction data) in sequences, under all three limits.

    A null or negative count is 0. Result: the id (as text), n_tokens, n_loss, sequence_id, offset.
    """
    prepare(examples.sparkSession)
    count = lambda c: F.greatest(F.lit(0), F.coalesce(F.col(c).cast("long"), F.lit(0)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, serial = TaskContext.get().partitionId() << 32, 0
        for batch in pooled(batches):
            ids, t, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            rows = []
            for sequence in best_fit(t, n, capacity, max_segments, max_loss, False):
                offset = 0
                for e, _, _ in sequence:
                    rows.append((ids[e], int(t[e]), int(n[e]), base | serial, offset))
                    offset += int(t[e])
                serial += 1
            kinds = [pa.string()] + [pa.int64()] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["id", "n_tokens", "n_loss", "sequence_id", "offset"])

    def pooled(batches: Iterator[pa.RecordBatch], most: int = 65536) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
        if sum(b.num_rows for b in held):
            yield pa.Table.from_batches(held).combine_chunks()

    return examples.select(F.col(id_col).cast("string").alias("id"), count(tokens_col).alias("t"), count(loss_col).alias("n")).mapInArrow(
        pack, "id string, n_tokens long, n_loss long, sequence_id long, offset long")


def conversation_examples(conversations: DataFrame, tokenizer: str, id_col: str = "conv_id", role_col: str = "role", text_col: str = "text",
                          learned: str = "assistant") -> DataFrame:
    """id, n_tokens, n_loss of every conversation: ids of all its turns, each with an end id, and those of the turns to be learned.

    A null text has the end id alone; a null id is a conversation of its own.
    """
    prepare(conversations.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, False)
        for batch in gathered(batches):
            _, ends = own.batch(batch.column(2))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.diff(ends, prepend=0) + 1, pa.int64())], names=["id", "loss", "n"])

    loss = F.coalesce(F.col(role_col) == learned, F.lit(False))
    turns = conversations.select(F.col(id_col).cast("string").alias("id"), loss.alias("loss"), F.col(text_col).alias("x")).mapInArrow(tidy(count), "id string, loss boolean, n long")
    return turns.groupBy("id").agg(F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("loss"), F.col("n")).otherwise(0)).alias("n_loss"))
