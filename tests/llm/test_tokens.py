"""Token files and packing: exact round trips."""

import zlib
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kilnworks.llm import packing, wavelet
from kilnworks.llm.encode import Encoder
from kilnworks.session import scratch_path

TEXTS = ["", " ", "a  b", " a", "a ", "\n", "a\n\nb", "a \nb", "it's don't, no.", "x\x1cy z", "é ΑΣ ς. b", "<|endoftext|> a", "日本 語", "a\tb c", "1234 5 6",
         "!!! ??? a.b", "Ωmega, a_, b²." * 3, "The quick, brown fox.\nJumps over. And on"]


@pytest.mark.parametrize(("name", "drops"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids_are_those_of_the_whole_text(name, drops):
    own, plain = Encoder(public_tokenizers.path(name), drops), Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    rnd = np.random.default_rng(3)
    made = ["".join(rnd.choice(list("ab'sÉ1 2.,_  \n\t!\x1c\x00 "), size=rnd.integers(1, 14))) for _ in range(800)]
    for _ in range(2):  # from the tokenizer, then from memory
        ids, ends = own.batch(pa.array([*TEXTS, *made, None]))
        got = [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == [plain.encode(x, add_special_tokens=False).ids for x in [*TEXTS, *made]] + [[]]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=700))
def test_wavelet_matrix_answers_like_the_sequence(values):
    ids = np.array(values, dtype=np.uint32)
    m = wavelet.WaveletMatrix.build(ids, 7)
    assert m.decode().tolist() == values
    for v in {0, 5, 40, *values[:5]}:
        places = [i for i, x in enumerate(values) if x == v]
        assert m.rank(v, len(values)) == len(places)
        assert m.rank(v, len(values) // 2) == sum(i < len(values) // 2 for i in places)
        assert [m.select(v, k) for k in range(min(4, len(places)))] == places[:4]
        assert m.select(v, len(places)) == -1
    assert [m.access(i) for i in range(min(9, len(values)))] == values[:9]
    assert m.rank(1 << 9, 3) == 0 and m.select(1 << 9, 0) == -1


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, start long, ids_crc32 string").repartition(3)


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_IDS", 400)
    rows = [(k, TEXTS[k % len(TEXTS)] * (1 + k % 5), 7, "x") for k in range(60)] + [(None, None, 1, None), (5, "again", 2, "y"), (5, "again", 2, "y"), (70, "word " * 3000, 0, "")]
    path = scratch_path(spark, "wavelet-test")
    wavelet.write_shards(_docs(spark, rows), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    got = sorted(wavelet.document_digests(spark, path).collect(), key=lambda r: r.start)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    ids = {}
    for d, x, *_ in rows:
        ids.setdefault(d, []).append(np.array([*plain.encode(x or "", add_special_tokens=False).ids, 2], dtype="<u4"))
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: -1 if d is None else d)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    for r in got:
        assert (r.n_tokens, r.ids_crc32) in {(len(x), zlib.crc32(x.tobytes())) for x in ids[r.doc_id]}
    empty = scratch_path(spark, "wavelet-test")
    wavelet.write_shards(_docs(spark, []), empty, public_tokenizers.path("word_bpe_49k.json"), 2)
    assert wavelet.document_digests(spark, empty).count() == 0


def test_packing_keeps_every_id_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "POOL_IDS", 3000)
    rows = [(k, TEXTS[k % len(TEXTS)] * (1 + k % 7), 7, "x") for k in range(80)] + [(None, None, 1, None), (500, "word, " * 3000, 0, "")]
    got = packing.pack_texts(_docs(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), 1, max_segments=12).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d, x, *_ in rows:
        ids = np.array([*plain.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by_doc.pop(d), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert pieces[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in pairwise(pieces))
        assert sum(r.length for r in pieces) <= 2048 and len(pieces) <= 12
    assert packing.pack_texts(_docs(spark, []), public_tokenizers.path("byte_bpe_50k.json"), 1).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60), st.integers(1, 6))
def test_uncut_examples_hold_all_limits(items, most):
    t = np.array([a for a, _ in items], dtype=np.int64)
    n = np.array([min(a, b) for a, b in items], dtype=np.int64)
    sequences = packing.best_fit(t, n, 32, most, 16, False)
    assert sorted(e for s in sequences for e, _, _ in s) == list(range(len(items)))
    for s in sequences:
        if len(s) > 1:
            assert len(s) <= most and sum(t[e] for e, _, _ in s) <= 32 and sum(n[e] for e, _, _ in s) <= 16


def test_instruction_examples(spark):
    rows = [(str(k), k % 50, k % 20) for k in range(200)] + [(None, None, -1)]
    got = packing.pack_examples(spark.createDataFrame(rows, "conv_id string, n long, loss long"), "conv_id", "n", "loss", 64, 5, 40).toPandas()
    assert len(got) == len(rows)
    sums = got.groupby("sequence_id").agg(n=("n_tokens", "sum"), loss=("n_loss", "sum"), k=("n_tokens", "size"))
    assert sums.n.max() <= 64 and sums.loss.max() <= 40 and sums.k.max() <= 5


def test_conversations_hold_all_limits(spark):
    """Whole conversations, their counts from the plain tokenizer, in sequences within all three limits."""
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op8_instruction_packing"](spark, sf).toPandas()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    want = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        n = len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1
        t, loss = want.get(str(r.conv_id), (0, 0))
        want[str(r.conv_id)] = t + n, loss + n * (r.role == "assistant")
    assert {r.id: (r.n_tokens, r.n_loss) for r in got.itertuples()} == want and len(got) == len(want)
    sums = got.groupby("sequence_id").agg(n=("n_tokens", "sum"), loss=("n_loss", "sum"), k=("n_tokens", "size"))
    assert 5000 < sums.n.max() <= 5120 and 4000 < sums.loss.max() <= 4096 and sums.k.max() == 6  # each limit is met by some


def test_lookup_without_decoding(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_IDS", 300)
    rows = [(k, TEXTS[k % len(TEXTS)] * (1 + k % 4), 7, "x") for k in range(50)] + [(None, None, 1, None), (60, "a b " * 400, 0, "")]
    path = scratch_path(spark, "wavelet-test")
    wavelet.write_shards(_docs(spark, rows), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    ids = {d: [*plain.encode(x or "", add_special_tokens=False).ids, 2] for d, x, _, _ in rows}
    some = [2, ids[60][0], ids[60][1], 49_000]
    want = sorted((t, -1 if d is None else d, own.count(t), own.index(t)) for t in some for d, own in ids.items() if t in own)
    assert sorted((r.token, -1 if r.doc_id is None else r.doc_id, r.n, r.first) for r in wavelet.token_counts(spark, path, some).collect()) == want
    asked = spark.createDataFrame([(3,), (60,), (999,)], "doc_id long")
    got = {}
    for r in sorted(wavelet.document_tokens(spark, path, asked).collect(), key=lambda r: (r.doc_id, r.place)):
        got.setdefault(r.doc_id, []).append(r.token)
    assert got == {d: ids[d] for d in (3, 60)}
