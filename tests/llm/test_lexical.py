"""Ranked search against every score."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kilnworks.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _ranked(docs, items, top):
    rows = [(d, Counter(t), len(t)) for d, x in docs if (t := _terms(x))]
    n_all, l_all = len(rows), sum(n for _, _, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item, text in items:
        scored = []
        for d, c, n in rows:
            m = 100 - 25 + (25 * n * n_all) // l_all
            s = sum(w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in _terms(text) if t in c)
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aA9_ \n.\x7fé日\x00-", max_size=20)), max_size=6))
def test_terms(texts):
    flat, n = lexical.terms_of(pa.array(texts, pa.string()))
    assert flat.to_pylist() == [t for x in texts for t in _terms(x)] and n.tolist() == [len(_terms(x)) for x in texts]


def _rows(spark, docs):
    return spark.createDataFrame([(*d, 3, "q", 1) for d in docs], "doc_id long, text string, score int, q string, terms int").repartition(3)


@pytest.mark.parametrize(("first", "block"), [(1 << 13, 4096), (40, 4096), (40, 2)])
def test_equals_every_score(spark, monkeypatch, first, block):
    monkeypatch.setattr(lexical, "FIRST", first)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", block)
    rnd = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(400)]
    p = 1 / np.arange(1, 401)
    p /= p.sum()
    words = lambda n: " ".join(rnd.choice(vocab, size=n, p=p))
    docs = [(i, words(rnd.integers(1, 120))) for i in range(900)]
    items = [(1, words(30)), (2, words(5)), (3, docs[7][1]), (4, "w399 w398"), (5, "nothing of that"), (6, None), (7, "W1, w1. w1!"), (7, "w2"), (None, "w3 w4")]
    docs += [(2000 + i, docs[7][1] + " tail") for i in range(40)] + [(50, docs[50][1])] * 3 + [(None, docs[9][1]), (3000, None), (3001, " . "), (3002, "w5 " * 30_000)]
    got = [tuple(r) for r in lexical.search(_rows(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(got, key=str) == _ranked(docs, items, 20)


def test_pruning_leaves_few_to_score(spark):
    """Of all pairs of an item and a document that share a term only a small part is scored."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toArrow()
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").toPandas()
    block = lexical.Items(items.item_id.tolist(), items.text.tolist())
    scored = [0]
    add = lexical._Found.add

    def counted(self, scores, ids):
        scored[0] += len(ids)
        add(self, scores, ids)

    rows = []
    for d, x in zip(docs.column(0).to_pylist(), docs.column(1).to_pylist(), strict=True):
        c = Counter(_terms(x))
        known = [(i, c[t]) for i, t in enumerate(block.terms.to_pylist()) if t in c]
        rows.append((d, sum(c.values()), known))
    n_all, l_all = len(rows), sum(n for _, n, _ in rows)
    df = Counter(i for _, _, k in rows for i, _ in k)
    weights = np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[i] + 1))) for i in range(len(block.terms))])
    made = []
    for d, n, known in rows:
        m = 75 + (25 * n * n_all) // l_all
        length = math.sqrt(sum(weights[i] * float((1_000_000_000 * t) // (1000 * t + 12 * m)) ** 2 for i, t in known))
        made.append({"doc_id": d, "m": m, "terms": [i for i, _ in known], "tfs": [t for _, t in known], "length": length})
    made.sort(key=lambda r: -r["length"])
    batch = pa.RecordBatch.from_pylist(made, schema=pa.schema([("doc_id", pa.int64()), ("m", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("length", pa.float64())]))
    found = [lexical._Found(0, 20) for _ in block.vectors]
    lexical._Found.add = counted
    try:
        scratch = np.zeros(len(weights), np.int64)
        for part in lexical._cut(iter([batch.slice(k, 100) for k in range(0, len(made), 100)])):
            bucket = lexical._Bucket(part, weights, len(weights))
            for (terms, times), f in zip(block.vectors, found, strict=True):
                bucket.search(terms, times, np.sqrt(weights), scratch, f)
    finally:
        lexical._Found.add = add
    share = sum(bool({i for i, _ in k} & set(t.tolist())) for _, _, k in rows for t, _ in block.vectors)
    print("scored", scored[0], "of", share)
    assert scored[0] < 0.5 * share


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs, items).collect() == []
    some = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert lexical.search(some, items.limit(0)).collect() == []
    assert lexical.search(some, spark.createDataFrame([(1, None), (2, "b")], "item_id long, text string")).collect() == []
    assert [tuple(r) for r in lexical.search(some, items).collect()] == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 12 * 100)))]
