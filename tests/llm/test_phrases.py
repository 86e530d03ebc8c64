"""Counting quotient filters and phrase mining against plain counting."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kilnworks.llm import phrases, quotient


@pytest.mark.parametrize(("n", "bits"), [(2, 1), (2, 32), (3, 13), (3, 32), (4, 7), (4, 16), (4, 17), (4, 32)])
def test_keys_come_back_and_filters_hold_exact_counts(n, bits):
    keys, rnd = quotient.Keys(n, bits), np.random.default_rng(n * 100 + bits)
    ids = rnd.integers(0, 1 << bits, size=(4000, n))
    ids[::3] = ids[0]
    lanes = keys.pack([ids[:, k] for k in range(n)])
    assert (np.stack(keys.unpack(*lanes), axis=1) == ids).all()
    want = Counter(map(tuple, ids.tolist()))
    for prefix in {0, min(3, keys.left), min(keys.left, 9)}:
        parts = []
        for half in (slice(0, 1500), slice(1500, None)):
            left, right, counts = keys.summed(lanes[0][half], lanes[1][half], np.ones(len(ids[half]), np.int64))
            place = (left >> np.uint64(keys.left - prefix)).astype(int) if prefix else np.zeros(len(left), int)
            parts += [(p, quotient.encode(keys, prefix, left[place == p], right[place == p], counts[place == p])) for p in np.unique(place)]
        got = {}
        for p in {p for p, _ in parts}:
            merged = keys.summed(*(np.concatenate(x) for x in zip(*(quotient.decode(keys, p, f) for q, f in parts if q == p), strict=True)))
            data = quotient.encode(keys, prefix, *merged)
            left, right, counts = quotient.decode(keys, p, data)
            found = list(zip(map(tuple, np.stack(keys.unpack(left, right), axis=1).tolist()), counts.tolist(), strict=True))
            got |= dict(found)
            assert quotient.find(keys, p, data, list(found[0][0])) == found[0][1]
        assert got == want


def test_empty_filter():
    keys = quotient.Keys(2, 8)
    none = np.empty(0, np.uint64)
    left, right, counts = quotient.decode(keys, 0, quotient.encode(keys, 0, none, none, np.empty(0, np.int64)))
    assert not len(left) and not len(right) and not len(counts)


def _pieces(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aAÉ \t.,\n\x0b\x1c b?", max_size=30)), max_size=6))
def test_streams_are_the_pieces(texts):
    codes, words = phrases.word_stream(pa.array(texts, pa.string()))
    names = words.to_pylist()
    got = [[]]
    for c in codes.tolist():
        if c < 0:
            got.append([])
        else:
            got[-1].append(names[c])
    assert [p for p in got if p] == [p for x in texts for p in _pieces(x) if p]


def _mined(docs, least, longest, cover, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        for w in _pieces(text):
            n[lang or "und"] += len(w)
            for j in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i:i + j]) for i in range(len(w) - j + 1))
    out = []
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        rows = []
        for p, a in often.items():
            if any(100 * b >= cover * a for q, b in often.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, _, l, r = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def test_mining_equals_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RANGE_ENTRIES", 500)
    monkeypatch.setattr(phrases, "HELD_ENTRIES", 300)
    rnd = np.random.default_rng(4)
    vocab = ["the", "of", "São", "Paulo", "new", "york", "times", "x", "日本", "City", "a1"]
    weights = np.array([9, 7, 4, 4, 3, 3, 2, 2, 1, 1, 1]) / 37
    docs = []
    for i in range(260):
        w = rnd.choice(vocab, size=rnd.integers(0, 40), p=weights).tolist()
        for _ in range(rnd.integers(0, 4)):
            w += ["New", "York", "City"] if rnd.random() < 0.5 else ["são", "paulo"]
        text = "".join(x + rnd.choice([" ", "\t ", ". ", ",", "\n"], p=[0.8, 0.1, 0.04, 0.03, 0.03]) for x in w)
        docs.append((["en", "pt", None][i % 3], text))
    docs += [("en", None), ("en", ""), (None, " . \t,"), ("pt", "São Paulo " * 4000)] + [("en", "same words here")] * 50
    df = spark.createDataFrame([(k, *d, 1, "z", 5) for k, d in enumerate(docs)], "doc_id long, lang string, text string, rank int, shard string, ids int").repartition(5)
    for least, top, sent in ((30, 2000, 500_000), (3, 7, 500_000), (3, 7, 0)):
        monkeypatch.setattr(phrases, "SENT_WORDS", sent)
        monkeypatch.setattr(phrases, "SENT_PAIRS", sent)
        got = sorted(tuple(r) for r in phrases.mine(df, least=least, top=top).collect())
        assert got == _mined(docs, least, 4, 80, top) and got


def test_empty_and_wordless_tables(spark):
    for rows in ([], [("en", None), (None, "")], [("en", "a b"), ("fr", "c")]):
        assert phrases.mine(spark.createDataFrame(rows, "lang string, text string")).collect() == []
