"""Line dedup, near duplicates and byte dedup against brute force."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from kilnworks.llm import bytededup, graph, linedup, minhash, oracles
from kilnworks.llm.graph import components
from kilnworks.session import durable

SCHEMA = "doc_id long, text string, k1 string, t long"  # the last two clash with names of the operators


def _frame(spark, texts, parts=3):
    return spark.createDataFrame([(d, x, "k", 3) for d, x in texts], SCHEMA).repartition(parts)


def _vocabulary(rnd, n=400):
    return ["".join(rnd.choice(list("abcdefghij"), size=rnd.integers(2, 9))) for _ in range(n)]


def _corpus(seed, n=60):
    """Texts with exact copies, near copies, shared passages, repeated lines, nulls and repeated rows."""
    rnd = np.random.default_rng(seed)
    words = _vocabulary(rnd)
    line = lambda k: " ".join(rnd.choice(words, size=k))
    passage = "\n".join(line(30) for _ in range(3))
    out = []
    for d in range(n):
        kind = d % 8
        if kind == 1 and out:
            text = out[rnd.integers(len(out))][1]
        elif kind == 2 and out:
            base = (out[rnd.integers(len(out))][1] or "").split(" ")
            for _ in range(2):
                base[rnd.integers(len(base))] = "edited"
            text = " ".join(base)
        elif kind == 3:
            text = f"{line(20)}\n{passage}\n\n{line(10)}"
        elif kind == 4:
            text = ["", " \n ", "one", "one two", None, "a b a b a b"][rnd.integers(6)]
        elif kind == 5:
            text = "\n".join([line(9)] * int(rnd.integers(1, 12)) + [line(60)] * 2)
        else:
            text = "\n".join(line(int(rnd.integers(1, 80))) for _ in range(int(rnd.integers(1, 9))))
        out.append((d, text))
    return [*out, (3, out[3][1]), (None, out[6][1]), (None, None), (900, "z" * 1500), (901, "z" * 1500 + "é" * 300)]


def test_components(spark):
    edges = [(a, a + 1) for a in range(0, 90) if a % 30 != 29] + [(200, 5)] + [(1000, k) for k in range(1001, 1100)]
    got = {r.c: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == k // 30 * 30 for k in range(90)) and got[200] == 0 and {got[k] for k in range(1000, 1100)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("shape", ["path", "caterpillar", "zigzag"])
def test_component_rounds_grow_slowly(spark, monkeypatch, shape):
    """Paths of 5,000 nodes in random and in alternating order; each round has at most three tables."""
    n, rnd = 5000, np.random.default_rng(3)
    names = {"path": rnd.permutation(n), "caterpillar": rnd.permutation(n), "zigzag": [k // 2 if k % 2 else n - k // 2 for k in range(n)]}[shape]
    ends = [(k, k + 1) if shape != "caterpillar" else (k - k % 10, k + 1 if k % 10 < 9 else k + 1) for k in range(n - 1)]
    edges = [(int(names[a]), int(names[b])) for a, b in ends]
    written = [0]

    def counted(df):
        written[0] += 1
        return df.sparkSession.createDataFrame(df.toArrow(), df.schema) if written[0] % 9 else durable(df)

    monkeypatch.setattr(graph, "durable", counted)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == n and {r.label for r in got} == {min(min(e) for e in edges)}
    assert written[0] <= 3 * 20


@pytest.mark.parametrize("least", [1, 50])
def test_line_dedup_equals_sql(spark, least):
    texts = _corpus(1)
    con = duckdb.connect()
    con.execute("CREATE TABLE rows (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO rows VALUES (?, ?)", texts)
    con.execute("CREATE VIEW documents AS SELECT DISTINCT * FROM rows")
    want = {(d, n, h) for d, n, h in con.execute(oracles.deduplicated_lines(least)).fetchall()}
    rows = linedup.dedup_lines(_frame(spark, texts), least)
    assert rows.columns == ["doc_id", "text", "k1", "t", "line_starts", "line_ends"]
    rows.createOrReplaceTempView("line_rows")
    got = spark.sql("""SELECT doc_id, coalesce(aggregate(zip_with(line_starts, line_ends, (a, b) -> b - a), 0, (n, x) -> n + x), 0) AS n, md5(text) AS h
                       FROM line_rows""").collect()
    assert len(got) == len(texts) and {tuple(r) for r in got} == want
    assert any(n for _, n, _ in want)


def _maximal_repeats(texts, least):
    """Lines (numbered among lines with a word) that a run of at least ``least`` words shares with an earlier start."""
    lines = [[x for x in text.split("\n") if x.split()] for _, text in texts]
    places = [(d, i) for d, x in enumerate(lines) for i in range(len(x))]
    gone = [set() for _ in texts]
    for n, (d, i) in enumerate(places):
        for e, j in places[:n]:
            size = 0
            while i + size < len(lines[d]) and j + size < len(lines[e]) and lines[d][i + size] == lines[e][j + size]:
                size += 1
            if sum(len(x.split()) for x in lines[d][i:i + size]) >= least:
                gone[d] |= set(range(i, i + size))
    return [sorted(g) for g in gone]


def test_whole_repeated_runs_go(spark):
    rnd = np.random.default_rng(5)
    words = _vocabulary(rnd)
    line = lambda k: " ".join(rnd.choice(words, size=k))
    pool = [line(int(k)) for k in rnd.choice([1, 2, 5, 8, 20, 45, 60], size=14)]
    long, short, other = line(60), line(5), line(7)
    texts = [(0, f"{long}\n{short}"), (1, f"{long}\n{short}"), (2, f"{long}\n{other}"), (3, f"{long}\n{other}\n{line(9)}")]
    for d in range(4, 40):
        at = int(rnd.integers(len(pool)))
        texts.append((d, "\n".join([line(int(rnd.integers(1, 9)))] * (d % 2) + (pool * 2)[at:at + int(rnd.integers(1, 12))])))
    want = _maximal_repeats(texts, 50)
    got = {r.doc_id: [k for a, b in zip(r.line_starts or [], r.line_ends or []) for k in range(a, b)] for r in linedup.dedup_lines(_frame(spark, texts)).collect()}
    assert got[1] == [0, 1] and got[2] == [0] and got[3] == [0, 1]
    assert [got[d] for d, _ in texts] == want


def test_line_dedup_of_nothing(spark):
    assert linedup.dedup_lines(_frame(spark, [])).count() == 0
    assert linedup.dedup_lines(_frame(spark, [(1, None), (2, "")])).where("line_starts is not null").count() == 0


def _shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def _brute_components(texts, k, percent):
    sets = [_shingles(x, k) for _, x in texts]
    parent = list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for a in range(len(texts)):
        groups[find(a)].append(texts[a][0])
    return [(d, len(s), min((x for x in groups[find(n)] if x is not None), default=None)) for n, ((d, _), s) in enumerate(zip(texts, sets))]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(spark, k, percent, monkeypatch):
    monkeypatch.setattr(minhash, "STAR_ROWS", 2)
    texts = _corpus(2, 90)
    got = minhash.near_duplicates(_frame(spark, texts), k, percent).collect()
    want = _brute_components(texts, k, percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chain_of_near_copies_is_one_component(spark):
    """Neighbours are similar, the ends are not, so no single centre links them all."""
    words = [f"w{k}" for k in range(200)]
    texts = [(k, " ".join([f"x{j}" for j in range(4 * k)] + words[4 * k:])) for k in range(25)]
    got = minhash.near_duplicates(_frame(spark, texts)).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 25


def test_one_row_of_each_component_stays(spark):
    texts = _corpus(2, 90)
    rows = minhash.one_of_each(_frame(spark, texts), 3, 85)
    assert rows.columns == ["doc_id", "text", "k1", "t"]
    want = _brute_components(texts, 3, 85)
    empty = sum(1 for _, n, _ in want if not n)
    kept = rows.collect()
    assert len(kept) == empty + len({c for _, n, c in want if n})
    assert {r.doc_id for r in kept if r.text and r.text.split()} == {c for _, n, c in want if n}
    assert minhash.one_of_each(_frame(spark, [])).count() == 0


def _brute_bytes(texts):
    length = bytededup.LENGTH
    data = [(d, (x or "").encode()) for d, x in texts]
    seen = Counter(b[s:s + length] for _, b in data for s in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                gone[s:s + length] = True
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), bytes(x for x, g in zip(b, gone) if not g)))
    return Counter(out)


def _own_bytes(frame):
    return Counter((r.doc_id, r.n_bytes, sum(b - a for a, b in zip(r.starts, r.ends)), len(r.starts), bytes(r.kept)) for r in bytededup.removed_bytes(frame).collect())


@pytest.mark.parametrize("seed", [3, 4])
def test_byte_dedup_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(bytededup, "RANGE_ITEMS", 40)  # many ranges, so neighbours meet across them
    texts = _corpus(seed, 70)
    rnd = np.random.default_rng(seed)
    body = " ".join(rnd.choice(_vocabulary(rnd), size=500))
    for k in range(12):  # many contexts of one group, with edits at different places
        cut = list(body[int(rnd.integers(0, 300)):int(rnd.integers(1500, 3000))])
        for _ in range(int(rnd.integers(0, 4))):
            cut[int(rnd.integers(len(cut)))] = "#"
        texts.append((2000 + k, "".join(cut)))
    assert _own_bytes(_frame(spark, texts)) == _brute_bytes(texts)


def test_byte_dedup_counts_windows_that_neighbours_leave_open(spark):
    """Left and right partners differ, so the longest match on either side does not tell which windows repeat."""
    rnd = np.random.default_rng(9)
    text = lambda n: "".join(rnd.choice(list("abcdefgh"), size=n))
    middle = text(230)
    left, right = [text(300) for _ in range(4)], [text(300) for _ in range(4)]
    texts = [(10 * a + b, left[a][k:] + middle + right[b][:300 - k]) for a in range(4) for b in range(4) for k in (0,) if (a + b) % 3]
    texts += [(100 + k, left[k][150:] + middle + right[k][:90] + text(200)) for k in range(4)]
    texts += [(200 + k, text(150) + left[k][210:] + middle + right[(k + 1) % 4][:200] + text(100)) for k in range(4)]
    assert _own_bytes(_frame(spark, texts)) == _brute_bytes(texts)


def test_byte_dedup_of_nothing(spark):
    assert bytededup.removed_bytes(_frame(spark, [])).count() == 0


def test_repeats_elsewhere_are_told_from_own_ones(spark):
    rnd = np.random.default_rng(12)
    some = lambda n: "".join(rnd.choice(list("abcdefghij "), size=n))
    own, shared, whole = some(600), some(700), some(900)
    texts = [(1, own + "x" + own), (2, some(300) + shared), (3, shared + some(200)), (4, whole), (5, whole), (6, some(3000)), (7, None)]
    got = {r.doc_id: (bool(r.starts), r.elsewhere) for r in bytededup.removed_bytes(_frame(spark, texts)).collect()}
    assert got == {1: (True, False), 2: (True, True), 3: (True, True), 4: (True, True), 5: (True, True), 6: (False, False), 7: (False, False)}


def test_loser_tree_merges_front_coded_runs():
    rnd = np.random.default_rng(5)
    for n_runs in (1, 2, 3, 7):
        runs, everything = [], []
        for _ in range(n_runs):
            strings = sorted("".join(rnd.choice(list("ab"), size=rnd.integers(0, 9))).encode() * int(rnd.integers(1, 4)) for _ in range(int(rnd.integers(1, 40))))
            shared, rests = bytededup.front_coded(strings)
            runs.append(bytededup._Run(shared, [len(s) for s in strings], rests, strings))
            everything += strings
        got = list(bytededup.merged(runs))
        assert [s for s, _, _ in got] == sorted(everything) and all(s == m for s, _, m in got)
        last = b""
        for s, h, _ in got:
            assert h == bytededup.common(last, s, 0) == next((k for k, (a, b) in enumerate(zip(last, s)) if a != b), min(len(last), len(s)))
            last = s


def test_very_long_texts_are_linked(spark):
    rnd = np.random.default_rng(21)
    words = [f"w{k}" for k in rnd.integers(0, 10**9, size=150_000)]
    near, far = list(words), list(words)
    near[::900] = ["changed"] * len(near[::900])
    far[::5] = ["changed"] * len(far[::5])
    texts = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, "short one two three")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(_frame(spark, texts)).collect()}
    assert got[1][0] == 149_998 and got[1][1] == got[2][1] == 1 and got[3][1] == 3 and got[4] == (2, 4)
