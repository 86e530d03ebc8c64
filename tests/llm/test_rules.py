"""The native operators against their SQL, on small tables with odd rows."""

import textwrap
from collections import Counter

import duckdb
import numpy as np
import pytest

from kilnworks.llm import decontaminate, licences, oracles, quality

SCHEMA = "doc_id long, text string, source string, w string, t1 long, licence string"
ITEMS = [(1, " ".join(f"item{k}" for k in range(30))), (2, "alpha beta gamma"), (3, "one"), (4, None), (5, ""), (6, "a b a b a b a b a b a b"),
         (7, " ".join(f"long{k % 17}" for k in range(90))), (7, " ".join(f"long{k % 17}" for k in range(90))), (None, "null item words are five here now")]


def _docs():
    rnd = np.random.default_rng(11)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("a", "e", "io", "ü", "#")]
    line = lambda k: " ".join(rnd.choice(words, size=k))
    notices = list(licences.NOTICES.values())
    common = [line(12), line(25)]
    rows = []
    for d in range(90):
        parts = [line(int(rnd.integers(1, 60))) for _ in range(int(rnd.integers(1, 6)))]
        if d % 3 == 0:
            parts += [common[d % 2], common[d % 2]]
        if d % 5 == 0:
            parts.append(notices[d % len(notices)].upper() if d % 2 else notices[d % len(notices)] + " and so on")
        if d % 7 == 0:
            parts.append(parts[0])
        if d % 6 == 0:
            item = (ITEMS[d // 6 % len(ITEMS)][1] or "x").split()
            if d % 4 == 0 and len(item) > 9:
                item[4 + d % 3] = "changed"
            parts.append(" ".join(item))
        rows.append((d, "\n".join(parts), f"h{d % 3}" if d % 10 else None))
    rows += [(100, None, "h0"), (101, "", "h1"), (102, " \n\t ", None), (103, "one", "h1"), (None, rows[6][1], "h0"), (6, rows[6][1], rows[6][2]), (104, "a b " * 4000, "h2"),
             (105, "Alpha, BETA; gamma!", "h2"), (106, "\n".join(notices), "h0")]
    return rows


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", _docs())
    c.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO benchmark VALUES (?, ?)", ITEMS)
    return c


def _frame(spark, rows):
    return spark.createDataFrame([(d, x, s, "w", 1, "l") for d, x, s in rows], SCHEMA).repartition(3)


def _same(df, con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    order = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(rel.fetchall(), key=order)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=order)
    assert got == want
    return got


def test_licences_equal_sql(spark, con):
    rows = _same(licences.scan(_frame(spark, _docs())), con, oracles.licences())
    assert len({r[1] for r in rows}) > 8
    assert licences.scan(_frame(spark, [])).count() == 0
    assert licences.scan(_frame(spark, _docs()), {}).where("licence is not null").count() == 0


@pytest.mark.parametrize("name", ["MIT-text", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0-boilerplate", "GPL-2.0-notice", "GPL-3.0-header", "ISC-text", "Zlib", "MIT", "CC-BY-4.0"])
def test_wrapped_notices_inside_files(spark, name):
    """Notices wrapped at 60 columns behind comment marks, with a holder, in the middle of a file, or in a longer line."""
    rnd = np.random.default_rng(5)
    filler = lambda k: " ".join(f"f{rnd.integers(1000)}" for _ in range(k))
    notice = licences.NOTICES[name]
    lines = textwrap.wrap(notice, 60)
    docs = [(1, "\n".join([filler(30), "# Copyright (c) 2020 A. Holder", *[f"# {x}" for x in lines], filler(300), "x = 1"]), "h"),
            (2, f"{filler(40)} {notice.lower()} {filler(7)}\n{filler(9)}", "h"), (3, " * ".join(["/*", *lines, "*/"]), "h"),
            (4, "\n".join([filler(30), *lines[:len(lines) // 3], filler(60)]) if len(lines) > 3 else filler(50), "h")]
    got = {r.doc_id: r for r in licences.scan(_frame(spark, docs)).collect()}
    assert {got[d].licence for d in (1, 2, 3)} == {name} and got[4].licence != name
    assert len(lines) == 1 or (got[1].unit is None and got[1].word_start > 30)


def test_lines_of_copies_count_by_document(spark):
    """A line in 200 copies of one text is in 200 documents; rows that repeat one document are not."""
    words = [f"w{k}" for k in range(60)]
    text = " ".join(words[:30]) + "\n" + " ".join(words[30:])
    copies = [(d, text, "a") for d in range(200)]
    same = [(1000, "other " + text, "b")] * 200
    got = {(r.doc_id, r.removed_lines, r.kept) for r in quality.judge(_frame(spark, copies + same)).collect()}
    assert got == {(d, 2, False) for d in range(200)} | {(1000, 0, True)}


@pytest.mark.parametrize("most", [3, 12, 100])
def test_quality_equals_sql(spark, con, most):
    rows = _same(quality.judge(_frame(spark, _docs()), max_documents=most), con, oracles.quality(most, quality.LEAST_WORDS, quality.LEAST_PERCENT))
    assert len(rows) == len(_docs())
    assert quality.judge(_frame(spark, [])).count() == 0


def test_leaks_equal_sql(spark, con, monkeypatch):
    own = "SELECT doc_id, item_id, window_start, shared, total"
    sql = f"{own} FROM ({oracles.leaked()})"
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    # an id of null cannot name an item in SQL joins, nor tell two items apart: compare without it
    sql = sql.replace("FROM benchmark", "FROM (SELECT * FROM benchmark WHERE item_id IS NOT NULL)")
    found = decontaminate.leaks(_frame(spark, _docs()), benchmark.where("item_id is not null")).select("doc_id", "item_id", "window_start", "shared", "total")
    rows = _same(found, con, sql)
    assert {1, 2, 3, 6, 7} <= {r[1] for r in rows}
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", 20)  # the benchmark in several blocks
    again = decontaminate.leaks(_frame(spark, _docs()), benchmark.where("item_id is not null")).select("doc_id", "item_id", "window_start", "shared", "total")
    assert _same(again, con, sql) == rows


def _grams(w, k=5):
    return Counter(zip(*[w[i:] for i in range(k)]))


def _best_window(text, item):
    """Shared, total and start of the best of all windows, or None."""
    w, it = text.split(), item.split()
    best = None
    for start in range(max(1, len(w) - len(it) + 1)):
        a, b = _grams(w[start:start + len(it)]), _grams(it)
        shared = (a & b).total()
        total = a.total() + b.total() - shared
        if 100 * shared >= 80 * total and (best is None or shared / total > best[0] / best[1]):
            best = (shared, total, start)
    return best


def test_leaks_in_another_order(spark):
    rnd = np.random.default_rng(3)
    filler = lambda k: [f"f{rnd.integers(10_000)}" for _ in range(k)]
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in (45, 55, 100)]
    docs = []
    for n, text in items:
        w = text.split()
        for d, parts in enumerate((w, w[n // 2:] + w[:n // 2], w[2 * n // 3:] + w[:2 * n // 3], w[::-1], w[n // 3:], w[:n // 2] + w[:n // 2])):
            docs += [(n * 10 + d, " ".join(filler(40 + d) + parts + filler(50)), "h"), (5000 + n * 10 + d, " ".join(parts), "h")]
    want = {(d, n): _best_window(x, text) for d, x, _ in docs for n, text in items if _best_window(x, text)}
    found = decontaminate.leaks(_frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(451, 45), (551, 55), (1001, 100)} <= set(want)
    assert {(r.doc_id, r.item_id): (r.shared, r.total, r.window_start) for r in found} == want


def test_documents_without_leaks(spark):
    docs, benchmark = _frame(spark, _docs()), spark.createDataFrame(ITEMS, "item_id long, text string")
    bad = {r.t1 for r in decontaminate.leaks(docs, benchmark).select("t1").collect()}
    rest = decontaminate.without_leaks(docs, benchmark)
    assert rest.columns == docs.columns
    text_hashes = docs.selectExpr("doc_id", "xxhash64(coalesce(text, '\\0null')) AS h").collect()
    assert rest.count() == sum(r.h not in bad for r in text_hashes) < len(_docs())
    assert decontaminate.without_leaks(docs, benchmark.where("false")).count() == len(_docs())
    assert decontaminate.without_leaks(docs.where("false"), benchmark).count() == 0
