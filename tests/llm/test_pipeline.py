"""The pipeline's stages against brute-force versions of each, on the smallest tables."""

import os
from collections import defaultdict

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as cp
from kilnworks.llm import linedup, oracles
from kilnworks.llm import toxicity as pu
from tests.llm.test_dedup import _brute_components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert 4 <= len(cp.STAGES) <= 5


def _table(con, name, rows):
    con.execute(f"CREATE OR REPLACE TABLE {name} (doc_id BIGINT, text VARCHAR)")
    con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)


def test_stages_equal_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    scorer = pu.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {d: x for d, x in texts.items() if scorer.score(x) < 0.7}
    docs = cp.toxicity(spark, docs, SF)
    columns = docs.columns
    assert {r.doc_id: r.text for r in docs.collect()} == want and len(want) < len(texts)

    _table(con, "documents", sorted(want.items()))
    lines = {d: (n, h) for d, n, h in con.execute(oracles.deduplicated_lines(linedup.LEAST_WORDS)).fetchall()}
    docs = cp.line_dedup(spark, docs, SF)
    got = docs.selectExpr("doc_id", "text", "md5(text) AS h", "n_chars").collect()
    empty = con.execute("SELECT md5('')").fetchone()[0]
    assert {r.doc_id: r.h for r in got} == {d: h for d, (n, h) in lines.items() if not (n and h == empty)}
    assert all(r.n_chars == len(r.text) for r in got) and docs.columns == columns

    rows = sorted((r.doc_id, r.text) for r in got)
    comps = defaultdict(list)
    for (d, _), (_, n, c) in zip(rows, _brute_components(rows, 5, 80)):
        comps[c if n else (d,)].append(d)
    docs = cp.near_duplicates(spark, docs, SF)
    left = {r.doc_id: r.text for r in docs.collect()}
    assert set(left) == {min(g) for g in comps.values()} and docs.columns == columns

    _table(con, "documents", sorted(left.items()))
    leaked = {r[0] for r in con.execute(oracles.leaked()).fetchall()}
    docs = cp.decontamination(spark, docs, SF)
    clean = {r.doc_id: r.text for r in docs.collect()}
    assert set(clean) == set(left) - leaked and leaked and docs.columns == columns

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = defaultdict(int)
    for r in cp.packed(spark, docs, SF).collect():
        sizes[r.doc_id] += r.length
    assert sizes == {d: len(plain.encode(x, add_special_tokens=False).ids) + 1 for d, x in clean.items()}


def test_run_takes_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, line_starts string, label string"
    rows = [(None, None, None, None, None, "x", "y"), (1, "", "en", "a", 0, None, None), (2, "one", None, "a", 3, "x", None), (2, "one", None, "a", 3, "x", None),
            (3, "word " * 60, "en", None, None, None, "z")]
    for n, some in enumerate((rows, [])):
        folder = f"{tmp_path}/{n}"
        spark.createDataFrame(some, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, None, 1), (None, 1, None)] if some else [], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(None, None), (1, "")] if some else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        after = cp.line_dedup(spark, docs, folder)
        assert after.columns == docs.columns and sorted(str(r.line_starts) for r in after.collect()) == sorted(str(r.line_starts) for r in docs.collect())
        assert sorted({r.doc_id if r.doc_id is not None else -1 for r in cp.run(spark, folder).collect()}) == ([-1, 1, 2, 3] if some else [])
