"""Toxicity and language models: held-out accuracy, and probabilities that sum to one."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnworks.llm import langid, toxicity

SF = "/root/testdata/sf0.01"


def _toxic_rows(n=600):
    rnd = np.random.default_rng(8)
    words = [f"w{k}" for k in range(300)]
    bad = ["vilest", "scorned", "rotten", "cursed"]
    docs, labels = [], []
    for d in range(n):
        text = list(rnd.choice(words, size=rnd.integers(5, 60)))
        toxic = d % 6 == 0
        if toxic:
            text += [f"{w}{rnd.integers(30)}" for w in rnd.choice(bad, size=2)]
        docs.append((d, " ".join(text), "x", 1.0))
        if d % 2 == 0:
            labels.append((d, int(toxic), "extra"))
    return docs + [(5000, None, "x", 1.0), (5001, "", "x", 1.0), (None, "w1 w2", "x", 1.0), (6, docs[6][1], "x", 1.0)], labels + [(6, None, ""), (None, 1, ""), (12, 1, ""), (12, 0, "")]


def test_held_out_toxicity(spark):
    docs, labels = _toxic_rows()
    d = spark.createDataFrame(docs, "doc_id long, text string, p string, score double").repartition(3)
    scorer = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int, text string"))
    rows = toxicity.score(d, scorer).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.doc_id < 600]
    right = sum((r.score >= 0.7) == (r.doc_id % 6 == 0) for r in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and {r.score for r in rows if r.doc_id in (5000, 5001)} == {scorer.score(None)}
    rest = toxicity.without_toxic(d, scorer)
    assert rest.columns == d.columns and rest.count() == sum(r.score < 0.7 for r in rows)


def test_held_out_labels_are_not_learned(spark):
    docs, labels = _toxic_rows(200)
    d = spark.createDataFrame(docs, "doc_id long, text string, p string, score double")
    flipped = [(i, 1 - t if i is not None and t is not None and zlib.crc32(str(i).encode()) % 3 == 1 else t, x) for i, t, x in labels]
    a, b = (toxicity.fit(d, spark.createDataFrame(rows, "doc_id long, toxic int, text string")) for rows in (labels, flipped))
    assert (a.prior, a.bias, a.weights) == (b.prior, b.bias, b.weights)


def test_toxicity_without_positives(spark):
    d = spark.createDataFrame(_toxic_rows(30)[0], "doc_id long, text string, p string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(d, toxicity.fit(d, none)).collect()} == {0.0}
    only_bad = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    assert toxicity.score(d.where("false"), toxicity.fit(d.where("false"), only_bad)).count() == 0


def _languages():
    rnd = np.random.default_rng(2)
    parts = {"aa": ["ba", "bo", "lu"], "bb": ["schr", "ung", "keit"], "cc": ["é", "aux", "ou"]}
    rows = []
    for d in range(240):
        lang = ["aa", "bb", "cc"][d % 3]
        rows.append((d, " ".join("".join(rnd.choice(parts[lang], size=rnd.integers(1, 5))) for _ in range(int(rnd.integers(3, 40)))), lang, 1.0))
    return rows + [(900, None, "aa", 1.0), (901, "", "bb", 1.0), (902, "12 34 !?", None, 1.0), (903, "baboluba", None, 1.0), (None, "schrung", "bb", 1.0)]


def test_held_out_languages(spark):
    rows = _languages()
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3)
    got = langid.identify(d, toxicity.in_training()).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[d].lang_pred == lang for d, _, lang, _ in rows if d is not None and d < 240)
    assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 and by_id[k].rejected for k in (900, 901, 902))
    assert by_id[903].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got)
    assert langid.identify(d.where("false"), toxicity.in_training()).count() == 0
    assert {r.lang_pred for r in langid.identify(d, F.lit(False)).collect()} == {"und"}


@pytest.mark.parametrize("most", [1 << 17, 60])
def test_each_model_sums_to_one(spark, most):
    rows = [(lang, text) for _, text, lang, _ in _languages()]
    models = langid.fit(spark.createDataFrame(rows, "lang string, text string"), most)
    alphabet = sorted({c for _, x in rows if x for c in x.lower() if c.isalpha()}) + [langid.END]
    assert round(1 / models.floor) == len(alphabet) + 1
    for word in ("", "b", "bal", "schru"):
        total = sum(_step(models, langid.START + word + c) for c in [*alphabet, "\u0142"])  # the last was never seen
        assert np.allclose(total, 1, atol=1e-3), (word, total)
    costs, sizes = models.word_costs(["bal", "schrung"])
    assert sizes.tolist() == [4, 8]
    for word, cost in zip(("bal", "schrung"), costs):
        padded = langid.START + word + langid.END
        assert np.allclose(cost, sum(np.log(_step(models, padded[:k])) for k in range(2, len(padded) + 1)), atol=1e-3)


def test_models_keep_all_ngrams(spark):
    rnd = np.random.default_rng(4)
    words = sorted({"".join(w) for w in rnd.choice(list("abcdefghijklmnopqrstuvwxyz"), size=(30_000, 8))})
    rows = [("aa", " ".join(words[k::300])) for k in range(300)] + [("bb", "ab abc")]
    models = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    padded = [langid.START + w + langid.END for w in words]
    grams = {p[max(0, j - n):j] for p in padded for j in range(2, len(p) + 1) for n in range(1, langid.ORDER + 1)}
    assert len(grams) > 1 << 17
    for n in range(1, langid.ORDER + 1):
        some = sorted(g for g in grams if len(g) == n)
        hashes = np.array([langid._hashes(langid._codes(g), n)[-1] for g in some])
        at = np.searchsorted(models.keys, hashes)
        assert np.array_equal(models.keys[np.minimum(at, len(models.keys) - 1)], hashes), n
        # n-grams seen once may be discounted to nothing; those of lower orders are not
        assert n > 2 or (models.alpha[at][:, 0] > 0).all()


def _step(models, padded):
    """Probability of the last character after the others."""
    codes = langid._codes(padded)
    p = np.full(len(models.langs), models.floor)
    for order in range(1, min(langid.ORDER, len(codes)) + 1):
        gram, context = codes[-order:], codes[-order:-1]
        find = lambda x: (lambda h, i: i if i < len(models.keys) and models.keys[i] == h else None)(
            langid._hashes(x, len(x))[-1], int(np.searchsorted(models.keys, langid._hashes(x, len(x))[-1])))
        at, behind = find(gram), find(context) if order > 1 else None
        weight = models.gamma0 if order == 1 else models.gamma[behind] if behind is not None else 1
        p = (models.alpha[at] if at is not None else 0) + weight * p
    return p


def test_letters_are_unicode_letters():
    import sys
    import unicodedata
    for c in map(chr, range(sys.maxunicode + 1)):
        if not 0xD800 <= ord(c) <= 0xDFFF:
            assert bool(langid._LETTERS.fullmatch(c)) == unicodedata.category(c).startswith("L"), hex(ord(c))


def test_very_long_texts(spark):
    """A text of two million characters is scored like its words."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    scorer = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    rows = [r for r in docs.collect() if len(r.text or "") > 400][:6]
    long = spark.createDataFrame([(r.doc_id, r.lang, (r.text + "\n") * (2_000_000 // len(r.text))) for r in rows], "doc_id long, lang string, text string")
    short = spark.createDataFrame([(r.doc_id, r.lang, r.text) for r in rows], "doc_id long, lang string, text string")
    scores = [{r.doc_id: r.score for r in toxicity.score(df, scorer).collect()} for df in (long, short)]
    assert scores[0] == pytest.approx(scores[1])
    models = langid.fit(docs.where("crc32(cast(doc_id as string)) % 3 <> 1"))
    langs = [{r.doc_id: r.lang_pred for r in langid.predict(df, models, ["doc_id"]).collect()} for df in (long, short)]
    assert langs[0] == langs[1] and "und" not in langs[0].values()
