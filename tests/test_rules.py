"""Small fixed cases for money, privacy, labels, weights, alerts and files."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from kilnworks.functions import inventory as V
from kilnworks.functions import money as M
from kilnworks.functions import pii, text
from kilnworks.functions import quote as Q
from kilnworks.operators import labels, sweep
from kilnworks.operators import weights as W
from kilnworks.operators.graph import family_roots
from kilnworks.sources import files as L


def test_hmac_equals_python(spark):
    for salt in ("s", "x" * 100):
        got = spark.createDataFrame([("ünï-7",), ("",), (None,)], "v string").select(pii.pseudonym(F.col("v"), salt).alias("t")).collect()
        assert got[0]["t"] == hmac.new(salt.encode(), "ünï-7".encode(), hashlib.sha256).hexdigest()
        assert got[1]["t"] is None and got[2]["t"] is None


def test_money(spark):
    r = spark.sql("SELECT 0.125D AS p, 10D AS b, 110D AS a, 100D AS e").select(
        M.line_amount(F.lit(1.0), F.col("p")).alias("amt"), M.clamp_price(F.lit(13.5), F.col("b")).alias("c"),
        M.is_overrun(F.col("a"), F.col("e")).alias("o"), M.is_overrun(F.col("a"), F.lit(0.0)).alias("z")).first()
    assert str(r["amt"]) == "0.13" and str(r["c"]) == "13.00" and r["o"] is False and r["z"] is False


@pytest.mark.parametrize("status, want", [("Closed Won", 1.0), ("LOSS", 0.0), ("won back after loss", None), ("winning", None), ("Order confirmed", 1.0)])
def test_text_outcome(spark, status, want):
    assert spark.range(1).select(Q.text_outcome(F.lit(status)).alias("v")).first()["v"] == want


def test_unknown_vocabulary_is_refused(spark):
    df = spark.createDataFrame([("Sent",), ("Open",)], "statusName string")
    with pytest.raises(ValueError):
        labels.derive_label(df)


def test_family_roots(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 99)], "id bigint, up bigint")
    assert {r["id"]: r["root"] for r in family_roots(df, "id", "up").collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 99}
    with pytest.raises(ValueError):
        family_roots(spark.createDataFrame([(1, 2), (2, 1)], "id bigint, up bigint"), "id", "up")


def signals(spark, **cols):
    rows = [("t", i, s, p, lo, hi) for i, (s, p, lo, hi) in enumerate(W.SIGNALS)]
    df = spark.createDataFrame(rows, "tenant string, ord int, signal string, prior_bp bigint, min_bp bigint, max_bp bigint")
    return df.withColumns({k: F.element_at(F.array(*[F.lit(x) for x in v]), F.col("ord") + 1) for k, v in cols.items()})


def test_weights_always_add_up(spark):
    out = W.redistribute(signals(spark, available=[True, False, True, False, True])).collect()
    assert sum(r["new_prior_bp"] for r in out) == 10000 and all(r["new_prior_bp"] == 0 for r in out if not r["available"])
    out = W.redistribute(signals(spark, available=[False] * 5)).collect()
    assert sum(r["new_prior_bp"] for r in out) == 0
    out = W.blend(signals(spark, fitted_bp=[1, 2, 3, 4, 9990], lambda_bp=[3333] * 5)).collect()
    assert sum(r["final_bp"] for r in out) == 10000
    out = W.project(signals(spark, adjust_bp=[2900, -2900, 0, 0, 0])).collect()
    assert all(r["success"] for r in out) and sum(r["projected_bp"] for r in out) == 10000
    assert all(r["min_bp"] <= r["projected_bp"] <= r["max_bp"] for r in out)


def test_trust_is_zero_at_the_floor_and_grows(spark):
    got = spark.createDataFrame([(n,) for n in (0, 40, 41, 80, 400)], "n int").select(W.trust_bp(F.col("n"), F.lit(40)).alias("l")).collect()
    lam = [r["l"] for r in got]
    assert lam[:2] == [0, 0] and lam == sorted(lam) and lam[3] == 5000


def test_unknown_reliability_is_unreliable_and_never_suppresses(spark):
    df = spark.sql("SELECT 5D AS available_qty, 0D AS reserved_qty, 10D AS rop, 9D AS open_qty, CAST(NULL AS DOUBLE) AS open_po_vendor_reliability, DATE'2024-01-01' AS snapshot_date")
    f = V.engineer(df)
    r = f.select(V.rule_flags()["unreliable_po_coverage"].alias("u"), V.suppressed().alias("s")).first()
    assert r["u"] is True and r["s"] is False


def test_run_and_rise(spark):
    a = F.array(*[F.lit(x) for x in (0.9, 0.88, 0.86, 0.5, 0.87)])
    r = spark.range(1).select(sweep.longest_run(a, F.lit(0), F.lit(0.85)).alias("i"), sweep.rises(a).alias("up"),
                              sweep.monotone_envelope(a).alias("m")).first()
    assert r["i"] == 2 and r["up"] and r["m"][-1] == 0.5


def test_job_key(spark):
    got = spark.range(1).select(text.job_key(F.lit("WH/MO/00142")).alias("k"), text.job_key(F.lit("//")).alias("j")).first()
    assert got["k"] == "WH_MO_00142-" + hashlib.sha256(b"WH/MO/00142").hexdigest()[:10] and got["j"].startswith("job-")


def test_non_finite_json_is_refused(spark, tmp_path):
    bad = spark.createDataFrame([(1.0,), (float("inf"),)], "v double")
    with pytest.raises(ValueError):
        L.write_json_records(bad, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_missing_columns_and_bad_dates_are_refused(spark, tmp_path):
    p = str(tmp_path / "q")
    spark.createDataFrame([("a",)], "quotationID string").write.option("header", True).csv(p)
    with pytest.raises(ValueError):
        L.read_quote_export(spark, p)


def test_json_merge_payload_wins(spark):
    got = spark.range(1).select(L.merge_json(F.lit('{"a": 1, "b": {"c": 2}}'), F.lit('{"a": {"d": 3}}')).alias("j")).first()["j"]
    import json
    assert json.loads(got) == {"a": {"d": 3}, "b": {"c": 2}}
