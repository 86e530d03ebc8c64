"""Registered price-sweep and draft-quote queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnworks.functions import quote as Q
from kilnworks.operators import sweep as W
from kilnworks.operators.labels import decided_headers
from kilnworks.operators.scale import with_group_totals, with_scalars
from kilnworks.plans import frames
from kilnworks.plans.catalog import query
from kilnworks.plans.quotes_queries import RATE_TABLE, rate_table
from kilnworks.sources import proxies as P
from kilnworks.sources.oracle_views import VIEWS

LO, HI = 0.70, 1.12
GRID = ", ".join(f"{v!r}::DOUBLE" for v in W.grid(LO, HI, W.SWEEP_POINTS))
STEEP, MIDDLE = "(3 + productID % 5)", "(0.9::DOUBLE + (quotationID % 7) / 20)"


def curve_sql(r: str) -> str:
    return f"(1 / (1 + exp({STEEP} * ({r} - {MIDDLE}))))"


def curve(r):
    steep = 3 + F.col("productID") % 5
    middle = F.lit(0.9) + F.col("quotationID") % 7 / 20
    return 1 / (1 + F.exp(steep * (r - middle)))


VIEWS["priceable"] = """
SELECT quotationLineItemID AS id, quotationID, productID, quantity, unitPrice, unitPrice * (8 + productID % 12) / 10 AS basis, salesPrice / (unitPrice * (8 + productID % 12) / 10) AS current_ratio,
       CASE WHEN lineNumber % 2 = 0 THEN floor(unitPrice * 120 + 0.5) / 100 END AS base_price FROM quote_lines"""


def priceable(spark, sf):
    li = P.quote_lines(spark, sf)
    basis = F.col("unitPrice") * (8 + F.col("productID") % 12) / 10
    return li.select(F.col("quotationLineItemID").alias("id"), "quotationID", "productID", "quantity", "unitPrice", basis.alias("basis"),
                     (F.col("salesPrice") / basis).alias("current_ratio"),
                     F.when(F.col("lineNumber") % 2 == 0, F.floor(F.col("unitPrice") * 120 + 0.5) / 100).alias("base_price"))


VIEWS["swept"] = f"""
SELECT l.*, i, r, {curve_sql('r')} AS p, r >= unitPrice / basis - 1e-12 AS elig FROM priceable l CROSS JOIN (SELECT unnest([{GRID}]) AS r, unnest(range(0, 41)) AS i)"""
VIEWS["banded"] = """
SELECT *, first + coalesce(hi_fail, 41) - first - 1 AS hi_i, least(coalesce(mid_fail, 41) - 1, coalesce(hi_fail, 41) - 1) AS mid_i FROM (
 SELECT s.id, any_value(f.first) AS first, any_value(f.best) AS best, min(CASE WHEN i > f.first AND p < f.best - 0.05 THEN i END) AS hi_fail, min(CASE WHEN i > f.first AND p < f.best - 0.05 / 2 THEN i END) AS mid_fail
 FROM swept s JOIN (SELECT id, min(i) AS first, arg_min(p, i) AS best FROM swept WHERE elig GROUP BY 1) f ON f.id = s.id GROUP BY 1)"""
VIEWS["grid_points"] = f"SELECT unnest([{GRID}]) AS r, unnest(range(0, 41)) AS i"
VIEWS["edge_hi"] = f"""
SELECT l.*, b.best - 0.05 AS thr, g.r AS lo, h.r AS hi, 0 AS k FROM banded b JOIN priceable l ON l.id = b.id JOIN grid_points g ON g.i = b.hi_i JOIN grid_points h ON h.i = least(b.hi_i + 1, 40)
UNION ALL SELECT * REPLACE (CASE WHEN {curve_sql('(lo + hi) / 2')} >= thr THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN {curve_sql('(lo + hi) / 2')} >= thr THEN hi ELSE (lo + hi) / 2 END AS hi, k + 1 AS k) FROM edge_hi WHERE k < 14 AND hi > lo"""
VIEWS["high_edge"] = "SELECT id, arg_max(lo, k) AS r_high FROM edge_hi GROUP BY 1"
VIEWS["edge_mid"] = f"""
SELECT l.*, b.best - 0.05 / 2 AS thr, g.r AS lo, least(h.r, e.r_high) AS hi, 0 AS k FROM banded b JOIN priceable l ON l.id = b.id JOIN high_edge e ON e.id = b.id JOIN grid_points g ON g.i = b.mid_i JOIN grid_points h ON h.i = least(b.mid_i + 1, 40)
UNION ALL SELECT * REPLACE (CASE WHEN {curve_sql('(lo + hi) / 2')} >= thr THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN {curve_sql('(lo + hi) / 2')} >= thr THEN hi ELSE (lo + hi) / 2 END AS hi, k + 1 AS k) FROM edge_mid WHERE k < 14 AND hi > lo"""
VIEWS["mid_edge"] = "SELECT id, arg_max(lo, k) AS r_mid FROM edge_mid GROUP BY 1"


@query("i17_refined_edges", "SELECT id, round(r_high, 6) AS r_high, round(r_mid, 6) AS r_mid FROM high_edge JOIN mid_edge USING (id)")
def _(spark, sf):
    return _edges(priceable(spark, sf))


def _from_cost(df, g):
    """Lines whose cost lies within the grid, with ``first``, the first point at or above it.

    The filter is a plain comparison: Spark pushes one with a lambda to one side of the join below while it still names the other's column.
    """
    floor_ratio = F.col("unitPrice") / F.col("basis")
    within = df.filter(F.lit(HI) >= floor_ratio - 1e-12)
    return within.withColumn("first", (F.array_position(F.transform(g, lambda x: x >= floor_ratio - 1e-12), F.lit(True)) - 1).cast("int"))


def _edges(df):
    """The two refined ratios of each line."""
    g = F.array(*[F.lit(v) for v in W.grid(LO, HI, W.SWEEP_POINTS)])
    df = _from_cost(df.withColumn("p", F.transform(g, curve)), g)
    best = F.get("p", F.col("first"))
    df = df.withColumns({"best": best, "hi": W.longest_run(F.col("p"), F.col("first"), best - 0.05)})
    df = df.withColumn("mid", F.least(W.longest_run(F.col("p"), F.col("first"), F.col("best") - 0.05 / 2), F.col("hi")))

    def at(i):
        return F.get(g, i.cast("int"))

    df = df.withColumn("r_high", W.refine_edge(curve, at(F.col("hi")), at(F.least(F.col("hi") + 1, F.lit(40))), F.col("best") - 0.05))
    mid = W.refine_edge(curve, at(F.col("mid")), F.least(at(F.least(F.col("mid") + 1, F.lit(40))), F.col("r_high")), F.col("best") - 0.05 / 2)
    return df.select("id", "r_high", mid.alias("r_mid"))


BAND_SQL = f"""SELECT l.id, round(low, 2) AS recommended_price_low, round(mid, 2) AS recommended_price_mid, round(high, 2) AS recommended_price_high, coalesce(b.hi_i = 40, false) AS boundary_hit,
 CASE WHEN b.id IS NULL THEN 'unavailable' WHEN round(low, 2) <= l.current_ratio * l.basis AND l.current_ratio * l.basis <= round(high, 2) THEN 'within_range' ELSE 'out_of_range' END AS price_band_status,
 format('{{:.2f}}', ev.mid_r * l.basis)::DOUBLE AS ev_price_mid, format('{{:.2f}}', ev.lo_r * l.basis)::DOUBLE AS ev_price_low, format('{{:.2f}}', ev.hi_r * l.basis)::DOUBLE AS ev_price_high
 FROM priceable l LEFT JOIN banded b ON b.id = l.id LEFT JOIN (
  SELECT id, low, CASE WHEN base_price IS NULL THEN m ELSE greatest(m, low) END AS mid, CASE WHEN base_price IS NULL THEN h ELSE greatest(h, low) END AS high FROM (
   SELECT x.id, base_price, CASE WHEN base_price IS NULL THEN format('{{:.2f}}', g.r * basis)::DOUBLE ELSE greatest(clamp_low, unitPrice) END AS low, CASE WHEN base_price IS NULL THEN format('{{:.2f}}', r_mid * basis)::DOUBLE ELSE clamp_mid END AS m, CASE WHEN base_price IS NULL THEN format('{{:.2f}}', r_high * basis)::DOUBLE ELSE clamp_high END AS h
   FROM (SELECT b.id, b.first, l.*, e.r_high, m.r_mid, round(least(greatest(gg.r * basis, base_price * 0.7::DOUBLE), base_price * 1.3::DOUBLE), 2) AS clamp_low, round(least(greatest(m.r_mid * basis, base_price * 0.7::DOUBLE), base_price * 1.3::DOUBLE), 2) AS clamp_mid,
    round(least(greatest(e.r_high * basis, base_price * 0.7::DOUBLE), base_price * 1.3::DOUBLE), 2) AS clamp_high FROM banded b JOIN priceable l ON l.id = b.id JOIN high_edge e ON e.id = b.id JOIN mid_edge m ON m.id = b.id JOIN grid_points gg ON gg.i = b.first) x JOIN grid_points g ON g.i = x.first)) c ON c.id = l.id
 LEFT JOIN (SELECT id, any_value(pr) AS mid_r, min(CASE WHEN i > coalesce(low_fail, -1) AND i <= pk THEN r END) AS lo_r, max(CASE WHEN i < coalesce(hi_fail, 41) AND i >= pk THEN r END) AS hi_r FROM (
   SELECT *, max(CASE WHEN i < pk AND NOT coalesce(v >= (1.0::DOUBLE - 0.10::DOUBLE) * top, false) THEN i END) OVER (PARTITION BY id) AS low_fail, min(CASE WHEN i > pk AND NOT coalesce(v >= (1.0::DOUBLE - 0.10::DOUBLE) * top, false) THEN i END) OVER (PARTITION BY id) AS hi_fail FROM (
    SELECT s.id, s.i, s.r, s.v, t.top, t.pk, t.pr FROM (SELECT id, i, r, CASE WHEN elig THEN p * (r * basis - unitPrice) * quantity END AS v FROM swept) s
    JOIN (SELECT id, max(v) AS top, arg_max(i, (v, -i)) AS pk, arg_max(r, (v, -i)) AS pr FROM (SELECT id, i, r, p * (r * basis - unitPrice) * quantity AS v FROM swept WHERE elig) GROUP BY 1 HAVING max(v) > 0) t ON t.id = s.id)) GROUP BY id) ev ON ev.id = l.id"""


@query("i16_price_band", BAND_SQL, digits=2)
def _(spark, sf):
    return W.price_band(priceable(spark, sf), curve, LO, HI).select(
        "id", "recommended_price_low", "recommended_price_mid", "recommended_price_high", "boundary_hit", "price_band_status",
        "ev_price_mid", "ev_price_low", "ev_price_high")


@query("e18_contiguous_run", "SELECT id, hi_i FROM banded")
def _(spark, sf):
    g = F.array(*[F.lit(v) for v in W.grid(LO, HI, W.SWEEP_POINTS)])
    df = _from_cost(priceable(spark, sf).withColumn("p", F.transform(g, curve)), g)
    return df.select("id", W.longest_run(F.col("p"), F.col("first"), F.get("p", F.col("first")) - 0.05).alias("hi_i"))


MARGINS = ", ".join(f"{v!r}::DOUBLE" for v in W.grid(W.MIN_MARGIN, W.MAX_MARGIN, W.MARGIN_POINTS))
VIEWS["margin_swept"] = f"""
SELECT id, productID, unitPrice, quantity, i, m, 1 / (1 + exp((4 + productID % 9) * (m - 0.05::DOUBLE - (quotationID % 5) / 20))) + CASE WHEN i % 7 = 3 AND productID % 4 = 0 THEN 0.03::DOUBLE ELSE 0 END AS w
FROM priceable CROSS JOIN (SELECT unnest([{MARGINS}]) AS m, unnest(range(0, 50)) AS i)"""
VIEWS["margin_env"] = "SELECT *, min(w) OVER (PARTITION BY id ORDER BY i) AS e, lag(w) OVER (PARTITION BY id ORDER BY i) AS before FROM margin_swept"


def margin_curve(m, i=None):
    base = 1 / (1 + F.exp((4 + F.col("productID") % 9) * (m - 0.05 - F.col("quotationID") % 5 / 20)))
    step = F.lit((W.MAX_MARGIN - W.MIN_MARGIN) / (W.MARGIN_POINTS - 1))
    i = F.round(m / step).cast("int")
    return base + F.when((i % 7 == 3) & (F.col("productID") % 4 == 0), 0.03).otherwise(0.0)


@query("e13_monotone_envelope", "SELECT id, round(sum(e), 5) AS envelope_sum, round(min(e), 5) AS lowest FROM margin_env GROUP BY 1", digits=5)
def _(spark, sf):
    m = F.array(*[F.lit(v) for v in W.grid(W.MIN_MARGIN, W.MAX_MARGIN, W.MARGIN_POINTS)])
    f = priceable(spark, sf).withColumn("w", F.transform(m, margin_curve)).withColumn("e", W.monotone_envelope(F.col("w")))
    return f.select("id", F.aggregate("e", F.lit(0.0), lambda a, x: a + x).alias("envelope_sum"), F.array_min("e").alias("lowest"))


@query("e14_rise_detection", "SELECT id, bool_or(coalesce(w - before > 1e-9, false)) AS rises FROM margin_env GROUP BY 1")
def _(spark, sf):
    m = F.array(*[F.lit(v) for v in W.grid(W.MIN_MARGIN, W.MAX_MARGIN, W.MARGIN_POINTS)])
    return priceable(spark, sf).withColumn("w", F.transform(m, margin_curve)).select("id", W.rises(F.col("w")).alias("rises"))


@query("i19_margin_sweep", """SELECT id, round(arg_max(unitPrice / (1 - m), (e * (unitPrice / (1 - m) - unitPrice) * quantity, -i)), 4) AS price_mid, bool_or(w > e + 1e-9) AS monotonicity_violated,
 arg_max(i, (e * (unitPrice / (1 - m) - unitPrice) * quantity, -i)) IN (0, 49) AS boundary_hit, NOT arg_max(m, (e * (unitPrice / (1 - m) - unitPrice) * quantity, -i)) BETWEEN 0.05::DOUBLE AND 0.30::DOUBLE AS out_of_distribution FROM margin_env GROUP BY 1""", digits=4)
def _(spark, sf):
    return W.margin_sweep(priceable(spark, sf), margin_curve, (0.05, 0.30)).select(
        "id", "price_mid", "monotonicity_violated", "boundary_hit", "out_of_distribution")


PROBE = ", ".join(f"{v!r}::DOUBLE" for v in W.grid(0.2, 2.4, W.PROBE_POINTS))


@query("i18_informative_range", f"""WITH s AS (SELECT * FROM priceable), m AS (SELECT i, r, quantile_cont({curve_sql('r')}, 0.5) AS m FROM s CROSS JOIN (SELECT unnest([{PROBE}]) AS r, unnest(range(0, 121)) AS i) GROUP BY 1, 2),
 e AS (SELECT arg_min(m, i) AS l, arg_max(m, i) AS h FROM m) SELECT round(min(CASE WHEN l - m > 0.005 THEN r END), 6) AS low, round(max(CASE WHEN m - h > 0.005 THEN r END), 6) AS high FROM m, e""")
def _(spark, sf):
    f = priceable(spark, sf)
    return W.informative_range(f, curve, 0.2, 2.4)


@query("i20_noisy_or", "SELECT quotationID, round(least(greatest(product(least(greatest(p, 1e-4), 1 - 1e-4)), 1e-4), 1 - 1e-4), 6) AS quote_win_probability FROM scored GROUP BY 1")
def _(spark, sf):
    return W.noisy_or(P.scored_lines(spark, sf), "quotationID", "p")


@query("c17_catalog_translation", """SELECT l.quotationLineItemID, CASE WHEN productID % 3 <> 0 AND productID % 2 = 0 THEN 'uuid-' || productID ELSE 'SKU-' || productID END AS model_product FROM quote_lines l""")
def _(spark, sf):
    """The model may know a product by SKU or by id; send the form it was trained on."""
    p = P.table(spark, sf, "part").select(F.col("p_partkey").alias("productID"))
    catalog = p.select("productID", F.concat(F.lit("SKU-"), "productID").alias("sku"), F.concat(F.lit("uuid-"), "productID").alias("uid"))
    known = p.select(F.explode(F.array_compact(F.array(
        F.when(F.col("productID") % 3 == 0, F.concat(F.lit("SKU-"), "productID")),
        F.when(F.col("productID") % 2 == 0, F.concat(F.lit("uuid-"), "productID"))))).alias("word"))
    f = P.quote_lines(spark, sf).join(catalog, "productID", "left")
    f = f.join(known.withColumnsRenamed({"word": "sku"}).withColumn("has_sku", F.lit(True)), "sku", "left")
    f = f.join(known.withColumnsRenamed({"word": "uid"}).withColumn("has_uid", F.lit(True)), "uid", "left")
    use = F.col("has_sku").isNull() & F.col("has_uid").isNotNull()
    return f.select("quotationLineItemID", F.when(use, F.col("uid")).otherwise(F.col("sku")).alias("model_product"))


@query("c18_side_by_side", """SELECT w.id, round(w.p, 6) AS win_probability, round(b.mid, 2) AS price_model_mid FROM scored w LEFT JOIN (
 SELECT productID, quantile_cont(price_ratio, 0.5) AS mid FROM scored WHERE quantity > 25 GROUP BY 1) b ON b.productID = w.productID""".replace("round(b.mid, 2)", "round(b.mid, 6)"))
def _(spark, sf):
    from kilnworks.operators.scale import exact_quantiles, join_on
    s = P.scored_lines(spark, sf)
    bands = exact_quantiles(s.filter(F.col("quantity") > 25), ["productID"], "price_ratio", {"price_model_mid": 0.5})
    return join_on(s, bands, ["productID"]).select("id", F.col("p").alias("win_probability"), "price_model_mid")


DRAFT = "(SELECT * FROM quote_lines JOIN quotes USING (quotationID) WHERE statusName = 'Sent')"
EFFECTIVE = "coalesce(CASE WHEN negotiatedSalesPrice > 0 THEN negotiatedSalesPrice END, CASE WHEN salesPrice > 0 THEN salesPrice END, unitPrice)"


def drafts(spark, sf):
    q = P.quotes(spark, sf).filter(F.col("statusName") == "Sent")
    return P.quote_lines(spark, sf).join(q, "quotationID")


def draft_line_features(lines, contact, rep):
    """Line features of unsaved quotes with the formulas of the training frame."""
    effective = Q.first_positive(F.col("negotiatedSalesPrice"), F.col("salesPrice"), F.col("unitPrice"))
    listed = F.coalesce(F.when(F.col("listPrice") > 0, F.col("listPrice")), F.col("unitPrice") * Q.LIST_PRICE_MARKUP)
    f = lines.withColumns({"effective": effective, "list_price": listed, "price_ratio": Q.serving_ratio(
        F.col("negotiatedSalesPrice"), F.col("salesPrice"), F.col("unitPrice"), F.col("listPrice"))})
    f = with_group_totals(f, ["quotationID"], {"quote_total": F.sum(F.col("quantity") * F.col("effective"))})
    for table, key, name in ((contact, "customerID", "contact_win_rate"), (rep, "salesRepID", "salesrep_win_rate")):
        overall = table.filter(F.col("entity") == "_global").select(F.col("rate").alias("__g"))
        own = table.withColumnsRenamed({"entity": "__e", "rate": "__r"})
        f = with_scalars(f.join(own, F.col(key).cast("string") == F.col("__e"), "left"), overall)
        f = f.withColumn(name, F.coalesce("__r", "__g")).drop("__e", "__r", "__g")
    return f.withColumn("payment_terms", Q.payment_term(F.col("paymentTerms")))


@query("i26_draft_line_features", f"""WITH r AS ({RATE_TABLE}), d AS (SELECT *, {EFFECTIVE} AS eff FROM {DRAFT})
 SELECT quotationLineItemID, round(eff / listPrice, 6) AS price_ratio, round(sum(quantity * eff) OVER (PARTITION BY quotationID), 4) AS quote_total, round(coalesce(r.rate, (SELECT rate FROM r WHERE entity = '_global')), 6) AS contact_win_rate,
 CASE paymentTerms WHEN 'Immediate Payment' THEN 'Immediate' WHEN '15 days' THEN '15 Days' ELSE '21 Days' END AS payment_terms FROM d LEFT JOIN r ON r.entity = CAST(customerID AS VARCHAR)""".replace("round(sum(quantity * eff) OVER (PARTITION BY quotationID), 4)", "round(sum(quantity * eff) OVER (PARTITION BY quotationID), 6)"))
def _(spark, sf):
    h = decided_headers(P.quotes(spark, sf))
    f = draft_line_features(drafts(spark, sf), rate_table(h, "customerID"), rate_table(h, "salesRepID"))
    return f.select("quotationLineItemID", "price_ratio", "quote_total", "contact_win_rate", "payment_terms")


@query("i26_draft_quote_features", f"""SELECT quotationID, round(sum(quantity), 6) AS total_quantity, count(*) AS line_count, count(DISTINCT productID) AS n_products, round(avg(ratio), 6) AS mean_price_ratio, round(min(ratio), 6) AS min_price_ratio,
 round(sum(ratio * quantity * e) / sum(quantity * e), 6) AS wtd_price_ratio FROM (SELECT *, coalesce(negotiatedSalesPrice, salesPrice) AS e, coalesce(negotiatedSalesPrice, salesPrice) / unitPrice AS ratio FROM {DRAFT}) GROUP BY 1""")
def _(spark, sf):
    f = frames.priced_lines(drafts(spark, sf), use_list=False)
    return frames.quote_rollup(f).drop("avg_discount_pct")


def _or(c: str, default: float):
    """A number that counts as not given where it is null or zero."""
    return F.when(F.col(c).cast("double") != 0, F.col(c).cast("double")).otherwise(F.lit(float(default)))


def draft_bag_features(lines):
    """One bag per unsaved quote: the lines as the multi-line model reads them; a line without unit or sales price has an issue and no bag."""
    unit, price = F.col("unitPrice").cast("double"), F.col("salesPrice").cast("double")
    issue = F.when(unit.isNull(), F.lit("unitPrice is required and must be numeric")).when(price.isNull(), F.lit("salesPrice is required and must be numeric"))
    return lines.select("quotationLineItemID", "quotationID", F.coalesce(F.col("productID").cast("string"), F.lit("")).alias("productID"), _or("quantity", 1).alias("quantity"),
                        unit.alias("unitPrice"), price.alias("salesPrice"), F.coalesce("materialSpec", F.lit("Other")).alias("materialSpec"),
                        _or("discountPercent", 0).alias("discountPercent"), _or("leadTimeDays", 0).alias("leadTimeDays"), F.coalesce("region", F.lit("")).alias("region"),
                        F.coalesce("industry", F.lit("")).alias("industry"), F.coalesce(F.col("salesRepID").cast("string"), F.lit("")).alias("salesRepID"), issue.alias("issue"))


def draft_price_features(lines, contact):
    """Features of the price band for each line of unsaved quotes, with the customer's historical rate."""
    overall = contact.filter(F.col("entity") == "_global").select(F.col("rate").alias("__g"))
    own = contact.withColumnsRenamed({"entity": "__e", "rate": "__r"})
    f = with_scalars(lines.join(own, F.col("customerID").cast("string") == F.col("__e"), "left"), overall)
    unit = F.col("unitPrice").cast("double")
    return f.select("quotationLineItemID", _or("quantity", 1).alias("quantity"), unit.alias("unitPrice"), _or("leadTimeDays", 0).alias("leadTimeDays"),
                    F.coalesce("__r", "__g").alias("contact_win_rate"), F.coalesce(F.col("productID").cast("string"), F.lit("")).alias("productID"),
                    F.coalesce("materialSpec", F.lit("unknown")).alias("materialSpec"), F.coalesce("region", F.lit("")).alias("region"),
                    F.when(unit.isNull(), F.lit("unitPrice is required and must be numeric")).alias("issue"))


# every seventh material and every fifth sales price of the test lines is left blank, so that the defaults show
BLANKED = f"(SELECT * REPLACE (CASE WHEN productID % 7 <> 0 THEN materialSpec END AS materialSpec, CASE WHEN lineNumber % 5 <> 0 THEN salesPrice END AS salesPrice) FROM {DRAFT})"


def blanked(spark, sf):
    return drafts(spark, sf).withColumns({"materialSpec": F.when(F.col("productID") % 7 != 0, F.col("materialSpec")),
                                          "salesPrice": F.when(F.col("lineNumber") % 5 != 0, F.col("salesPrice"))})


@query("i26_draft_bag_features", f"""SELECT quotationLineItemID, quotationID, CAST(productID AS VARCHAR) AS productID, CASE WHEN quantity <> 0 THEN quantity ELSE 1 END AS quantity, unitPrice, salesPrice,
 coalesce(materialSpec, 'Other') AS materialSpec, discountPercent, leadTimeDays::DOUBLE AS leadTimeDays, region, industry, salesRepID,
 CASE WHEN salesPrice IS NULL THEN 'salesPrice is required and must be numeric' END AS issue FROM {BLANKED}""")
def _(spark, sf):
    return draft_bag_features(blanked(spark, sf))


@query("i26_draft_price_features", f"""WITH r AS ({RATE_TABLE}) SELECT quotationLineItemID, CASE WHEN quantity <> 0 THEN quantity ELSE 1 END AS quantity, unitPrice, leadTimeDays::DOUBLE AS leadTimeDays,
 round(coalesce(r.rate, (SELECT rate FROM r WHERE entity = '_global')), 6) AS contact_win_rate, CAST(productID AS VARCHAR) AS productID, coalesce(materialSpec, 'unknown') AS materialSpec, region, NULL AS issue
 FROM {BLANKED} LEFT JOIN r ON r.entity = CAST(customerID AS VARCHAR)""")
def _(spark, sf):
    h = decided_headers(P.quotes(spark, sf))
    return draft_price_features(blanked(spark, sf), rate_table(h, "customerID"))
