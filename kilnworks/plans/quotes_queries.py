"""Registered quote queries: labels, history, roll-ups, training frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnworks.functions import money as M
from kilnworks.functions import quote as Q
from kilnworks.operators import asof, labels
from kilnworks.operators.graph import family_roots
from kilnworks.operators.scale import (
    exact_quantiles, group_and_overall, ordered_text_levels, prefix_sums, top_per_key, with_group_totals, with_scalars)
from kilnworks.plans import frames
from kilnworks.plans.catalog import query
from kilnworks.sources import proxies as P


@query("a03_quote_scan", "SELECT o_orderkey AS id, o_custkey AS contact_id, round(o_totalprice,6) AS grand_total FROM orders WHERE o_orderstatus <> 'O'")
def _(spark, sf):
    """Pruned header scan; the soft-delete filter reaches the file scan."""
    return P.table(spark, sf, "orders").filter(F.col("o_orderstatus") != "O").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("contact_id"),
        F.col("o_totalprice").alias("grand_total"))


@query("b01_fill_optional", "SELECT quotationID, 1 AS revisionNumber, CAST(NULL AS BIGINT) AS parentQuotationID, CAST(NULL AS VARCHAR) AS paymentTerms FROM quotes")
def _(spark, sf):
    return labels.fill_optional(P.quotes(spark, sf).select("quotationID"), labels.OPTIONAL_HEADER).select(
        "quotationID", "revisionNumber", "parentQuotationID", "paymentTerms")


@query("b03_filter_active", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def _(spark, sf):
    li = P.table(spark, sf, "lineitem").withColumn("deleted_at", F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")))
    return li.filter(F.col("deleted_at").isNull()).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


STATUS_TEXT = """CASE o_orderkey % 6 WHEN 0 THEN 'Order Confirmed' WHEN 1 THEN 'REJECTED by buyer' WHEN 2 THEN 'Won back after loss'
 WHEN 3 THEN 'Sent' WHEN 4 THEN 'winning' ELSE 'Closed Lost' END"""


@query("b06_text_label", f"""SELECT quotationID, s AS status, CASE WHEN w AND NOT l THEN 1.0::DOUBLE WHEN l AND NOT w THEN 0.0 END AS won FROM (
 SELECT o_orderkey AS quotationID, {STATUS_TEXT} AS s,
 regexp_matches(lower({STATUS_TEXT}), '\\b(won|win|wins|confirmed|accepted|converted|order|ordered|success|successful)\\b') AS w,
 regexp_matches(lower({STATUS_TEXT}), '\\b(lost|loss|lose|rejected|declined|cancelled|canceled|failed|unsuccessful)\\b') AS l FROM orders)""")
def _(spark, sf):
    s = F.expr(STATUS_TEXT)
    return P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("quotationID"), s.alias("status")).withColumn(
        "won", Q.text_outcome(F.col("status")))


@query("b07_label_precedence", "SELECT quotationID, CAST(quotationID % 2 AS DOUBLE) AS won FROM quotes")
def _(spark, sf):
    """target_win holds a stray 2 and is passed over; is_won is valid and beats the status."""
    q = P.quotes(spark, sf).withColumns({"target_win": F.col("quotationID") % 3, "is_won": F.col("quotationID") % 2})
    return labels.derive_label(q)[0].select("quotationID", "won")


CODED = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'SALES_ORDER' ELSE 'QUOTATION' END AS stage,
 CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED' WHEN 'P' THEN 'CLOSED_LOST' ELSE 'QUOTATION_SENT' END AS status,
 CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey END AS sales_order_id, o_custkey AS contact_id, o_orderpriority AS sales_person_id,
 o_orderdate AS created_at, o_orderdate + to_days(CAST(20 + o_orderkey % 50 AS INTEGER)) AS sales_order_created_at,
 o_orderdate + to_days(CAST(10 + o_orderkey % 90 AS INTEGER)) AS lost_at FROM orders"""
CODED_LABEL = f"""SELECT *, CASE WHEN is_won THEN 1.0::DOUBLE WHEN is_lost THEN 0.0 END AS label,
 CASE WHEN is_won THEN sales_order_created_at ELSE lost_at END AS close_time FROM (
 SELECT *, (stage = 'SALES_ORDER' OR status = 'CONFIRMED' OR sales_order_id IS NOT NULL) AND status <> 'CLOSED_LOST' AS is_won,
 status = 'CLOSED_LOST' AS is_lost FROM ({CODED}))"""


def coded_quotes(spark, sf):
    k = F.col("o_orderkey")
    df = P.table(spark, sf, "orders").select(
        k.alias("id"), F.when(k % 7 == 0, "SALES_ORDER").otherwise("QUOTATION").alias("stage"),
        F.when(F.col("o_orderstatus") == "F", "CONFIRMED").when(F.col("o_orderstatus") == "P", "CLOSED_LOST")
         .otherwise("QUOTATION_SENT").alias("status"),
        F.when(k % 11 == 0, k).alias("sales_order_id"), F.col("o_custkey").alias("contact_id"),
        F.col("o_orderpriority").alias("sales_person_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.timestamp_add("DAY", (20 + k % 50).cast("int"), F.col("o_orderdate").cast("timestamp")).alias("sales_order_created_at"),
        F.timestamp_add("DAY", (10 + k % 90).cast("int"), F.col("o_orderdate").cast("timestamp")).alias("lost_at"))
    won, lost = labels.coded_outcome(F.col("stage"), F.col("status"), F.col("sales_order_id"))
    return df.withColumns({"is_won": won, "is_lost": lost}).withColumns({
        "label": F.when(F.col("is_won"), 1.0).when(F.col("is_lost"), 0.0),
        "close_time": F.when(F.col("is_won"), F.col("sales_order_created_at")).otherwise(F.col("lost_at"))})


@query("b08_coded_label", f"SELECT id, label, strftime(close_time, '%Y-%m-%d %H:%M:%S.%f') AS close_time FROM ({CODED_LABEL})")
def _(spark, sf):
    return coded_quotes(spark, sf).select("id", "label", "close_time")


@query("b09_age_out_open", """SELECT quotationID, CASE WHEN statusName = 'Closed Won' THEN 1.0::DOUBLE WHEN statusName = 'Closed Lost' THEN 0.0
 WHEN datediff('day', quoteDate, (SELECT max(quoteDate) FROM quotes)) >= 60 THEN 0.0 END AS won FROM quotes""")
def _(spark, sf):
    return labels.age_out_open(labels.derive_label(P.quotes(spark, sf))[0]).select("quotationID", "won")


@query("c01_lines_with_header", "SELECT quotationLineItemID, q.region, q.industry FROM quote_lines l LEFT JOIN quotes q USING (quotationID)")
def _(spark, sf):
    return P.quote_lines(spark, sf).join(P.quotes(spark, sf), "quotationID", "left").select(
        "quotationLineItemID", "region", "industry")


@query("c02_lines_of_won", "SELECT quotationLineItemID FROM quote_lines WHERE quotationID IN (SELECT quotationID FROM quotes WHERE statusName = 'Closed Won')")
def _(spark, sf):
    won = P.quotes(spark, sf).filter(F.col("statusName") == "Closed Won")
    return P.quote_lines(spark, sf).join(won, "quotationID", "left_semi").select("quotationLineItemID")


@query("c03_two_clock_asof", f"""WITH q AS ({CODED_LABEL}) SELECT a.id, count(b.id) AS n, coalesce(sum(b.label), 0) AS w
 FROM q a LEFT JOIN q b ON b.sales_person_id = a.sales_person_id AND b.label IS NOT NULL AND b.close_time < a.created_at GROUP BY a.id""")
def _(spark, sf):
    q = coded_quotes(spark, sf)
    closed = q.filter(F.col("label").isNotNull() & F.col("close_time").isNotNull())
    out = asof.two_clock_prior(q, closed, ["sales_person_id"], "created_at", "close_time",
                               {"n": F.lit(1), "w": F.col("label")})
    return out.select("id", F.col("prior_n").cast("bigint").alias("n"), F.col("prior_w").alias("w"))


@query("c03_two_clock_rates", f"""WITH q AS ({CODED_LABEL}), g AS (SELECT avg(label) AS g FROM q)
 SELECT a.id, round((coalesce(sum(b.label), 0) + 3 * any_value(g)) / (count(b.id) + 3), 6) AS contact_prior_winrate, count(b.id) AS n_comparable
 FROM q a CROSS JOIN g LEFT JOIN q b ON b.contact_id = a.contact_id AND b.label IS NOT NULL AND b.close_time < a.created_at GROUP BY a.id""")
def _(spark, sf):
    q = coded_quotes(spark, sf)
    closed = q.filter(F.col("label").isNotNull())
    out = asof.two_clock_prior(q, closed, ["contact_id"], "created_at", "close_time", {"n": F.lit(1), "w": F.col("label")})
    out = with_scalars(out, q.agg(F.avg("label").alias("g")))
    return out.select("id", Q.smoothed_rate(F.col("prior_w"), F.col("prior_n"), F.col("g")).alias("contact_prior_winrate"),
                      F.col("prior_n").cast("bigint").alias("n_comparable"))


@query("c04_same_clock_asof", """SELECT a.quotationID, count(b.quotationID) AS n, round(coalesce(sum(b.grandTotal), 0), 4) AS s FROM quotes a
 LEFT JOIN quotes b ON a.customerID = b.customerID AND b.quoteDate < a.quoteDate GROUP BY 1""", digits=4)
def _(spark, sf):
    out = asof.prior_totals(P.quotes(spark, sf), ["customerID"], "quoteDate", asof.value_and_count("g", F.col("grandTotal")))
    return out.select("quotationID", F.col("prior_g_n").alias("n"), F.col("prior_g_s").alias("s"))


@query("c05_prior_on_timestamps", """SELECT a.event_id, count(b.event_id) AS n, round(coalesce(sum(b.value), 0), 4) AS s FROM events a
 LEFT JOIN events b ON a.user_id = b.user_id AND b.ts < a.ts GROUP BY 1""", digits=4)
def _(spark, sf):
    """The strict self comparison on microsecond time, answered by level prefixes."""
    ev = P.table(spark, sf, "events")
    out = asof.prior_totals(ev, ["user_id"], "ts", asof.value_and_count("v", F.col("value")), daily=False)
    return out.select("event_id", F.col("prior_v_n").alias("n"), F.col("prior_v_s").alias("s"))


RATE_TABLE = """SELECT coalesce(CAST(customerID AS VARCHAR), '_global') AS entity,
 CASE WHEN customerID IS NULL THEN avg(won) ELSE (sum(won) + 3 * (SELECT avg(won) FROM decided)) / (count(won) + 3) END AS rate
 FROM decided GROUP BY GROUPING SETS ((customerID), ())"""


def rate_table(df, entity):
    """Smoothed rate per entity over all its history, and the overall rate."""
    g = df.agg(F.avg("won").alias("g"))
    per = group_and_overall(df.select(entity, "won"), entity).groupBy(entity).agg(
        F.sum("won").alias("w"), F.count("won").alias("n"), F.avg("won").alias("m"))
    rate = F.when(F.col(entity) == "_global", F.col("m")).otherwise(Q.smoothed_rate(F.col("w"), F.col("n"), F.col("g")))
    return with_scalars(per, g).select(F.col(entity).alias("entity"), rate.alias("rate"))


@query("d04_rate_lookup", f"SELECT entity, round(rate, 6) AS rate FROM ({RATE_TABLE})")
def _(spark, sf):
    return rate_table(labels.decided_headers(P.quotes(spark, sf), columns=["customerID"]), "customerID")


@query("c10_rate_with_fallback", f"""WITH r AS ({RATE_TABLE}) SELECT quotationID, round(coalesce(r.rate, (SELECT rate FROM r WHERE entity = '_global')), 6) AS rate
 FROM quotes LEFT JOIN r ON r.entity = CAST(customerID AS VARCHAR)""")
def _(spark, sf):
    q = P.quotes(spark, sf)
    rates = rate_table(labels.decided_headers(q, columns=["customerID"]), "customerID")
    overall = rates.filter(F.col("entity") == "_global").select(F.col("rate").alias("g"))
    joined = q.withColumn("entity", F.col("customerID").cast("string")).join(rates, "entity", "left")
    return with_scalars(joined, overall).select("quotationID", F.coalesce("rate", "g").alias("rate"))


@query("d01_quote_rollup", """SELECT quotationID, round(total_quantity,6) AS total_quantity, line_count, n_products, round(mean_price_ratio,6) AS mean_price_ratio,
 round(min_price_ratio,6) AS min_price_ratio, round(wtd_price_ratio,6) AS wtd_price_ratio, round(avg_discount_pct,6) AS avg_discount_pct FROM rollup""")
def _(spark, sf):
    return frames.quote_rollup(frames.priced_lines(P.quote_lines(spark, sf)))


D02_SQL = """SELECT quotationID, round(CASE WHEN sum(w) FILTER (m IS NOT NULL) > 0 THEN sum(m * w) FILTER (m IS NOT NULL) / sum(w) FILTER (m IS NOT NULL) ELSE avg(m) END, 4) AS gross_margin FROM (
 SELECT quotationID, CASE WHEN productID % 17 = 0 THEN NULL ELSE (sp - uc) / sp END AS m, CAST(qty * sp AS DECIMAL(18,2))::DOUBLE AS w FROM (
 SELECT quotationID, productID, CAST(salesPrice AS DECIMAL(18,4))::DOUBLE AS sp, CAST(unitPrice AS DECIMAL(18,4))::DOUBLE AS uc, quantity AS qty FROM quote_lines)) GROUP BY 1"""


@query("d02_weighted_margin", D02_SQL, digits=4)
def _(spark, sf):
    """Line margins weighted by amount; lines whose product cost is unknown drop out."""
    li = P.quote_lines(spark, sf).withColumn("cost", F.when(F.col("productID") % 17 != 0, F.col("unitPrice")))
    m = M.margin_fraction(F.col("salesPrice"), F.col("cost")).cast("double")
    w = F.when(m.isNotNull(), M.line_amount(F.col("quantity"), F.col("salesPrice")).cast("double"))
    return li.select("quotationID", m.alias("m"), w.alias("w")).groupBy("quotationID").agg(
        frames.wavg(F.col("m"), F.col("w"), F.avg("m")).alias("gross_margin"))


@query("d03_majority_type", """SELECT quotationID, coalesce(t, 'FINISHED_GOOD') AS product_type FROM quotes LEFT JOIN (
 SELECT quotationID, materialSpec AS t FROM quote_lines GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY quotationID ORDER BY count(*) DESC, materialSpec) = 1) USING (quotationID)""")
def _(spark, sf):
    """Counted per (quote, type) first, then the best count per quote with ties to the smallest."""
    n = P.quote_lines(spark, sf).groupBy("quotationID", "materialSpec").agg(F.count(F.lit(1)).alias("n"))
    best = top_per_key(n, ["quotationID"], [F.desc("n"), F.asc("materialSpec")], 1)
    return P.quotes(spark, sf).join(best, "quotationID", "left").select(
        "quotationID", F.coalesce("materialSpec", F.lit("FINISHED_GOOD")).alias("product_type"))


@query("d05_comparable_support", """SELECT 'product' AS level, CAST(productID AS VARCHAR) AS entity, count(DISTINCT quotationID) AS n FROM quote_lines GROUP BY 2
 UNION ALL SELECT 'product_type', materialSpec, count(DISTINCT quotationID) FROM quote_lines GROUP BY 2""")
def _(spark, sf):
    """Both levels in one pass: distinct (level, entity, quote) triples, then counts."""
    li = P.quote_lines(spark, sf)
    pairs = F.explode(F.array(F.struct(F.lit("product").alias("level"), F.col("productID").cast("string").alias("entity")),
                              F.struct(F.lit("product_type").alias("level"), F.col("materialSpec").alias("entity"))))
    return (li.select("quotationID", pairs.alias("p")).select("quotationID", "p.*").distinct()
            .groupBy("level", "entity").agg(F.count(F.lit(1)).alias("n")))


PRIOR_LINES = """WITH f AS (SELECT p.*, d.quoteDate, d.won, d.customerID FROM priced p JOIN decided d USING (quotationID))"""


@query("e01_prior_cumulative", """SELECT a.quotationID, count(b.won) AS prior_n, coalesce(sum(b.won), 0.0) AS prior_wins FROM decided a
 LEFT JOIN decided b ON a.salesRepID = b.salesRepID AND b.quoteDate < a.quoteDate GROUP BY 1""")
def _(spark, sf):
    out = asof.prior_totals(labels.decided_headers(P.quotes(spark, sf), columns=["salesRepID"]), ["salesRepID"], "quoteDate",
                            asof.value_and_count("won", F.col("won")))
    return out.select("quotationID", F.col("prior_won_n").alias("prior_n"), F.col("prior_won_s").alias("prior_wins"))


@query("e02_prior_ratio", PRIOR_LINES + """ SELECT a.quotationLineItemID, round(coalesce(any_value(a.price_ratio) / nullif(avg(b.price_ratio), 0), 1.0), 5) AS price_vs_product
 FROM f a LEFT JOIN f b ON a.productID = b.productID AND b.quoteDate < a.quoteDate GROUP BY 1""", digits=5)
def _(spark, sf):
    h = labels.decided_headers(P.quotes(spark, sf), columns=()).select("quotationID", "quoteDate", "won")
    f = frames.priced_lines(P.quote_lines(spark, sf)).join(h, "quotationID")
    f = asof.prior_totals(f, ["productID"], "quoteDate", asof.value_and_count("pr", F.col("price_ratio")))
    return f.select("quotationLineItemID", asof.prior_ratio(
        F.col("price_ratio"), F.col("prior_pr_s"), F.col("prior_pr_n")).alias("price_vs_product"))


@query("e03_prior_win_rate", PRIOR_LINES + """, u AS (SELECT DISTINCT productID, quotationID, quoteDate, won FROM f), g AS (SELECT avg(won) AS g FROM u),
 r AS (SELECT a.productID, a.quotationID, (coalesce(sum(b.won), 0) + 3 * any_value(g)) / (count(b.won) + 3) AS rate FROM u a CROSS JOIN g
 LEFT JOIN u b ON a.productID = b.productID AND b.quoteDate < a.quoteDate GROUP BY 1, 2)
 SELECT quotationLineItemID, round(rate, 6) AS product_win_rate FROM f JOIN r USING (productID, quotationID)""")
def _(spark, sf):
    h = labels.decided_headers(P.quotes(spark, sf), columns=()).select("quotationID", "quoteDate", "won")
    f = P.quote_lines(spark, sf).join(h, "quotationID")
    return asof.prior_win_rate(f, "productID", "quoteDate", "won", "product_win_rate", quote="quotationID").select(
        "quotationLineItemID", "product_win_rate")


E04_SQL = """SELECT quotationID, row_number() OVER w - 1 AS prior_count,
 coalesce(datediff('day', lag(quoteDate) OVER w, quoteDate), -1)::DOUBLE AS recency_days FROM quotes WINDOW w AS (PARTITION BY customerID ORDER BY quoteDate, quotationID)"""


@query("e04_prior_quote_count", f"SELECT quotationID, prior_count FROM ({E04_SQL})")
def _(spark, sf):
    return asof.count_and_recency_history(P.quotes(spark, sf), "customerID", "quoteDate", "quotationID").select(
        "quotationID", "prior_count")


@query("e05_recency_days", f"SELECT quotationID, recency_days FROM ({E04_SQL})")
def _(spark, sf):
    return asof.count_and_recency_history(P.quotes(spark, sf), "customerID", "quoteDate", "quotationID").select(
        "quotationID", "recency_days")


@query("e06_final_revision", "SELECT root, quotationID FROM finals")
def _(spark, sf):
    return labels.final_revisions(P.quotes(spark, sf)).select("root", "quotationID")


@query("j01_family_root", "SELECT quotationID, root FROM families")
def _(spark, sf):
    return family_roots(P.quotes(spark, sf), "quotationID", "parentQuotationID").select("quotationID", "root")


@query("e12_line_share", """SELECT quotationLineItemID, round(least(greatest(coalesce(amt / nullif(sum(amt) OVER (PARTITION BY quotationID), 0), 0), 0), 1), 6) AS line_share FROM priced""")
def _(spark, sf):
    f = with_group_totals(frames.priced_lines(P.quote_lines(spark, sf)), ["quotationID"], {"total": F.sum("amt")})
    share = F.coalesce(F.try_divide("amt", "total"), F.lit(0.0))
    return f.select("quotationLineItemID", F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)).alias("line_share"))


@query("e16_deal_breaker", """SELECT quotationLineItemID, coalesce(m - (sum(m) OVER w - m) / nullif(count(*) OVER w - 1, 0) > 10.0, false) AS deal_breaker FROM (
 SELECT quotationLineItemID, quotationID, CASE WHEN salesPrice > 0 THEN (salesPrice - unitPrice) / salesPrice * 100 ELSE 0 END AS m FROM quote_lines)
 WINDOW w AS (PARTITION BY quotationID)""")
def _(spark, sf):
    li = P.quote_lines(spark, sf)
    m = F.when(F.col("salesPrice") > 0, (F.col("salesPrice") - F.col("unitPrice")) / F.col("salesPrice") * 100).otherwise(0.0)
    f = with_group_totals(li.select("quotationLineItemID", "quotationID", m.alias("m")), ["quotationID"],
                          {"s": F.sum("m"), "n": F.count(F.lit(1))})
    others = F.try_divide(F.col("s") - F.col("m"), F.nullif(F.col("n") - 1, F.lit(0)))
    return f.select("quotationLineItemID", F.coalesce(F.col("m") - others > 10.0, F.lit(False)).alias("deal_breaker"))


@query("e17_price_of_largest_line", """SELECT quotationID, round(arg_max(unitPrice, (amt, quotationLineItemID)), 6) AS base_price FROM priced GROUP BY 1""")
def _(spark, sf):
    f = frames.priced_lines(P.quote_lines(spark, sf))
    return f.groupBy("quotationID").agg(F.max_by("unitPrice", F.struct("amt", "quotationLineItemID")).alias("base_price"))


@query("h01_effective_price", "SELECT quotationLineItemID, round(effective_price, 4) AS effective_price FROM priced", digits=4)
def _(spark, sf):
    return frames.priced_lines(P.quote_lines(spark, sf)).select("quotationLineItemID", "effective_price")


@query("h02_price_ratio", """SELECT quotationLineItemID, round(price_ratio, 6) AS list_ratio,
 round(effective_price / nullif(unitPrice, 0), 6) AS cost_ratio FROM priced""")
def _(spark, sf):
    li = P.quote_lines(spark, sf)
    a = frames.priced_lines(li, frames.has_list_price(li))
    cost = F.try_divide("effective_price", F.nullif(F.col("unitPrice"), F.lit(0.0)))
    return a.select("quotationLineItemID", F.col("price_ratio").alias("list_ratio"), cost.alias("cost_ratio"))


@query("h03_serving_ratio", """SELECT quotationLineItemID, round(coalesce(CASE WHEN negotiatedSalesPrice > 0 THEN negotiatedSalesPrice END, CASE WHEN s > 0 THEN s END, unitPrice)
 / coalesce(lp, unitPrice * 1.67), 6) AS ratio FROM (SELECT *, CASE WHEN lineNumber = 2 THEN 0 ELSE salesPrice END AS s, CASE WHEN lineNumber <> 3 THEN listPrice END AS lp FROM quote_lines)""")
def _(spark, sf):
    li = P.quote_lines(spark, sf).withColumns({
        "s": F.when(F.col("lineNumber") == 2, 0.0).otherwise(F.col("salesPrice")),
        "lp": F.when(F.col("lineNumber") != 3, F.col("listPrice"))})
    return li.select("quotationLineItemID", Q.serving_ratio(
        F.col("negotiatedSalesPrice"), F.col("s"), F.col("unitPrice"), F.col("lp")).alias("ratio"))


DEC = "SELECT *, CAST(salesPrice AS DECIMAL(18,4)) AS sp, CAST(unitPrice AS DECIMAL(18,4)) AS uc, CAST(quantity AS DECIMAL(18,4)) AS q FROM quote_lines"


@query("h04_gross_margin", f"SELECT quotationLineItemID, round(CASE WHEN sp > 0 THEN (sp - uc)::DOUBLE / sp::DOUBLE END, 6) AS fraction, ROUND((sp - uc) * q, 2)::DOUBLE AS amount FROM ({DEC})")
def _(spark, sf):
    sp, uc, q = F.col("salesPrice"), F.col("unitPrice"), F.col("quantity")
    return P.quote_lines(spark, sf).select("quotationLineItemID", M.margin_fraction(sp, uc).cast("double").alias("fraction"),
                                           M.margin_amount(sp, uc, q).alias("amount"))


@query("h05_line_amount", f"SELECT quotationLineItemID, ROUND(q * sp, 2)::DOUBLE AS amount FROM ({DEC})")
def _(spark, sf):
    return P.quote_lines(spark, sf).select("quotationLineItemID", M.line_amount(F.col("quantity"), F.col("salesPrice")).alias("amount"))


@query("h06_price_clamp", f"""SELECT quotationLineItemID, ROUND(least(greatest(sp, uc * 0.70::DECIMAL(3,2)), uc * 1.30::DECIMAL(3,2)), 2)::DOUBLE AS price,
 sp < uc * 0.70::DECIMAL(3,2) OR sp > uc * 1.30::DECIMAL(3,2) AS clamped FROM ({DEC})""")
def _(spark, sf):
    sp, base = F.col("salesPrice"), F.col("unitPrice")
    return P.quote_lines(spark, sf).select("quotationLineItemID", M.clamp_price(sp, base).alias("price"),
                                           M.is_clamped(sp, base).alias("clamped"))


@query("h07_overrun", f"SELECT quotationLineItemID, round(CASE WHEN uc > 0 THEN sp::DOUBLE / uc::DOUBLE END, 6) AS ratio, uc > 0 AND sp > uc * 1.10::DECIMAL(3,2) AS overrun FROM ({DEC})")
def _(spark, sf):
    sp, uc = F.col("salesPrice"), F.col("unitPrice")
    return P.quote_lines(spark, sf).select("quotationLineItemID", M.ratio(sp, uc).cast("double").alias("ratio"),
                                           M.is_overrun(sp, uc).alias("overrun"))


@query("h08_exact_quantile", "SELECT round(quantile_cont(salesPrice, 0.1), 4) AS p10, round(quantile_cont(salesPrice, 0.5), 4) AS p50, round(quantile_cont(salesPrice, 0.975), 4) AS p975 FROM quote_lines", digits=4)
def _(spark, sf):
    return exact_quantiles(P.quote_lines(spark, sf), [], "salesPrice", {"p10": 0.1, "p50": 0.5, "p975": 0.975})


@query("d11_ratio_bands", """SELECT coalesce(CAST(productID AS VARCHAR), '_global') AS productID, round(quantile_cont(price_ratio, 0.25), 6) AS p25,
 round(quantile_cont(price_ratio, 0.5), 6) AS p50, round(quantile_cont(price_ratio, 0.75), 6) AS p75 FROM priced GROUP BY GROUPING SETS ((productID), ())""")
def _(spark, sf):
    f = group_and_overall(frames.priced_lines(P.quote_lines(spark, sf)).select("productID", "price_ratio"), "productID")
    return exact_quantiles(f, ["productID"], "price_ratio", {"p25": 0.25, "p50": 0.5, "p75": 0.75})


@query("d12_price_bands_by_type", """SELECT coalesce(materialSpec, '__global__') AS product_type, round(quantile_cont(effective_price, 0.25), 2) AS low,
 round(quantile_cont(effective_price, 0.5), 2) AS mid, round(quantile_cont(effective_price, 0.75), 2) AS high
 FROM priced SEMI JOIN (SELECT quotationID FROM quotes WHERE statusName = 'Closed Won') w USING (quotationID) GROUP BY GROUPING SETS ((materialSpec), ())""", digits=2)
def _(spark, sf):
    won = P.quotes(spark, sf).filter(F.col("statusName") == "Closed Won")
    f = frames.priced_lines(P.quote_lines(spark, sf)).join(won, "quotationID", "left_semi")
    f = group_and_overall(f.select(F.col("materialSpec").alias("product_type"), "effective_price"), "product_type", "__global__")
    return exact_quantiles(f, ["product_type"], "effective_price", {"low": 0.25, "mid": 0.5, "high": 0.75})


@query("d13_top_vocabulary", """WITH v AS (SELECT productID, count(*) AS n FROM quote_lines GROUP BY 1 QUALIFY row_number() OVER (ORDER BY count(*) DESC, productID) <= 8)
 SELECT coalesce(CAST(v.productID AS VARCHAR), 'Other') AS category, count(*) AS rows FROM quote_lines l LEFT JOIN v ON v.productID = l.productID GROUP BY 1""")
def _(spark, sf):
    li = P.quote_lines(spark, sf)
    n = li.groupBy("productID").agg(F.count(F.lit(1)).alias("n"))
    top = n.orderBy(F.desc("n"), "productID").limit(8).select("productID", F.col("productID").cast("string").alias("category"))
    return li.join(F.broadcast(top), "productID", "left").groupBy(
        F.coalesce("category", F.lit("Other")).alias("category")).agg(F.count(F.lit(1)).alias("rows"))


@query("d14_option_graph", """SELECT parent, child, row_number() OVER (PARTITION BY parent ORDER BY child) - 1 AS place
 FROM (SELECT DISTINCT industry AS parent, CAST(productID AS VARCHAR) AS child FROM quote_lines JOIN quotes USING (quotationID))""")
def _(spark, sf):
    """Every child of every parent with its place in the sorted list; a list cut to a length is a filter on the place."""
    pairs = P.quote_lines(spark, sf).join(P.quotes(spark, sf), "quotationID").select(
        F.col("industry").alias("parent"), F.col("productID").cast("string").alias("child")).distinct()
    levels = ordered_text_levels(pairs, F.col("child"))
    placed = prefix_sums(pairs, ["parent"], levels, {"rows": F.lit(1)})
    return placed.select("parent", F.col(f"_l{len(levels) - 1}").alias("child"), F.col("rows_before").alias("place"))


@query("h09_log_features", "SELECT quotationID, round(ln(1 + greatest(grandTotal, 0)), 6) AS log_value FROM quotes")
def _(spark, sf):
    return P.quotes(spark, sf).select("quotationID", F.log1p(F.greatest("grandTotal", F.lit(0.0))).alias("log_value"))


@query("h10_days_to_expiration", """SELECT event_id, round(greatest((epoch_us(date_trunc('day', ts) + to_days(CAST(event_id % 3 AS INTEGER))) - epoch_us(ts)) / 86400000000.0, 0), 6) AS days_to_expiration,
 round((epoch_us(date_trunc('day', ts) + to_days(CAST(event_id % 3 AS INTEGER))) - epoch_us(ts)) / 86400000000.0, 6) AS signed_days FROM events""")
def _(spark, sf):
    from kilnworks.functions.timefn import days_between
    ev = P.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("created_at")).withColumn(
        "expiration", F.date_add(F.col("created_at").cast("date"), (F.col("event_id") % 3).cast("int")))
    signed = days_between(F.col("created_at"), F.col("expiration"))
    return ev.select("event_id", F.greatest(F.coalesce(signed, F.lit(0.0)), F.lit(0.0)).alias("days_to_expiration"),
                     signed.alias("signed_days"))


@query("h31_bands_and_confidence", """SELECT quotationID, CASE WHEN p >= .65 THEN 'High' WHEN p >= .40 THEN 'Medium' ELSE 'Low' END AS band,
 CASE WHEN n < 5 THEN 'Low' WHEN n < 20 THEN 'Medium' ELSE 'High' END AS confidence FROM (SELECT quotationID, (quotationID % 100) / 100.0 AS p, quotationID % 30 AS n FROM quotes)""")
def _(spark, sf):
    q = P.quotes(spark, sf).select("quotationID", (F.col("quotationID") % 100 / 100.0).alias("p"), (F.col("quotationID") % 30).alias("n"))
    return q.select("quotationID", Q.probability_band(F.col("p")).alias("band"), Q.confidence_level(F.col("n")).alias("confidence"))


@query("h32_guardrail", """SELECT quotationLineItemID, CASE WHEN n < 5 THEN 'few_comparable' WHEN price_ratio < 0.7 OR price_ratio > 1.12 THEN 'price_out_of_range'
 WHEN p < .40 OR p > .95 THEN 'score_out_of_range' ELSE '' END AS reason FROM (SELECT quotationLineItemID, productID, price_ratio, (productID % 100) / 100.0 AS p FROM priced)
 JOIN (SELECT productID, count(DISTINCT quotationID) AS n FROM quote_lines GROUP BY 1) USING (productID)""")
def _(spark, sf):
    f = frames.priced_lines(P.quote_lines(spark, sf))
    n = f.select("productID", "quotationID").distinct().groupBy("productID").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("productID") % 100 / 100.0
    return f.join(n, "productID").select("quotationLineItemID", Q.guardrail(
        F.col("n"), F.col("price_ratio"), F.lit(0.7), F.lit(1.12), p).alias("reason"))


@query("h33_cold_start", """WITH pn AS (SELECT productID, count(DISTINCT quotationID) AS n FROM quote_lines GROUP BY 1), tn AS (SELECT materialSpec, count(DISTINCT quotationID) AS n FROM quote_lines GROUP BY 1)
 SELECT p_partkey AS productID, CASE WHEN pn.n >= 25 THEN 'product' WHEN tn.n >= 5 THEN 'product_type' ELSE 'none' END AS level,
 CASE WHEN pn.n >= 25 THEN pn.n WHEN tn.n >= 5 THEN tn.n ELSE coalesce(pn.n, 0) END AS support
 FROM part LEFT JOIN pn ON p_partkey = pn.productID LEFT JOIN tn ON p_type = tn.materialSpec""")
def _(spark, sf):
    li = P.quote_lines(spark, sf)
    pn = li.groupBy("productID").agg(F.count_distinct("quotationID").alias("pn"))
    tn = li.groupBy("materialSpec").agg(F.count_distinct("quotationID").alias("tn"))
    f = (P.table(spark, sf, "part").select(F.col("p_partkey").alias("productID"), F.col("p_type").alias("materialSpec"))
         .join(pn, "productID", "left").join(tn, "materialSpec", "left"))
    own, kind = F.col("pn") >= 25, F.col("tn") >= 5
    return f.select("productID", F.when(own, "product").when(kind, "product_type").otherwise("none").alias("level"),
                    F.when(own, F.col("pn")).when(kind, F.col("tn")).otherwise(F.coalesce("pn", F.lit(0))).alias("support"))


@query("h34_normalise_terms", """SELECT quotationID, CASE lower(trim(paymentTerms)) WHEN 'immediate payment' THEN 'Immediate' WHEN '15 days' THEN '15 Days' WHEN '21 days' THEN '21 Days' ELSE paymentTerms END AS payment_terms,
 CASE WHEN industry IN ('BUILDING', 'MACHINERY') THEN industry ELSE 'Other' END AS industry FROM quotes""")
def _(spark, sf):
    return P.quotes(spark, sf).select("quotationID", Q.payment_term(F.col("paymentTerms")).alias("payment_terms"),
                                      F.when(F.col("industry").isin("BUILDING", "MACHINERY"), F.col("industry")).otherwise("Other").alias("industry"))


@query("h57_below_cost", "SELECT quotationLineItemID, CASE WHEN price_ratio < 1 THEN 1.0::DOUBLE ELSE 0.0 END AS below_cost, month(quoteDate)::DOUBLE AS quote_month FROM priced JOIN quotes USING (quotationID)")
def _(spark, sf):
    return frames.priced_lines(P.quote_lines(spark, sf)).join(P.quotes(spark, sf), "quotationID").select(
        "quotationLineItemID", (F.col("price_ratio") < 1).cast("double").alias("below_cost"),
        F.month("quoteDate").cast("double").alias("quote_month"))


@query("l01_weighted_average", "SELECT quotationID, round(CASE WHEN sum(quantity) > 0 THEN sum(salesPrice * quantity) / sum(quantity) ELSE avg(salesPrice) END, 6) AS price FROM quote_lines GROUP BY 1")
def _(spark, sf):
    return P.quote_lines(spark, sf).groupBy("quotationID").agg(
        frames.wavg(F.col("salesPrice"), F.col("quantity"), F.avg("salesPrice")).alias("price"))


@query("i27_win_frame", """SELECT quotationID, round(grandTotal, 6) AS grand_total, round(total_quantity, 6) AS total_quantity, line_count, region, industry, leadTimeDays AS lead_time_days,
 CAST(quoteDate AS VARCHAR) AS "quoteDate", won::DOUBLE AS won, round(wtd_price_ratio, 6) AS wtd_price_ratio, round(mean_price_ratio, 6) AS mean_price_ratio, round(min_price_ratio, 6) AS min_price_ratio,
 round(coalesce(avg_discount_pct, 0), 6) AS avg_discount_pct, n_products, round(contact_win_rate, 6) AS contact_win_rate, round(salesrep_win_rate, 6) AS salesrep_win_rate
 FROM headers LEFT JOIN rollup USING (quotationID)""")
def _(spark, sf):
    return frames.win_frame(P.quotes(spark, sf), P.quote_lines(spark, sf))


LINE_SQL = """WITH f AS (SELECT p.*, h.customerID, h.region, h.industry, h.leadTimeDays, h.quoteDate, h.contact_win_rate, h.salesrep_win_rate, h.won, h.paymentTerms,
 sum(amt) OVER (PARTITION BY p.quotationID) AS quote_total FROM priced p JOIN headers h USING (quotationID)),
 pp AS (SELECT a.quotationLineItemID, coalesce(any_value(a.price_ratio) / nullif(avg(b.price_ratio), 0), 1) AS pvp, coalesce(any_value(a.leadTimeDays) / nullif(avg(b.leadTimeDays), 0), 1) AS lvp
   FROM f a LEFT JOIN f b ON a.productID = b.productID AND b.quoteDate < a.quoteDate GROUP BY 1),
 cc AS (SELECT a.quotationLineItemID, coalesce(any_value(a.price_ratio) / nullif(avg(b.price_ratio), 0), 1) AS pvc, coalesce(any_value(a.quote_total) / nullif(avg(b.quote_total), 0), 1) AS vvc
   FROM f a LEFT JOIN f b ON a.customerID = b.customerID AND b.quoteDate < a.quoteDate GROUP BY 1),
 u AS (SELECT DISTINCT productID, quotationID, quoteDate, won FROM f), g AS (SELECT avg(won) AS g FROM u),
 r AS (SELECT a.productID, a.quotationID, (coalesce(sum(b.won), 0) + 3 * any_value(g)) / (count(b.won) + 3) AS rate FROM u a CROSS JOIN g LEFT JOIN u b ON a.productID = b.productID AND b.quoteDate < a.quoteDate GROUP BY 1, 2),
 s AS (SELECT quotationID, row_number() OVER w - 1 AS k, coalesce(datediff('day', lag(quoteDate) OVER w, quoteDate), -1) AS d FROM headers WINDOW w AS (PARTITION BY customerID ORDER BY quoteDate, quotationID))
 SELECT quotationID, quotationLineItemID, CAST(quoteDate AS VARCHAR) AS "quoteDate", productID, quantity, unitPrice, round(listPrice, 5) AS list_price, round(price_ratio, 5) AS price_ratio, leadTimeDays, region, industry,
 materialSpec AS product_type, paymentTerms AS payment_terms, round(quote_total, 5) AS quote_total, round(contact_win_rate, 5) AS contact_win_rate, round(salesrep_win_rate, 5) AS salesrep_win_rate,
 round(pvp, 5) AS price_vs_product, round(pvc, 5) AS price_vs_customer, round(rate, 5) AS product_win_rate, round(vvc, 5) AS value_vs_customer, round(lvp, 5) AS leadtime_vs_product,
 round(amt / quote_total, 5) AS line_share, month(quoteDate)::DOUBLE AS quote_month, k::DOUBLE AS customer_prior_quotes, d::DOUBLE AS customer_recency_days, won::DOUBLE AS won
 FROM f JOIN pp USING (quotationLineItemID) JOIN cc USING (quotationLineItemID) JOIN r USING (productID, quotationID) JOIN s USING (quotationID)"""


@query("i27_line_frame", LINE_SQL, digits=5)
def _(spark, sf):
    return frames.line_frame(P.quotes(spark, sf), P.quote_lines(spark, sf))


@query("i27_price_frame", """SELECT quotationID, quotationLineItemID, CAST(quoteDate AS VARCHAR) AS "quoteDate", productID, productName, region, quantity, unitPrice, leadTimeDays,
 round(contact_win_rate, 6) AS contact_win_rate, round(price_ratio, 6) AS price_ratio FROM priced JOIN headers USING (quotationID) WHERE won = 1""")
def _(spark, sf):
    return frames.price_frame(P.quotes(spark, sf), P.quote_lines(spark, sf))


@query("i27_bag_frame", """SELECT quotationID, quotationLineItemID, productID, productName, quantity, unitPrice, round(effective_price, 5) AS "salesPrice", materialSpec, round(discountPercent, 5) AS "discountPercent", leadTimeDays,
 region, industry, salesRepID, won::DOUBLE AS won FROM priced JOIN decided USING (quotationID)""", digits=5)
def _(spark, sf):
    return frames.bag_frame(P.quotes(spark, sf), P.quote_lines(spark, sf))
