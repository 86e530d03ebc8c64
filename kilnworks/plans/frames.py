"""Training frames for the quote models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.functions import quote as Q
from kilnworks.operators.asof import prior_history, prior_ratio, value_and_count, win_rate_history
from kilnworks.operators.labels import OPTIONAL_LINE, fill_optional, header_frame
from kilnworks.operators.scale import join_on, with_group_totals
from kilnworks.session import durable


def priced_lines(lines: DataFrame, use_list: bool = True) -> DataFrame:
    """Lines with effective price, price basis, price ratio and recomputed amount."""
    basis = "listPrice" if use_list and "listPrice" in lines.columns else "unitPrice"
    li = fill_optional(lines, OPTIONAL_LINE).withColumn("effective_price", Q.effective_price(lines))
    base = F.nullif(Q.number(basis), F.lit(0.0))
    amount = F.coalesce(Q.number("lineTotal"), Q.number("quantity") * F.col("effective_price"), F.lit(0.0))
    return li.withColumns({"price_basis": base, "price_ratio": F.try_divide(F.col("effective_price"), base),
                           "amt": amount})


def has_list_price(lines: DataFrame) -> bool:
    """Whether the export carries any list price; it decides the basis for all rows."""
    return "listPrice" in lines.columns and not lines.filter(
        F.coalesce(Q.number("listPrice"), F.lit(0.0)) != 0).isEmpty()


def wavg(x, w, fallback):
    """Weighted mean as an aggregate; ``fallback`` where the weights add up to nothing."""
    return F.when(F.sum(w) > 0, F.try_divide(F.sum(x * w), F.sum(w))).otherwise(fallback)


def quote_rollup(priced: DataFrame) -> DataFrame:
    """Per quote: size, distinct products and price-ratio summaries."""
    ratio = F.col("price_ratio")
    return priced.groupBy("quotationID").agg(
        F.sum(Q.number("quantity")).alias("total_quantity"), F.count(F.lit(1)).alias("line_count"),
        F.count_distinct("productID").alias("n_products"), F.avg(ratio).alias("mean_price_ratio"),
        F.min(ratio).alias("min_price_ratio"),
        wavg(F.coalesce(ratio, F.lit(1.0)), F.col("amt"), F.avg(ratio)).alias("wtd_price_ratio"),
        ((1 - F.coalesce(F.avg(ratio), F.lit(1.0))) * 100).alias("avg_discount_pct"))


def win_frame(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per decided quote: header rates beside the roll-up of its lines."""
    h = header_frame(quotes)
    li = priced_lines(lines, has_list_price(lines)).join(h.select("quotationID"), "quotationID", "left_semi")
    return h.join(quote_rollup(li), "quotationID", "left").select(
        "quotationID", Q.number("grandTotal").alias("grand_total"), "total_quantity", "line_count",
        "region", "industry", F.col("leadTimeDays").alias("lead_time_days"), "quoteDate", "won",
        "wtd_price_ratio", "mean_price_ratio", "min_price_ratio",
        F.coalesce("avg_discount_pct", F.lit(0.0)).alias("avg_discount_pct"), "n_products",
        "contact_win_rate", "salesrep_win_rate")


def line_frame(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per line of every decided quote with strictly prior history features."""
    h = header_frame(quotes).select("quotationID", "customerID", "region", "industry", "leadTimeDays", "quoteDate",
        "contact_win_rate", "salesrep_win_rate", "won",
        F.col("paymentTerms").alias("payment_terms"),
        F.col("prior_count").cast("double").alias("customer_prior_quotes"),
        F.col("recency_days").alias("customer_recency_days"))
    li = priced_lines(lines, has_list_price(lines))
    li = li.select("quotationID", "quotationLineItemID", "productID", "quantity", "unitPrice",
                   F.col("price_basis").alias("list_price"), "price_ratio",
                   F.col("materialSpec").alias("product_type"),
                   (Q.number("quantity") * F.col("effective_price")).alias("__amt"))
    f = with_group_totals(li.join(h, "quotationID"), ["quotationID"], {"quote_total": F.sum("__amt")})
    f = durable(f.filter(F.col("price_ratio").isNotNull() & F.col("won").isNotNull()))
    product = prior_history(f, ["productID"], "quoteDate", value_and_count("pp", F.col("price_ratio"))
                            | value_and_count("lt", F.col("leadTimeDays")))
    customer = prior_history(f, ["customerID"], "quoteDate", value_and_count("cp", F.col("price_ratio"))
                             | value_and_count("qt", F.col("quote_total")))
    rate = win_rate_history(f, "productID", "quoteDate", "won", "product_win_rate", quote="quotationID")
    by_product = join_on(product, rate, ["productID", "quoteDate"])
    f = join_on(join_on(f, by_product, ["productID", "quoteDate"]), customer, ["customerID", "quoteDate"])

    def versus(value: str, m: str):
        return prior_ratio(F.col(value), F.col(f"prior_{m}_s"), F.col(f"prior_{m}_n"))

    f = f.withColumns({"price_vs_product": versus("price_ratio", "pp"),
                       "leadtime_vs_product": versus("leadTimeDays", "lt"),
                       "price_vs_customer": versus("price_ratio", "cp"),
                       "value_vs_customer": versus("quote_total", "qt")})
    share = F.least(F.greatest(F.coalesce(F.try_divide("__amt", "quote_total"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return f.withColumns({"line_share": share, "quote_month": F.month("quoteDate").cast("double")}).select(
        "quotationID", "quotationLineItemID", "quoteDate", "productID", "quantity", "unitPrice", "list_price",
        "price_ratio", "leadTimeDays", "region", "industry", "product_type", "payment_terms", "quote_total",
        "contact_win_rate", "salesrep_win_rate", "price_vs_product", "price_vs_customer", "product_win_rate",
        "value_vs_customer", "leadtime_vs_product", "line_share", "quote_month", "customer_prior_quotes",
        "customer_recency_days", "won")


def price_frame(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of won quotes: the ratios at which deals closed."""
    won = header_frame(quotes).filter(F.col("won") == 1.0).select(
        "quotationID", "region", "leadTimeDays", "quoteDate", "contact_win_rate")
    li = priced_lines(lines, has_list_price(lines)).filter(F.col("price_ratio").isNotNull())
    return li.join(won, "quotationID").select(
        "quotationID", "quotationLineItemID", "quoteDate", "productID", "productName", "region",
        "quantity", "unitPrice", "leadTimeDays", "contact_win_rate", "price_ratio")


def bag_frame(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    """Raw lines of decided quotes with the label of their bag."""
    h = header_frame(quotes).select("quotationID", "region", "industry", "leadTimeDays", "salesRepID", "won")
    li = priced_lines(lines, has_list_price(lines))
    return (li.withColumn("salesPrice", F.col("effective_price"))
            .filter(F.col("salesPrice").isNotNull() & F.col("unitPrice").isNotNull())
            .join(h, "quotationID").select(
        "quotationID", "quotationLineItemID", "productID", "productName", "quantity", "unitPrice", "salesPrice",
        "materialSpec", "discountPercent", "leadTimeDays", "region", "industry", "salesRepID", "won"))
