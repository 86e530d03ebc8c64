"""Quote outcomes and decided headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnworks.functions import quote as Q
from kilnworks.operators.asof import count_and_recency_history, win_rate_history
from kilnworks.operators.graph import family_roots
from kilnworks.operators.scale import join_on, last_per_key, with_scalars
from kilnworks.session import durable

# Optional columns of the export with their types. A parent id has the type of the id.
OPTIONAL_HEADER = {"parentQuotationID": T.StringType(), "revisionNumber": T.IntegerType(),
                   "paymentTerms": T.StringType()}
OPTIONAL_LINE = {"negotiatedSalesPrice": T.DoubleType(), "listPrice": T.DoubleType(),
                 "lineTotal": T.DoubleType(), "materialSpec": T.StringType(),
                 "productName": T.StringType(), "discountPercent": T.DoubleType()}
# Fixed value: open quotes of this age count as lost.
OPEN_QUOTE_LOST_AFTER_DAYS = 60


def fill_optional(df: DataFrame, spec: dict[str, T.DataType]) -> DataFrame:
    """Add absent optional columns: revision 1, everything else null."""
    types = dict(spec)
    if "parentQuotationID" in spec and "quotationID" in df.columns:
        types["parentQuotationID"] = df.schema["quotationID"].dataType
    add = {c: (F.lit(1) if c == "revisionNumber" else F.lit(None)).cast(t)
           for c, t in types.items() if c not in df.columns}
    return df.withColumns(add) if add else df


def derive_label(df: DataFrame) -> tuple[DataFrame, bool]:
    """``won`` from the first valid explicit 0/1 column, else from the status text.

    Returns the frame and whether the label came from the status text; raises
    when nothing in the data looks like an outcome.
    """
    present = [c for c in Q.LABEL_COLUMNS if c in df.columns]
    if present:
        checks = []
        for c in present:
            v = Q.number(F.col(c).cast("string"))
            checks += [F.count(v).alias(f"{c}_n"), F.count_if(~v.isin(0.0, 1.0)).alias(f"{c}_bad")]
        seen = df.agg(*checks).first()
        for c in present:
            if seen[f"{c}_n"] > 0 and seen[f"{c}_bad"] == 0:
                return df.withColumn("won", Q.number(F.col(c).cast("string"))), False
    if "statusName" not in df.columns:
        raise ValueError("no explicit label column and no statusName")
    out = df.withColumn("won", Q.text_outcome(F.col("statusName")))
    if out.filter(F.col("won").isNotNull()).isEmpty():
        raise ValueError("no statusName value looks like a win or a loss")
    return out, True


def age_out_open(df: DataFrame, days: int | None = OPEN_QUOTE_LOST_AFTER_DAYS) -> DataFrame:
    """Open, sent quotes older than ``days`` before the newest quote are lost."""
    if days is None:
        return df
    ref = df.agg(F.max("quoteDate").alias("__newest"))
    stale = (F.col("won").isNull() & ~F.lower("statusName").contains("draft")
             & (F.datediff(F.col("__newest"), F.col("quoteDate")) >= days))
    return with_scalars(df, ref).withColumn("won", F.when(stale, 0.0).otherwise(F.col("won"))).drop("__newest")


def final_revisions(df: DataFrame) -> DataFrame:
    """The last revision of each quote family."""
    rooted = family_roots(df, "quotationID", "parentQuotationID")
    return last_per_key(rooted, ["root"], ["revisionNumber", "quotationID"])


def decided_headers(quotes: DataFrame, lost_after_days: int | None = OPEN_QUOTE_LOST_AFTER_DAYS, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per decided quote family with its outcome; of other columns only ``columns``, or all of them."""
    h = fill_optional(quotes, OPTIONAL_HEADER)
    if columns is not None:
        needed = {"quotationID", "parentQuotationID", "revisionNumber", "quoteDate", "statusName", *Q.LABEL_COLUMNS, *columns}
        h = h.select(*[c for c in h.columns if c in needed])
    h = h.dropDuplicates(["quotationID"])
    # read by the label check, by the newest date and by the result
    h, from_status = derive_label(durable(final_revisions(h)))
    if from_status:
        h = age_out_open(h, lost_after_days)
    return h.filter(F.col("won").isNotNull())


def header_frame(quotes: DataFrame) -> DataFrame:
    """Decided headers with as-of rates, prior quote count and recency of the customer.

    The decided headers feed five aggregates, so they are written once.
    """
    h = durable(decided_headers(quotes))  # all columns: the frames choose from them
    customer = win_rate_history(h, "customerID", "quoteDate", "won", "contact_win_rate")
    rep = win_rate_history(h, "salesRepID", "quoteDate", "won", "salesrep_win_rate")
    seen = count_and_recency_history(h, "customerID", "quoteDate", "quotationID")
    out = join_on(join_on(h, customer, ["customerID", "quoteDate"]), rep, ["salesRepID", "quoteDate"])
    return out.join(seen, "quotationID", "left")


def coded_outcome(stage: Column, status: Column, sales_order_id: Column) -> tuple[Column, Column]:
    """(won, lost) from stage and status codes; lost beats won."""
    lost = status.isin("CLOSED_LOST", "CLOSED_LOST_STATUS")
    won = ((stage == "SALES_ORDER") | status.isin("CONFIRMED", "SALES_ORDER_STATUS")
           | sales_order_id.isNotNull())
    lost = F.coalesce(lost, F.lit(False))
    return F.coalesce(won, F.lit(False)) & ~lost, lost
