"""Registered streaming queries: each drains its stream over the given tables and returns the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnworks import schemas as X
from kilnworks.functions import quote as Q
from kilnworks.plans.catalog import query
from kilnworks.plans.quotes_queries import RATE_TABLE, rate_table
from kilnworks.operators.labels import decided_headers
from kilnworks.session import scratch_path
from kilnworks.sources import proxies as P
from kilnworks.streaming import jobs as J


def event_files(spark, sf):
    """The events table as JSON envelopes, several files so the stream sees several arrivals."""
    path = scratch_path(spark, "events")
    ev = P.table(spark, sf, "events")
    ev.select(F.col("event_type").alias("topic"), F.concat(F.lit("t"), F.col("user_id") % 5).alias("tenant"),
              F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("value"), F.col("value").cast("string")).alias("payload"),
              F.when(F.col("event_id") % 2 == 0, "1").alias("label"),
              (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts")).write.json(path)
    return path


@query("k01_event_ingestion", "SELECT event_type AS topic, 't' || (user_id % 5) AS tenant, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", digits=4)
def _(spark, sf):
    stream = J.read_events(spark, event_files(spark, sf))
    out = J.drain(stream, scratch_path(spark, "k01"), scratch_path(spark, "ck"))
    return out.groupBy("topic", "tenant").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("payload")["value"].cast("double")).alias("total"))


KEYED = "SELECT 't' || (user_id % 5) AS tenant, event_type AS topic, count(*) AS n, round(min(epoch_us(ts) / 1e6), 3) AS oldest FROM events GROUP BY 1, 2"


@query("k02_debounce_stream", f"""SELECT tenant, topic, 'count' AS reason, n // 100 AS batches, n // 100 * 100 AS events FROM ({KEYED}) WHERE n >= 100
 UNION ALL SELECT tenant, topic, 'close', 1, n % 100 FROM ({KEYED}) WHERE n % 100 > 0""")
def _(spark, sf):
    """Batches of one hundred per (tenant, topic), and what still waits when the stream is closed: every event is in one of them."""
    ready = J.debounce(J.read_events(spark, event_files(spark, sf)), 100, 100 * 366 * 86_400_000)
    checkpoint = scratch_path(spark, "ck")
    out = J.drain_debounced(ready, scratch_path(spark, "k02"), checkpoint).unionByName(J.waiting(spark, checkpoint))
    return out.groupBy("tenant", "topic", "reason").agg(F.sum("batches").alias("batches"), F.sum("events").alias("events"))


@query("k02_debounce_age", f"""SELECT tenant, topic, sum(events) AS events, sum(aged) AS aged FROM (SELECT tenant, topic, n AS events, n % 1000000 AS aged FROM ({KEYED})) GROUP BY 1, 2""")
def _(spark, sf):
    """Events of keys that never fill a batch: all are handed on as their oldest has waited for more than an hour."""
    ready = J.debounce(J.read_events(spark, event_files(spark, sf)), 1_000_000, 3_600_000)
    out = J.drain_debounced(ready, scratch_path(spark, "k02"), scratch_path(spark, "ck"))
    return out.groupBy("tenant", "topic").agg(F.sum("events").alias("events"), F.sum(F.when(F.col("reason") == "age", F.col("events")).otherwise(0)).alias("aged"))


@query("k02_debounce_batch", """SELECT event_type AS topic, user_id % 5 AS tenant, count(*) AS n, count(*) >= 400 OR epoch_us(TIMESTAMP '2024-01-31') / 1e6 - min(epoch_us(ts) / 1e6) >= 2590000 AS ready FROM events GROUP BY 1, 2""")
def _(spark, sf):
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    g = P.table(spark, sf, "events").groupBy(F.col("event_type").alias("topic"), (F.col("user_id") % 5).alias("tenant")).agg(
        F.count(F.lit(1)).alias("n"), F.min(sec).alias("oldest"))
    now = F.unix_micros(F.lit("2024-01-31").cast("timestamp")) / 1e6
    return g.withColumn("ready", J.batch_ready(F.col("n"), F.col("oldest"), now, 400, 2590000)).drop("oldest")


def completed_orders(spark, sf):
    return P.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.timestamp_add("DAY", F.lit(45), F.col("o_orderdate").cast("timestamp")).alias("completed_at"),
        F.when(F.col("o_orderstatus") == "P", "CANCELLED").otherwise("DONE").alias("status"))


def swept_work_orders(spark, sf):
    li = P.table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("job_id"), F.col("l_shipdate").cast("timestamp").alias("scheduled_end"),
                     (60 + 10 * F.col("l_quantity")).alias("expected"), F.when(F.col("l_linenumber") != 7, 70 + 9 * F.col("l_quantity")).alias("actual"))


OUTCOMES = """SELECT o_orderkey AS job_id, round((epoch_us(o_orderdate + INTERVAL 45 DAY) - epoch_us(f)) / 3.6e9, 4) AS hours_late, epoch_us(o_orderdate + INTERVAL 45 DAY) > epoch_us(f) AS was_late, round(CASE WHEN ok THEN a / e END, 6) AS duration_overrun_ratio
 FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS f, sum(60 + 10 * l_quantity) AS e, sum(70 + 9 * l_quantity) AS a, bool_and(l_linenumber <> 7) AS ok FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'"""


@query("k03_outcome_sweep", OUTCOMES)
def _(spark, sf):
    """Two sweeps, the second over the look-back and what came after: one record per order."""
    root = scratch_path(spark, "sweep")
    done, wo = completed_orders(spark, sf), swept_work_orders(spark, sf)
    early = done.filter(F.col("completed_at") < F.lit("1999-01-01").cast("timestamp"))
    J.sweep_outcomes(early, wo, root)
    J.sweep_outcomes(done, wo, root)
    return J.read_outcomes(spark, f"{root}/outcomes").select("job_id", "hours_late", "was_late", "duration_overrun_ratio")


@query("k03_outcome_stream", OUTCOMES)
def _(spark, sf):
    """The same labels from a stream of completed orders, committed batch by batch."""
    path, out = scratch_path(spark, "done"), scratch_path(spark, "outcomes")
    completed_orders(spark, sf).write.parquet(path)
    stream = spark.readStream.schema("job_id bigint, completed_at timestamp, status string").option("maxFilesPerTrigger", 1).parquet(path)
    J.for_each_batch(stream, J.write_outcomes(out, swept_work_orders(spark, sf)), scratch_path(spark, "ck"))
    return J.read_outcomes(spark, out).select("job_id", "hours_late", "was_late", "duration_overrun_ratio")


@query("k04_late_copies", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def _(spark, sf):
    """Every event arrives twice; the copies fall away."""
    path = scratch_path(spark, "twice")
    ev = P.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    ev.unionByName(ev).sortWithinPartitions("ts").write.parquet(path)
    stream = spark.readStream.schema("event_id bigint, ts timestamp").parquet(path)
    out = J.drain(J.drop_late_copies(stream, "event_id", "ts"), scratch_path(spark, "k04"), scratch_path(spark, "ck"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query("k05_event_labels", "SELECT event_type AS topic, count(CASE WHEN event_id % 2 = 0 THEN 1 END) AS labelled, count(CASE WHEN event_id % 2 = 1 THEN 1 END) AS unlabelled FROM events GROUP BY 1")
def _(spark, sf):
    """The label comes from the event and not from a later look at the tables."""
    stream = J.read_events(spark, event_files(spark, sf)).select("topic", "label")
    out = J.drain(stream, scratch_path(spark, "k05"), scratch_path(spark, "ck"))
    return out.groupBy("topic").agg(F.count_if(F.col("label").isNotNull()).alias("labelled"), F.count_if(F.col("label").isNull()).alias("unlabelled"))


DRAFT_SQL = f"""WITH r AS ({RATE_TABLE}) SELECT quotationLineItemID, round(coalesce(negotiatedSalesPrice, salesPrice) / listPrice, 6) AS price_ratio, round(r.rate, 6) AS contact_win_rate
 FROM quote_lines JOIN quotes USING (quotationID) LEFT JOIN r ON r.entity = CAST(customerID AS VARCHAR) WHERE statusName = 'Sent'"""


@query("k06_stream_features", DRAFT_SQL)
def _(spark, sf):
    """Draft lines priced and joined to their customer's rate as they arrive."""
    path = scratch_path(spark, "drafts")
    q = P.quotes(spark, sf)
    d = P.quote_lines(spark, sf).join(q.filter("statusName = 'Sent'").select("quotationID", "customerID"), "quotationID").select(
        "quotationLineItemID", "customerID", "negotiatedSalesPrice", "salesPrice", "unitPrice", "listPrice")
    d.write.parquet(path)
    rates = rate_table(decided_headers(q), "customerID").filter("entity <> '_global'")

    def score(f):
        ratio = Q.serving_ratio(F.col("negotiatedSalesPrice"), F.col("salesPrice"), F.col("unitPrice"), F.col("listPrice"))
        return f.select("quotationLineItemID", ratio.alias("price_ratio"), "contact_win_rate")

    return J.drain(J.score_stream(spark.readStream.schema(d.schema).parquet(path), rates, "customerID", score),
                   scratch_path(spark, "k06"), scratch_path(spark, "ck"))


@query("k06_stream_scoring", "SELECT materialSpec, count(*) AS rows, round(avg(y), 3) AS mean_score FROM scored GROUP BY 1", digits=3)
def _(spark, sf):
    """Draft lines scored by a fitted pipeline inside the stream; rows and mean score per material."""
    from pyspark.ml.classification import LogisticRegression

    from kilnworks.operators import models as ML
    s = P.scored_lines(spark, sf)
    num, cat = ["quantity", "unitPrice", "price_ratio"], ["materialSpec"]
    prep = ML.prepare(s, num, cat)
    model = ML.fit_model(s, prep, LogisticRegression(labelCol="y"))
    path = scratch_path(spark, "lines")
    s.select("id", *num, *cat).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    out = J.drain(ML.raw_scores(stream, prep, model, "p").select("id", "materialSpec", "p"), scratch_path(spark, "k06s"), scratch_path(spark, "ck"))
    return out.groupBy("materialSpec").agg(F.count(F.lit(1)).alias("rows"), F.avg("p").alias("mean_score"))


@query("k07_snapshot_sink", "SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    """Scoring events appended to folders by date, read back by partition."""
    stream = spark.readStream.schema(X.EVENT_ROW).option("pathGlobFilter", "events.parquet").parquet(sf)
    scored = stream.select("event_id", "value", F.col("ts").cast("timestamp").alias("scored_at"))
    path = scratch_path(spark, "snaps")
    J.snapshot_sink(scored, path, scratch_path(spark, "ck"), "scored_at")
    return spark.read.parquet(path).groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count(F.lit(1)).alias("n"))
