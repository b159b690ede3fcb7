"""Incremental ingest queries over files staged from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import run_dir
from ..sources.panel import read
from ..streaming import ingest as st
from . import query

SCHEMA = "event_id bigint, user_id bigint, value double, revision int"


def stage(spark, sf, corrections=True):
    """Event files, then a later file set with corrected values for some events."""
    path = run_dir(spark, "landing")
    e = read(spark, sf, "events").select("event_id", "user_id", "value", F.lit(0).alias("revision"), F.to_date("ts").alias("day"))
    e.repartition("day").drop("day").write.parquet(f"{path}/first")
    if corrections:
        fixed = e.filter("event_id % 7 = 0").withColumns({"value": F.col("value") + 1, "revision": F.lit(1)})
        fixed.drop("day").write.parquet(f"{path}/second")
    return path


@query("W1", "SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN value + 1 ELSE value END AS value FROM events")
def w1(spark, sf):
    target = run_dir(spark, "ingested")
    st.append_batches(st.file_stream(spark, stage(spark, sf), SCHEMA, 4), target)
    return st.latest_state(spark, target, ["event_id"], "revision").select("event_id", "user_id", "value")


@query("W2", "SELECT count(*) + count(*) FILTER (event_id % 7 = 0) AS rows_read, count(*) FILTER (value > 0) + count(*) FILTER (event_id % 7 = 0) AS rows_kept FROM events")
def w2(spark, sf):
    target = run_dir(spark, "ingested")
    st.append_batches(st.file_stream(spark, stage(spark, sf), SCHEMA, 4), target, keep=F.col("value") > 0,
                      counters={"rows_read": F.count(F.lit(1)), "rows_kept": F.count_if(F.col("value") > 0)})
    return st.batch_counters(spark, target).agg(F.sum("rows_read").alias("rows_read"), F.sum("rows_kept").alias("rows_kept"))


@query("W3", "SELECT user_id, sum(value::DECIMAL(18,2))::DOUBLE AS amount_sum, count(*) AS valid_rows, sum(value::DECIMAL(18,2))::DOUBLE / count(*) AS average_amount FROM events WHERE value > 0 GROUP BY user_id")
def w3(spark, sf):
    stream = st.file_stream(spark, stage(spark, sf, corrections=False), SCHEMA, 4).filter("value > 0")
    sums = stream.groupBy("user_id").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("amount_sum"),
                                         F.count(F.lit(1)).alias("valid_rows"))
    target = run_dir(spark, "partial_sums")
    st.append_batches(sums, target, mode="update")
    return st.latest_state(spark, target, ["user_id"]).withColumn("average_amount", F.col("amount_sum") / F.col("valid_rows"))
