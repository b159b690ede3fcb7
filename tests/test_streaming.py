import os

from pyspark.sql import functions as F

from tidepanel.operators.screens import keep_last
from tidepanel.session import run_dir
from tidepanel.streaming import ingest as st

SCHEMA = "k bigint, v double, revision int"


def test_corrections_win_and_retries_are_harmless(spark):
    src, target = run_dir(spark, "src"), run_dir(spark, "dst")
    base = spark.range(20).select(F.col("id").alias("k"), F.col("id").cast("double").alias("v"), F.lit(0).alias("revision"))
    base.coalesce(1).write.parquet(f"{src}/a")
    base.filter("k % 5 = 0").withColumns({"v": F.col("v") + 100, "revision": F.lit(1)}).coalesce(1).write.parquet(f"{src}/b")
    st.append_batches(st.file_stream(spark, src, SCHEMA, 1), target)
    want = {k: float(k + 100 if k % 5 == 0 else k) for k in range(20)}

    def state():
        return {r.k: r.v for r in st.latest_state(spark, target, ["k"], "revision").collect()}
    assert state() == want
    batches = [d for d in os.listdir(target) if d.startswith("batch_id=")]
    assert len(batches) >= 2
    # A new run over the same input has nothing to read; the state does not change.
    st.append_batches(st.file_stream(spark, src, SCHEMA, 2), target)
    assert state() == want


def test_a_correction_after_a_restart_wins(spark):
    src, target = run_dir(spark, "src"), run_dir(spark, "dst")
    rows = spark.range(9).select(F.col("id").alias("k"), F.lit(3.0).alias("v"), F.lit(0).alias("revision"))
    for i in range(3):
        rows.filter(f"k % 3 = {i}").coalesce(1).write.parquet(f"{src}/{i}")
    st.append_batches(st.file_stream(spark, src, SCHEMA, 1), target)
    rows.filter("k = 1").withColumn("v", F.lit(99.0)).coalesce(1).write.parquet(f"{src}/later")
    st.append_batches(st.file_stream(spark, src, SCHEMA, 16), target)
    assert {r.k: r.v for r in st.latest_state(spark, target, ["k"], "revision").collect()} == {
        k: 99.0 if k == 1 else 3.0 for k in range(9)}


def test_counters_of_more_batches_than_progress_keeps(spark):
    src, target = run_dir(spark, "src"), run_dir(spark, "dst")
    rows = spark.range(130).select(F.col("id").alias("k"), F.col("id").cast("double").alias("v"), F.lit(0).alias("revision"))
    rows.repartitionByRange(105, "k").write.parquet(src)
    st.append_batches(st.file_stream(spark, src, SCHEMA, 1), target, keep=F.col("v") > 9,
                      counters={"n": F.count(F.lit(1)), "kept": F.count_if(F.col("v") > 9)})
    totals = st.batch_counters(spark, target).agg(F.sum("n"), F.sum("kept"), F.count("*")).first()
    assert tuple(totals)[:2] == (130, 120) and totals[2] > 100
    assert st.latest_state(spark, target, ["k"]).count() == 120


def test_keep_last_needs_no_sort(spark):
    df = spark.range(10).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"), F.col("id").alias("seq"))
    out = keep_last(df, ["k"], "seq")
    assert "SortAggregate" not in out._jdf.queryExecution().toString()
    assert {r.k: r.v for r in out.collect()} == {0: 9.0, 1: 7.0, 2: 8.0}
