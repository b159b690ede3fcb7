"""The mixture reaches the pieces; proofs pass nothing through the driver."""

from pyspark.sql import functions as F

from tidepanel.llm import common, merkle, mixing


def test_pieces_carry_the_order_of_the_mixture(spark):
    import corpus_pipeline

    df = spark.createDataFrame([(i, "a" if i < 300 else "b", f"text {i}") for i in range(900)], "doc_id long, source string, text string")
    stored = common.stored(corpus_pipeline.source_mixing(spark, df.repartition(3), ""), "mixed")
    out = corpus_pipeline.sentencepiece(spark, stored, "").orderBy("position").collect()
    wanted = [r["doc_id"] for r in mixing.mix(df, block_rows=1).orderBy("position").collect()]
    assert [r["position"] for r in out] == list(range(900)) and [r["doc_id"] for r in out] == wanted
    assert 0 < sum(r["source"] == "a" for r in out[:90]) < 90


def test_proofs_broadcast_no_paths_or_records(spark):
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    plan = merkle.prove(merkle.manifest(rows, fan=4))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [digest" not in plan
    assert plan.count("SortMergeJoin [digest") >= 4
