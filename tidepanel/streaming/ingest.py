"""Incremental ingest with Structured Streaming.

Each micro-batch is appended under its own batch number, which is overwritten if the
batch is retried, so the sink is idempotent; reading resolves the latest version of
each key. Nothing is rewritten per batch and no state grows on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.screens import keep_last


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .option("recursiveFileLookup", True).parquet(path))


def append_batches(stream: DataFrame, target: str, mode: str = "append", checkpoint: str | None = None,
                   keep: Column | None = None, counters: dict[str, Column] | None = None):
    """Run a stream to the end of its input, one folder per micro-batch.

    The checkpoint stays beside the target, so that a later run goes on where this one
    ended, with new batch numbers. ``keep`` filters what is stored; ``counters`` over all
    rows of a batch are stored by batch too.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch if keep is None else batch.filter(keep)
        kept.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        if counters:
            counts = batch.agg(*[v.alias(k) for k, v in counters.items()])
            counts.write.mode("overwrite").parquet(f"{target}_counters/batch_id={batch_id}")
    query = (stream.writeStream.outputMode(mode).trigger(availableNow=True)
             .option("checkpointLocation", checkpoint or f"{target}_checkpoint").foreachBatch(write).start())
    query.awaitTermination()
    return query


def latest_state(spark: SparkSession, target: str, keys, revision: str | None = None) -> DataFrame:
    """Latest version of each key: the newest batch, then the newest revision (a
    non-negative int)."""
    df = spark.read.parquet(target)
    seq = F.col("batch_id").cast("long") * (1 << 31) + (F.coalesce(F.col(revision), F.lit(0)) if revision else F.lit(0))
    return keep_last(df.withColumn("_seq", seq), list(keys), "_seq").drop("_seq", "batch_id")


def batch_counters(spark: SparkSession, target: str) -> DataFrame:
    """Counters of every micro-batch of a target, over all its runs."""
    return spark.read.parquet(f"{target}_counters")
