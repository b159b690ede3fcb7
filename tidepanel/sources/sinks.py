"""Partitioned and text sinks in the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import evaluate as ev, factors as fs
from ..session import run_dir


def write_partitioned(df: DataFrame, by, name: str) -> str:
    """Hive-style directories. The rebalance hint lets adaptive execution split a large
    partition over several tasks and files and merge small ones, by measured size."""
    path = run_dir(df.sparkSession, name)
    df.hint("rebalance", *by).write.partitionBy(*by).parquet(path)
    return path


def write_factors(values: DataFrame) -> str:
    return write_partitioned(values, ["factor_id"], "factor_values")


def materialize_factors(panel: DataFrame, factors: dict[str, Column | fs.Step], buckets: int | None = None) -> DataFrame:
    """Compute a factor set (Columns, or Steps for nested cross-sections), store it by
    factor, and report per factor.

    Factors that the panel cannot compute become ``error`` rows and do not stop the rest. Those that shuffle different
    rows are made apart, so that no shuffle carries the columns of the others. The rows of a panel in ``buckets`` are
    dealt by code already, and are written where they are made.
    """
    good, bad = fs.resolvable(panel, factors)
    spark = panel.sparkSession
    if good:
        values = reduce(DataFrame.unionByName, [ev.unpivot(fs.composed(panel, part, buckets=buckets), list(part)) for part in fs.parts(good)])
        if buckets is None:
            path = write_factors(values)
        else:
            path = run_dir(spark, "factor_values")
            values.write.partitionBy("factor_id").parquet(path)
        rows = spark.read.parquet(path)
    else:
        rows = spark.createDataFrame([], "factor_id string, value double")
    status = fs.factor_status(rows).withColumn("status", F.lit("ok"))
    errors = spark.createDataFrame([(n, 0, 0, None, "error") for n in bad],
                                   "factor_id string, row_count long, valid_count long, coverage double, status string")
    return status.unionByName(errors)


def export_panel(rows: DataFrame) -> DataFrame:
    """Write selected panel rows and return their profile."""
    from ..operators.quality import profile
    path = run_dir(rows.sparkSession, "pool_panel")
    rows.write.parquet(path)
    return profile(rows.sparkSession.read.parquet(path))


def export_snapshot(spark, tables: dict[str, DataFrame]) -> DataFrame:
    """Write the tables of a research snapshot; the manifest lists their row counts as
    read back from storage."""
    root = run_dir(spark, "snapshot")
    parts = []
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}")
        parts.append(spark.read.parquet(f"{root}/{name}").agg(F.count(F.lit(1)).alias("row_count"))
                     .select(F.lit(name).alias("table_name"), "row_count"))
    manifest = parts[0]
    for part in parts[1:]:
        manifest = manifest.unionByName(part)
    return manifest
