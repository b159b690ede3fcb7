"""Session settings that the library reads but never forces on a cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by the cluster.

    Only where ``spark.checkpoint.dir`` is unset (a local test session) a scratch
    folder is chosen, and only for a local master.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A folder in the shared directory that belongs to this application alone."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/tidepanel-{app}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that keeps
    column pruning and survives the loss of executors."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables that this application has stored by code, with the application's id.
_BY_CODE: list[tuple[str, str]] = []


def cut_by_code(df: DataFrame, name: str, buckets: int | None = None) -> DataFrame:
    """``cut`` into a table that is bucketed by code: windows along a code's history then read it without a shuffle. A
    stored panel says into how many ``buckets``; the default is that of the session's shuffles."""
    spark = df.sparkSession
    if buckets is None:
        buckets = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = run_dir(spark, name)
    table = "tidepanel_" + path.rsplit("-", 1)[1]
    df.repartition(buckets, "code").write.bucketBy(buckets, "code").sortBy("code", "date").option("path", path).saveAsTable(table)
    _BY_CODE.append((spark.sparkContext.applicationId, table))
    return spark.table(table)


def clean(spark: SparkSession) -> None:
    """Delete what this application has stored: its folder and its panel tables. Call it
    when no result is read any more."""
    from .sources import panel
    app = spark.sparkContext.applicationId
    for key in [k for k in panel._STORED if k[0] == app]:
        _BY_CODE.append((app, panel._STORED.pop(key).table))
    for entry in [t for t in _BY_CODE if t[0] == app]:
        spark.sql(f"DROP TABLE IF EXISTS {entry[1]}")
        _BY_CODE.remove(entry)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidepanel-{app}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
