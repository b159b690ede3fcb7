"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import run_dir

#: Words are runs of anything but these six ASCII white-space characters.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: survives the loss of executors."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_of(id_col: str) -> Column:
    """CRC-32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def share_of_hash(*cols: str) -> Column:
    """A number in [0, 1) that depends on the columns' values alone."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols], F.lit(7)), F.lit(1 << 30)) / float(1 << 30)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tasks(df: DataFrame, each: int = 64 << 20) -> int:
    """Partitions for a shuffle of ``df``: as set for the session, and more where Catalyst's size says that a partition
    would hold over ``each`` bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(df), min(size // each, 200_000))
