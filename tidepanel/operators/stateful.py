"""Sequential operators per code. A code has one row per session, so the history that a
task holds is bounded by the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clean import c
from ..functions.timeseries import history, so_far


def days_from_last_change(df: DataFrame, x: str, out: str) -> DataFrame:
    """Rows since the value changed; missing to missing is no change."""
    w = history()
    first = F.row_number().over(w) == 1
    moved = F.when(first | ~c(x).eqNullSafe(F.lag(c(x)).over(w)), 1).otherwise(0)
    df = df.withColumn("_moved", moved).withColumn("_island", F.sum("_moved").over(so_far()))
    run = Window.partitionBy("code", "_island").orderBy("date")
    return (df.withColumn(out, (F.row_number().over(run) - 1).cast("double"))
            .drop("_moved", "_island"))


STEP_ROWS = 64


def hump(df: DataFrame, x: str, out: str, limit: float) -> DataFrame:
    """Damped signal: each row moves toward x by at most ``limit`` and restarts after a gap.

    The recurrence has no window form. A code's history, bounded by the calendar, is folded in blocks of rows: the
    outer fold carries the value from block to block, the inner one appends to its block alone, so that the work per
    row does not grow with the history. Other columns stay.
    """
    names = [n for n in df.columns if n not in ("date", "code", out)]
    rest = F.struct("date", *names)
    kept = df.withColumn("_x", c(x)).groupBy("code").agg(
        F.array_sort(F.collect_list(F.struct(F.col("date").alias("d"), "_x", rest.alias("rest")))).alias("rows"))
    value = lambda y, x: F.when(y.isNull() | x.isNull(), x).otherwise(
        F.greatest(F.least(x, y + F.lit(float(limit))), y - F.lit(float(limit))))
    state = "struct<last: double, path: array<double>>"
    start = F.lit(None).cast("double")

    def block(carried: Column, rows: Column) -> Column:
        first = F.struct(carried.alias("last"), F.array().cast("array<double>").alias("path")).cast(state)
        return F.aggregate(rows, first, lambda held, r: F.struct(
            value(held["last"], r["_x"]).alias("last"),
            F.array_append(held["path"], value(held["last"], r["_x"])).alias("path")))

    starts = F.sequence(F.lit(1), F.greatest(F.size("rows"), F.lit(1)), F.lit(STEP_ROWS))
    whole = F.aggregate(starts, F.struct(start.alias("last"), F.array().cast("array<array<double>>").alias("paths")),
                        lambda held, at: _joined(held, block(held["last"], F.slice(F.col("rows"), at, F.lit(STEP_ROWS)))))
    paths = kept.select("code", "rows", F.flatten(whole["paths"]).alias("path"))
    flat = paths.select("code", "path", F.posexplode("rows").alias("at", "row"))
    made = flat.select("code", "row.rest.*", F.get("path", F.col("at")).alias(out))
    return made.select(*[n for n in df.columns if n != out], out)


def _joined(held: Column, made: Column) -> Column:
    """State after a block: its last value, and its path behind the ones before."""
    both = F.transform(F.array(made), lambda b: F.struct(
        b["last"].alias("last"), F.array_append(held["paths"], b["path"]).alias("paths")))
    return both[0]
