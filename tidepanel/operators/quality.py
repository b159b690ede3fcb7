"""Profiles, contracts, completeness and audits as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clean import c


RAW_FIELDS, PRICES = ("open", "close", "high", "low", "volume", "amount"), ("open", "close", "high", "low")


def usable(fields=RAW_FIELDS) -> Column:
    """All raw fields present and all prices positive."""
    tests = [F.col(x).isNotNull() for x in fields] + [F.col(x) > 0 for x in PRICES if x in fields]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def session_completeness(panel: DataFrame) -> DataFrame:
    """Codes with a usable row per session against the universe. The panel is unique on
    (date, code), so counting rows counts codes."""
    universe = panel.agg(F.countDistinct("code")).scalar()
    per_day = panel.groupBy("date").agg(F.count_if(usable()).alias("present"))
    return per_day.withColumn("complete", F.col("present") == universe)


def universe_check(a: DataFrame, b: DataFrame, key: str = "code", required=()) -> DataFrame:
    """Do two tables hold the same keys, and does each have the required fields?"""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    sides = (left.intersect(right).select(F.lit("common").alias("side"))
             .unionByName(left.exceptAll(right).select(F.lit("left_only").alias("side")))
             .unionByName(right.exceptAll(left).select(F.lit("right_only").alias("side"))))
    lost = sorted({x for df in (a, b) for x in required if x not in df.columns})
    counts = sides.agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("common", "left_only", "right_only")])
    return counts.withColumns({"same": (F.col("left_only") == 0) & (F.col("right_only") == 0),
                               "missing_fields": F.lit(", ".join(lost))})


def latest_complete(days: DataFrame) -> DataFrame:
    return days.agg(F.max(F.when(F.col("complete"), F.col("date"))).alias("latest_complete"),
                    F.count_if("complete").alias("complete_sessions"),
                    F.count_if(~F.col("complete")).alias("incomplete_sessions"))


def profile(df: DataFrame, date: str = "date", code: str = "code") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.min(date).alias("first_date"),
                  F.max(date).alias("last_date"), F.countDistinct(code).alias("codes")).withColumn(
        "column_count", F.lit(len(df.columns)))


def fingerprint(df: DataFrame, columns: list[Column]) -> DataFrame:
    """Content hash that does not depend on row order: the sum of 48 bits of each row's
    SHA-256. Columns are given as text."""
    text = F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("~")) for x in columns])
    part = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(part).cast("string").alias("fingerprint"))


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def contract_errors(name: str, df: DataFrame, required, keys=()) -> DataFrame:
    """Missing columns and repeated keys of a table as rows (table, error)."""
    spark = df.sparkSession
    lost = sorted(set(required) - set(df.columns))
    if lost:
        return spark.createDataFrame([(name, f"missing columns: {', '.join(lost)}")], "table_name string, error string")
    if not keys:
        return spark.createDataFrame([], "table_name string, error string")
    n = duplicate_keys(df, keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    return n.select(F.lit(name).alias("table_name"), F.concat(
        F.lit("duplicate keys: "), F.col("n").cast("string")).alias("error"))


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that fail each check (check, violations); one pass over the data."""
    counts = df.agg(*[F.count_if(~F.coalesce(test, F.lit(False))).alias(name) for name, test in checks.items()])
    return counts.unpivot([], list(checks), "check_name", "violations")


def field_catalog(df: DataFrame) -> DataFrame:
    """Name, type and NULL share per column; one pass over the data."""
    kinds = dict(df.dtypes)
    cells = F.explode(F.array(*[
        F.struct(F.lit(x).alias("field"), F.lit(kinds[x]).alias("type"),
                 F.col(f"n_{x}").alias("present"), F.col("n_all").alias("total")) for x in df.columns])).alias("f")
    counts = df.agg(F.count(F.lit(1)).alias("n_all"), *[F.count(x).alias(f"n_{x}") for x in df.columns])
    return counts.select(cells).select("f.field", "f.type", (
        1 - F.col("f.present") / F.col("f.total")).alias("null_share"))


def store_summary(panel: DataFrame) -> DataFrame:
    """Rows, date span and latest values per code."""
    return panel.groupBy("code").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("date").alias("start_date"), F.max("date").alias("end_date"),
        *[F.max_by(x, "date").alias(f"latest_{x}") for x in ("open", "close", "volume", "amount")])


def import_quality(panel: DataFrame, fields=RAW_FIELDS) -> DataFrame:
    """Counts that an import reports, over the raw rows of a panel (unique on date and code)."""
    universe = panel.agg(F.countDistinct("code")).scalar()
    counts = {"observed_rows": F.count(F.lit(1)), "missing_price_rows": F.count_if(~usable(fields)),
              "zero_volume_without_suspend": F.count_if((F.col("volume") == 0) & (F.col("Ifsuspend") == 0)),
              **{f"null_{x}": F.count_if(F.col(x).isNull()) for x in fields}}
    days = panel.groupBy("date").agg(*[v.alias(n) for n, v in counts.items()])
    total = {n: F.sum(n) for n in counts}
    return days.withColumn("codes", universe).agg(
        *[v.alias(n) for n, v in total.items()],
        (F.count(F.lit(1)) * F.max("codes") - F.sum("observed_rows")).alias("padded_rows"),
        F.count_if(F.col("observed_rows") < F.col("codes")).alias("incomplete_sessions"),
        F.count_if(F.col("observed_rows") - F.col("missing_price_rows") == F.col("codes")).alias("complete_sessions"))


def publication_audit(facts: DataFrame, published: str, date: str = "date") -> DataFrame:
    p, d = F.col(published), F.col(date)
    return facts.agg(F.count(p).alias("known"), F.count_if(p > d).alias("future"), F.count_if(p.isNull()).alias("unknown"))


def placeholder_audit(panel: DataFrame, field: str) -> DataFrame:
    """Is a field on the latest date all zero where volume is positive? Then it is a
    placeholder and must not be used for filtering."""
    last = panel.agg(F.max("date")).scalar()
    day = panel.filter(F.col("date") == last)
    x, active = F.col(field), F.col("volume") > 0
    return day.agg(
        F.max("date").alias("date"), F.count(F.lit(1)).alias("row_count"), F.count(x).alias("finite"),
        F.count_if(x > 0).alias("positive"), F.count_if(x == 0).alias("zero"),
        (F.count_if(active) > 0).alias("_any"), F.count_if(active & ~F.coalesce(x == 0, F.lit(False))).alias("_real")
    ).withColumn("enabled", (F.col("finite") > 0) & ~(F.col("_any") & (F.col("_real") == 0))).drop("_any", "_real")
