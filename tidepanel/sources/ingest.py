"""Sources: delimited text, Parquet, raw imports and run folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.clean import c, normalize_code, ratio, session_day, to_number

DELIMITERS = ("\t", ",", ";", "|")


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The candidate that occurs most often in the header line (one line is read)."""
    header = spark.read.text(path).first()[0]
    return max(DELIMITERS, key=header.count)


def read_delimited(spark: SparkSession, path: str, schema: str, columns=None, delimiter: str | None = None,
                   limit_rows: int | None = None, multi_line: bool = False) -> DataFrame:
    """Delimited files with a header. Malformed rows are dropped; every row is parsed in
    full so that a short projection drops the same rows. Files are split among tasks
    unless ``multi_line`` asks for quoted line breaks, which ties a file to one task."""
    df = (spark.read.schema(schema).option("header", True).option("sep", delimiter or detect_delimiter(spark, path))
          .option("mode", "DROPMALFORMED").option("multiLine", multi_line).option("columnPruning", False).csv(path))
    if columns:
        df = df.select(*columns)
    return df if limit_rows is None else df.limit(limit_rows)


def read_merged(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet folders whose files have different columns."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def scan(df: DataFrame, columns, start, stop, codes=None, date="date", code="code") -> DataFrame:
    """Projection with date and code filters that reach the Parquet reader."""
    keep = F.col(date).between(F.lit(start).cast("timestamp"), F.lit(stop).cast("timestamp"))
    if codes is not None:
        keep = keep & F.col(code).isin(*codes)
    return df.filter(keep).select(*columns)


# Columns of raw panels that are text or dates; all others are numbers.
TEXT_COLUMNS = ("category", "industry", "name", "ChiName", "EngName", "SecuAbbr", "ChiNameAbbr", "ListedSector")
DATE_COLUMNS = ("ListedDate", "InfoPublDate", "EndDate")


def normalize_panel(raw: DataFrame, required=("open", "close", "high", "low", "volume", "amount"),
                    renames=(("timestamps", "date"), ("vol", "volume")), text=TEXT_COLUMNS, dates=DATE_COLUMNS) -> DataFrame:
    """Raw text rows to panel rows: rename, parse dates and numbers, normalize codes,
    drop rows without required values or volume, add vwap."""
    df = raw.withColumnsRenamed({a: b for a, b in renames if a in raw.columns})
    numbers = [x for x in df.columns if x not in ("date", "code", *text, *dates)]
    df = df.withColumns({"date": session_day("date"), "code": normalize_code("code"),
                         **{x: F.col(x).try_cast("timestamp") for x in dates if x in df.columns},
                         **{x: to_number(x) for x in numbers}})
    df = df.dropna(subset=["date", "code", *required]).filter(F.col("volume") > 0)
    return df.withColumn("vwap", ratio("amount", "volume"))


def audit_import(raw: DataFrame, universe: DataFrame, code: str = "code") -> DataFrame:
    """Rows with their import status: rejected code, outside the universe, imported.
    Source values stay as text."""
    valid = F.coalesce(F.col(code).rlike(r"^\d{1,6}(\.0+)?$"), F.lit(False))
    df = raw.withColumn("norm_code", F.when(valid, normalize_code(F.regexp_replace(F.col(code), r"\.0+$", ""))))
    known = universe.select(F.col("code").alias("norm_code"), F.lit(True).alias("_known")).distinct()
    df = df.join(known, "norm_code", "left")
    return df.withColumn("status", F.when(~valid, "rejected").when(F.col("_known"), "imported")
                         .otherwise("outside_universe")).drop("_known")


def nested_metrics(records: DataFrame, payload: str, names) -> DataFrame:
    """One metric row per JSON record: the nested value if there is one, else the top
    level value."""
    fields = ", ".join(f"{n} DOUBLE" for n in names)
    parsed = F.from_json(c(payload), f"generation_metrics STRUCT<{fields}>, {fields}")
    df = records.withColumn("_p", parsed)
    return df.withColumns({n: F.coalesce(F.col(f"_p.generation_metrics.{n}"), F.col(f"_p.{n}")) for n in names}).drop("_p")


def _headers(spark: SparkSession, paths) -> dict[str, list[str]]:
    """Files below ``paths`` by their first line, from one text scan that takes the first line of each file."""
    lines = spark.read.option("recursiveFileLookup", True).text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"))
    first = lines.filter("start = 0").groupBy("path").agg(F.min_by("value", "place").alias("header"))
    found: dict[str, list[str]] = {}
    for r in first.orderBy("path").toLocalIterator():
        found.setdefault(r["header"], []).append(r["path"])
    return found


def union_runs(spark: SparkSession, paths, pool_id: str | None = None, prefix: str = "backtest_") -> DataFrame:
    """Summary tables of runs in scattered folders: strip the prefix (the plain column wins where a table has both), tag
    the run by its folder, align columns. Files of the same header are one scan, so that jobs and plan follow
    the number of different headers, not of files."""
    parts = []
    for header, files in _headers(spark, paths).items():
        names = [n.strip().strip('"') for n in header.split(",")]
        df = spark.read.schema(", ".join(f"`{n}` string" for n in names)).option("header", True).csv(files)
        run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        if pool_id is not None and "pool_id" in names:
            df = df.filter(F.col("pool_id") == pool_id)
        keep = [x for x in names if not (x.startswith(prefix) and x[len(prefix):] in names)]
        parts.append(df.select(*[F.col(f"`{x}`").alias(x.removeprefix(prefix)) for x in keep], run.alias("run_id")))
    if not parts:
        return spark.createDataFrame([], "factor_id string, run_id string")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def backtest_metrics(runs: DataFrame) -> DataFrame:
    """Runs' summaries as metric rows: a missing split is ``unknown``, missing dates are NULL."""
    for name in ("split", "start_date", "end_date"):
        if name not in runs.columns:
            runs = runs.withColumn(name, F.lit(None).cast("string"))
    fixed = ("factor_id", "run_id", "split", "start_date", "end_date", "pool_id")
    metrics = [n for n in runs.columns if n not in fixed]
    return runs.select("factor_id", F.col("run_id").alias("backtest_run_id"), F.coalesce("split", F.lit("unknown")).alias("split"),
                       "start_date", "end_date", *[to_number(n).alias(n) for n in metrics])


def with_warm_up(panel: DataFrame, segments: DataFrame, lookback: int) -> DataFrame:
    """Rows per segment with the ``lookback`` sessions before its first one as warm-up.
    Resolved on the calendar; a date may serve several segments."""
    from ..operators.joins import calendar
    cal = F.broadcast(calendar(panel).select("date", "session"))
    inside = F.broadcast(segments).join(cal, F.col("date").between(F.col("start"), F.col("stop")))
    first = inside.groupBy("segment").agg(F.min("session").alias("_first"), F.max("session").alias("_last"))
    roles = first.join(cal, F.col("session").between(F.col("_first") - lookback, F.col("_last"))).select(
        "segment", "date", (F.col("session") < F.col("_first")).alias("warm_up"))
    return panel.join(F.broadcast(roles), "date")
