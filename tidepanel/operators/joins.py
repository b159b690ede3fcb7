"""Calendar, padding, as-of and point-in-time operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clean import c


def calendar(df: DataFrame) -> DataFrame:
    """Sessions with their number and neighbours: bounded by MAX_SESSIONS rows, so the
    ordering window and a broadcast of the result are both safe."""
    w = Window.orderBy("date")
    return df.select("date").distinct().select(
        "date", F.row_number().over(w).alias("session"),
        F.lag("date").over(w).alias("prev_date"), F.lead("date").over(w).alias("next_date"))


def every_session(entities: DataFrame, dates: DataFrame) -> DataFrame:
    """Each entity at each date: the (bounded) calendar travels as one array row and is
    unrolled next to each entity, without shuffling the entities."""
    days = dates.select("date").distinct().agg(F.sort_array(F.collect_list("date"))).scalar()
    return entities.select(*entities.columns, F.explode(days).alias("date"))


def pad(panel: DataFrame) -> DataFrame:
    """Calendar x universe reindex: missing (date, code) rows appear with NULLs."""
    grid = every_session(panel.select("code").distinct(), panel)
    return grid.join(panel, ["code", "date"], "left")


def shift_sessions(df: DataFrame, x: str, ahead: int) -> Column:
    """Value exactly ``ahead`` sessions later by session number, not by row."""
    w = Window.partitionBy("code").orderBy("session").rangeBetween(ahead, ahead)
    return F.max(c(x)).over(w)


def segment_label(panel: DataFrame, segments: DataFrame, horizon: int, price: str = "open") -> DataFrame:
    """Next-session price to ``horizon`` sessions later, both inside the row's segment."""
    w = Window.orderBy("session")
    cal = calendar(panel).withColumns({
        "_buy": F.lead("date", 1).over(w), "_sell": F.lead("date", 1 + horizon).over(w)})
    cal = cal.join(F.broadcast(segments),
                   F.col("date").between(F.col("start"), F.col("stop"))).filter(
        (F.col("_buy") >= F.col("start")) & (F.col("_sell") <= F.col("stop"))).select(
        "date", F.lit(True).alias("_inside"))
    sessions = calendar(panel).select("date", "session")
    df = panel.join(F.broadcast(sessions), "date").join(F.broadcast(cal), "date", "left")
    a, b = shift_sessions(df, price, 1), shift_sessions(df, price, 1 + horizon)
    value = F.try_divide(b, F.nullif(a, F.lit(0.0))) - 1.0
    return df.withColumn("label", F.when(F.col("_inside"), value)).drop("_inside")


def warm_up(panel: DataFrame, lookback: int, as_of: Column | None = None) -> DataFrame:
    """The last ``lookback`` + 1 sessions up to the as-of date."""
    dates = panel.select("date").distinct()
    if as_of is not None:
        dates = dates.filter(F.col("date") <= as_of)
    keep = dates.orderBy(F.col("date").desc()).limit(lookback + 1)
    return panel.join(F.broadcast(keep), "date", "left_semi")


def last_available(panel: DataFrame, as_of: Column) -> DataFrame:
    """Rows of the latest date that is not after the as-of date."""
    day = panel.filter(F.col("date") <= as_of).agg(F.max("date")).scalar()
    return panel.filter(F.col("date") == day)


def many_to_one(left: DataFrame, right: DataFrame, keys, repeated: str | None = None) -> DataFrame:
    """Inner join in which each key may stand on the right once. A key that repeats there fails the job, or with
    ``repeated`` its rows are kept once and marked in a column of that name. The right side is counted by key on the
    exchange that the join needs anyway."""
    keys = list(keys)
    rest = [n for n in right.columns if n not in keys]
    once = right.groupBy(*keys).agg(*[F.first(n).alias(n) for n in rest], F.count(F.lit(1)).alias("_times"))
    if repeated is not None:
        return left.join(once.withColumn(repeated, F.col("_times") > 1).drop("_times"), keys)
    text = F.concat(F.lit(f"the right side repeats a key of {', '.join(keys)}: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    return left.join(once.withColumn("_times", F.when(F.col("_times") > 1, F.raise_error(text)).otherwise(F.col("_times"))), keys) \
        .filter("_times = 1").drop("_times")


def mask_by_publication(value, published: Column, date: Column) -> Column:
    """NULL once the publication lies after the row; unknown publication keeps it."""
    return F.when(published.isNull() | (published <= date), c(value))


def mask_by_availability(value, available: Column, date: Column, hours: int = 15) -> Column:
    """NULL unless known to be available by the cut-off hour of the row's date."""
    return F.when(available <= date + F.make_dt_interval(hours=F.lit(hours)), c(value))


def effective_join(facts: DataFrame, mapping: DataFrame, key: str = "code") -> DataFrame:
    """Date-effective dimension: mapping rows with valid_from <= date <= valid_to.

    An equi-join on the key with the range as residual; a key has few intervals.
    """
    m = mapping.withColumnRenamed(key, "_key")
    return facts.join(m, (F.col(key) == F.col("_key"))
                      & F.col("date").between(F.col("valid_from"), F.col("valid_to"))).drop("_key")


def in_segments(panel: DataFrame, segments: DataFrame) -> DataFrame:
    """Label rows with their segment. The segment list is a handful of configured date
    ranges, resolved on the calendar first so that the panel joins on equality."""
    days = panel.select("date").distinct().join(
        F.broadcast(segments), F.col("date").between(F.col("start"), F.col("stop")))
    return panel.join(F.broadcast(days.select("date", "segment")), "date")


def next_session(signals: DataFrame, cal: DataFrame) -> DataFrame:
    """Signals dated by the session on which they execute."""
    moves = cal.filter(F.col("next_date").isNotNull()).select(
        F.col("date").alias("signal_date"), F.col("next_date").alias("exec_date"))
    return signals.withColumnRenamed("date", "signal_date").join(
        F.broadcast(moves), "signal_date").withColumnRenamed("exec_date", "date")
