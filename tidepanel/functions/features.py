"""Causal feature set and market state features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import timeseries as ts
from .clean import c, ratio

RAW = ("open", "close", "high", "low", "volume", "amount")
RETURNS = (1, 5, 10, 20, 60)
WINDOWS = (5, 20, 60)
EPS = 1e-12


def lookback(name: str) -> int:
    """Past rows that a feature needs."""
    if name in ("overnight_gap", "range_relative"):
        return 1
    head, _, tail = name.rpartition("_")
    if not tail.isdigit():
        return 0
    return int(tail) - (1 if head in ("volume_ratio", "ma_gap") else 0)


def causal_features() -> dict[str, Column]:
    """24 features, each from rows up to the current one only; near-zero denominators
    give NULL. All share one window per code."""
    prev = ts.delay("close", 1)
    feats = {name: c(name) for name in RAW}
    for w in RETURNS:
        feats[f"return_{w}"] = ratio("close", ts.delay("close", w), EPS) - 1.0
    for w in WINDOWS:
        feats[f"volatility_{w}"] = ts.ts_std_pop(ratio("close", prev, EPS) - 1.0, w)
        feats[f"volume_ratio_{w}"] = ratio("volume", ts.ts_mean("volume", w), EPS) - 1.0
        feats[f"ma_gap_{w}"] = ratio("close", ts.ts_mean("close", w), EPS) - 1.0
    high, low, close = c("high"), c("low"), c("close")
    feats["intraday_return"] = ratio("close", "open", EPS) - 1.0
    feats["overnight_gap"] = ratio("open", prev, EPS) - 1.0
    feats["range_relative"] = ratio(high - low, prev, EPS)
    feats["close_location"] = ratio(2 * close - high - low, high - low, EPS)
    return feats


def market_features(panel: DataFrame) -> DataFrame:
    """Mean return, dispersion and share of risers per date (missing returns are 0)."""
    r = F.coalesce(ratio("close", ts.delay("close", 1)) - 1.0, F.lit(0.0))
    return panel.select("date", r.alias("_r")).groupBy("date").agg(
        F.avg("_r").alias("market_return"), F.stddev_pop("_r").alias("cross_section_dispersion"),
        F.avg(F.when(F.col("_r") > 0, 1.0).otherwise(0.0)).alias("up_ratio"))


def market_volatility(days: DataFrame, n: int = 20) -> DataFrame:
    """Rolling deviation of the market return over a date-level table (one row per
    session, so the single ordered window is bounded by the calendar)."""
    w = Window.orderBy("date").rowsBetween(-(n - 1), 0)
    value = F.when(F.count("market_return").over(w) >= 2, F.stddev_pop("market_return").over(w))
    return days.withColumn("market_volatility", F.coalesce(value, F.lit(0.0)))


def rule_states(days: DataFrame, trend: float = 0.002, volatility: float = 0.03) -> DataFrame:
    state = (F.when(F.col("market_volatility") >= volatility, "high_volatility")
             .when(F.col("market_return") >= trend, "bull")
             .when(F.col("market_return") <= -trend, "bear").otherwise("sideways"))
    return days.withColumns({
        "state_id": state, "fit_window_end": F.max("date").over(Window.partitionBy())})


def time_splits(dates: DataFrame, train: float = 0.6, valid: float = 0.2) -> DataFrame:
    """Chronological train / valid / test over distinct dates with minimum sizes."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    i = F.row_number().over(Window.orderBy("date"))
    a = F.greatest(F.lit(1), F.floor(n * F.lit(train)).cast("int"))
    want = F.floor(n * F.lit(valid)).cast("int")
    want = F.when(n >= 3, F.greatest(want, F.lit(1))).otherwise(want)
    b = F.when(a + want >= n, F.greatest(F.lit(0), (n - a - 1).cast("int"))).otherwise(want)
    return dates.select("date").distinct().select("date", F.when(i <= a, "train").when(
        i <= a + b, "valid").otherwise("test").alias("split"))
