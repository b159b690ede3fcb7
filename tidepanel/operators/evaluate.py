"""Factor evaluation: daily correlations, conditional metrics, quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import stats
from ..functions.clean import c, ratio
from . import cross
from .joins import every_session
from .order import placed, places


def day_quality(df: DataFrame, x: str, eligible: str = "eligible", eps: float = 1e-12,
                by=("date",)) -> DataFrame:
    """Coverage and degeneracy of a factor per date, over eligible rows."""
    v = F.when(F.col(eligible), c(x))
    total, present = F.count_if(F.col(eligible)), F.count(v)
    return df.groupBy(*by).agg(
        F.coalesce(ratio(present.cast("double"), total.cast("double")), F.lit(1.0)).alias("coverage"),
        ((total > 0) & ((present < 2) | (F.coalesce(F.stddev_pop(v), F.lit(0.0)) < eps)))
        .alias("degenerate"))


def quality_gate(days: DataFrame, min_coverage: float, max_low: float, max_degenerate: float,
                 by=()) -> DataFrame:
    """Share of low-coverage and of degenerate days against their limits."""
    low = F.avg(F.when(F.col("coverage") < min_coverage, 1.0).otherwise(0.0))
    bad = F.avg(F.when(F.col("degenerate"), 1.0).otherwise(0.0))
    return days.groupBy(*by).agg(
        low.alias("low_coverage_fraction"), bad.alias("degenerate_fraction"),
        ((low <= max_low) & (bad <= max_degenerate)).alias("passed"))


def unpivot(wide: DataFrame, factors, keep=("date", "code"), value: str = "value") -> DataFrame:
    """Wide factor columns to long (keys, factor_id, value)."""
    return wide.unpivot(list(keep), list(factors), "factor_id", value)


def with_pair_ranks(df: DataFrame, x: str, y: str, by) -> DataFrame:
    """Both sides of the complete pairs of each group (_px, _py) and their ranks (_rx, _ry)."""
    px, py = stats.paired(x, y)
    df = df.withColumns({"_px": px, "_py": py})
    return placed(df, {"_px": {"place": "_rx"}, "_py": {"place": "_ry"}}, by, alike=True)


def daily_ic(values: DataFrame, by=("date", "factor_id"), x="value", y="target",
             min_pairs: int = 3, horizon: int | None = None) -> DataFrame:
    """IC, rank IC, slope and pair count per date and factor."""
    ranked = with_pair_ranks(values, x, y, by)
    daily = ranked.groupBy(*by).agg(
        stats.pearson("_px", "_py", min_pairs).alias("ic"),
        stats.pearson("_rx", "_ry", min_pairs).alias("rank_ic"),
        stats.slope("_px", "_py").alias("slope"), stats.pair_count("_px", "_py").alias("sample_count"))
    if horizon is not None:
        daily = daily.withColumn("label_available_date",
                                 F.col("date") + F.make_dt_interval(F.lit(horizon)))
    return daily


def ic_only(values: DataFrame, by=("date", "factor_id"), x="value", y="target",
            min_pairs: int = 3) -> DataFrame:
    """Daily correlation from moments alone: one partial aggregation, no sort."""
    return values.groupBy(*by).agg(stats.pair_count(x, y).alias("valid_count"),
                                   stats.pearson(x, y, min_pairs).alias("correlation"))


def conditional_metrics(daily: DataFrame, by) -> DataFrame:
    """Metrics of a daily IC table per factor, state (and split)."""
    ic, n = F.col("ic"), F.count("ic")
    return daily.groupBy(*by).agg(
        n.alias("sample_count"),
        F.avg(F.when(F.col("sample_count") >= 3, 1.0).otherwise(0.0)).alias("coverage"),
        F.avg(ic).alias("ic_mean"), F.avg("rank_ic").alias("rank_ic_mean"),
        stats.information_ratio(ic).alias("icir"),
        F.avg(F.when(ic > 0, 1.0).when(ic.isNotNull(), 0.0)).alias("hit_rate"),
        ratio(F.abs(F.avg(ic)), F.avg(F.abs(ic))).alias("stability"))


def composite_metrics(scored: DataFrame, x="alpha", y="target", by=()) -> DataFrame:
    """Mean daily IC / rank IC, their ratios to a floored deviation, coverage, days.

    ``scored`` keeps label rows without a score, which lower the coverage.
    """
    by = list(by)
    ranked = with_pair_ranks(scored, x, y, [*by, "date"])
    daily = ranked.groupBy(*by, "date").agg(
        F.count(F.lit(1)).alias("rows"), stats.pair_count("_px", "_py").alias("pairs"),
        stats.pearson_floored("_px", "_py").alias("ic"),
        stats.pearson_floored("_rx", "_ry").alias("rank_ic"))
    return daily.groupBy(*by).agg(
        F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"),
        stats.floored_ratio("ic").alias("icir"), stats.floored_ratio("rank_ic").alias("rank_icir"),
        (F.sum("pairs") / F.sum("rows")).alias("coverage"),
        F.least(F.count("ic"), F.count("rank_ic")).alias("valid_days"))


def factor_score(metrics: DataFrame, weights=(0.4, 0.4, 0.2)) -> DataFrame:
    """Weighted |IC|, |rank IC| and tanh |ICIR|; 0 when one of them is missing."""
    a, b, d = weights
    value = (a * F.abs("ic") + b * F.abs("rank_ic") + d * F.tanh(F.abs(F.col("icir")))) / sum(weights)
    return metrics.withColumn("score", F.coalesce(value, F.lit(0.0)))


def behavior_summary(daily: DataFrame, names=("ic", "rank_ic", "slope"), by=("factor_id",)) -> DataFrame:
    """Mean, sample deviation and their ratio per metric and factor."""
    aggs = []
    for name in names:
        aggs += [F.avg(name).alias(f"{name}_mean"),
                 F.when(F.count(name) >= 2, F.stddev_samp(name)).alias(f"{name}_std"),
                 stats.information_ratio(name).alias(f"{name}_ir")]
    return daily.groupBy(*by).agg(*aggs)


def mature(daily: DataFrame, as_of: Column) -> DataFrame:
    """Rows whose date and label are strictly before the as-of date."""
    return daily.filter((F.col("date") < as_of) & (F.col("label_available_date") < as_of))


def rolling_behavior(daily: DataFrame, as_of_dates: DataFrame, horizon: int, window: int,
                     names=("ic", "rank_ic", "slope")) -> DataFrame:
    """Nine statistics of the last ``window`` mature rows for every as-of date.

    A label matures a fixed number of days after its date, so the mature rows of a
    factor are a prefix of its history: roll the statistics once per row and look up the
    newest mature row. Daily rows of one factor are bounded by the calendar.
    """
    line = Window.partitionBy("factor_id").orderBy("date")
    last = line.rowsBetween(-(window - 1), 0)
    cols = {"mature_sample_count": F.count(F.lit(1)).over(last)}
    for name in names:
        mean, std = F.avg(name).over(last), F.stddev_samp(name).over(last)
        cols[f"{name}_mean"] = mean
        cols[f"{name}_std"] = F.when(F.count(name).over(last) >= 2, std)
        cols[f"{name}_ir"] = F.when(F.count(name).over(last) >= 2, ratio(mean, std))
    rolled = daily.withColumns(cols)
    names_out = ["mature_sample_count", *[f"{n}_{s}" for n in names for s in ("mean", "std", "ir")]]
    # One time line per factor: statistics take effect when their newest label has
    # matured, as-of dates look back at the latest ones strictly before them.
    effect = rolled.select(
        "factor_id", (F.col("date") + F.make_dt_interval(F.lit(horizon))).alias("at"),
        F.lit(1).alias("kind"), F.struct(*names_out).alias("row"))
    asked = every_session(daily.select("factor_id").distinct(), as_of_dates).select(
        "factor_id", F.col("date").alias("at"), F.lit(0).alias("kind"))
    past = (Window.partitionBy("factor_id").orderBy("at", "kind")
            .rowsBetween(Window.unboundedPreceding, 0))
    merged = effect.unionByName(asked, allowMissingColumns=True).withColumn(
        "row", F.last("row", ignorenulls=True).over(past))
    return merged.filter("kind = 0 AND row IS NOT NULL").select(
        F.col("at").alias("as_of_date"), "factor_id", "row.*")


def parity(a: DataFrame, b: DataFrame, keys, columns) -> DataFrame:
    """Per column: rows on one side only, missing-flag differences, largest error."""
    left = a.select(*keys, *[F.col(x).alias(f"a_{x}") for x in columns], F.lit(True).alias("_a"))
    right = b.select(*keys, *[F.col(x).alias(f"b_{x}") for x in columns], F.lit(True).alias("_b"))
    both = left.join(right, list(keys), "full")
    cells = F.explode(F.array(*[
        F.struct(F.lit(x).alias("field"), F.col(f"a_{x}").alias("x"), F.col(f"b_{x}").alias("y"))
        for x in columns])).alias("cell")
    alone = F.col("_a").isNull() | F.col("_b").isNull()
    return both.select(alone.alias("alone"), cells).select("alone", "cell.*").groupBy("field").agg(
        F.count_if("alone").alias("unmatched"),
        F.count_if(~F.col("alone") & (F.col("x").isNull() != F.col("y").isNull())).alias("missing_differs"),
        F.coalesce(F.max(F.abs(F.col("x") - F.col("y"))), F.lit(0.0)).alias("max_error"))


def ranking_parity(a: DataFrame, b: DataFrame, score: str) -> DataFrame:
    """Per date: do both score tables order the same codes in the same way (by score, ties by code)? ``same_ranking``,
    the number of codes, and how many stand at another place or on one side only."""
    sides = []
    for df, name in ((a, "_a"), (b, "_b")):
        key = F.when(F.col(score).isNotNull(), F.struct((-F.col(score)).alias("s"), F.col("code").alias("t")))
        sides.append(places(df.select("date", "code", key.alias("_key")), "_key", ("date",), place=name)
                     .filter(F.col(name).isNotNull()).select("date", "code", name))
    both = sides[0].join(sides[1], ["date", "code"], "full")
    moved = F.count_if(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.groupBy("date").agg(F.count(F.lit(1)).alias("codes"), moved.alias("moved"), (moved == 0).alias("same_ranking"))
