"""Cross-sectional operators: per date, or per date and group.

Statistics are aggregated map-side and joined back. Ranks are places in ranges whose
number follows the size of the group (``order``), so that no task ever holds a whole date.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clean import c, ratio
from ..functions.probit import spread_rank
from ..session import cut
from .order import _temp, places

DATE = ("date",)



def join_groups(df: DataFrame, stats: DataFrame, by) -> DataFrame:
    """Left join of group statistics. Only a table keyed by the date alone is
    broadcast: ingest bounds it to MAX_SESSIONS rows of a few numbers. Wider keys are
    left to adaptive execution, which broadcasts on the measured size and splits
    skewed keys otherwise."""
    return df.join(F.broadcast(stats) if tuple(by) == DATE else stats, list(by), "left")


def attach(df: DataFrame, by=DATE, **aggs: Column) -> DataFrame:
    """Add one column per aggregate of the row's group (NULL for a NULL group key).

    Statistics combine map-side and come back by a join: no task holds a group, and
    for dates the rows themselves are not shuffled at all.
    """
    return join_groups(df, df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()]), by)


@dataclass(frozen=True)
class Stat:
    """A value of a row and of statistics of its group: aggregates by (temporary) name and
    the Column that uses them."""
    by: tuple
    aggs: dict[str, Column]
    value: Column


def with_stats(df: DataFrame, stats: dict[str, Stat], stored: bool = False) -> DataFrame:
    """Add a column for each ``Stat``. Those with the same key share one aggregate. With ``stored`` the statistics of wider
    keys are written first: their size is then known when the join is planned, so that small ones are broadcast
    and the rows stay where they are. Adaptive execution measures only after the rows are shuffled."""
    base = df
    for by in dict.fromkeys(s.by for s in stats.values()):
        aggs = [a.alias(n) for s in stats.values() if s.by == by for n, a in s.aggs.items()]
        made = base.groupBy(*by).agg(*aggs)
        df = join_groups(df, cut(made, "stats") if stored and tuple(by) != DATE else made, by)
    return df.withColumns({out: s.value for out, s in stats.items()}).drop(
        *[n for s in stats.values() for n in s.aggs])


def rank(df: DataFrame, x: str, out: str, by=DATE, pct: bool = True) -> DataFrame:
    """Rank with ties averaged over the non-NULL values of the group."""
    place, size = _temp("place"), _temp("size")
    df = places(df, x, by, place=place, **({"size": size} if pct else {}))
    return df.withColumn(out, F.col(place) / F.col(size) if pct else F.col(place)).drop(place, size)


def densify(df: DataFrame, x: str, out: str) -> DataFrame:
    """Label number 0..k-1 in sorted order over the whole panel. The labels are stored first, so that the join knows their size:
    few are broadcast. Otherwise rows without a label are spread over the join's tasks."""
    spread, code = _temp("spread"), _temp("code")
    labels = df.select(x).filter(F.col(x).isNotNull()).distinct()
    codes = places(labels, x, place=code).select(x, (F.col(code) - 1).alias(out), F.lit(-1).alias(spread))
    df = df.withColumn(spread, F.when(F.col(x).isNull(), F.spark_partition_id()).otherwise(-1))
    return df.join(cut(codes, "labels"), [x, spread], "left").drop(spread)


def _moments(x, by=DATE) -> tuple[Column, Column, dict[str, Column]]:
    mu, sd = _temp("mu"), _temp("sd")
    return F.col(mu), F.col(sd), {mu: F.avg(c(x)), sd: F.stddev_pop(c(x))}


def zscore_stat(x, by=DATE) -> Stat:
    mu, sd, aggs = _moments(x)
    return Stat(tuple(by), aggs, ratio(c(x) - mu, sd))


def normalize_stat(x, use_std=False, limit=0.0, by=DATE) -> Stat:
    mu, sd, aggs = _moments(x)
    value = ratio(c(x) - mu, sd) if use_std else c(x) - mu
    if limit > 0:
        value = F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(limit)), F.lit(-limit)))
    return Stat(tuple(by), aggs, value)


def scale_stat(x, size=1.0, long_size=1.0, short_size=1.0, by=DATE) -> Stat:
    gross, longs, shorts = _temp("gross"), _temp("longs"), _temp("shorts")
    x = c(x)
    aggs = {gross: F.sum(F.abs(x)), longs: F.sum(F.greatest(x, F.lit(0.0))), shorts: F.sum(F.abs(F.least(x, F.lit(0.0))))}
    if long_size != 1 or short_size != 1:
        up = ratio(F.greatest(x, F.lit(0.0)), longs) * F.lit(long_size)
        down = ratio(F.least(x, F.lit(0.0)), shorts) * F.lit(short_size)
        both = F.coalesce(up, F.lit(0.0)) + F.coalesce(down, F.lit(0.0))
        # With both sides present a missing value is an empty position.
        return Stat(tuple(by), aggs, F.when(F.coalesce(shorts, F.lit(0.0)) == 0, up).otherwise(both))
    return Stat(tuple(by), aggs, ratio(x, gross) * F.lit(size))


def winsorize_stat(x, std=4.0, by=DATE) -> Stat:
    mu, sd, aggs = _moments(x)
    low, high = mu - F.lit(std) * sd, mu + F.lit(std) * sd
    return Stat(tuple(by), aggs, F.when(c(x).isNotNull(), F.greatest(F.least(c(x), high), low)))


def group_neutralize_stat(x, group) -> Stat:
    mu = _temp("mu")
    return Stat(("date", group), {mu: F.avg(c(x))}, c(x) - F.col(mu))


def group_scale_stat(x, group, size=1.0) -> Stat:
    gross = _temp("gross")
    return Stat(("date", group), {gross: F.sum(F.abs(c(x)))}, ratio(x, gross) * F.lit(size))


def group_mean_stat(x, weight, group) -> Stat:
    top, bottom = _temp("top"), _temp("bottom")
    value = ratio(F.coalesce(F.col(top), F.lit(0.0)), bottom)
    return Stat(("date", group), {top: F.sum(c(x) * c(weight)), bottom: F.sum(c(weight))},
                F.when(F.col(group).isNotNull(), value))


def group_fill_stat(x, tamed, group) -> Stat:
    """Missing values take their group's mean of ``tamed``."""
    mu = _temp("mu")
    return Stat(("date", group), {mu: F.avg(c(tamed))}, F.coalesce(c(x), F.col(mu)))


def zscore(df, x, out, by=DATE) -> DataFrame:
    """(x - mean) / population deviation; NULL where the group does not vary."""
    return with_stats(df, {out: zscore_stat(x, by)})


def zscore_filled(df, x, out, by=DATE) -> DataFrame:
    """z-score used in composition: no variation or a missing value gives 0."""
    stat = zscore_stat(x, by)
    return with_stats(df, {out: Stat(stat.by, stat.aggs, F.coalesce(stat.value, F.lit(0.0)))})


def zscores_filled(df, names, by=DATE) -> DataFrame:
    """Composition z-scores of many columns in place: one pass of statistics for all."""
    mu, sd = {n: _temp("mu") for n in names}, {n: _temp("sd") for n in names}
    df = attach(df, by, **{mu[n]: F.avg(n) for n in names},
                **{sd[n]: F.stddev_pop(n) for n in names})
    return df.withColumns({n: F.coalesce(ratio(c(n) - F.col(mu[n]), sd[n]), F.lit(0.0))
                           for n in names}).drop(*mu.values(), *sd.values())


def zscore_scored(df, x, out, missing, eligible="eligible", eps=1e-12, by=DATE) -> DataFrame:
    """z-score over eligible rows with a floor on the deviation, and a missing flag."""
    kept = _temp("kept")
    df = df.withColumn(kept, F.when(F.col(eligible), c(x)))
    mu, sd, aggs = _moments(kept)
    z = (F.col(kept) - mu) / F.greatest(sd, F.lit(eps))
    df = with_stats(df, {out: Stat(tuple(by), aggs, F.coalesce(z, F.lit(0.0)))})
    return df.withColumn(missing, F.col(kept).isNull()).drop(kept)


def eligible_rank(df, x, out, eligible="eligible", by=DATE) -> DataFrame:
    kept = _temp("kept")
    df = df.withColumn(kept, F.when(F.col(eligible), c(x)))
    return rank(df, kept, out, by).drop(kept)


def normalize(df, x, out, use_std=False, limit=0.0, by=DATE) -> DataFrame:
    return with_stats(df, {out: normalize_stat(x, use_std, limit, by)})


def scale(df, x, out, size=1.0, long_size=1.0, short_size=1.0, by=DATE) -> DataFrame:
    """Scale the group to a book of ``size``, or the two sides separately."""
    return with_stats(df, {out: scale_stat(x, size, long_size, short_size, by)})


def winsorize(df, x, out, std=4.0, by=DATE) -> DataFrame:
    return with_stats(df, {out: winsorize_stat(x, std, by)})


def quantile(df, x, out, driver="gaussian", sigma=1.0, by=DATE) -> DataFrame:
    r = _temp("r")
    df = rank(df, x, r, by)
    return df.withColumn(out, spread_rank(r, driver, sigma)).drop(r)


def group_neutralize(df, x, group, out) -> DataFrame:
    return with_stats(df, {out: group_neutralize_stat(x, group)})


def group_scale(df, x, group, out, size=1.0) -> DataFrame:
    return with_stats(df, {out: group_scale_stat(x, group, size)})


def group_mean(df, x, weight, group, out) -> DataFrame:
    """Weighted mean of the group; the weights of missing values count too."""
    return with_stats(df, {out: group_mean_stat(x, weight, group)})


def group_backfill(df, x, group, out, d, std=4.0) -> DataFrame:
    """Missing values take the mean of their group's winsorized values, then the last
    value of their code within ``d`` rows."""
    from ..functions import timeseries as ts
    tamed, filled = _temp("tamed"), _temp("filled")
    df = with_stats(winsorize(df, x, tamed, std), {filled: group_fill_stat(x, tamed, group)})
    return df.withColumn(out, ts.ts_backfill(filled, d)).drop(tamed, filled)
