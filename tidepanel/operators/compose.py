"""Factor composition, scoring and selection."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clean import c, ratio
from ..functions.scalar import add as add_present
from . import cross, joins, screens
from .pairs import moments


def weighted_alpha(weights: dict[str, float]) -> Column:
    """Weighted sum of factor columns; NULL only where all of them are."""
    return add_present(*[F.col(n) * F.lit(float(w)) for n, w in weights.items()])


def combine_parts(parts: list[DataFrame]) -> DataFrame:
    """Sum of weighted parts that need not cover the same keys: a union and one
    aggregation instead of a chain of outer joins."""
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.groupBy("date", "code").agg(F.sum(F.coalesce("part", F.lit(0.0))).alias("alpha"))


def weighted_sum(weights: dict[str, float]) -> Column:
    """Weighted sum of columns that are never NULL (composition z-scores)."""
    return reduce(add, [F.col(n) * F.lit(float(w)) for n, w in weights.items()])


def frozen_score(df: DataFrame, weights: dict[str, float], eligible: str = "eligible",
                 eps: float = 1e-12) -> DataFrame:
    """Score of fixed weights over eligible-only z-scores, with one contribution per
    factor; ``violation`` marks eligible rows on which every factor is missing."""
    names = list(weights)
    kept = {n: cross._temp(n) for n in names}
    df = df.withColumns({kept[n]: F.when(F.col(eligible), F.col(n)) for n in names})
    mu, sd = {n: cross._temp("mu") for n in names}, {n: cross._temp("sd") for n in names}
    df = cross.attach(df, **{mu[n]: F.avg(kept[n]) for n in names},
                      **{sd[n]: F.stddev_pop(kept[n]) for n in names})
    parts = []
    for n in names:
        z = F.coalesce((F.col(kept[n]) - F.col(mu[n])) / F.greatest(F.col(sd[n]), F.lit(eps)), F.lit(0.0))
        w = F.lit(float(weights[n]))
        parts.append(F.struct(F.lit(n).alias("factor_id"), w.alias("weight"), F.col(n).alias("raw"),
                              z.alias("standardized"), (w * z).alias("contribution"),
                              F.col(kept[n]).isNull().alias("missing")))
    df = df.withColumn("contributions", F.array(*parts))
    score = reduce(add, [F.col("contributions")[i]["contribution"] for i in range(len(names))])
    lost = reduce(lambda a, b: a & b, [F.col("contributions")[i]["missing"] for i in range(len(names))])
    return df.withColumns({"score": score, "violation": F.col(eligible) & lost}).drop(
        *kept.values(), *mu.values(), *sd.values())


def dated_weights_alpha(df: DataFrame, weights: DataFrame, names) -> DataFrame:
    """Alpha with weights that vary by date: sum(w z) / sum(w) over present factors.

    ``weights`` is (date, factor_id, weight); it becomes one map per date. The map is
    as wide as the factor list and there is one per session.
    """
    maps = weights.filter(F.col("factor_id").isin(list(names))).groupBy("date").agg(
        F.map_from_entries(F.collect_list(F.struct("factor_id", "weight"))).alias("_w"))
    mu, sd = {n: cross._temp("mu") for n in names}, {n: cross._temp("sd") for n in names}
    df = cross.attach(df, **{mu[n]: F.avg(n) for n in names},
                      **{sd[n]: F.stddev_pop(n) for n in names})
    df = df.join(maps, "date")
    z = {n: ratio(F.col(n) - F.col(mu[n]), sd[n]) for n in names}
    w = {n: F.coalesce(F.col("_w")[n], F.lit(0.0)) for n in names}
    top = add_present(*[z[n] * w[n] for n in names])
    bottom = reduce(add, [F.when(z[n].isNotNull(), w[n]).otherwise(0.0) for n in names])
    return df.withColumn("alpha", ratio(top, bottom)).drop("_w", *mu.values(), *sd.values())


def asof_selection(panel_factors: DataFrame, pool: DataFrame, weights: dict[str, float], as_of: Column,
                   top_n: int, min_coverage: float) -> DataFrame:
    """Rank a pool on its last available date: score, coverage, first reason, rank and
    each factor's contribution. Only the pool's rows enter the z-scores."""
    day = joins.last_available(panel_factors.join(pool.select("code").distinct(), "code", "left_semi"), as_of)
    raw = {n: f"_raw_{n}" for n in weights}
    day = day.withColumns({raw[n]: F.col(n) for n in weights})
    day = cross.zscores_filled(day, list(weights))
    present = reduce(add, [F.col(raw[n]).isNotNull().cast("double") for n in weights])
    parts = {f"contribution_{n}": F.col(n) * w for n, w in weights.items()}
    day = day.select("code", "close", "Ifsuspend", weighted_sum(weights).alias("_score"), *[v.alias(n) for n, v in parts.items()],
                     (present / len(weights)).alias("_coverage"), F.lit(True).alias("_seen"))
    got = pool.join(day, "code", "left").withColumns({
        "score": F.coalesce("_score", F.lit(0.0)), "coverage": F.coalesce("_coverage", F.lit(0.0)),
        **{n: F.coalesce(n, F.lit(0.0)) for n in parts}})
    reason = screens.selection_reason(F.col("close"), F.col("Ifsuspend"), F.col("coverage"), F.col("score"), min_coverage,
                                      F.col("_seen").isNotNull())
    got = got.withColumn("reason", reason).withColumn("eligible", F.col("reason") == "")
    return screens.ranking(got.drop("_score", "_coverage", "_seen"), "score", top_n)


def asof_scores(stored, pool: DataFrame, factors: dict, weights: dict[str, float], as_of: str, top_n: int,
                min_coverage: float) -> DataFrame:
    """``asof_selection`` from a stored panel. How far the factors look back bounds the scan: only the periods of the
    rows that the pool's last date needs are read."""
    from .factors import composed, lookback
    far = [lookback(f) for f in factors.values()]
    part, day = stored.history(as_of, None if None in far else max(far, default=0), pool)
    last = F.lit(day or as_of).cast("timestamp")
    values = composed(part, factors, ("date", "code", "close", "Ifsuspend")).filter(F.col("date") == last)
    return asof_selection(values, pool, weights, last, top_n, min_coverage)


def with_catalog(metrics: DataFrame, catalog: DataFrame) -> DataFrame:
    """Metrics of catalogued factors; the catalog's category wins where it has one."""
    cat = catalog.select("factor_id", F.col("category").alias("_cat"))
    own = F.col("category") if "category" in metrics.columns else F.lit(None)
    return metrics.join(cat, "factor_id").withColumn("category", F.coalesce("_cat", own)).drop("_cat")


def selection_score() -> Column:
    return (F.coalesce("rank_ic_mean", F.lit(0.0)) * 0.7 + F.coalesce("icir", F.lit(0.0)) * 0.3)


def category_scores(metrics: DataFrame, by=()) -> DataFrame:
    """Mean score, distinct factors and mean metrics per category; NULL is a group."""
    return metrics.withColumn("_s", selection_score()).groupBy(*by, "category").agg(
        F.avg("_s").alias("score"), F.countDistinct("factor_id").alias("factor_count"),
        F.avg("rank_ic_mean").alias("mean_rank_ic"), F.avg("icir").alias("mean_icir"))


def conflicts(pairs: DataFrame, measure: str, threshold: float, signed: bool = False) -> DataFrame:
    """Both directions of factor pairs whose measure reaches the threshold."""
    value = F.col(measure)
    hit = value > threshold if signed else F.abs(value) >= threshold
    close = pairs.filter(hit)
    return close.select(F.col("f1").alias("factor_id"), F.col("f2").alias("other")).unionByName(
        close.select(F.col("f2").alias("factor_id"), F.col("f1").alias("other")))


def greedy_pick(candidates: DataFrame, pairs: DataFrame, by, score: str, top_n: int) -> DataFrame:
    """Walk candidates by score; admit unless the list is full or an admitted factor
    conflicts. Groups hold catalogue entries (factor definitions), not data rows."""
    by = list(by)
    rivals = pairs.groupBy("factor_id").agg(F.sort_array(F.collect_set("other")).alias("rivals"))
    rows = candidates.join(rivals, "factor_id", "left").select(     # missing scores come last
        *by, F.struct(F.col(score).isNull().alias("none"), (-F.col(score)).alias("s"), "factor_id",
                      F.coalesce("rivals", F.array().cast("array<string>")).alias("rivals")).alias("item"))
    lists = rows.groupBy(*by).agg(F.sort_array(F.collect_list("item")).alias("items"))
    chosen = F.aggregate("items", F.array().cast("array<string>"), lambda acc, x: F.when(
        (F.size(acc) < top_n) & ~F.arrays_overlap(acc, x["rivals"]),
        F.array_append(acc, x["factor_id"])).otherwise(acc))
    walked = lists.withColumn("chosen", chosen).select(*by, "chosen", "items", F.posexplode("items").alias("pos", "item"))
    ids = F.transform("items", lambda x: x["factor_id"])
    before = F.size(F.filter("chosen", lambda x: F.array_position(ids, x) <= F.col("pos")))
    selected = F.array_contains("chosen", F.col("item")["factor_id"])
    reason = F.when(selected, "").when(before >= top_n, "top_n_limit").otherwise("mutual_correlation")
    rival = F.get(F.filter("chosen", lambda x: F.array_contains(F.col("item")["rivals"], x)), F.lit(0))
    return walked.select(*by, F.col("item")["factor_id"].alias("factor_id"), (-F.col("item")["s"]).alias("score"),
                         selected.alias("selected"), reason.alias("reason"),
                         F.when(reason == "mutual_correlation", rival).alias("with_factor"))


def equal_weights(selected: DataFrame, by) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return selected.withColumn("weight", F.lit(1.0) / n)


def strategy_scores(zscores: DataFrame, strategies: dict[str, dict[str, float]], keep=("date", "code")) -> DataFrame:
    """Scores of many weight vectors at once: each row of z-scores is read once and
    yields one score per strategy. No join with the grid."""
    scores = F.explode(F.array(*[
        F.struct(F.lit(name).alias("strategy_id"), weighted_sum(w).alias("score"))
        for name, w in strategies.items()])).alias("s")
    return zscores.select(*keep, scores).select(*keep, "s.*")


def prefix_strategies(names, sizes) -> dict[str, dict[str, float]]:
    """Equal weights over the first ``size`` factors of a ranked list."""
    return {f"top{n}": {x: 1.0 / n for x in names[:n]} for n in sizes}


def marginal_strategies(pool, candidates) -> dict[str, dict[str, float]]:
    """The pool itself and the pool plus each candidate, equally weighted."""
    k = len(pool)
    trial = {c_: {**{p: 1.0 / (k + 1) for p in pool}, c_: 1.0 / (k + 1)} for c_ in candidates}
    return {"base": {p: 1.0 / k for p in pool}, **trial}


def sample_moments(zscores: DataFrame, names, target: str) -> tuple[np.ndarray, np.ndarray]:
    """Second moments of the factors, and of each with the daily-normalized target, every day with the same total
    weight: (K + 1)^2 numbers for the driver, from sums by blocks of factors."""
    days = zscores.filter(F.col(target).isNotNull())
    days = cross.attach(days, _mu=F.avg(target), _sd=F.stddev_pop(target))
    y = F.coalesce(ratio(c(target) - F.col("_mu"), "_sd"), F.lit(0.0))
    width = len(names) + 1
    sums = moments(days.select("date", F.array(*[F.col(n) for n in names], y).alias("x")), "x", width, ("date",))
    square = lambda v, a, b: F.avg(F.col(v) / F.col("n") + F.col(a) * F.col(b)).alias(v)
    rows = sums.groupBy("i", "j").agg(square("cxy", "mx", "my"), square("vx", "mx", "mx"), square("vy", "my", "my")).collect()
    both = np.zeros((width, width))
    for r in rows:
        i, j = r["i"], r["j"]
        both[i, j] = both[j, i] = r["cxy"]
        both[i, i], both[j, j] = r["vx"], r["vy"]
    return both[:-1, :-1], both[:-1, -1]


def l1_weights(zscores: DataFrame, names, target: str, alpha: float, tolerance: float = 1e-13, sweeps: int = 10_000) -> np.ndarray:
    """Sparse factor weights: least squares with an L1 penalty, by coordinate descent on the moments of the sample. The
    sample is read once, whatever the number of sweeps."""
    m, v = sample_moments(zscores, names, target)
    weights = np.zeros(len(names))
    for _ in range(sweeps):
        before = weights.copy()
        for k in np.flatnonzero(np.diag(m) > 0):
            rest = v[k] - m[k] @ weights + m[k, k] * weights[k]
            weights[k] = np.sign(rest) * max(abs(rest) - alpha / 2, 0.0) / m[k, k]
        if np.abs(weights - before).max(initial=0.0) < tolerance:
            break
    return weights


def pick_for_state(candidates: DataFrame, categories: dict[str, str], pairs: DataFrame, state: str,
                   top_n: int) -> DataFrame:
    """Best category of a state, its factors without close relatives, equal weights."""
    names = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])
    rows = candidates.filter(F.col("state_id") == state).withColumn("category", names[F.col("factor_id")])
    best = category_scores(rows).orderBy(F.col("score").desc_nulls_last(), F.col("category").asc()).limit(1)
    rows = rows.join(F.broadcast(best.select("category")), "category", "left_semi")
    picks = greedy_pick(rows, pairs, ("category",), "selection_score", top_n)
    return equal_weights(picks.filter("selected"), ("category",))
