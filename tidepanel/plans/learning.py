"""Clustering, market states and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as ft
from ..operators import cluster as cl
from ..sources.panel import weekly_panel
from . import query
from .common import PW, out, rd
from .evaluation import SPLITS
from .history import DAYS

FEATS = ("range_mean", "volume_mean", "gap_std")
# Behavior of each code; codes with few large weeks have no deviation.
BEHAVIOR = f"""WITH {PW}, b AS (SELECT code, max(sector) AS cluster, avg((high - low) / open) AS range_mean, avg(volume) AS volume_mean,
 CASE WHEN count(*) FILTER (volume > 60) > 30 THEN stddev_pop(open / (open + close)) END AS gap_std FROM pw GROUP BY code),
 f AS (SELECT code, cluster, {', '.join(f'coalesce({n}, (SELECT median({n}) FROM b), 0) AS {n}' for n in FEATS)} FROM b)"""


def behavior(spark, sf):
    gap = F.stddev_pop(F.col("open") / (F.col("open") + F.col("close")))
    return weekly_panel(spark, sf).df.groupBy("code").agg(
        F.max("sector").alias("cluster"), F.avg((F.col("high") - F.col("low")) / F.col("open")).alias("range_mean"),
        F.avg("volume").alias("volume_mean"), F.when(F.count_if(F.col("volume") > 60) > 30, gap).alias("gap_std"))


@query("L1", f"{BEHAVIOR} SELECT code, " + ", ".join(f"{rd(n)} AS {n}, {rd(f'({n} - avg({n}) OVER ()) / coalesce(nullif(stddev_pop({n}) OVER (), 0), 1)')} AS z_{n}" for n in FEATS) + " FROM f")
def l1(spark, sf):
    m = cl.behavior_matrix(behavior(spark, sf), FEATS)
    return out(m, "code", **{n: n for n in FEATS}, **{f"z_{n}": f"z_{n}" for n in FEATS})


@query("L2")
def l2(spark, sf):
    m = cl.behavior_matrix(behavior(spark, sf).drop("cluster"), FEATS)
    labels, centers, cost = cl.fit_kmeans(m, FEATS, 4, starts=4)
    return labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("members")).join(centers, "cluster").withColumn("cost", F.lit(cost))


@query("L3", f"""{BEHAVIOR}, c AS (SELECT cluster, {', '.join(f'avg({n}) AS c_{n}' for n in FEATS)} FROM f GROUP BY cluster),
 d AS (SELECT code, cluster, round(sqrt({' + '.join(f'pow({n} - c_{n}, 2)' for n in FEATS)}), 9) AS distance FROM f JOIN c USING (cluster))
 SELECT cluster, code, {rd('distance')} AS distance, row_number() OVER w AS place FROM d WINDOW w AS (PARTITION BY cluster ORDER BY distance, code) QUALIFY row_number() OVER w <= 2""")
def l3(spark, sf):
    m = cl.behavior_matrix(behavior(spark, sf), FEATS)
    got = cl.representatives(m, cl.raw_centers(m, FEATS), FEATS, "code", 2)
    return out(got.withColumn("place", F.col("place").cast("bigint")), "cluster", "code", "place", distance="distance")


@query("L4", f"""{DAYS} SELECT date, CASE WHEN market_volatility >= 3.4 THEN 'high_volatility' WHEN market_return >= 4.75 THEN 'bull' WHEN market_return <= -4.75 THEN 'bear' ELSE 'sideways' END AS state_id,
 max(date) OVER () AS fit_window_end FROM days""")
def l4(spark, sf):
    days = ft.market_volatility(ft.market_features(weekly_panel(spark, sf).df))
    return ft.rule_states(days, 4.75, 3.4).select("date", "state_id", "fit_window_end")


@query("L5", f"WITH {PW}, {SPLITS} SELECT date, split FROM splits")
def l5(spark, sf):
    return ft.time_splits(weekly_panel(spark, sf).df)
