"""Factor evaluation over the weekly panel."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions import features as ft, stats, timeseries as ts
from ..operators import cross, evaluate as ev, factors as fs, joins, pairs
from ..sources.panel import weekly_panel
from . import query
from .common import KEYS, PW, WC, full_sql, out, rank_sql, rd, wn
from .history import DAYS, LABEL, segments

NAMES = ("mom4", "rev1", "vol8", "liq4", "rng")
HORIZON = 28      # days until a label of four weekly sessions is known

FW = f"""{PW}, fw AS (SELECT date, code, Ifsuspend, Ifsuspend = 0 AS eligible, industry, sector, close,
 close / lag(close, 4) OVER {WC} - 1 AS mom4, lag(close) OVER {WC} / close - 1 AS rev1,
 {full_sql(f'stddev_samp(close) OVER {wn(8)} / avg(close) OVER {wn(8)}', 'close', 8)} AS vol8,
 {full_sql(f'avg(amount) OVER {wn(4)}', 'amount', 4)} AS liq4, (high - low) / open AS rng,
 lead(close, 4) OVER {WC} / close - 1 AS target FROM pw)"""
FL = f"""{FW}, fl AS (SELECT date, code, eligible, sector, target, unnest([{', '.join(f"'{n}'" for n in NAMES)}]) AS factor_id,
 unnest([{', '.join(NAMES)}]) AS value FROM fw)"""


def corr_sql(x, y, floor=3):
    return f"CASE WHEN count({x}) >= {floor} THEN covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) END"


def floored_sql(x, y):
    return (f"CASE WHEN count({x}) >= 2 THEN CASE WHEN stddev_pop({x}) < 1e-3 OR stddev_pop({y}) < 1e-3 THEN 0"
            f" ELSE covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END END")


PAIRS = "CASE WHEN {v} IS NOT NULL AND target IS NOT NULL THEN {v} END AS px, CASE WHEN {v} IS NOT NULL AND target IS NOT NULL THEN target END AS py"
DP = f"""{FL}, pr AS (SELECT *, {PAIRS.format(v='value')} FROM fl),
 rk AS (SELECT *, {rank_sql('px', 'date, factor_id', False)} AS rx, {rank_sql('py', 'date, factor_id', False)} AS ry FROM pr),
 dp AS (SELECT date, factor_id, {corr_sql('px', 'py')} AS ic, {corr_sql('rx', 'ry')} AS rank_ic,
  CASE WHEN count(px) >= 2 THEN covar_pop(px, py) / nullif(var_pop(px), 0) END AS slope, count(px) AS sample_count,
  (date + INTERVAL {HORIZON} DAYS)::TIMESTAMP AS label_available_date FROM rk GROUP BY date, factor_id)"""


def wide(spark, sf, *more):
    p = weekly_panel(spark, sf)
    df = fs.wide(p.df, {**fs.demo_factors(), "target": ts.forward_return("close", 4)},
                 keep=(*KEYS, "Ifsuspend", "industry", "sector", "close"))
    return df.withColumn("eligible", F.col("Ifsuspend") == 0)


def long(spark, sf):
    df = wide(spark, sf)
    return ev.unpivot(df, NAMES, keep=(*KEYS, "eligible", "sector", "target"))


def performance(spark, sf):
    values = long(spark, sf)
    return ev.daily_ic(values, horizon=HORIZON)


@query("V1", f"WITH {DP} SELECT date, factor_id, {rd('ic')} AS ic, {rd('rank_ic')} AS rank_ic, sample_count FROM dp")
def v1(spark, sf):
    values = long(spark, sf)
    return out(ev.daily_ic(values), "date", "factor_id", "sample_count", ic="ic", rank_ic="rank_ic")


@query("V2", f"WITH {FL}, pr AS (SELECT *, {PAIRS.format(v='value')} FROM fl) SELECT date, factor_id, count(px) AS valid_count, {rd(corr_sql('px', 'py'))} AS correlation FROM pr GROUP BY ALL")
def v2(spark, sf):
    return out(ev.ic_only(long(spark, sf)), "date", "factor_id", "valid_count", correlation="correlation")


@query("A11", f"WITH {FL}, pr AS (SELECT *, {PAIRS.format(v='value')} FROM fl) SELECT sector, factor_id, count(px) AS valid_count, {rd(corr_sql('px', 'py'))} AS correlation FROM pr GROUP BY ALL")
def a11(spark, sf):
    return out(ev.ic_only(long(spark, sf), by=("sector", "factor_id")), "sector", "factor_id", "valid_count", correlation="correlation")


@query("J1", f"""WITH {FL} SELECT date, factor_id, count(*) AS n, count(target) AS labelled, count(*) FILTER (copies > 1) AS repeated, {rd('avg(value)', 3)} AS mean_value
 FROM fl JOIN (SELECT date, code, count(*) AS copies FROM (SELECT date, code FROM fw WHERE target IS NOT NULL UNION ALL SELECT date, code FROM fw WHERE target > 2) GROUP BY ALL) USING (date, code) GROUP BY ALL""")
def j1(spark, sf):
    df = wide(spark, sf)
    values = ev.unpivot(df, NAMES)
    labels = df.filter(F.col("target").isNotNull()).select(*KEYS, "target")
    # A delivery that repeats the labels of large moves: their rows are kept once and reported.
    labels = labels.unionByName(labels.filter(F.col("target") > 2))
    joined = joins.many_to_one(values, labels, KEYS, repeated="again")
    got = joined.groupBy("date", "factor_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("target").alias("labelled"), F.count_if("again").alias("repeated"), F.avg("value").alias("mean_value"))
    return out(got, "date", "factor_id", "n", "labelled", "repeated", digits=3, mean_value="mean_value")


@query("V3", f"WITH {DP} SELECT date, factor_id, {rd('slope')} AS slope, sample_count, label_available_date FROM dp")
def v3(spark, sf):
    return out(performance(spark, sf), "date", "factor_id", "sample_count", "label_available_date", slope="slope")


COMPOSITE = f"""sc AS (SELECT date, target, {PAIRS.format(v='a')} FROM (SELECT *, CASE WHEN eligible THEN mom4 END AS a FROM fw WHERE target IS NOT NULL)),
 sr AS (SELECT *, {rank_sql('px', 'date', False)} AS rx, {rank_sql('py', 'date', False)} AS ry FROM sc),
 sd AS (SELECT date, count(*) AS n, count(px) AS pairs, {floored_sql('px', 'py')} AS ic, {floored_sql('rx', 'ry')} AS rank_ic FROM sr GROUP BY date)"""
COMPOSITE_OUT = f"""{rd('avg(ic)')} AS ic, {rd('avg(rank_ic)')} AS rank_ic, {rd('avg(ic) / greatest(stddev_pop(ic), 1e-6)')} AS icir,
 {rd('avg(rank_ic) / greatest(stddev_pop(rank_ic), 1e-6)')} AS rank_icir, {rd('sum(pairs)::DOUBLE / sum(n)')} AS coverage,
 least(count(ic), count(rank_ic)) AS valid_days"""
METRICS = ("ic", "rank_ic", "icir", "rank_icir", "coverage")


@query("V4", f"WITH {FW}, {COMPOSITE} SELECT {COMPOSITE_OUT} FROM sd")
def v4(spark, sf):
    df = wide(spark, sf)
    scored = df.filter(F.col("target").isNotNull()).select(
        *KEYS, "target", F.when(F.col("eligible"), F.col("mom4")).alias("alpha"))
    return out(ev.composite_metrics(scored), "valid_days", **{m: m for m in METRICS})


SPLITS = """dn AS (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM pw)),
 cutp AS (SELECT *, greatest(1, floor(n * 0.6::DOUBLE)) AS a, greatest(1, floor(n * 0.2::DOUBLE)) AS b FROM dn),
 splits AS (SELECT date, CASE WHEN i <= a THEN 'train' WHEN i <= a + b THEN 'valid' ELSE 'test' END AS split FROM cutp)"""


@query("V5", f"""WITH {FL}, {SPLITS}, pr AS (SELECT fl.*, split, {PAIRS.format(v='value')} FROM fl JOIN splits USING (date)),
 rk AS (SELECT *, {rank_sql('px', 'date, factor_id', False)} AS rx, {rank_sql('py', 'date, factor_id', False)} AS ry FROM pr),
 d AS (SELECT date, factor_id, split, count(*) AS n, count(px) AS pairs, {floored_sql('px', 'py')} AS ic, {floored_sql('rx', 'ry')} AS rank_ic FROM rk GROUP BY ALL),
 m AS (SELECT factor_id, split, avg(ic) AS ic, avg(rank_ic) AS rank_ic, avg(ic) / greatest(stddev_pop(ic), 1e-6) AS icir FROM d GROUP BY ALL)
 SELECT factor_id, split, {rd('ic')} AS ic, {rd('coalesce(0.4 * abs(ic) + 0.4 * abs(rank_ic) + 0.2 * tanh(abs(icir)), 0)')} AS score FROM m""")
def v5(spark, sf):
    values = long(spark, sf)
    splits = ft.time_splits(weekly_panel(spark, sf).df)
    tagged = values.join(F.broadcast(splits), "date")
    got = ev.factor_score(ev.composite_metrics(tagged, "value", "target", ("factor_id", "split")))
    return out(got, "factor_id", "split", ic="ic", score="score")


STATES = f"""ret AS (SELECT *, coalesce(close / nullif(lag(close) OVER {WC}, 0) - 1, 0) AS ret FROM pw),
 days0 AS (SELECT date, avg(ret) AS market_return FROM ret GROUP BY date),
 days AS (SELECT *, coalesce(CASE WHEN count(*) OVER w >= 2 THEN stddev_pop(market_return) OVER w END, 0) AS market_volatility
  FROM days0 WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 states AS (SELECT date, CASE WHEN market_volatility >= 3.4 THEN 'high_volatility' WHEN market_return >= 4.75 THEN 'bull'
  WHEN market_return <= 2.75 THEN 'bear' ELSE 'sideways' END AS state_id FROM days)"""


def states(spark, sf):
    """Market states; the two-sided rule is centred on the typical weekly return."""
    days = ft.market_volatility(ft.market_features(weekly_panel(spark, sf).df))
    centred = days.withColumn("market_return", F.col("market_return") - 3.75)
    return ft.rule_states(centred, 1.0, 3.4).select("date", "state_id")


COND_OUT = f"""count(ic) AS sample_count, {rd('avg(CASE WHEN sample_count >= 3 THEN 1.0::DOUBLE ELSE 0.0 END)')} AS coverage, {rd('avg(ic)')} AS ic_mean,
 {rd('avg(rank_ic)')} AS rank_ic_mean, {rd('CASE WHEN count(ic) >= 2 THEN avg(ic) / nullif(stddev_samp(ic), 0) END')} AS icir,
 {rd('avg(CASE WHEN ic > 0 THEN 1.0::DOUBLE WHEN ic IS NOT NULL THEN 0.0 END)')} AS hit_rate, {rd('abs(avg(ic)) / nullif(avg(abs(ic)), 0)')} AS stability"""
COND_COLS = ("coverage", "ic_mean", "rank_ic_mean", "icir", "hit_rate", "stability")


def tagged_daily(spark, sf):
    """Daily IC with its state and split: date-level tables, bounded by the calendar."""
    splits = ft.time_splits(weekly_panel(spark, sf).df)
    return (performance(spark, sf).join(F.broadcast(states(spark, sf)), "date")
            .join(F.broadcast(splits), "date"))


@query("V6", f"WITH {DP}, {STATES}, {SPLITS} SELECT factor_id, state_id, split, {COND_OUT} FROM dp JOIN states USING (date) JOIN splits USING (date) GROUP BY factor_id, state_id, split")
def v6(spark, sf):
    got = ev.conditional_metrics(tagged_daily(spark, sf), ["factor_id", "state_id", "split"])
    return out(got, "factor_id", "state_id", "split", "sample_count", **{m: m for m in COND_COLS})


@query("A4", f"WITH {DP}, {STATES} SELECT factor_id, state_id, {COND_OUT} FROM dp JOIN states USING (date) GROUP BY factor_id, state_id")
def a4(spark, sf):
    daily = performance(spark, sf).join(F.broadcast(states(spark, sf)), "date")
    got = ev.conditional_metrics(daily, ["factor_id", "state_id"])
    return out(got, "factor_id", "state_id", "sample_count", **{m: m for m in COND_COLS})


@query("A12", f"""WITH {DP}, {STATES}, {SPLITS} SELECT factor_id, coalesce(state_id, 'all') AS state_id, coalesce(split, 'all') AS split, count(ic) AS n, {rd('avg(ic)')} AS ic_mean
 FROM dp JOIN states USING (date) JOIN splits USING (date) GROUP BY GROUPING SETS ((factor_id, state_id, split), (factor_id, state_id), (factor_id, split), (factor_id))""")
def a12(spark, sf):
    f, s, p = F.col("factor_id"), F.col("state_id"), F.col("split")
    got = tagged_daily(spark, sf).groupingSets([(f, s, p), (f, s), (f, p), (f,)], f, s, p).agg(
        F.count("ic").alias("n"), F.avg("ic").alias("ic_mean"))
    return out(got.withColumns({"state_id": F.coalesce("state_id", F.lit("all")), "split": F.coalesce("split", F.lit("all"))}),
               "factor_id", "state_id", "split", "n", ic_mean="ic_mean")


@query("V7", f"WITH {FL} SELECT factor_id, count(*) AS row_count, count(value) AS valid_count, {rd('count(value)::DOUBLE / count(*)')} AS coverage FROM fl GROUP BY factor_id")
def v7(spark, sf):
    return out(fs.factor_status(long(spark, sf)), "factor_id", "row_count", "valid_count", coverage="coverage")


def _behavior_sql(name):
    return (f"{rd(f'avg({name})')} AS {name}_mean, {rd(f'CASE WHEN count({name}) >= 2 THEN stddev_samp({name}) END')} AS {name}_std, "
            f"{rd(f'CASE WHEN count({name}) >= 2 THEN avg({name}) / nullif(stddev_samp({name}), 0) END', 4)} AS {name}_ir")


# Slopes depend on the scale of the factor: for amounts they are per million.
PER_MILLION = "dps AS (SELECT * REPLACE (slope * CASE factor_id WHEN 'liq4' THEN 1e6::DOUBLE ELSE 1.0::DOUBLE END AS slope) FROM dp)"
BEHAVIOR = ", ".join(_behavior_sql(n) for n in ("ic", "rank_ic", "slope"))
BEHAVIOR_COLS = [f"{n}_{s}" for n in ("ic", "rank_ic", "slope") for s in ("mean", "std", "ir")]


def scaled_performance(spark, sf):
    unit = F.when(F.col("factor_id") == "liq4", 1e6).otherwise(1.0)
    return performance(spark, sf).withColumn("slope", F.col("slope") * unit)


def behavior_out(df, *keys):
    from .common import r
    return df.select(*keys, *[r(n, 4 if n.endswith("_ir") else 6).alias(n) for n in BEHAVIOR_COLS])


@query("V8", f"WITH {DP}, {PER_MILLION} SELECT factor_id, {BEHAVIOR} FROM dps WHERE date < TIMESTAMP '2000-01-03' AND label_available_date < TIMESTAMP '2000-01-03' GROUP BY factor_id")
def v8(spark, sf):
    past = ev.mature(scaled_performance(spark, sf), F.lit("2000-01-03").cast("timestamp"))
    return behavior_out(ev.behavior_summary(past), "factor_id")


@query("T33", f"""WITH {DP} SELECT date, factor_id, {rd('ic')} AS ic FROM dp WHERE date < TIMESTAMP '2000-01-03' AND label_available_date < TIMESTAMP '2000-01-03'
 QUALIFY row_number() OVER (PARTITION BY factor_id ORDER BY date DESC) <= 40""")
def t33(spark, sf):
    past = ev.mature(performance(spark, sf), F.lit("2000-01-03").cast("timestamp"))
    from pyspark.sql import Window
    w = Window.partitionBy("factor_id").orderBy(F.col("date").desc())
    return out(past.withColumn("_n", F.row_number().over(w)).filter("_n <= 40"), "date", "factor_id", ic="ic")


@query("T34", f"""WITH {DP}, {PER_MILLION}, asd AS (SELECT DISTINCT date AS as_of_date FROM pw),
 m AS (SELECT as_of_date, dps.* FROM asd JOIN dps ON date < as_of_date AND label_available_date < as_of_date
  QUALIFY row_number() OVER (PARTITION BY as_of_date, factor_id ORDER BY date DESC) <= 40)
 SELECT as_of_date, factor_id, count(*) AS mature_sample_count, {BEHAVIOR} FROM m GROUP BY as_of_date, factor_id""")
def t34(spark, sf):
    dates = weekly_panel(spark, sf).df.select("date").distinct()
    return behavior_out(ev.rolling_behavior(scaled_performance(spark, sf), dates, HORIZON, 40),
                        "as_of_date", "factor_id", "mature_sample_count")


@query("V9", f"""WITH {FL}, d AS (SELECT factor_id, date, coalesce((count(value) FILTER (eligible))::DOUBLE / nullif(count(*) FILTER (eligible), 0), 1) AS coverage,
  (count(*) FILTER (eligible) > 0 AND (count(value) FILTER (eligible) < 2 OR coalesce(stddev_pop(value) FILTER (eligible), 0) < 1e-12)) AS degenerate FROM fl GROUP BY ALL),
 g AS (SELECT factor_id, avg(CASE WHEN coverage < 0.9 THEN 1.0::DOUBLE ELSE 0.0 END) AS low, avg(CASE WHEN degenerate THEN 1.0::DOUBLE ELSE 0.0 END) AS bad FROM d GROUP BY factor_id)
 SELECT factor_id, {rd('low')} AS low_coverage_fraction, {rd('bad')} AS degenerate_fraction, low <= 0.02 AND bad <= 0.02 AS passed FROM g""")
def v9(spark, sf):
    values = long(spark, sf)
    got = ev.quality_gate(ev.day_quality(values, "value", by=("factor_id", "date")), 0.9, 0.02, 0.02, by=("factor_id",))
    return out(got, "factor_id", "passed", low_coverage_fraction="low_coverage_fraction", degenerate_fraction="degenerate_fraction")


Z = f"{FW}, zw AS (SELECT date, code, target, eligible, " + ", ".join(
    f"coalesce(({n} - avg({n}) OVER d) / nullif(stddev_pop({n}) OVER d, 0), 0) AS {n}" for n in NAMES) + " FROM fw WINDOW d AS (PARTITION BY date))"


def zscores(spark, sf, names=NAMES):
    """Composition z-scores of the factor set, one statistics pass for all factors."""
    df = wide(spark, sf)
    return cross.zscores_filled(df, names)


@query("V10", f"""WITH {Z}, l AS (SELECT date, code, unnest([{', '.join(f"'{n}'" for n in NAMES)}]) AS f, unnest([{', '.join(NAMES)}]) AS z FROM zw),
 d AS (SELECT a.f AS f1, b.f AS f2, a.date, {floored_sql('a.z', 'b.z')} AS ic FROM l a JOIN l b ON a.date = b.date AND a.code = b.code AND a.f <> b.f GROUP BY ALL)
 SELECT f1, f2, {rd('avg(ic)')} AS mutual_ic, count(ic) AS usable_dates FROM d WHERE list_position([{', '.join(f"'{n}'" for n in NAMES)}], f1) < list_position([{', '.join(f"'{n}'" for n in NAMES)}], f2) GROUP BY f1, f2""")
def v10(spark, sf):
    df = zscores(spark, sf)
    return out(pairs.mutual_ic(df, NAMES), "f1", "f2", "usable_dates", mutual_ic="mutual_ic")


SPEAR_NAMES = NAMES
SPEAR = f"""prs AS ({' UNION ALL '.join(f"SELECT '{a}' AS f1, '{b}' AS f2, {a} AS x, {b} AS y FROM fw" for a, b in combinations(NAMES, 2))}),
 prr AS (SELECT f1, f2, {rank_sql('x', 'f1, f2', False)} AS rx, {rank_sql('y', 'f1, f2', False)} AS ry FROM prs WHERE x IS NOT NULL AND y IS NOT NULL),
 spear AS (SELECT f1, f2, corr(rx, ry) AS spearman, count(*) AS pairs FROM prr GROUP BY f1, f2)"""


@query("V11", f"WITH {FW}, {SPEAR} SELECT f1, f2, {rd('spearman')} AS spearman, pairs FROM spear")
def v11(spark, sf):
    df = wide(spark, sf)
    return out(pairs.pooled_spearman(df, SPEAR_NAMES), "f1", "f2", "pairs", spearman="spearman")


@query("V12", f"""{LABEL}, s AS (SELECT date, code, (high - low) / open AS x, label FROM lab WHERE Ifsuspend = 0),
 d AS (SELECT date, CASE WHEN count(*) >= 2 AND stddev_pop(x) > 1e-12 AND stddev_pop(label) > 1e-12 THEN covar_pop(x, label) / (stddev_pop(x) * stddev_pop(label)) END AS ic
  FROM s WHERE x IS NOT NULL AND label IS NOT NULL GROUP BY date)
 SELECT segment, {rd('coalesce(avg(ic), 0)')} AS segment_ic, count(ic) AS days FROM d JOIN seg ON date BETWEEN start AND stop GROUP BY segment""")
def v12(spark, sf):
    df = joins.segment_label(weekly_panel(spark, sf).df, segments(spark), 4)
    scored = df.filter(F.col("Ifsuspend") == 0).select("date", ((F.col("high") - F.col("low")) / F.col("open")).alias("x"), "label")
    daily = scored.groupBy("date").agg(stats.pearson_over_eps("x", "label", 1e-12).alias("ic"))
    got = joins.in_segments(daily.filter("ic IS NOT NULL"), segments(spark)).groupBy("segment").agg(
        F.coalesce(F.avg("ic"), F.lit(0.0)).alias("segment_ic"), F.count("ic").alias("days"))
    return out(got, "segment", "days", segment_ic="segment_ic")


COARSE = {n: f"floor({n} * 1000) / 1000" for n in NAMES} | {"mom4": "CASE WHEN Ifsuspend = 0 THEN floor(mom4 * 1000) / 1000 END"}


@query("V13", f"""WITH {FW}, b AS (SELECT date, code, {', '.join(f'{e} AS {n}' for n, e in COARSE.items())} FROM fw),
 b2 AS (SELECT * FROM b WHERE code NOT LIKE '%7'), j AS (SELECT a.code IS NULL OR b2.code IS NULL AS alone, {', '.join(f'a.{n} AS x_{n}, b2.{n} AS y_{n}' for n in NAMES)} FROM fw a FULL JOIN b2 ON a.date = b2.date AND a.code = b2.code)
 {' UNION ALL '.join(f"SELECT '{n}' AS field, count(*) FILTER (alone) AS unmatched, count(*) FILTER (NOT alone AND (x_{n} IS NULL) <> (y_{n} IS NULL)) AS missing_differs, {rd(f'coalesce(max(abs(x_{n} - y_{n})), 0)')} AS max_error FROM j" for n in NAMES)}""")
def v13(spark, sf):
    df = wide(spark, sf)
    coarse = df.select(*KEYS, *[(F.when(F.col("eligible"), F.floor(F.col(n) * 1000) / 1000) if n == "mom4"
                                 else F.floor(F.col(n) * 1000) / 1000).alias(n) for n in NAMES])
    part = coarse.filter(~F.col("code").endswith("7"))
    return out(ev.parity(df, part, KEYS, NAMES), "field", "unmatched", "missing_differs", max_error="max_error")


@query("V13_ranking", f"""WITH {FW}, b AS (SELECT date, code, CASE WHEN code NOT LIKE '%7' THEN floor(rng * 100) / 100 END AS rng FROM fw),
 x AS (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY rng DESC, code) AS p FROM fw WHERE rng IS NOT NULL),
 y AS (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY rng DESC, code) AS p FROM b WHERE rng IS NOT NULL)
 SELECT coalesce(x.date, y.date) AS date, count(*) AS codes, count(*) FILTER (x.p IS DISTINCT FROM y.p) AS moved, count(*) FILTER (x.p IS DISTINCT FROM y.p) = 0 AS same_ranking
 FROM x FULL JOIN y ON x.date = y.date AND x.code = y.code GROUP BY 1""")
def v13_ranking(spark, sf):
    """Per date, whether a score that was cut to two digits and lost some codes still ranks like the first one."""
    df = wide(spark, sf).select(*KEYS, "rng")
    other = df.withColumn("rng", F.when(~F.col("code").endswith("7"), F.floor(F.col("rng") * 100) / 100))
    return ev.ranking_parity(df, other, "rng")


def _grid_sql():
    ops = {"delta": "(({x}) - lag({x}, {n}) OVER {wc}) / nullif(lag({x}, {n}) OVER {wc}, 0)",
           "ts_zscore": "({x} - avg({x}) OVER {w}) / nullif(stddev_samp({x}) OVER {w}, 0)",
           "ts_scale": "({x} - min({x}) OVER {w}) / nullif(max({x}) OVER {w} - min({x}) OVER {w}, 0)",
           "mean_gap": "{x} / nullif(avg({x}) OVER {w}, 0) - 1"}
    cols = {}
    for x in ("close", "volume", "amount"):
        for op, sql in ops.items():
            for n in (4, 8):
                body = sql.format(x=x, n=n, wc=WC, w=wn(n))
                cols[f"{op}_{x}_{n}"] = body if op == "delta" else full_sql(body, x, n)
    return cols


GRID = _grid_sql()


@query("V14", f"""WITH {PW}, gw AS (SELECT date, code, lead(close, 4) OVER {WC} / close - 1 AS target, {', '.join(f'{s} AS {n}' for n, s in GRID.items())} FROM pw),
 gl AS (SELECT date, code, target, unnest([{', '.join(f"'{n}'" for n in GRID)}]) AS factor_id, unnest([{', '.join(GRID)}]) AS value FROM gw),
 pr AS (SELECT *, {PAIRS.format(v='value')} FROM gl), d AS (SELECT date, factor_id, {corr_sql('px', 'py')} AS ic FROM pr GROUP BY ALL),
 m AS (SELECT factor_id, avg(ic) AS ic, avg(ic) / nullif(stddev_samp(ic), 0) AS icir FROM d GROUP BY factor_id)
 SELECT factor_id, {rd('ic')} AS ic, {rd('icir')} AS icir, row_number() OVER (ORDER BY abs(ic) DESC, factor_id) AS place FROM m""")
def v14(spark, sf):
    from pyspark.sql import Window
    p = weekly_panel(spark, sf)
    grid = fs.grid()
    values = ev.unpivot(fs.wide(p.df, {**grid, "target": ts.forward_return("close", 4)}), list(grid), keep=(*KEYS, "target"))
    daily = ev.ic_only(values)
    m = daily.groupBy("factor_id").agg(F.avg("correlation").alias("ic"), stats.information_ratio("correlation").alias("icir"))
    # One row per grid cell: the ordering window sees the configured grid only.
    w = Window.orderBy(F.abs("ic").desc(), "factor_id")
    return out(m.withColumn("place", F.row_number().over(w).cast("bigint")), "factor_id", "place", ic="ic", icir="icir")
