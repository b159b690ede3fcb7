"""Rolling and sequential operators per code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as ft, timeseries as ts
from ..operators import joins, stateful
from ..sources.panel import weekly_panel
from . import query
from .common import KEYS, PW, WC, full_sql, out, r, rd, wn
from .crosses import probit_sql

P = f"WITH {PW}"
# A price with gaps: missing while the code is suspended.
GAP = f"{P}, g AS (SELECT *, CASE WHEN Ifsuspend = 0 THEN close END AS v FROM pw)"


def panel(spark, sf):
    return weekly_panel(spark, sf).df


def gaps(spark, sf):
    return panel(spark, sf).withColumn("v", F.when(F.col("Ifsuspend") == 0, F.col("close")))


def rolling(key, sql, make, digits=6, source=GAP, table="g", load=gaps):
    """A rolling Column ``z`` over the weekly panel, on a price with gaps."""
    @query(key, f"{source} SELECT date, code, {rd(sql, digits)} AS z FROM {table}")
    def run(spark, sf):
        return load(spark, sf).select(*KEYS, r(make(), digits).alias("z"))
    return run


def two(key, sqls, makes, digits=6):
    """Several rolling Columns over the weekly panel."""
    body = ", ".join(f"{rd(s, digits)} AS {name}" for name, s in sqls.items())

    @query(key, f"{GAP} SELECT date, code, {body} FROM g")
    def run(spark, sf):
        return out(gaps(spark, sf), *KEYS, digits=digits, **makes())
    return run


rolling("T1", f"lag(v, 3) OVER {WC}", lambda: ts.delay("v", 3))
rolling("T2", f"v - lag(v, 3) OVER {WC}", lambda: ts.delta("v", 3))
two("T3", {"m": full_sql(f"avg(v) OVER {wn(4)}", "v", 4), "s": full_sql(f"sum(v) OVER {wn(4)}", "v", 4)},
    lambda: {"m": ts.ts_mean("v", 4), "s": ts.ts_sum("v", 4)})
two("T4", {"std": full_sql(f"stddev_samp(v) OVER {wn(5)}", "v", 5),
           "var": full_sql(f"var_samp(v) OVER {wn(5)}", "v", 5),
           "pop": full_sql(f"stddev_pop(v) OVER {wn(5)}", "v", 5)},
    lambda: {"std": ts.ts_std("v", 5), "var": ts.ts_var("v", 5), "pop": ts.ts_std_pop("v", 5)}, 3)
two("T5", {"lo": full_sql(f"min(v) OVER {wn(4)}", "v", 4), "hi": full_sql(f"max(v) OVER {wn(4)}", "v", 4)},
    lambda: {"lo": ts.ts_min("v", 4), "hi": ts.ts_max("v", 4)})
rolling("T6", f"last_value(v IGNORE NULLS) OVER {wn(3)}", lambda: ts.ts_backfill("v", 2))
rolling("T7", full_sql(f"median(v) OVER {wn(4)}", "v", 4), lambda: ts.ts_median("v", 4))
rolling("T8", full_sql("(" + " + ".join(
            f"abs(lag(v, {k}) OVER {WC} - avg(v) OVER {wn(4)})" for k in range(4)) + ") / 4", "v", 4),
        lambda: ts.ts_mad("v", 4))
rolling("T9", full_sql(f"product(v / 1000) OVER {wn(4)}", "v", 4),
        lambda: ts.ts_product(F.col("v") / 1000, 4))
LAGS5 = [f"lag(q, {k}) OVER {WC}" for k in range(1, 5)]
# Rounded prices give ties inside the window.
TIED = f"{P}, g AS (SELECT *, CASE WHEN Ifsuspend = 0 THEN round(volume / 20) END AS q FROM pw)"
TS_RANK = full_sql("(" + " + ".join(f"({l} < q)::INT + ({l} = q)::INT / 2.0" for l in LAGS5) + " + 1)::DOUBLE / 5", "q", 5)


def tied(spark, sf):
    return panel(spark, sf).withColumn(
        "q", F.when(F.col("Ifsuspend") == 0, F.round(F.col("volume") / 20)))


rolling("T10", TS_RANK, lambda: ts.ts_rank("q", 5), source=TIED, load=tied)


@query("T11", f"""{TIED}, k AS (SELECT *, {TS_RANK} AS k0 FROM g),
 c AS (SELECT *, CASE WHEN k0 IS NOT NULL THEN greatest(least(k0, 1 - 1e-6), 1e-6) END AS k FROM k)
 SELECT date, code, {rd(probit_sql('k'))} AS gaussian, {rd('k - 0.5')} AS uniform FROM c""")
def t11(spark, sf):
    return out(tied(spark, sf), *KEYS, gaussian=ts.ts_quantile("q", 5),
               uniform=ts.ts_quantile("q", 5, "uniform"))


rolling("T12", full_sql(f"(v - min(v) OVER {wn(4)}) / nullif(max(v) OVER {wn(4)} - min(v) OVER {wn(4)}, 0)", "v", 4),
        lambda: ts.ts_scale("v", 4))
rolling("T13", full_sql(f"(v - avg(v) OVER {wn(4)}) / nullif(stddev_samp(v) OVER {wn(4)}, 0)", "v", 4),
        lambda: ts.ts_zscore("v", 4))
rolling("T14", full_sql(f"v - avg(v) OVER {wn(4)}", "v", 4), lambda: ts.ts_av_diff("v", 4))


def _arg_sql(cmp):
    """Rows since the first extreme: the furthest lag that no entry beats."""
    lags = ["q"] + LAGS5
    cases = []
    for k in range(4, -1, -1):
        beats = " AND ".join(f"{lags[k]} {cmp} {lags[j]}" for j in range(5) if j != k)
        cases.append(f"WHEN {beats} THEN {k}.0")
    return full_sql("CASE " + " ".join(cases) + " END", "q", 5)


@query("T15", f"{TIED} SELECT date, code, {rd(_arg_sql('>='))} AS hi, {rd(_arg_sql('<='))} AS lo FROM g")
def t15(spark, sf):
    return out(tied(spark, sf), *KEYS, hi=ts.ts_arg_max("q", 5), lo=ts.ts_arg_min("q", 5))


rolling("T16", full_sql(f"covar_samp(v, CASE WHEN v IS NOT NULL THEN volume END) OVER {wn(5)}", "v", 5),
        lambda: ts.ts_covariance("v", "volume", 5), 2)
rolling("T17", full_sql(f"covar_pop(v, volume) OVER {wn(5)} / nullif(stddev_pop(v) OVER {wn(5)} * stddev_pop(CASE WHEN v IS NOT NULL THEN volume END) OVER {wn(5)}, 0)", "v", 5),
        lambda: ts.ts_corr("v", "volume", 5))
rolling("T18", full_sql(f"covar_samp(v, volume) OVER {wn(5)} / nullif(var_samp(volume) OVER {wn(5)}, 0)", "v", 5),
        lambda: ts.ts_regression("v", "volume", 5), 3)


def _weighted_sql(weights):
    n, total = len(weights), sum(weights)
    return " + ".join(f"lag(v, {n - 1 - i}) OVER {WC} * {w / total!r}::DOUBLE" for i, w in enumerate(weights))


rolling("T19", _weighted_sql([1.0, 2.0, 3.0, 4.0]), lambda: ts.ts_decay_linear("v", 4))
two("T20", {"from_zero": _weighted_sql([0.0, 1.0, 2.0, 3.0]), "from_one": _weighted_sql([1.0, 2.0, 3.0, 4.0])},
    lambda: {"from_zero": ts.ts_wma("v", 4), "from_one": ts.ts_wma("v", 4, first=1)})
rolling("T21", _weighted_sql([0.6 ** k for k in (4, 3, 2, 1)]), lambda: ts.ts_ema("v", 4))
rolling("T22", full_sql(f"lag(v, 2) OVER {WC}", "v", 4), lambda: ts.kth_element("v", 4, 3))
rolling("T23", full_sql("coalesce(" + ", ".join(f"CASE WHEN {l} <> q THEN {l} END" for l in LAGS5) + ")", "q", 5),
        lambda: ts.last_diff_value("q", 5), source=TIED, load=tied)
rolling("T24", f"CASE WHEN row_number() OVER {WC} >= 4 THEN count(*) FILTER (v IS NULL) OVER {wn(4)} END",
        lambda: ts.ts_count_nans("v", 4))
rolling("T25", f"row_number() OVER {WC} - 1", ts.ts_step)

DAYS = f"""{P}, ret AS (SELECT *, coalesce(close / nullif(lag(close) OVER {WC}, 0) - 1, 0) AS ret FROM pw),
 days0 AS (SELECT date, avg(ret) AS market_return, stddev_pop(ret) AS cross_section_dispersion,
  avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS up_ratio FROM ret GROUP BY date),
 days AS (SELECT *, coalesce(CASE WHEN count(*) OVER w >= 2 THEN stddev_pop(market_return) OVER w END, 0) AS market_volatility
  FROM days0 WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


@query("A3", f"""{DAYS} SELECT date, {rd('market_return')} AS market_return,
 {rd('cross_section_dispersion')} AS cross_section_dispersion, {rd('up_ratio')} AS up_ratio FROM days""")
def a3(spark, sf):
    return out(ft.market_features(panel(spark, sf)), "date", market_return="market_return",
               cross_section_dispersion="cross_section_dispersion", up_ratio="up_ratio")


@query("T26", f"{DAYS} SELECT date, {rd('market_volatility')} AS market_volatility FROM days")
def t26(spark, sf):
    days = ft.market_volatility(ft.market_features(panel(spark, sf)))
    return out(days, "date", market_volatility="market_volatility")


NAV = f"""{P}, ret AS (SELECT date, code, CASE WHEN close > 0 THEN (high - low) / close * 0.01 - 0.004 END AS ret FROM pw),
 nav AS (SELECT date, code, product(1 + coalesce(ret, 0)) OVER w AS nav FROM ret
  WINDOW w AS (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING))"""


def nav(spark, sf):
    from ..operators.portfolio import equity
    df = panel(spark, sf).select(*KEYS, ((F.col("high") - F.col("low")) / F.col("close") * 0.01 - 0.004).alias("ret"))
    return equity(df, "ret", by=("code",))


@query("T27", f"""{NAV} SELECT date, code, {rd('nav / max(nav) OVER w - 1')} AS drawdown FROM nav
 WINDOW w AS (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def t27(spark, sf):
    return out(nav(spark, sf), *KEYS, drawdown="drawdown")


@query("T28", f"{NAV} SELECT date, code, {rd('nav')} AS equity FROM nav")
def t28(spark, sf):
    return out(nav(spark, sf), *KEYS, equity="equity")


rolling("T29", f"lead(v, 4) OVER {WC} / nullif(v, 0) - 1", lambda: ts.forward_return("v", 4))

# Configured evaluation segments (name, first day, last day).
SEGMENTS = (("F", "1996-01-01", "1998-12-31"), ("E", "1999-01-01", "1999-12-31"),
            ("V", "2000-01-01", "2000-12-31"), ("T", "2001-01-01", "2001-12-31"))
SEG_SQL = "seg(segment, start, stop) AS (VALUES " + ", ".join(
    f"('{s}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for s, a, b in SEGMENTS) + ")"


def segments(spark):
    return spark.createDataFrame([*SEGMENTS], "segment string, start string, stop string").select(
        "segment", F.col("start").cast("timestamp"), F.col("stop").cast("timestamp"))


LABEL = f"""{P}, {SEG_SQL}, cal AS (SELECT date, row_number() OVER w AS session, lead(date) OVER w AS buy,
   lead(date, 5) OVER w AS sell FROM (SELECT DISTINCT date FROM pw) WINDOW w AS (ORDER BY date)),
 inside AS (SELECT date FROM cal JOIN seg ON date BETWEEN start AND stop WHERE buy >= start AND sell <= stop),
 lab AS (SELECT pw.*, c.session, CASE WHEN pw.date IN (SELECT date FROM inside) THEN b.open / nullif(a.open, 0) - 1 END AS label
  FROM pw JOIN cal c USING (date) LEFT JOIN pw a ON a.code = pw.code AND a.date = c.buy
  LEFT JOIN pw b ON b.code = pw.code AND b.date = c.sell)"""


@query("T30", f"{LABEL} SELECT date, code, session, {rd('label')} AS label FROM lab")
def t30(spark, sf):
    df = joins.segment_label(panel(spark, sf), segments(spark), 4)
    return df.select(*KEYS, F.col("session").cast("bigint").alias("session"), r("label").alias("label"))


def _feature_sql():
    def guard(a, b):
        return f"({a}) / CASE WHEN abs({b}) > 1e-12 THEN {b} END"
    f = {n: n for n in ft.RAW}
    for w in ft.RETURNS:
        f[f"return_{w}"] = guard("close", f"lag(close, {w}) OVER {WC}") + " - 1"
    for w in ft.WINDOWS:
        f[f"volatility_{w}"] = full_sql(f"stddev_pop(r1) OVER {wn(w)}", "r1", w)
        for name, x in (("volume_ratio", "volume"), ("ma_gap", "close")):
            f[f"{name}_{w}"] = guard(x, f"({full_sql(f'avg({x}) OVER {wn(w)}', x, w)})") + " - 1"
    f["intraday_return"] = guard("close", "open") + " - 1"
    f["overnight_gap"] = guard("open", f"lag(close) OVER {WC}") + " - 1"
    f["range_relative"] = guard("high - low", f"lag(close) OVER {WC}")
    f["close_location"] = guard("2 * close - high - low", "(high - low)")
    return f


@query("T31", f"{P}, a AS (SELECT *, close / lag(close) OVER {WC} - 1 AS r1 FROM pw) SELECT date, code, "
       + ", ".join(f"{rd(s, 4)} AS {n}" for n, s in _feature_sql().items()) + " FROM a")
def t31(spark, sf):
    return out(panel(spark, sf), *KEYS, digits=4, **ft.causal_features())


@query("T32", f"{P} SELECT date, code, close FROM pw WHERE date IN (SELECT DISTINCT date FROM pw WHERE date <= '2001-06-04' ORDER BY date DESC LIMIT 21)")
def t32(spark, sf):
    return weekly_panel(spark, sf).last_sessions("2001-06-04", 21).select(*KEYS, "close")


@query("E1", f"""{TIED}, m AS (SELECT *, CASE WHEN row_number() OVER {WC} = 1 OR q IS DISTINCT FROM lag(q) OVER {WC} THEN 1 ELSE 0 END AS moved FROM g),
 i AS (SELECT *, sum(moved) OVER {WC} AS island FROM m)
 SELECT date, code, (row_number() OVER (PARTITION BY code, island ORDER BY date) - 1)::DOUBLE AS z FROM i""")
def e1(spark, sf):
    return stateful.days_from_last_change(tied(spark, sf), "q", "z").select(*KEYS, "z")


@query("E2", f"""WITH RECURSIVE {PW}, n AS (SELECT date, code, CASE WHEN Ifsuspend = 0 THEN close END AS v, row_number() OVER {WC} AS i FROM pw),
 h AS (SELECT code, i, date, v AS h FROM n WHERE i = 1 UNION ALL
  SELECT n.code, n.i, n.date, CASE WHEN h.h IS NULL OR n.v IS NULL THEN n.v ELSE h.h + greatest(least(n.v - h.h, 150), -150) END
  FROM h JOIN n ON n.code = h.code AND n.i = h.i + 1)
 SELECT date, code, {rd('h')} AS z FROM h""")
def e2(spark, sf):
    return out(stateful.hump(gaps(spark, sf), "v", "z", 150.0), *KEYS, z="z")


@query("E3", f"""{P}, s AS (SELECT *, close - open > 0 AS enter, volume > 60 AS leave FROM pw),
 k AS (SELECT *, CASE WHEN leave OR enter THEN date END AS mark FROM s),
 l AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) AS at FROM k)
 SELECT l.date, l.code, {rd('CASE WHEN NOT k.leave THEN k.high END')} AS z FROM l LEFT JOIN k ON k.code = l.code AND k.date = l.at""")
def e3(spark, sf):
    hold = ts.trade_when(F.col("close") - F.col("open"), "high", F.col("volume") - 60)
    return out(panel(spark, sf), *KEYS, z=hold)
