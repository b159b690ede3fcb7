"""Portfolio accounting queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import timeseries as ts
from ..operators import evaluate as ev, portfolio as pf
from ..sources.panel import weekly_panel
from . import query
from .common import KEYS, PW, WC, out, rd
from .evaluation import FW, NAMES, wide

K, FEE = 10, 0.0015
# Prices of the simulated shares: an index level, so that returns stay small.
MK = "mk AS (SELECT date, code, Ifsuspend, 100 + ln(close) AS px FROM pw)"
ACC_COLS = ("gross_return", "turnover", "cost", "net_return", "equity", "drawdown")


def market(spark, sf):
    return weekly_panel(spark, sf).df.select(*KEYS, "Ifsuspend", (F.lit(100.0) + F.ln("close")).alias("close"))


def accounts_sql(k=K):
    """SQL accounting of a score table sg(strategy_id, date, code, score)."""
    return f"""{MK}, cal AS (SELECT date, lead(date) OVER (ORDER BY date) AS nd FROM (SELECT DISTINCT date FROM pw)),
 ex AS (SELECT strategy_id, date AS signal_date, nd AS date, coalesce(lag(nd) OVER w, date) AS prev, lead(nd) OVER w AS nxt
  FROM (SELECT DISTINCT strategy_id, date, nd FROM sg JOIN cal USING (date) WHERE nd IS NOT NULL) WINDOW w AS (PARTITION BY strategy_id ORDER BY nd)),
 tk AS (SELECT strategy_id, date AS signal_date, code FROM sg WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY strategy_id, date ORDER BY score DESC, code) <= {k}),
 pos AS (SELECT ex.strategy_id, ex.signal_date, ex.date, ex.prev, ex.nxt, tk.code, 1.0::DOUBLE / count(*) OVER (PARTITION BY ex.strategy_id, ex.date) AS weight, m.px
  FROM tk JOIN ex USING (strategy_id, signal_date) JOIN mk m ON m.date = ex.date AND m.code = tk.code WHERE m.Ifsuspend = 0),
 gr AS (SELECT strategy_id, pos.date, sum(weight * coalesce(pos.px / nullif(o.px, 0) - 1, 0)) AS gross_return, count(*) AS holding_count
  FROM pos LEFT JOIN mk o ON o.date = pos.prev AND o.code = pos.code GROUP BY 1, 2),
 mv AS (SELECT strategy_id, date, code, weight AS w FROM pos UNION ALL SELECT strategy_id, nxt, code, -weight FROM pos WHERE nxt IS NOT NULL),
 tv AS (SELECT strategy_id, date, sum(abs(w)) AS turnover FROM (SELECT strategy_id, date, code, sum(w) AS w FROM mv GROUP BY ALL) GROUP BY ALL),
 ac0 AS (SELECT ex.strategy_id, ex.date, ex.signal_date, coalesce(gross_return, 0) AS gross_return, coalesce(turnover, 0) AS turnover, coalesce(holding_count, 0) AS holding_count
  FROM ex LEFT JOIN gr ON gr.strategy_id = ex.strategy_id AND gr.date = ex.date LEFT JOIN tv ON tv.strategy_id = ex.strategy_id AND tv.date = ex.date),
 ac1 AS (SELECT *, turnover * {FEE} AS cost, gross_return - turnover * {FEE} AS net_return FROM ac0),
 ac2 AS (SELECT *, product(1 + net_return) OVER (PARTITION BY strategy_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM ac1),
 ac AS (SELECT *, equity / max(equity) OVER (PARTITION BY strategy_id ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM ac2)"""


SG = "sg AS (SELECT 'mom4' AS strategy_id, date, code, mom4 AS score FROM fw)"
AC = f"WITH {FW}, {SG}, {accounts_sql()}"
MULTI = "sg AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in NAMES) + "]) AS strategy_id, date, code, unnest([" + ", ".join(NAMES) + "]) AS score FROM fw)"
ACM = f"WITH {FW}, {MULTI}, {accounts_sql()}"


def signals(spark, sf):
    df = wide(spark, sf)
    return df.select(F.lit("mom4").alias("strategy_id"), *KEYS, F.col("mom4").alias("score"))


def all_signals(spark, sf):
    df = wide(spark, sf)
    return ev.unpivot(df, NAMES, value="score").withColumnRenamed("factor_id", "strategy_id")


def accounts(spark, sf):
    return pf.account(signals(spark, sf), market(spark, sf), K, FEE)


def positions(spark, sf, cap=None):
    m, best = market(spark, sf), pf.best_signals(signals(spark, sf), K)
    return pf.target_weights(best, pf.executions(best, m), m, cap=cap)


def flows(spark, sf):
    return pf.daily_flows(pf.position_returns(positions(spark, sf), market(spark, sf)))


@query("R1", f"{AC} SELECT strategy_id, signal_date, date, code, {rd('weight')} AS weight FROM pos")
def r1(spark, sf):
    return out(positions(spark, sf), "strategy_id", "signal_date", *KEYS, weight="weight")


@query("R2", f"{AC} SELECT strategy_id, date, code, {rd('least(weight, 0.12)')} AS weight FROM pos")
def r2(spark, sf):
    return out(positions(spark, sf, cap=0.12), "strategy_id", *KEYS, weight="weight")


@query("R3", f"{AC} SELECT strategy_id, date, holding_count, {rd('gross_return')} AS gross_return FROM gr")
def r3(spark, sf):
    return out(flows(spark, sf).filter("holding_count > 0"), "strategy_id", "date", "holding_count", gross_return="gross_return")


@query("J11", f"{AC} SELECT strategy_id, date, {rd('turnover')} AS turnover FROM tv")
def j11(spark, sf):
    return out(flows(spark, sf), "strategy_id", "date", turnover="turnover")


def _ac(names):
    return ", ".join(f"{rd(n)} AS {n}" for n in names)


@query("R4", f"{AC} SELECT strategy_id, date, signal_date, holding_count, {_ac(ACC_COLS[:4])} FROM ac")
def r4(spark, sf):
    return out(accounts(spark, sf), "strategy_id", "date", "signal_date", "holding_count", **{n: n for n in ACC_COLS[:4]})


@query("R5", f"{AC} SELECT strategy_id, date, {_ac(ACC_COLS[4:])} FROM ac")
def r5(spark, sf):
    return out(accounts(spark, sf), "strategy_id", "date", **{n: n for n in ACC_COLS[4:]})


SUM_SQL = f"""sm AS (SELECT strategy_id, arg_max(equity, date) AS g, count(*) AS n, avg(net_return) / nullif(stddev_samp(net_return), 0) * sqrt(252.0::DOUBLE) AS sharpe, min(drawdown) AS max_drawdown,
 avg(CASE WHEN net_return > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS win_rate, avg(turnover) AS average_turnover, sum(cost) AS total_cost, avg(cost) * 252 AS annual_cost,
 count(*) FILTER (turnover > 0) AS number_of_trades, avg(holding_count) AS average_holding_count FROM ac GROUP BY strategy_id),
 su AS (SELECT *, g - 1 AS total_return, CASE WHEN g > 0 THEN pow(g, 252.0::DOUBLE / n) - 1 END AS annual_return FROM sm)"""
SUM_COLS = ("total_return", "annual_return", "sharpe", "max_drawdown", "win_rate", "average_turnover", "total_cost", "annual_cost", "average_holding_count")
SUM_OUT = f"strategy_id, number_of_trades, {_ac(SUM_COLS)}, {rd('CASE WHEN max_drawdown < 0 THEN annual_return / abs(max_drawdown) END')} AS calmar"


@query("R6", f"{AC}, {SUM_SQL} SELECT {SUM_OUT} FROM su")
def r6(spark, sf):
    return out(pf.summary(accounts(spark, sf)), "strategy_id", "number_of_trades", calmar="calmar", **{n: n for n in SUM_COLS})


YEAR_SQL = """yr0 AS (SELECT *, year(date)::INT AS yr, product(1 + net_return) OVER (PARTITION BY strategy_id, year(date) ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM ac),
 yr AS (SELECT *, e / max(e) OVER (PARTITION BY strategy_id, yr ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS d FROM yr0)"""


@query("R7", f"""{AC}, {YEAR_SQL} SELECT strategy_id, yr AS year, count(*) AS sessions, {rd('arg_max(e, date) - 1')} AS year_return,
 {rd('CASE WHEN count(*) >= 2 THEN avg(net_return) / nullif(stddev_samp(net_return), 0) * sqrt(252.0::DOUBLE) END')} AS sharpe, {rd('min(d)')} AS max_drawdown,
 {rd('avg(turnover)')} AS turnover, {rd('sum(cost)')} AS cost, {rd('avg(CASE WHEN net_return > 0 THEN 1.0::DOUBLE ELSE 0.0 END)')} AS win_rate FROM yr GROUP BY strategy_id, yr""")
def r7(spark, sf):
    return out(pf.yearly(accounts(spark, sf)), "strategy_id", "year", "sessions",
               **{n: n for n in ("year_return", "sharpe", "max_drawdown", "turnover", "cost", "win_rate")})


@query("A10", f"{ACM}, {YEAR_SQL} SELECT strategy_id, yr AS year, {rd('arg_max(e, date) - 1')} AS year_return, {rd('min(d)')} AS max_drawdown, {rd('sum(cost)')} AS cost FROM yr GROUP BY strategy_id, yr")
def a10(spark, sf):
    daily = pf.account(all_signals(spark, sf), market(spark, sf), K, FEE)
    return out(pf.yearly(daily), "strategy_id", "year", year_return="year_return", max_drawdown="max_drawdown", cost="cost")


OBJ = "CASE WHEN count(*) FILTER (coalesce(net_return <= -1, true)) = 0 THEN 252 * (avg(ln(1 + net_return)) - var_pop(ln(1 + net_return)) / 2) END"


@query("R8", f"{ACM} SELECT strategy_id, {rd(OBJ)} AS objective FROM ac GROUP BY strategy_id")
def r8(spark, sf):
    daily = pf.account(all_signals(spark, sf), market(spark, sf), K, FEE)
    return out(daily.groupBy("strategy_id").agg(pf.growth_objective("net_return").alias("objective")), "strategy_id", objective="objective")


@query("R9", f"""{AC}, d AS (SELECT *, equity / greatest(1, max(equity) OVER (PARTITION BY strategy_id ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM ac)
 SELECT strategy_id, {rd('min(dd)')} AS max_drawdown, {rd('stddev_pop(ln(1 + net_return)) * sqrt(252.0::DOUBLE)')} AS annual_volatility FROM d GROUP BY strategy_id""")
def r9(spark, sf):
    return out(pf.risk_from_start(accounts(spark, sf)), "strategy_id", max_drawdown="max_drawdown", annual_volatility="annual_volatility")


@query("R10", f"{ACM}, {SUM_SQL} SELECT {SUM_OUT} FROM su")
def r10(spark, sf):
    daily = pf.account(all_signals(spark, sf), market(spark, sf), K, FEE)
    return out(pf.summary(daily), "strategy_id", "number_of_trades", calmar="calmar", **{n: n for n in SUM_COLS})


@query("R11", f"""WITH {PW} SELECT date, code, {rd(f"(CASE WHEN volume > 60 THEN 2.0 ELSE 1.0 END * close + CASE WHEN volume < 10 THEN 5.0 ELSE 0.0 END) / nullif(lag(close) OVER {WC}, 0) - 1")} AS adjusted FROM pw""")
def r11(spark, sf):
    split = F.when(F.col("volume") > 60, 2.0).otherwise(1.0)
    cash = F.when(F.col("volume") < 10, 5.0).otherwise(0.0)
    value = pf.adjusted_return("close", ts.delay("close", 1), split, cash)
    return out(weekly_panel(spark, sf).df, *KEYS, adjusted=value)


@query("R12", f"""{ACM}, o AS (SELECT strategy_id, {OBJ} AS objective FROM ac GROUP BY strategy_id), b AS (SELECT objective AS base FROM o WHERE strategy_id = 'mom4')
 SELECT strategy_id, {rd('objective - base')} AS delta, {rd('tanh((objective - base) / 0.5)')} AS reward, objective > base + 0.01 AS accepted FROM o, b WHERE strategy_id <> 'mom4'""")
def r12(spark, sf):
    from ..functions.scalar import paired_delta, paired_reward
    daily = pf.account(all_signals(spark, sf), market(spark, sf), K, FEE)
    o = daily.groupBy("strategy_id").agg(pf.growth_objective("net_return").alias("objective"))
    # One row per strategy: the baseline comes from a window over that short table.
    base = F.max(F.when(F.col("strategy_id") == "mom4", F.col("objective"))).over(Window.partitionBy())
    o = o.withColumn("delta", paired_delta("objective", base, 0.0, 0.0, 0.0))
    return out(o.filter("strategy_id <> 'mom4'").withColumn("accepted", F.col("delta") > 0.01),
               "strategy_id", "accepted", delta="delta", reward=paired_reward("delta", F.lit(True), 0.5))


@query("A9", f"""{ACM}, {YEAR_SQL}, runs AS (SELECT strategy_id, yr, arg_max(e, date) - 1 AS objective, sum(turnover) AS budget FROM yr GROUP BY ALL)
 SELECT strategy_id AS grp, count(*) AS seeds, {rd('avg(objective)')} AS objective_mean, {rd('stddev_pop(objective)')} AS objective_std,
 {rd('avg(CASE WHEN objective < 0 THEN 1.0::DOUBLE ELSE 0.0 END)')} AS failure_rate, {rd('avg(budget)')} AS budget_mean FROM runs GROUP BY 1""")
def a9(spark, sf):
    daily = pf.account(all_signals(spark, sf), market(spark, sf), K, FEE)
    runs = pf.yearly(daily).select(F.col("strategy_id").alias("grp"), F.col("year_return").alias("objective"),
                                   (F.col("turnover") * F.col("sessions")).alias("budget"))
    got = pf.group_statistics(runs, "grp", "objective", F.col("objective") < 0, "budget")
    return out(got, "grp", "seeds", **{n: n for n in ("objective_mean", "objective_std", "failure_rate", "budget_mean")})
