"""Weight-based portfolio return accounting; any number of strategies at a time.

Positions are top-k rows per strategy and date, far fewer than panel rows; the panel is
touched twice, by equi-joins on (date, code).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clean import c, ratio
from ..session import cut
from . import joins

YEAR_DAYS = 252.0
BY = ("strategy_id",)


def line(by, date="date"):
    """All rows of a strategy so far: one per session."""
    return Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)


def equity(daily: DataFrame, ret: str, by=BY) -> DataFrame:
    """Compounded equity and drawdown; one row per session and strategy."""
    w = line(by)
    df = daily.withColumn("equity", F.product(1.0 + F.coalesce(c(ret), F.lit(0.0))).over(w))
    return df.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1.0)


def best_signals(signals: DataFrame, k: int, by=BY) -> DataFrame:
    """Top k scores per strategy and date. A date without any score keeps placeholder
    rows, because it still is an execution (of an empty portfolio)."""
    w = Window.partitionBy(*by, "date").orderBy(F.col("score").desc_nulls_last(), F.col("code"))
    return (signals.select(*by, "date", "code", "score").withColumn("_n", F.row_number().over(w))
            .filter(F.col("_n") <= k).drop("_n"))


def executions(best: DataFrame, panel: DataFrame, by=BY) -> DataFrame:
    """Signal dates with the session they execute on and the previous execution date
    (the signal date itself for the first): one row per strategy and session."""
    moved = joins.next_session(best.select(*by, "date").distinct(), joins.calendar(panel))
    w = Window.partitionBy(*by).orderBy("date")
    return moved.withColumns({"prev": F.coalesce(F.lag("date").over(w), F.col("signal_date")),
                              "next": F.lead("date").over(w)})


def target_weights(best: DataFrame, runs: DataFrame, panel: DataFrame, by=BY,
                   price: str = "close", cap: float | None = None) -> DataFrame:
    """Equal weights of the top k that can trade at execution, renormalized to 1
    (or capped per name)."""
    picks = best.filter("score IS NOT NULL").select(*by, F.col("date").alias("signal_date"), "code")
    market = panel.filter(F.coalesce(F.col("Ifsuspend"), F.lit(0.0)) == 0).select(
        "date", "code", F.col(price).alias("px"))
    held = picks.join(runs, [*by, "signal_date"]).join(market, ["date", "code"])
    weight = F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(*by, "date"))
    return held.withColumn("weight", weight if cap is None else F.least(weight, F.lit(cap)))


def position_returns(positions: DataFrame, panel: DataFrame, price: str = "close") -> DataFrame:
    """Return of each position since the previous execution date; without an earlier
    price it is 0."""
    old = panel.select(F.col("date").alias("prev"), "code", F.col(price).alias("old_px"))
    return positions.join(old, ["prev", "code"], "left").withColumn(
        "ret", F.coalesce(ratio("px", "old_px") - 1.0, F.lit(0.0)))


def daily_flows(returns: DataFrame, by=BY) -> DataFrame:
    """Gross return, holdings and turnover per strategy and date.

    Each position counts on its own date and, with opposite sign, on the next execution
    date; the absolute net change per name sums to the turnover. No self-join.
    """
    weight = F.col("weight")
    arrive = F.struct(F.col("date"), weight.alias("w"), (weight * F.col("ret")).alias("gain"), F.lit(1).alias("held"))
    leave = F.struct(F.col("next").alias("date"), (-weight).alias("w"), F.lit(0.0).alias("gain"), F.lit(0).alias("held"))
    moves = returns.select(*by, "code", F.explode(F.array(arrive, leave)).alias("m")).select(
        *by, "code", "m.*").filter("date IS NOT NULL")
    names = moves.groupBy(*by, "date", "code").agg(
        F.sum("w").alias("w"), F.sum("gain").alias("gain"), F.sum("held").alias("held"))
    return names.groupBy(*by, "date").agg(
        F.sum("gain").alias("gross_return"), F.sum("held").alias("holding_count"), F.sum(F.abs("w")).alias("turnover"))


def account(signals: DataFrame, panel: DataFrame, k: int, fee: float, by=BY,
            price: str = "close") -> DataFrame:
    """Daily gross and net return, turnover, cost, holdings, equity and drawdown."""
    best = cut(best_signals(signals, k, by), "best")    # small; read twice below
    runs = executions(best, panel, by)
    flows = daily_flows(position_returns(target_weights(best, runs, panel, by, price), panel, price), by)
    daily = runs.join(flows, [*by, "date"], "left").select(*by, "date", "signal_date", *[
        F.coalesce(x, F.lit(0.0)).alias(x) for x in ("gross_return", "turnover")],
        F.coalesce("holding_count", F.lit(0)).cast("bigint").alias("holding_count"))
    daily = daily.withColumn("cost", F.col("turnover") * F.lit(float(fee)))
    daily = daily.withColumn("net_return", F.col("gross_return") - F.col("cost"))
    return equity(daily, "net_return", by)


def annualized(total_growth: Column, periods: Column) -> Column:
    """Growth per year; NULL after ruin."""
    return F.when(total_growth > 0, F.pow(total_growth, F.lit(YEAR_DAYS) / periods) - 1.0)


def sharpe(x) -> Column:
    return F.when(F.count(c(x)) >= 2, ratio(F.avg(c(x)), F.stddev_samp(c(x))) * F.sqrt(F.lit(YEAR_DAYS)))


def summary(daily: DataFrame, by=BY) -> DataFrame:
    """Performance summary per strategy."""
    n = F.count(F.lit(1))
    growth = F.max_by("equity", "date")
    out = daily.groupBy(*by).agg(
        (growth - 1.0).alias("total_return"), annualized(growth, n).alias("annual_return"),
        sharpe("net_return").alias("sharpe"), F.min("drawdown").alias("max_drawdown"),
        F.avg(F.when(F.col("net_return") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.avg("turnover").alias("average_turnover"), F.sum("cost").alias("total_cost"),
        (F.avg("cost") * YEAR_DAYS).alias("annual_cost"),
        F.count_if(F.col("turnover") > 0).alias("number_of_trades"),
        F.avg("holding_count").alias("average_holding_count"))
    return out.withColumn("calmar", F.when(
        F.col("max_drawdown") < 0, F.col("annual_return") / F.abs("max_drawdown")))


def yearly(daily: DataFrame, by=BY) -> DataFrame:
    """Metrics per calendar year; the drawdown restarts each year."""
    keys = [*by, "year"]
    years = equity(daily.drop("equity", "drawdown").withColumn("year", F.year("date")), "net_return", keys)
    return years.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sessions"), (F.max_by("equity", "date") - 1.0).alias("year_return"),
        sharpe("net_return").alias("sharpe"), F.min("drawdown").alias("max_drawdown"),
        F.avg("turnover").alias("turnover"), F.sum("cost").alias("cost"),
        F.avg(F.when(F.col("net_return") > 0, 1.0).otherwise(0.0)).alias("win_rate"))


def growth_objective(r, risk: float = 1.0) -> Column:
    """Annualized log growth minus a variance penalty; NULL once a return is <= -1."""
    r = c(r)
    logs = F.when(r > -1, F.ln(1.0 + r))
    value = F.lit(YEAR_DAYS) * (F.avg(logs) - F.lit(risk) * F.var_pop(logs) / 2)
    return F.when(F.count_if(F.coalesce(r <= -1, F.lit(True))) == 0, value)


def risk_from_start(daily: DataFrame, by=BY) -> DataFrame:
    """Drawdown against a peak that includes the starting value, and log volatility."""
    w = line(by)
    peak = F.greatest(F.lit(1.0), F.max("equity").over(w))
    return daily.withColumn("_dd", F.col("equity") / peak - 1.0).groupBy(*by).agg(
        F.min("_dd").alias("max_drawdown"),
        (F.stddev_pop(F.ln(1.0 + F.col("net_return"))) * F.sqrt(F.lit(YEAR_DAYS))).alias("annual_volatility"))


def adjusted_return(close, previous_close, multiplier, dividend) -> Column:
    """Return of a share through splits and cash dividends."""
    return ratio(c(multiplier) * c(close) + c(dividend), previous_close) - 1.0


def group_statistics(runs: DataFrame, group: str, objective: str, failed: Column, budget: str) -> DataFrame:
    """Seed statistics per group: mean and population deviation of the objective."""
    return runs.groupBy(group).agg(
        F.count(F.lit(1)).alias("seeds"), F.avg(objective).alias("objective_mean"),
        F.stddev_pop(objective).alias("objective_std"),
        F.avg(F.when(failed, 1.0).otherwise(0.0)).alias("failure_rate"), F.avg(budget).alias("budget_mean"))
