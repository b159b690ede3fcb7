"""Shared pieces of the registered queries and of their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.clean import c

KEYS = ("date", "code")

# The weekly panel in SQL. Joins, masks and operators below build on it as ``pw``.
PW = """
pw0 AS (
 SELECT date_trunc('week', l_shipdate)::TIMESTAMP AS date, l_suppkey AS sk,
  arg_min(l_extendedprice/l_quantity, row(l_shipdate,l_orderkey,l_linenumber,l_partkey,l_extendedprice)) AS open,
  arg_max(l_extendedprice/l_quantity, row(l_shipdate,l_orderkey,l_linenumber,l_partkey,l_extendedprice)) AS close,
  max(l_extendedprice/l_quantity) AS high, min(l_extendedprice/l_quantity) AS low,
  sum(l_quantity) AS volume, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS amount,
  arg_max(CASE WHEN l_returnflag='R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, row(l_shipdate,l_orderkey,l_linenumber,l_partkey,l_extendedprice)) AS Ifsuspend,
  arg_max(l_linestatus, row(l_shipdate,l_orderkey,l_linenumber,l_partkey,l_extendedprice)) AS category,
  min(l_shipdate) AS fs
 FROM lineitem GROUP BY 1, 2),
pw AS (
 SELECT date, lpad(sk::VARCHAR, 6, '0') AS code, open, close, high, low, volume, amount, Ifsuspend, category,
  min(fs) OVER (PARTITION BY sk)::TIMESTAMP AS ListedDate, s_nationkey::INT AS industry, n_regionkey::INT AS sector
 FROM pw0 JOIN supplier ON s_suppkey = sk JOIN nation ON n_nationkey = s_nationkey)"""

PD = """
pd AS (
 SELECT date_trunc('day', ts)::TIMESTAMP AS date, lpad(user_id::VARCHAR, 6, '0') AS code,
  arg_min(value, row(ts, event_id)) AS open, arg_max(value, row(ts, event_id)) AS close,
  max(value) AS high, min(value) AS low, count(*)::DOUBLE AS volume, sum(value::DECIMAL(18,2))::DOUBLE AS amount,
  max(CASE WHEN event_type='error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS Ifsuspend,
  max(CASE WHEN event_type='purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS if_up,
  max(CASE WHEN event_type='signup' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS if_down
 FROM events GROUP BY 1, 2)"""

WC = "(PARTITION BY code ORDER BY date)"


def wn(n: int) -> str:
    """SQL window of the last n rows of a code."""
    return f"(PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full_sql(expr: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {wn(n)} = {n} THEN {expr} END"


# Results are compared on a grid of 10^-digits. The offset keeps the cell borders away
# from short decimals, so two engines that add in another order land in the same cell.
GRID_OFFSET = 0.4142135


def rd(expr: str, digits: int = 6) -> str:
    return f"(floor(({expr})::DOUBLE * 1e{digits} + {GRID_OFFSET}) / 1e{digits})"


def rank_sql(x: str, by: str = "date", pct: bool = True) -> str:
    """SQL percentile rank with ties averaged over non-NULL values."""
    place = (f"(rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST)"
             f" + (count({x}) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)::DOUBLE")
    value = f"{place} / count({x}) OVER (PARTITION BY {by})" if pct else place
    return f"CASE WHEN {x} IS NOT NULL THEN {value} END"


def r(x, digits: int = 6) -> Column:
    unit = F.lit(float(10 ** digits))
    return F.floor(c(x).cast("double") * unit + F.lit(GRID_OFFSET)).cast("double") / unit


def out(df, *keys, digits: int = 6, **cols):
    """Select keys and rounded result columns."""
    return df.select(*keys, *[r(v, digits).alias(k) for k, v in cols.items()])
