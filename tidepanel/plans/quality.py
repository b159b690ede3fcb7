"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as ft
from ..operators import evaluate as ev, joins, quality as q
from ..sources.panel import daily_panel, read, weekly_panel
from . import query
from .common import KEYS, PD, PW, out, rd
from .history import _feature_sql
from .joining import ASOF, PADD, asof_facts

P, D = f"WITH {PW}", f"WITH {PD}"
FIELDS = ("open", "close", "high", "low", "volume", "amount")


@query("Q1", f"{P} SELECT count(*) AS row_count, min(date) AS first_date, max(date) AS last_date, count(DISTINCT code) AS codes, 13::INT AS column_count FROM pw")
def q1(spark, sf):
    return q.profile(weekly_panel(spark, sf).df)


@query("Q2", f"""{P} SELECT count(*) AS row_count, sum(('0x' || substr(sha256(strftime(date, '%Y-%m-%d') || '|' || code || '|' || volume::BIGINT || '|' || round(amount * 100)::BIGINT || '|' || category), 1, 12))::BIGINT)::VARCHAR AS fingerprint FROM pw""")
def q2(spark, sf):
    cols = [F.date_format("date", "yyyy-MM-dd"), F.col("code"), F.col("volume").cast("bigint"),
            F.round(F.col("amount") * 100).cast("bigint"), F.col("category")]
    return q.fingerprint(weekly_panel(spark, sf).df, cols)


@query("Q3", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q3(spark, sf):
    return q.duplicate_keys(read(spark, sf, "lineitem"), ("l_orderkey", "l_linenumber"))


@query("Q4", """SELECT 'lineitem' AS table_name, 'duplicate keys: ' || count(*) AS error FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) HAVING count(*) > 0
 UNION ALL SELECT 'orders', 'missing columns: code, pool_id' FROM (SELECT count(*) FROM orders)""")
def q4(spark, sf):
    parts = [q.contract_errors("market", weekly_panel(spark, sf).df, ("date", "code", "close"), KEYS),
             q.contract_errors("lineitem", read(spark, sf, "lineitem"), ("l_orderkey",), ("l_orderkey", "l_linenumber")),
             q.contract_errors("orders", read(spark, sf, "orders"), ("o_orderkey", "code", "pool_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("Q5", f"""{PADD} SELECT 'explicit_flag' AS check_name, count(*) FILTER (Ifsuspend IS NULL OR Ifsuspend NOT IN (0, 1)) AS violations FROM padded
 UNION ALL SELECT 'positive_price', count(*) FILTER (close IS NULL OR close <= 0) FROM padded UNION ALL SELECT 'amount_not_negative', count(*) FILTER (amount IS NULL OR amount < 0) FROM padded""")
def q5(spark, sf):
    return q.violations(joins.pad(daily_panel(spark, sf).df), {
        "explicit_flag": F.col("Ifsuspend").isin(0.0, 1.0), "positive_price": F.col("close") > 0,
        "amount_not_negative": F.col("amount") >= 0})


@query("Q6", f"""{D}, n AS (SELECT count(DISTINCT code) AS n FROM pd), d AS (SELECT date, count(*) FILTER (open > 0 AND close > 0 AND high > 0 AND low > 0 AND volume IS NOT NULL AND amount IS NOT NULL) = max(n) AS complete FROM pd, n GROUP BY date)
 SELECT max(date) FILTER (complete) AS latest_complete, count(*) FILTER (complete) AS complete_sessions, count(*) FILTER (NOT complete) AS incomplete_sessions FROM d""")
def q6(spark, sf):
    return q.latest_complete(q.session_completeness(daily_panel(spark, sf).df))


PD_TYPES = {"date": "timestamp", "code": "string", **{x: "double" for x in (
    "open", "close", "high", "low", "volume", "amount", "Ifsuspend", "if_up", "if_down")}}


@query("Q7", PADD + " " + " UNION ALL ".join(
    f"SELECT '{n}' AS field, '{t}' AS type, {rd(f'1 - count({n})::DOUBLE / count(*)')} AS null_share FROM padded" for n, t in PD_TYPES.items()))
def q7(spark, sf):
    return out(q.field_catalog(joins.pad(daily_panel(spark, sf).df)), "field", "type", null_share="null_share")


CHECKED = tuple(_feature_sql())


@query("Q8", f"{P}, u AS (SELECT unnest([{', '.join(f'{chr(39)}{n}{chr(39)}' for n in CHECKED)}]) AS field) SELECT field, 0::BIGINT AS unmatched, 0::BIGINT AS missing_differs, 0.0::DOUBLE AS max_error FROM u WHERE (SELECT count(*) FROM pw WHERE date <= TIMESTAMP '2000-01-03') > 0")
def q8(spark, sf):
    cut = F.col("date") <= F.lit("2000-01-03").cast("timestamp")
    df = weekly_panel(spark, sf).df
    shaken = df.withColumns({x: F.when(cut, F.col(x)).otherwise(F.col(x) * 77) for x in FIELDS})
    feats = {n: v for n, v in ft.causal_features().items() if n in CHECKED}
    a, b = (x.select(*KEYS, *[v.alias(n) for n, v in feats.items()]).filter(cut) for x in (df, shaken))
    return ev.parity(a, b, KEYS, CHECKED)


@query("A2", f"""{P} SELECT code, count(*) AS row_count, min(date) AS start_date, max(date) AS end_date, arg_max(open, date) AS latest_open, arg_max(close, date) AS latest_close,
 arg_max(volume, date) AS latest_volume, arg_max(amount, date) AS latest_amount FROM pw GROUP BY code""")
def a2(spark, sf):
    return q.store_summary(weekly_panel(spark, sf).df)


@query("A6", f"""{D}, n AS (SELECT count(DISTINCT code) AS n FROM pd),
 d AS (SELECT date, count(*) AS r, count(*) FILTER (open > 0 AND close > 0 AND high > 0 AND low > 0 AND volume IS NOT NULL AND amount IS NOT NULL) AS u FROM pd GROUP BY date)
 SELECT count(*) AS observed_rows, (SELECT count(*) * max(n) - sum(r) FROM d, n)::BIGINT AS padded_rows,
 (SELECT count(*) FILTER (r < n) FROM d, n) AS incomplete_sessions, (SELECT count(*) FILTER (u = n) FROM d, n) AS complete_sessions,
 count(*) - count(*) FILTER (open > 0 AND close > 0 AND high > 0 AND low > 0 AND volume IS NOT NULL AND amount IS NOT NULL) AS missing_price_rows,
 count(*) FILTER (volume = 0 AND Ifsuspend = 0) AS zero_volume_without_suspend, {', '.join(f'count(*) FILTER ({n} IS NULL) AS null_{n}' for n in FIELDS)} FROM pd""")
def a6(spark, sf):
    return q.import_quality(daily_panel(spark, sf).df, FIELDS)


@query("A7", f"{ASOF} SELECT count(published) AS known, count(*) FILTER (published > date) AS future, count(*) FILTER (published IS NULL) AS unknown FROM f")
def a7(spark, sf):
    return q.publication_audit(asof_facts(spark, sf), "published")


@query("A8", f"""{D}, l AS (SELECT *, CASE WHEN if_up > 5 THEN 1.0 ELSE 0.0 END AS turnover FROM pd WHERE date = (SELECT max(date) FROM pd))
 SELECT max(date) AS date, count(*) AS row_count, count(turnover) AS finite, count(*) FILTER (turnover > 0) AS positive, count(*) FILTER (turnover = 0) AS zero,
 count(turnover) > 0 AND NOT (count(*) FILTER (volume > 0) > 0 AND count(*) FILTER (volume > 0 AND turnover <> 0) = 0) AS enabled FROM l""")
def a8(spark, sf):
    df = daily_panel(spark, sf).df.withColumn("turnover", F.when(F.col("if_up") > 5, 1.0).otherwise(0.0))
    return q.placeholder_audit(df, "turnover")
