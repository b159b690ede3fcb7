"""Source, ingest, sink and registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registry as reg, text, timeseries as ts
from ..operators import factors as fs, joins, screens
from ..session import run_dir
from ..sources import ingest, sinks
from ..sources.panel import daily_panel, order_number, read, weekly_panel
from . import query
from .accounting import accounts, AC
from .common import KEYS, PD, PW, WC, full_sql, out, rd, wn
from .evaluation import FL, long
from .history import SEG_SQL, segments
from .joining import CAND, PADD, candidates, day, pool_stats
from .scalars import CATALOG, _normalized_sql, catalog

P, D = f"WITH {PW}", f"WITH {PD}"


@query("S1", "SELECT event_id, event_type, value FROM events WHERE event_id % 50 <> 0")
def s1(spark, sf):
    # Tab-separated text of all events; every fiftieth line is broken by extra fields.
    cells = [F.col("event_id").cast("string"), F.col("ts").cast("string"), F.col("event_type"), F.col("value").cast("string")]
    extra = F.when(F.col("event_id") % 50 == 0, F.lit("\tx\ty")).otherwise("")
    lines = read(spark, sf, "events").select(F.concat(F.concat_ws("\t", *cells), extra).alias("line"))
    path = run_dir(spark, "delimited")
    header = "event_id\tts\tevent_type\tvalue"
    (lines.withColumnRenamed("line", header).write.option("header", True).option("sep", "\u0001")
     .option("quote", "\u0000").option("escapeQuotes", False).csv(path))
    return ingest.read_delimited(spark, path, "event_id bigint, ts string, event_type string, value double",
                                 ["event_id", "event_type", "value"])


@query("S2", "SELECT event_id, value, CASE WHEN event_type = 'click' THEN user_id END AS user_id, CASE WHEN event_type <> 'click' THEN event_type END AS event_type FROM events")
def s2(spark, sf):
    path = run_dir(spark, "parts")
    e = read(spark, sf, "events")
    e.filter("event_type = 'click'").select("event_id", "value", "user_id").write.parquet(f"{path}/a")
    e.filter("event_type <> 'click'").select("event_id", "value", "event_type").write.parquet(f"{path}/b")
    return ingest.read_merged(spark, f"{path}/a", f"{path}/b").select("event_id", "value", "user_id", "event_type")


@query("S3", "SELECT l_suppkey, l_shipdate, l_quantity FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' AND l_suppkey IN (3, 5, 8, 13, 21)")
def s3(spark, sf):
    return ingest.scan(read(spark, sf, "lineitem"), ["l_suppkey", "l_shipdate", "l_quantity"], "1997-01-01", "1997-12-31",
                       (3, 5, 8, 13, 21), "l_shipdate", "l_suppkey")


@query("S4", "SELECT event_id, ts AS date, user_id AS code, value AS volume FROM events")
def s4(spark, sf):
    return read(spark, sf, "events").withColumnsRenamed({"ts": "date", "user_id": "code", "value": "volume"}).select("event_id", "date", "code", "volume")


@query("S5", """SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS date, lpad(user_id::VARCHAR, 6, '0') AS code, value AS close, value AS volume, value * 2 AS amount, 2.0::DOUBLE AS vwap,
 CASE WHEN event_id % 3 <> 0 THEN value + 1 END AS turnover, event_type AS category
 FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_type <> 'error' AND value > 0""")
def s5(spark, sf):
    # Raw text with unreadable dates (every eleventh row), missing closes (errors), missing
    # highs, unreadable lows, and an extra column that is no number in every third row.
    value = F.col("value").cast("string")
    raw = read(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("category"),
        F.when(F.col("event_id") % 13 != 0, value).alias("high"), F.when(F.col("event_id") % 17 == 0, "x").otherwise(value).alias("low"),
        F.when(F.col("event_id") % 3 == 0, "n/a").otherwise((F.col("value") + 1).cast("string")).alias("turnover"),
        F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("ts").cast("string")).alias("timestamps"),
        F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(".0")).alias("code"), value.alias("open"),
        F.when(F.col("event_type") == "error", "NULL").otherwise(value).alias("close"), value.alias("vol"),
        (F.col("value") * 2).cast("string").alias("amount"))
    return ingest.normalize_panel(raw).select(
        F.col("event_id").cast("bigint"), "date", "code", "close", "volume", "amount", "vwap", "turnover", "category")


@query("S6", f"{D} SELECT date, code, CASE WHEN volume > 2 THEN close + 1 ELSE close END AS close FROM pd UNION ALL SELECT date + INTERVAL 40 DAYS, code, close FROM pd WHERE volume > 4")
def s6(spark, sf):
    df = daily_panel(spark, sf).df.select(*KEYS, "close")
    busy = daily_panel(spark, sf).df.filter("volume > 2").select(*KEYS, (F.col("close") + 1).alias("close"))
    late = daily_panel(spark, sf).df.filter("volume > 4").select((F.col("date") + F.expr("INTERVAL 40 DAYS")).alias("date"), "code", "close")
    parts = [x.withColumn("ingest_seq", F.lit(i)) for i, x in enumerate((df, busy, late))]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return screens.keep_last(merged, list(KEYS), "ingest_seq").select(*KEYS, "close")


@query("S7", """SELECT l_orderkey, l_linenumber, arg_max(l_quantity, row(l_shipdate, l_partkey, l_suppkey, l_extendedprice)) AS l_quantity,
 arg_max(l_extendedprice, row(l_shipdate, l_partkey, l_suppkey, l_extendedprice)) AS l_extendedprice FROM lineitem GROUP BY ALL""")
def s7(spark, sf):
    item = read(spark, sf, "lineitem").withColumn("seq", order_number(
        (F.datediff("l_shipdate", F.lit("1900-01-01")), 6), (F.col("l_partkey"), 11), (F.col("l_suppkey"), 11),
        (F.round(F.col("l_extendedprice") * 100).cast("bigint"), 10)))
    return screens.keep_last(item.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "seq"),
                             ["l_orderkey", "l_linenumber"], "seq").drop("seq")


@query("S8", f"""{P}, ls AS (SELECT code, sum(amount::DECIMAL(18,2))::DOUBLE / count(*) AS a FROM pw WHERE Ifsuspend = 0 AND volume > 0 AND amount > 0 AND date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' GROUP BY code
  HAVING count(*) >= ceil((SELECT count(DISTINCT date) FROM pw WHERE date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31') * 0.4::DOUBLE)), pool AS (SELECT code FROM ls ORDER BY a DESC, code LIMIT 30),
 x AS (SELECT date, code, close FROM pw WHERE code IN (FROM pool) AND date >= TIMESTAMP '1997-01-01')
 SELECT count(*) AS row_count, min(date) AS first_date, max(date) AS last_date, count(DISTINCT code) AS codes, 3::INT AS column_count FROM x""")
def s8(spark, sf):
    pool = screens.top_pool(pool_stats(spark, sf), 30).select("code")
    rows = weekly_panel(spark, sf).between("1997-01-01").join(F.broadcast(pool), "code", "left_semi")
    return sinks.export_panel(rows.select(*KEYS, "close"))


@query("S9", f"{PADD} SELECT date, code, close, volume FROM padded")
def s9(spark, sf):
    return joins.pad(daily_panel(spark, sf).df).select(*KEYS, "close", "volume")


@query("S10", f"""{P} SELECT date, sum(amount::DECIMAL(18,2)) FILTER (sector = 0)::DOUBLE AS r0, sum(amount::DECIMAL(18,2)) FILTER (sector = 1)::DOUBLE AS r1, sum(amount::DECIMAL(18,2)) FILTER (sector = 2)::DOUBLE AS r2,
 sum(amount::DECIMAL(18,2)) FILTER (sector = 3)::DOUBLE AS r3, sum(amount::DECIMAL(18,2)) FILTER (sector = 4)::DOUBLE AS r4 FROM pw GROUP BY date""")
def s10(spark, sf):
    # A date x code matrix of one field, with one code per region.
    regions = weekly_panel(spark, sf).df.groupBy("date", F.concat(F.lit("r"), "sector").alias("code")).agg(
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"))
    return fs.matrix(regions, "amount", [f"r{i}" for i in range(5)])


@query("S11", f"WITH {FL} SELECT factor_id, count(*) AS row_count, count(value) AS valid_count, {rd('count(value)::DOUBLE / count(*)')} AS coverage FROM fl GROUP BY factor_id")
def s11(spark, sf):
    values = long(spark, sf)
    path = sinks.write_factors(values.select(*KEYS, "factor_id", "value"))
    return out(fs.factor_status(spark.read.parquet(path)), "factor_id", "row_count", "valid_count", coverage="coverage")


@query("S12", f"""{P}, {SEG_SQL}, cal AS (SELECT date, row_number() OVER (ORDER BY date) AS s FROM (SELECT DISTINCT date FROM pw)),
 b AS (SELECT segment, min(s) AS a, max(s) AS z FROM cal JOIN seg ON date BETWEEN start AND stop GROUP BY segment)
 SELECT segment, s < a AS warm_up, count(*) AS row_count, min(pw.date) AS first_date, max(pw.date) AS last_date FROM b JOIN cal ON s BETWEEN a - 20 AND z JOIN pw USING (date) GROUP BY ALL""")
def s12(spark, sf):
    rows = ingest.with_warm_up(weekly_panel(spark, sf).df.select(*KEYS, "close"), segments(spark), 20)
    path = sinks.write_partitioned(rows, ["segment"], "segments")
    return spark.read.parquet(path).groupBy("segment", "warm_up").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("S13", f"{AC} SELECT strategy_id, date, holding_count, {rd('net_return')} AS net_return, {rd('turnover')} AS turnover FROM ac")
def s13(spark, sf):
    daily = accounts(spark, sf).select("strategy_id", "date", "holding_count", "net_return", "turnover")
    path = run_dir(spark, "results")
    daily.select("strategy_id", "date", "holding_count", "net_return").write.json(f"{path}/daily")
    daily.select("strategy_id", "date", "turnover").write.option("header", True).csv(f"{path}/trades")
    left = spark.read.schema("strategy_id string, date timestamp, holding_count bigint, net_return double").json(f"{path}/daily")
    right = spark.read.schema("strategy_id string, date timestamp, turnover double").option("header", True).csv(f"{path}/trades")
    return out(left.join(right, ["strategy_id", "date"]), "strategy_id", "date", "holding_count", net_return="net_return", turnover="turnover")


@query("S14", """WITH r AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'x' || user_id WHEN event_id % 9 = 1 THEN user_id || '.00' ELSE user_id::VARCHAR END AS code, user_id FROM events)
 SELECT status, count(*) AS n FROM (SELECT CASE WHEN code LIKE 'x%' THEN 'rejected' WHEN user_id IN (SELECT s_suppkey FROM supplier) THEN 'imported' ELSE 'outside_universe' END AS status FROM r) GROUP BY status""")
def s14(spark, sf):
    from ..functions.clean import zero_pad
    user, kind = F.col("user_id").cast("string"), F.col("event_id") % 9
    code = F.when(kind == 0, F.concat(F.lit("x"), user)).when(kind == 1, F.concat(user, F.lit(".00"))).otherwise(user)
    raw = read(spark, sf, "events").select(F.col("event_id").cast("string").alias("event_id"), code.alias("code"))
    universe = read(spark, sf, "supplier").select(zero_pad(F.col("s_suppkey").cast("string")).alias("code"))
    return ingest.audit_import(raw, universe).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def runs(spark, sf):
    """Summaries of two runs with other columns, in folders of their own."""
    path, c = run_dir(spark, "runs"), candidates(spark, sf)
    c.select("factor_id", "pool_id", F.col("p_size").alias("backtest_sharpe")).write.option("header", True).csv(f"{path}/run_a")
    c.select("factor_id", F.col("n").alias("sharpe"), F.lit(0).alias("backtest_sharpe"), F.col("p_size").alias("backtest_calmar")).write.option("header", True).csv(f"{path}/run_b")
    pool = read(spark, sf, "part").agg(F.min("p_brand")).first()[0]
    return ingest.union_runs(spark, [path], pool)


RUNS = """runs AS (SELECT factor_id, 'run_a' AS run_id, p_size::VARCHAR AS sharpe, NULL::VARCHAR AS calmar FROM candp WHERE pool_id = (SELECT min(p_brand) FROM part)
 UNION ALL SELECT factor_id, 'run_b', n::VARCHAR, p_size::VARCHAR FROM candp)"""


@query("S15", f"""WITH {FL}, {CAND}, {RUNS} SELECT 'market' AS table_name, count(*) AS row_count FROM pw UNION ALL SELECT 'universe', count(DISTINCT code) FROM pw UNION ALL SELECT 'factor_catalog', count(*) FROM candp
 UNION ALL SELECT 'factor_metrics', count(*) FROM candp UNION ALL SELECT 'factor_values', count(*) FROM fl
 UNION ALL SELECT 'backtest_metrics', count(*) FROM runs""")
def s15(spark, sf):
    panel = weekly_panel(spark, sf).df
    cands = candidates(spark, sf)
    values = long(spark, sf)
    return sinks.export_snapshot(spark, {
        "market": panel, "universe": panel.select("code").distinct(), "factor_catalog": cands.select("factor_id", "pool_id"),
        "factor_metrics": cands.select("factor_id", "ic", "rank_ic", "coverage", "score"),
        "factor_values": values.select(*KEYS, "factor_id", "value"), "backtest_metrics": ingest.backtest_metrics(runs(spark, sf))})


@query("S16", f"""WITH {CAND} SELECT factor_id, (CASE WHEN k % 2 = 0 THEN n ELSE p_size END)::DOUBLE AS score, CASE WHEN k % 2 = 0 THEN p_size::DOUBLE END AS ic FROM candp""")
def s16(spark, sf):
    # Records of two generations: nested metrics, or metrics at the top level.
    nested = F.to_json(F.struct(F.struct(F.col("n").alias("score"), F.col("p_size").alias("ic")).alias("generation_metrics"), F.lit(-1).alias("score")))
    flat = F.to_json(F.struct(F.col("p_size").alias("score")))
    rows = candidates(spark, sf).select("factor_id", F.when(F.col("k") % 2 == 0, nested).otherwise(flat).alias("payload"))
    return ingest.nested_metrics(rows, "payload", ("score", "ic")).select("factor_id", "score", "ic")


@query("S17", f"WITH {CAND}, {RUNS} SELECT factor_id, run_id, sharpe, calmar FROM runs")
def s17(spark, sf):
    return runs(spark, sf).select("factor_id", "run_id", "sharpe", "calmar")


# ---- operator registry ---------------------------------------------------------------

@query("F1", f"{P} SELECT date, code, {rd(f'(high + low + 2 * close) / 4 - lag(close, 2) OVER {WC}')} AS z FROM pw")
def f1(spark, sf):
    reg.register_operator("weighted_price_change", "custom",
                          lambda high, low, close, n: (F.col(high) + F.col(low) + 2 * F.col(close)) / 4 - ts.delay(close, n), 4)
    op = reg.resolve("weighted_price_change")
    return out(weekly_panel(spark, sf).df, *KEYS, z=op.make("high", "low", "close", 2))


# What the registry must list: names by (category, kind, inputs).
LISTED = {
    ("arithmetic", "column", 1): "abs inverse log reverse sign sqrt",
    ("arithmetic", "column", 2): "add div divide max min mul multiply power signed_power sub subtract",
    ("arithmetic", "frame", 1): "densify",
    ("cross_section", "cross", 1): "normalize scale winsorize zscore",
    ("cross_section", "frame", 1): "quantile rank",
    ("group", "cross", 2): "group_neutralize group_scale group_zscore",
    ("group", "cross", 3): "group_fill group_mean",
    ("group", "frame", 2): "group_rank",
    ("group", "macro", 3): "group_backfill",
    ("logic", "column", 1): "is_nan not_",
    ("logic", "column", 2): "and_ equal greater greater_equal less less_equal not_equal or_",
    ("logic", "column", 3): "if_else where",
    ("time_series", "column", 0): "ts_step",
    ("time_series", "column", 2): (
        "delay delta last_diff_value ts_arg_max ts_arg_min ts_av_diff ts_backfill ts_count_nans "
        "ts_decay_linear ts_delay ts_delta ts_ema ts_mad ts_max ts_mean ts_median ts_min ts_product "
        "ts_quantile ts_rank ts_scale ts_std ts_std_dev ts_sum ts_var ts_wma ts_zscore"),
    ("time_series", "column", 3): "kth_element ts_corr ts_covariance ts_regression",
    ("time_series", "history", 1): "days_from_last_change",
    ("time_series", "history", 2): "hump",
    ("transformational", "column", 2): "bucket",
    ("transformational", "column", 3): "trade_when",
    ("vector", "column", 1): "vec_avg vec_sum",
}


def _catalog_values() -> str:
    rows = []
    for (category, kind, inputs), names in LISTED.items():
        for name in names.split():
            spelled = ",".join(sorted(a for a, n in text.ALIASES.items() if n == name))
            rows.append(f"('{name}', '{category}', '{kind}', {inputs}, '{spelled}')")
    return ", ".join(rows)


@query("F2", f"""WITH {CATALOG}, e AS (SELECT DISTINCT k, unnest(regexp_extract_all({_normalized_sql('expression')}, '([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1)) AS name FROM cat),
 o(name, category, kind, inputs, aliases) AS (VALUES {_catalog_values()})
 SELECT name, category, kind, inputs, aliases, count(k) AS used_by FROM o LEFT JOIN e USING (name) GROUP BY ALL""")
def f2(spark, sf):
    """All operators with category, kind, inputs and other spellings, and the number of catalog expressions that call
    them. Operators of users are left out, as other queries register some."""
    listed = spark.createDataFrame([(o.name, o.category, o.kind, o.inputs, ",".join(reg.aliases_of(o.name)))
                                    for o in reg.list_operators() if o.category != "custom"],
                                   "name string, category string, kind string, inputs int, aliases string")
    calls = catalog(spark, sf).select("k", F.explode(text.operators_used(text.normalize_expression("expression"))).alias("name"))
    used = calls.groupBy("name").agg(F.count("k").alias("used_by"))
    return listed.join(used, "name", "left").withColumn("used_by", F.coalesce("used_by", F.lit(0)))


@query("F3", f"{P} SELECT date, code, {rd(full_sql(f'avg(close) OVER {wn(4)}', 'close', 4))} AS mean4, lag(close, 2) OVER {WC} AS ref2, greatest(open, close) AS top FROM pw")
def f3(spark, sf):
    mean, ref, top = (reg.resolve(x).make for x in ("Mean", "Ref", "Greater"))
    df = weekly_panel(spark, sf).df
    df = df.withColumns({"ref2": ref("close", 2), "top": top("open", "close"), "mean4": mean("close", 4)})
    return out(df, *KEYS, "ref2", "top", mean4="mean4")


@query("F4", f"{P} SELECT field, status, CASE WHEN status = 'ok' THEN (SELECT count(*) FROM pw) ELSE 0 END AS usable_rows FROM (VALUES ('close', 'ok'), ('volume', 'ok'), ('industry', 'forbidden'), ('turnover', 'unknown')) t(field, status)")
def f4(spark, sf):
    df = weekly_panel(spark, sf).df
    status = reg.check_fields(df, ("close", "volume", "industry", "turnover"))
    counts = df.agg(*[(F.count(n) if s == "ok" else F.count(F.lit(None))).alias(n) for n, s in status.items()])
    rows = counts.unpivot([], list(status), "field", "usable_rows")
    names = F.create_map(*[F.lit(x) for kv in status.items() for x in kv])
    return rows.select("field", names[F.col("field")].alias("status"), "usable_rows")
