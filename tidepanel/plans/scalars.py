"""Element-wise and text operators over the panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as m, text, timeseries as ts
from ..functions.clean import normalize_code
from ..sources.panel import daily_panel, read, weekly_panel
from . import query
from .common import KEYS, PD, PW, WC, out, rd

# The inputs of the element-wise checks: open price gap (any sign, may be zero), a
# lagged price (NULL in the first week of each code) and the amount.
BASE = f"WITH {PW}, b AS (SELECT *, close - open AS x, lag(close) OVER {WC} AS y FROM pw)"


def base(spark, sf):
    return weekly_panel(spark, sf).df.withColumns({
        "x": F.col("close") - F.col("open"), "y": ts.delay("close", 1)})


@query("M1", f"""{BASE} SELECT date, code, {rd('abs(x)')} AS abs_x,
 {rd('CASE WHEN x > 0 THEN ln(x) END')} AS log_x, {rd('CASE WHEN x >= 0 THEN sqrt(x) END')} AS sqrt_x,
 {rd('sign(x)')} AS sign_x, {rd('-x')} AS rev_x, {rd('CASE WHEN x <> 0 THEN 1.0 / x END')} AS inv_x FROM b""")
def m1(spark, sf):
    return out(base(spark, sf), *KEYS, abs_x=m.abs_("x"), log_x=m.log("x"), sqrt_x=m.sqrt("x"),
               sign_x=m.sign("x"), rev_x=m.reverse("x"), inv_x=m.inverse("x"))


@query("M2", f"""{BASE} SELECT date, code, {rd('CASE WHEN x >= 0 THEN pow(x, 0.5) END')} AS pow_half,
 {rd('CASE WHEN x <> 0 THEN pow(x, -1) END')} AS pow_inv, {rd('sign(x) * pow(abs(x), 0.5)')} AS signed_half FROM b""")
def m2(spark, sf):
    return out(base(spark, sf), *KEYS, pow_half=m.power("x", 0.5), pow_inv=m.power("x", -1.0),
               signed_half=m.signed_power("x", 0.5))


@query("M3", f"""{BASE} SELECT date, code, {rd('coalesce(x,0) + coalesce(y,0)')} AS added,
 {rd('CASE WHEN y IS NOT NULL THEN y + y END')} AS only_y, {rd('coalesce(y,0) + coalesce(y,0)')} AS filtered,
 {rd('x + y')} AS infix FROM b""")
def m3(spark, sf):
    return out(base(spark, sf), *KEYS, added=m.add("x", "y"), only_y=m.add("y", "y"),
               filtered=m.add("y", "y", filter=True), infix=F.col("x") + F.col("y"))


@query("M4", f"""{BASE} SELECT date, code, {rd('x - y')} AS sub, {rd('x - coalesce(y,0)')} AS sub_f,
 {rd('x * y')} AS mul, {rd('x * coalesce(y,0)')} AS mul_f FROM b""")
def m4(spark, sf):
    return out(base(spark, sf), *KEYS, sub=m.subtract("x", "y"), sub_f=m.subtract("x", "y", filter=True),
               mul=m.multiply("x", "y"), mul_f=m.multiply("x", "y", filter=True))


@query("M5", f"""WITH {PD} SELECT date, code, {rd('CASE WHEN low <> 0 THEN high / low END')} AS hl,
 {rd('CASE WHEN abs(close - open) > 1e-12 THEN high / (close - open) END')} AS guarded FROM pd""")
def m5(spark, sf):
    return out(daily_panel(spark, sf).df, *KEYS, hl=m.divide("high", "low"),
               guarded=m.divide("high", F.col("close") - F.col("open"), eps=1e-12))


@query("M6", f"""{BASE} SELECT date, code, {rd('greatest(open, y)')} AS hi, {rd('least(open, y)')} AS lo FROM b""")
def m6(spark, sf):
    return out(base(spark, sf), *KEYS, hi=m.maximum("open", "y"), lo=m.minimum("open", "y"))


@query("M7", f"""{BASE} SELECT date, code, {rd('pow(volume, 2)')} AS squared,
 {rd('x - floor(x / 7.0) * 7.0')} AS mod7, {rd('x - floor(x / -7.0) * -7.0')} AS mod_neg FROM b""")
def m7(spark, sf):
    return out(base(spark, sf), *KEYS, squared=m.power("volume", 2.0), mod7=m.floor_mod("x", 7.0),
               mod_neg=m.floor_mod("x", -7.0))


@query("M8", f"""{BASE} SELECT date, code, {rd('greatest(least(floor((x + 1000) / 250), 7), 0)')} AS slot,
 {rd('CASE WHEN y IS NOT NULL THEN greatest(least(floor((y - 900) / 100), 11), 0) END')} AS slot_y FROM b""")
def m8(spark, sf):
    return out(base(spark, sf), *KEYS, slot=m.bucket("x", "-1000,1000,250"),
               slot_y=m.bucket("y", "900,2100,100"))


@query("M9", f"""{BASE} SELECT date, code, coalesce(open = y, false) AS eq, coalesce(open <> y, true) AS ne,
 coalesce(open > y, false) AS gt, coalesce(open >= y, false) AS ge, coalesce(open < y, false) AS lt,
 coalesce(open <= y, false) AS le FROM b""")
def m9(spark, sf):
    return base(spark, sf).select(
        *KEYS, m.equal("open", "y").alias("eq"), m.not_equal("open", "y").alias("ne"),
        m.greater("open", "y").alias("gt"), m.greater_equal("open", "y").alias("ge"),
        m.less("open", "y").alias("lt"), m.less_equal("open", "y").alias("le"))


@query("M10", f"""{BASE} SELECT date, code, coalesce(x <> 0, true) AND coalesce(y <> 0, true) AS both,
 coalesce(x <> 0, true) OR coalesce(y <> 0, true) AS either, NOT coalesce(x <> 0, true) AS neither FROM b""")
def m10(spark, sf):
    return base(spark, sf).select(*KEYS, m.and_("x", "y").alias("both"), m.or_("x", "y").alias("either"),
                                  m.not_("x").alias("neither"))


@query("M11", f"""{BASE} SELECT date, code,
 {rd('CASE WHEN coalesce(x > 0, false) THEN open ELSE y END')} AS picked FROM b""")
def m11(spark, sf):
    return out(base(spark, sf), *KEYS, picked=m.if_else(m.greater("x", 0.0), "open", "y"))


@query("M12", f"{BASE} SELECT date, code, y IS NULL AS missing FROM b")
def m12(spark, sf):
    return base(spark, sf).select(*KEYS, m.is_nan("y").alias("missing"))


@query("M13", f"""{BASE} SELECT date, code, {rd('open')} AS scalar,
 {rd('open + close + coalesce(y, 0)')} AS total,
 {rd('(open + close + coalesce(y, 0)) / (2 + (y IS NOT NULL)::INT)')} AS mean FROM b""")
def m13(spark, sf):
    v = F.array("open", "close", "y")
    return out(base(spark, sf), *KEYS, scalar=m.vec_scalar("open"), total=m.vec_sum(v), mean=m.vec_avg(v))


@query("M14", """WITH t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ' ' || user_id || '.0'
  WHEN event_id % 3 = 1 THEN user_id::VARCHAR ELSE 'sh' || user_id END AS raw FROM events)
 SELECT event_id, raw, CASE WHEN regexp_matches(regexp_replace(trim(raw), '\\.0$', ''), '^\\d+$')
  THEN repeat('0', greatest(6 - length(regexp_replace(trim(raw), '\\.0$', '')), 0)) || regexp_replace(trim(raw), '\\.0$', '')
  ELSE upper(regexp_replace(trim(raw), '\\.0$', '')) END AS code FROM t""")
def m14(spark, sf):
    user = F.col("user_id").cast("string")
    kind = F.col("event_id") % 3
    raw = (F.when(kind == 0, F.concat(F.lit(" "), user, F.lit(".0"))).when(kind == 1, user)
           .otherwise(F.concat(F.lit("sh"), user)))
    return read(spark, sf, "events").select("event_id", raw.alias("raw"), normalize_code(raw).alias("code"))


@query("M15", """SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS day, year(o_orderdate)::INT AS yr,
 date_diff('day', o_orderdate::DATE, DATE '2002-01-01')::INT AS age,
 (date_trunc('day', o_orderdate) + INTERVAL 15 HOURS)::TIMESTAMP AS cutoff,
 (date_trunc('day', o_orderdate) + INTERVAL 20 DAYS)::TIMESTAMP AS matures FROM orders""")
def m15(spark, sf):
    day = F.date_trunc("day", "o_orderdate")
    return read(spark, sf, "orders").select(
        "o_orderkey", day.alias("day"), F.year("o_orderdate").alias("yr"),
        F.datediff(F.lit("2002-01-01").cast("date"), "o_orderdate").alias("age"),
        (day + F.expr("INTERVAL 15 HOURS")).alias("cutoff"),
        (day + F.expr("INTERVAL 20 DAYS")).alias("matures"))


# A catalog of expressions with one entry per part, spelled in either dialect.
CATALOG = """cat AS (SELECT p_partkey AS k, CASE p_partkey % 6
  WHEN 0 THEN 'Mean($close,' || p_size || 'd)' WHEN 1 THEN 'Greater($open,Ref($close,' || p_size || 'd))'
  WHEN 2 THEN 'ts_std(close,' || p_size || ')' WHEN 3 THEN 'Corr($close,$volume,' || p_size || 'd)'
  WHEN 4 THEN 'rank(volume)' ELSE 'Sub(ma5,ema12)' END AS expression FROM part)"""


def catalog(spark, sf):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    expr = (F.when(kind == 0, F.concat(F.lit("Mean($close,"), size, F.lit("d)")))
            .when(kind == 1, F.concat(F.lit("Greater($open,Ref($close,"), size, F.lit("d))")))
            .when(kind == 2, F.concat(F.lit("ts_std(close,"), size, F.lit(")")))
            .when(kind == 3, F.concat(F.lit("Corr($close,$volume,"), size, F.lit("d)")))
            .when(kind == 4, F.lit("rank(volume)")).otherwise(F.lit("Sub(ma5,ema12)")))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("k"), expr.alias("expression"))


def _normalized_sql(x: str) -> str:
    sql = f"regexp_replace(regexp_replace(trim({x}), '\\$', '', 'g'), '\\b(\\d+)d\\b', '\\1', 'g')"
    for alias, name in text.ALIASES.items():
        sql = f"regexp_replace({sql}, '\\b{alias}\\s*\\(', '{name}(', 'g')"
    return sql


@query("M16", f"WITH {CATALOG} SELECT k, expression, {_normalized_sql('expression')} AS canonical FROM cat")
def m16(spark, sf):
    return catalog(spark, sf).withColumn("canonical", text.normalize_expression("expression"))


def _fam_sql(x: str) -> str:
    flags = ", ".join(f"CASE WHEN regexp_matches({x}, '{text.word_pattern(names)}') THEN '{family}' END"
                      for family, names in text.FIELD_FAMILIES.items())
    return f"list_filter([{flags}], lambda e: e IS NOT NULL)"


def _families_sql(x: str) -> str:
    fam, calls = _fam_sql(x), "regexp_matches({x}, '{p}')"
    trend = calls.format(x=x, p=text.call_pattern(text.TREND_OPERATORS))
    moves = calls.format(x=x, p=text.call_pattern(text.VOLATILITY_OPERATORS))
    return (f"array_to_string(CASE WHEN {trend} AND NOT {moves} AND NOT list_contains({fam}, 'trend') "
            f"THEN list_append({fam}, 'trend') ELSE {fam} END, ',')")


def _category_sql(x: str) -> str:
    fam = _fam_sql(x)
    return f"""CASE WHEN regexp_matches({x}, '{text.call_pattern(text.VOLATILITY_OPERATORS)}') THEN 'volatility'
 WHEN regexp_matches({x}, '{text.call_pattern(text.TREND_OPERATORS)}') AND NOT list_contains({fam}, 'trend') THEN 'trend'
 WHEN len({fam}) = 0 THEN 'other' WHEN len({fam}) = 1 THEN {fam}[1] ELSE 'mixed' END"""


@query("M17", f"""WITH {CATALOG} SELECT k, expression, {_category_sql('expression')} AS category, {_families_sql('expression')} AS families,
 array_to_string(list_sort(list_distinct(regexp_extract_all(expression, '([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1))), ',') AS operators
 FROM cat""")
def m17(spark, sf):
    return catalog(spark, sf).select(
        "k", "expression", text.infer_category("expression").alias("category"),
        F.array_join(text.all_families("expression"), ",").alias("families"),
        F.array_join(text.operators_used("expression"), ",").alias("operators"))


@query("M18", f"""WITH {CATALOG} SELECT k, 'factor_' || printf('%04d', k) || '_' || substr(sha256(expression), 1, 10)
 AS factor_id FROM cat""")
def m18(spark, sf):
    return catalog(spark, sf).select("k", text.stable_id("k", "expression").alias("factor_id"))


@query("M19", """SELECT event_id, (props->>'$.k')::DOUBLE AS k, (props->>'$.missing')::DOUBLE AS missing,
 coalesce((props->>'$.missing')::DOUBLE, value) AS filled FROM events""")
def m19(spark, sf):
    missing = F.get_json_object("props", "$.missing").try_cast("double")
    return read(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"),
        missing.alias("missing"), F.coalesce(missing, F.col("value")).alias("filled"))


@query("M20", f"""{BASE}, d AS (SELECT *, (high - low) / low - 0.1 * (volume - 20) / 20 AS delta FROM b)
 SELECT date, code, {rd('delta')} AS delta,
 {rd("tanh((CASE WHEN Ifsuspend = 0 THEN delta ELSE 0.0 END) / 0.5)")} AS reward FROM d""")
def m20(spark, sf):
    gain = m.paired_delta(F.col("high") / F.col("low"), F.lit(1.0), F.col("volume") / 20, F.lit(1.0), 0.1)
    df = base(spark, sf).withColumn("delta", gain)
    return out(df, *KEYS, delta="delta", reward=m.paired_reward("delta", F.col("Ifsuspend") == 0, 0.5))


@query("M21", """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '=' || c_name
 WHEN c_custkey % 4 = 1 THEN '-' || c_acctbal::BIGINT ELSE c_name END AS txt FROM customer)
 SELECT c_custkey, CASE WHEN regexp_matches(txt, '^[=+\\-@\\t\\r]') THEN '''' || txt ELSE txt END AS safe FROM t""")
def m21(spark, sf):
    kind = F.col("c_custkey") % 4
    txt = (F.when(kind == 0, F.concat(F.lit("="), "c_name"))
           .when(kind == 1, F.concat(F.lit("-"), F.rint("c_acctbal").cast("bigint").cast("string")))
           .otherwise(F.col("c_name")))
    return read(spark, sf, "customer").select("c_custkey", text.sheet_safe(txt).alias("safe"))
