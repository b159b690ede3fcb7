"""Filters, joins, rankings and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeseries as ts
from ..functions.clean import first_text, ratio, zero_pad
from ..operators import joins, screens
from ..sources.panel import daily_panel, read, weekly_panel
from . import query
from .common import KEYS, PD, PW, WC, out, rd
from .history import SEG_SQL, segments

P, D = f"WITH {PW}", f"WITH {PD}"


def day(text):
    return F.lit(text).cast("timestamp")


def weekly(spark, sf):
    return weekly_panel(spark, sf).df


def daily(spark, sf):
    return daily_panel(spark, sf).df


# ---- filters -------------------------------------------------------------------------

@query("P1", f"""{P} SELECT date, code, close, amount FROM pw WHERE category = 'F' AND Ifsuspend = 0 AND volume > 0
 AND amount >= 50000 AND date_diff('day', ListedDate::DATE, date::DATE) >= 365""")
def p1(spark, sf):
    return screens.universe(weekly(spark, sf), "f", 50000.0, 365).select(*KEYS, "close", "amount")


@query("P2", f"{P} SELECT date, code, industry FROM pw WHERE industry IN (3, 7, 15)")
def p2(spark, sf):
    return weekly(spark, sf).filter(F.col("industry").isin(3, 7, 15)).select(*KEYS, "industry")


@query("P3", f"""{P}, g AS (SELECT *, CASE WHEN volume < 80 THEN Ifsuspend END AS s, CASE WHEN volume > 10 THEN amount END AS a FROM pw)
 SELECT date, code, a AS amount FROM g WHERE date BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-12-31'
 AND coalesce(s, 1) = 0 AND coalesce(a, 0) > 0 AND volume > 0""")
def p3(spark, sf):
    df = weekly(spark, sf).withColumns({"Ifsuspend": F.when(F.col("volume") < 80, F.col("Ifsuspend")),
                                        "amount": F.when(F.col("volume") > 10, F.col("amount"))})
    return screens.selection_window(df, day("1997-01-01"), day("1999-12-31")).select(*KEYS, "amount")


# Facts with a publication date of their own; urgent orders have no known date.
ASOF = """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::TIMESTAMP AS date, o_totalprice AS fact,
 CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate::TIMESTAMP END AS published FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
FACT_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "date")


def asof_facts(spark, sf):
    item = read(spark, sf, "lineitem").select(
        *FACT_KEYS[:4], F.col("l_shipdate").cast("timestamp").alias("date"))
    order = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("fact"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderdate").cast("timestamp")).alias("published"))
    return item.join(order, "l_orderkey")


@query("P4", f"{ASOF} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date, CASE WHEN published IS NULL OR published <= date THEN fact END AS fact FROM f")
def p4(spark, sf):
    return asof_facts(spark, sf).select(*FACT_KEYS, joins.mask_by_publication(
        "fact", F.col("published"), F.col("date")).alias("fact"))


@query("P5", f"{ASOF} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date, CASE WHEN published <= date + INTERVAL 15 HOURS THEN fact END AS fact FROM f")
def p5(spark, sf):
    return asof_facts(spark, sf).select(*FACT_KEYS, joins.mask_by_availability(
        "fact", F.col("published"), F.col("date")).alias("fact"))


PAD = "cells AS (SELECT d.date, c.code FROM (SELECT DISTINCT date FROM {t}) d, (SELECT DISTINCT code FROM {t}) c), padded AS (SELECT cells.date, cells.code, {t}.* EXCLUDE (date, code) FROM cells LEFT JOIN {t} USING (date, code))"
PADD = f"{D}, " + PAD.format(t="pd")


@query("P6", f"""{PADD} SELECT date, code, close IS NOT NULL AND open IS NOT NULL AS observed,
 coalesce(close > 0 AND open > 0 AND volume > 0 AND Ifsuspend = 0, false) AS eligible,
 coalesce(open > 0 AND Ifsuspend = 0, false) AS can_buy_open, coalesce(open > 0 AND Ifsuspend = 0, false) AS can_sell_open FROM padded""")
def p6(spark, sf):
    from ..functions.flags import session_flags
    return joins.pad(daily(spark, sf)).select(*KEYS, *[v.alias(k) for k, v in session_flags().items()])


@query("P7", f"""{D}, cal AS (SELECT date, lead(date) OVER (ORDER BY date) AS nd FROM (SELECT DISTINCT date FROM pd))
 SELECT pd.date AS signal_date, e.date AS date, pd.code, pd.close AS score, e.if_up <> 1 AS can_buy, e.if_down <> 1 AS can_sell
 FROM pd JOIN cal USING (date) JOIN pd e ON e.date = cal.nd AND e.code = pd.code WHERE e.Ifsuspend = 0 AND e.open > 0""")
def p7(spark, sf):
    df = daily(spark, sf)
    signals = joins.next_session(df.select(*KEYS, F.col("close").alias("score")), joins.calendar(df))
    open_rows = df.filter(screens.tradable()).select(*KEYS, screens.unlimited("if_up").alias("can_buy"),
                                                     screens.unlimited("if_down").alias("can_sell"))
    return signals.join(open_rows, list(KEYS)).select("signal_date", *KEYS, "score", "can_buy", "can_sell")


@query("P8", f"""{P} SELECT date, code, amount FROM pw WHERE category IN ('F') AND amount BETWEEN 40000 AND 120000
 AND date_diff('day', ListedDate::DATE, date::DATE) >= 180 AND volume <= 60""")
def p8(spark, sf):
    df = weekly(spark, sf).withColumn("listing_days", F.datediff("date", "ListedDate"))
    keep = screens.within({"amount": (40000, 120000), "listing_days": (180, None), "volume": (None, 60)},
                          {"category": ["F"]})
    return df.filter(keep).select(*KEYS, "amount")


@query("P9", f"""{PADD}, s AS (SELECT *, CASE WHEN volume > 1 THEN Ifsuspend END AS known, CASE WHEN close > 2 THEN close END AS f1, CASE WHEN open > 4 THEN open END AS f2,
  CASE WHEN high > low THEN (close - open) / (high - low) END AS score FROM padded)
 SELECT date, code, CASE WHEN close IS NULL THEN 'missing_as_of_date' WHEN close <= 0 THEN 'invalid_close'
 WHEN known IS NULL THEN 'suspension_status_unknown' WHEN known <> 0 THEN 'suspended' WHEN f1 IS NULL AND f2 IS NULL THEN 'all_factors_missing'
 WHEN f1 IS NULL OR f2 IS NULL THEN 'insufficient_factor_coverage' WHEN score IS NULL THEN 'invalid_score' ELSE '' END AS reason FROM s""")
def p9(spark, sf):
    df = joins.pad(daily(spark, sf)).withColumns({
        "known": F.when(F.col("volume") > 1, F.col("Ifsuspend")), "f1": F.when(F.col("close") > 2, F.col("close")),
        "f2": F.when(F.col("open") > 4, F.col("open")), "score": F.when(F.col("high") > F.col("low"), ratio(
            F.col("close") - F.col("open"), F.col("high") - F.col("low")))})
    coverage = (F.col("f1").isNotNull().cast("double") + F.col("f2").isNotNull().cast("double")) / 2
    reason = screens.selection_reason(F.col("close"), F.col("known"), coverage, F.col("score"), 1.0)
    return df.select(*KEYS, reason.alias("reason"))


# Candidate factors: one per part, with metrics from its line items and a pool (brand).
CAND = """cand AS (SELECT 'p' || l_partkey AS factor_id, l_partkey AS k, count(*) AS n,
  sum(l_discount::DECIMAL(18,2))::DOUBLE / count(*) - 0.05::DOUBLE AS ic,
  sum(l_tax::DECIMAL(18,2))::DOUBLE / count(*) - 0.04::DOUBLE AS rank_ic,
  (count(*) FILTER (l_returnflag <> 'R'))::DOUBLE / count(*) AS coverage,
  CASE WHEN count(*) FILTER (l_linestatus = 'O') > 0 THEN sum(l_quantity) FILTER (l_linestatus = 'O') / count(*) END AS score
 FROM lineitem GROUP BY l_partkey),
 candp AS (SELECT cand.*, p_brand AS pool_id, p_size FROM cand JOIN part ON p_partkey = k)"""


def candidates(spark, sf):
    n = F.count(F.lit(1))
    open_lines = F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))
    cand = read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(
        n.alias("n"),
        (F.sum(F.col("l_discount").cast("decimal(18,2)")).cast("double") / n - F.lit(0.05)).alias("ic"),
        (F.sum(F.col("l_tax").cast("decimal(18,2)")).cast("double") / n - F.lit(0.04)).alias("rank_ic"),
        (F.count_if(F.col("l_returnflag") != "R").cast("double") / n).alias("coverage"),
        (F.sum(open_lines) / n).alias("score"))
    part = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("pool_id"), "p_size")
    return cand.join(part, "k").withColumn("factor_id", F.concat(F.lit("p"), F.col("k").cast("string")))


@query("P10", f"""WITH {CAND} SELECT factor_id, pool_id, {rd('ic')} AS ic, {rd('score')} AS score FROM candp
 WHERE pool_id = (SELECT min(p_brand) FROM part) AND coalesce(score >= 5, false) AND ic >= -0.01 AND coverage >= 0.5""")
def p10(spark, sf):
    df = candidates(spark, sf)
    pool = read(spark, sf, "part").agg(F.min("p_brand")).scalar()
    keep = screens.pass_minima({"score": 5.0, "ic": -0.01, "coverage": 0.5})
    return out(df.filter(keep & (F.col("pool_id") == pool)),
               "factor_id", "pool_id", ic="ic", score="score")


SPLIT_IC = """si AS (SELECT l_partkey AS k, CASE WHEN year(l_shipdate) < 1999 THEN 'train' WHEN year(l_shipdate) < 2000 THEN 'valid' ELSE 'test' END AS split,
  (count(*) FILTER (l_returnflag <> 'R'))::DOUBLE / count(*) AS coverage,
  sum(l_discount::DECIMAL(18,2))::DOUBLE / count(*) - 0.05::DOUBLE AS ic, sum(l_tax::DECIMAL(18,2))::DOUBLE / count(*) * 10 - 0.3::DOUBLE AS icir
 FROM lineitem GROUP BY 1, 2),
 sw AS (SELECT k, max(coverage) FILTER (split='train') AS c1, max(coverage) FILTER (split='valid') AS c2, max(coverage) FILTER (split='test') AS c3,
  max(ic) FILTER (split='train') AS i1, max(ic) FILTER (split='valid') AS i2, max(ic) FILTER (split='test') AS i3, max(icir) FILTER (split='train') AS r1 FROM si GROUP BY k)"""


@query("P11", f"""WITH {SPLIT_IC} SELECT k, CASE WHEN c1 < 0.5 THEN 'train coverage' WHEN coalesce(abs(i1) < 0.002, true) THEN 'train IC'
 WHEN coalesce(abs(r1) < 0.05, true) THEN 'train ICIR' WHEN c2 < 0.5 THEN 'valid coverage' WHEN coalesce(abs(i2) < 0.003, true) THEN 'valid IC'
 WHEN c3 < 0.5 THEN 'test coverage' WHEN coalesce(abs(i3) < 0.003, true) THEN 'test IC' ELSE '' END AS reason FROM sw""")
def p11(spark, sf):
    n = F.count(F.lit(1))
    year = F.year("l_shipdate")
    split = F.when(year < 1999, "train").when(year < 2000, "valid").otherwise("test")
    m = read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k"), split.alias("split")).agg(
        (F.count_if(F.col("l_returnflag") != "R").cast("double") / n).alias("coverage"),
        (F.sum(F.col("l_discount").cast("decimal(18,2)")).cast("double") / n - F.lit(0.05)).alias("ic"),
        (F.sum(F.col("l_tax").cast("decimal(18,2)")).cast("double") / n * 10 - F.lit(0.3)).alias("icir"))
    names = ["train", "valid", "test"]
    wide = m.groupBy("k").pivot("split", names).agg(*[F.max(x).alias(x) for x in ("coverage", "ic", "icir")])
    reason = screens.acceptance(
        {s: F.col(f"{s}_coverage") for s in names},
        {s: (F.col(f"{s}_ic"), 0.002 if s == "train" else 0.003) for s in names},
        0.5, F.col("train_icir"), 0.05)
    return wide.select("k", reason.alias("reason"))


@query("P12", """SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_acctbal < 0 THEN '  ' END), ''), nullif(trim(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END), ''), c_name, '') AS label FROM customer""")
def p12(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", first_text(
        F.when(F.col("c_acctbal") < 0, F.lit("  ")), F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")),
        "c_name").alias("label"))


# ---- joins ---------------------------------------------------------------------------

@query("J2", f"""{P} SELECT w.date, w.code, {rd('s.x')} AS alpha, s.x IS NULL AS uncovered FROM pw w
 LEFT JOIN (SELECT date, code, close / open AS x FROM pw WHERE Ifsuspend = 0) s ON s.date = w.date AND s.code = w.code""")
def j2(spark, sf):
    df = weekly(spark, sf)
    scores = df.filter(F.col("Ifsuspend") == 0).select(*KEYS, (F.col("close") / F.col("open")).alias("alpha"))
    got = df.select(*KEYS).join(scores, list(KEYS), "left")
    return out(got.withColumn("uncovered", F.col("alpha").isNull()), *KEYS, "uncovered", alpha="alpha")


@query("J3", f"""{P}, a AS (SELECT date, code, 0.6 * close AS v FROM pw WHERE Ifsuspend = 0), b AS (SELECT date, code, 0.4 * open AS v FROM pw WHERE volume > 30)
 SELECT coalesce(a.date, b.date) AS date, coalesce(a.code, b.code) AS code, {rd('coalesce(a.v, 0) + coalesce(b.v, 0)')} AS alpha
 FROM a FULL JOIN b ON a.date = b.date AND a.code = b.code""")
def j3(spark, sf):
    from ..operators.compose import combine_parts
    df = weekly(spark, sf)
    a = df.filter(F.col("Ifsuspend") == 0).select(*KEYS, (0.6 * F.col("close")).alias("part"))
    b = df.filter(F.col("volume") > 30).select(*KEYS, (0.4 * F.col("open")).alias("part"))
    return out(combine_parts([a, b]), *KEYS, alpha="alpha")


@query("J4", f"""{P}, s AS (SELECT date, CASE WHEN avg(close / open) > 1.2 THEN 'bull' ELSE 'bear' END AS state_id FROM pw GROUP BY date)
 SELECT date, code, state_id, close FROM pw JOIN s USING (date)""")
def j4(spark, sf):
    df = weekly(spark, sf)
    states = df.groupBy("date").agg(F.when(F.avg(F.col("close") / F.col("open")) > 1.2, "bull").otherwise("bear").alias("state_id"))
    return df.join(F.broadcast(states), "date").select(*KEYS, "state_id", "close")


# A date-effective mapping: each supplier belongs to its nation until its first
# shipment turns 1000 days old, then to its region.
MAPPING = """map AS (SELECT code, 'n' || min(industry) AS industry, TIMESTAMP '1990-01-01' AS valid_from, min(ListedDate) + INTERVAL 1000 DAYS AS valid_to FROM pw GROUP BY code
 UNION ALL SELECT code, 'r' || min(sector), min(ListedDate) + INTERVAL 1001 DAYS, TIMESTAMP '2100-01-01' FROM pw GROUP BY code)"""


def mapping(df):
    base = df.groupBy("code").agg(F.min("industry").alias("i"), F.min("sector").alias("s"), F.min("ListedDate").alias("d"))
    first = base.select("code", F.concat(F.lit("n"), "i").alias("industry"), day("1990-01-01").alias("valid_from"),
                        (F.col("d") + F.expr("INTERVAL 1000 DAYS")).alias("valid_to"))
    then = base.select("code", F.concat(F.lit("r"), "s").alias("industry"), (F.col("d") + F.expr("INTERVAL 1001 DAYS")).alias("valid_from"),
                       day("2100-01-01").alias("valid_to"))
    return first.unionByName(then)


@query("J5", f"""{P}, {MAPPING}, {SEG_SQL} SELECT pw.date, pw.code, map.industry AS industry, segment FROM pw
 JOIN map ON map.code = pw.code AND pw.date BETWEEN valid_from AND valid_to JOIN seg ON pw.date BETWEEN start AND stop""")
def j5(spark, sf):
    df = weekly(spark, sf)
    tagged = joins.in_segments(df.drop("industry"), segments(spark))
    return joins.effective_join(tagged, mapping(df)).select(*KEYS, "industry", "segment")


@query("J6", f"""{P}, cal AS (SELECT date, lead(date) OVER (ORDER BY date) AS nd FROM (SELECT DISTINCT date FROM pw))
 SELECT date AS signal_date, nd AS date, code, close AS score FROM pw JOIN cal USING (date) WHERE nd IS NOT NULL""")
def j6(spark, sf):
    df = weekly(spark, sf)
    return joins.next_session(df.select(*KEYS, F.col("close").alias("score")), joins.calendar(df)).select("signal_date", *KEYS, "score")


@query("J7", f"{P} SELECT date, code, close FROM pw WHERE date = (SELECT max(date) FROM pw WHERE date <= TIMESTAMP '2000-07-08')")
def j7(spark, sf):
    return weekly_panel(spark, sf).last_sessions("2000-07-08", 1).select(*KEYS, "close")


@query("J8", f"""{PADD} SELECT date, code, last_value(CASE WHEN close > 0 THEN close END IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) AS exec_close,
 coalesce(CASE WHEN open > 0 THEN open END, last_value(CASE WHEN close > 0 THEN close END IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS exec_open FROM padded""")
def j8(spark, sf):
    df = joins.pad(daily(spark, sf))
    bought = F.coalesce(F.when(F.col("open") > 0, F.col("open")), ts.previous_mark("close"))
    return df.select(*KEYS, ts.current_mark("close").alias("exec_close"), bought.alias("exec_open"))


@query("J9", f"""WITH {PW}, pool AS (SELECT lpad((s_suppkey * 2)::VARCHAR, 6, '0') AS code FROM supplier)
 SELECT code, true AS present, count(*) AS n FROM pw WHERE code IN (SELECT code FROM pool) GROUP BY code
 UNION ALL SELECT code, false, 0 FROM pool WHERE code NOT IN (SELECT code FROM pw)""")
def j9(spark, sf):
    from ..functions.clean import zero_pad
    df = weekly(spark, sf)
    pool = read(spark, sf, "supplier").select(zero_pad((F.col("s_suppkey") * 2).cast("string")).alias("code"))
    have = df.join(pool, "code", "left_semi").groupBy("code").agg(F.lit(True).alias("present"), F.count(F.lit(1)).alias("n"))
    lost = pool.join(df.select("code"), "code", "left_anti").select("code", F.lit(False).alias("present"), F.lit(0).cast("bigint").alias("n"))
    return have.unionByName(lost)


# State-conditional metrics per candidate; the catalog leaves small parts unclassified.
COND = """cm AS (SELECT 'p' || l_partkey AS factor_id, l_partkey AS k, l_returnflag AS state_id, CASE WHEN year(l_shipdate) < 1999 THEN 'train' ELSE 'valid' END AS split,
  count(*) AS sample_count, sum(l_discount::DECIMAL(18,2))::DOUBLE / count(*) - 0.05::DOUBLE AS rank_ic_mean,
  CASE WHEN count(*) > 2 THEN sum(l_tax::DECIMAL(18,2))::DOUBLE / count(*) * 10 - 0.4::DOUBLE END AS icir FROM lineitem GROUP BY ALL),
 cmc AS (SELECT cm.*, 'm' || p_size % 3 AS own, CASE WHEN p_size > 10 THEN p_brand END AS catalog_category FROM cm JOIN part ON p_partkey = k),
 cmj AS (SELECT *, coalesce(catalog_category, own) AS category, coalesce(rank_ic_mean, 0) * 0.7 + coalesce(icir, 0) * 0.3 AS sc FROM cmc)"""


def conditional(spark, sf):
    n = F.count(F.lit(1))
    split = F.when(F.year("l_shipdate") < 1999, "train").otherwise("valid")
    m = read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("state_id"), split.alias("split")).agg(
        n.alias("sample_count"), (F.sum(F.col("l_discount").cast("decimal(18,2)")).cast("double") / n - F.lit(0.05)).alias("rank_ic_mean"),
        F.when(n > 2, F.sum(F.col("l_tax").cast("decimal(18,2)")).cast("double") / n * 10 - F.lit(0.4)).alias("icir"))
    return m.withColumn("factor_id", F.concat(F.lit("p"), F.col("k").cast("string")))


def catalog_of(spark, sf):
    """Catalog categories, and the metrics' own category in ``own``."""
    return read(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("factor_id"),
        F.concat(F.lit("m"), (F.col("p_size") % 3).cast("string")).alias("own"),
        F.when(F.col("p_size") > 10, F.col("p_brand")).alias("category"))


@query("J10", f"WITH {COND} SELECT factor_id, state_id, split, category, sample_count FROM cmj")
def j10(spark, sf):
    from ..operators.compose import with_catalog
    cat = catalog_of(spark, sf)
    m = conditional(spark, sf).join(cat.select("factor_id", F.col("own").alias("category")), "factor_id")
    return with_catalog(m, cat.drop("own")).select("factor_id", "state_id", "split", "category", "sample_count")


PAIRED = ("amount", "close", "high", "low", "open", "volume")


@query("J12", f"""{P}, l AS (SELECT date, code, unnest([{', '.join(f"'{n}'" for n in PAIRED)}]) AS factor_id, unnest([{', '.join(PAIRED)}]) AS value FROM pw)
 SELECT a.factor_id AS f1, b.factor_id AS f2, count(*) AS pairs, {rd('corr(a.value, b.value)')} AS corr FROM l a JOIN l b
 ON a.date = b.date AND a.code = b.code AND a.factor_id < b.factor_id GROUP BY 1, 2""")
def j12(spark, sf):
    from ..operators.pairs import correlations
    df = weekly(spark, sf).withColumn("whole", F.lit(1))
    return out(correlations(df, PAIRED, ("whole",)), "f1", "f2", "pairs", corr="ic")


@query("J14", f"""WITH {CAND}, c AS (SELECT factor_id, k, 'e' || p_size AS expression, ic FROM candp),
 x AS (SELECT factor_id, expression, k, ic * 10 AS sharpe FROM c WHERE k % 3 = 0),
 y AS (SELECT expression, arg_max(sharpe, factor_id) AS sharpe FROM x GROUP BY 1)
 SELECT c.factor_id, c.expression, {rd('coalesce(CASE WHEN x.factor_id IS NOT NULL THEN x.sharpe ELSE y.sharpe END, NULL)')} AS sharpe
 FROM c LEFT JOIN x ON x.factor_id = c.factor_id LEFT JOIN y ON y.expression = c.expression""")
def j14(spark, sf):
    c = candidates(spark, sf).select("factor_id", "k", F.concat(F.lit("e"), F.col("p_size").cast("string")).alias("expression"), "ic")
    extra = c.filter(F.col("k") % 3 == 0).select("factor_id", "expression", (F.col("ic") * 10).alias("sharpe"))
    got = screens.with_fallback(c.drop("ic", "k"), extra, "factor_id", "expression", ["sharpe"])
    return out(got, "factor_id", "expression", sharpe="sharpe")


# ---- sort, limit, top-k --------------------------------------------------------------

POOL = """dd AS (SELECT count(DISTINCT date) AS days FROM pw WHERE date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'),
 ls AS (SELECT code, sum(amount::DECIMAL(18,2))::DOUBLE / count(*) AS average_amount, count(*) AS valid_rows FROM pw
  WHERE date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' AND Ifsuspend = 0 AND volume > 0 AND amount > 0 GROUP BY code),
 liq AS (SELECT code, average_amount, valid_rows, valid_rows::DOUBLE / days AS coverage FROM ls, dd WHERE valid_rows >= ceil(days * 0.4::DOUBLE))"""


def pool_stats(spark, sf):
    return screens.liquid_pool(weekly(spark, sf), day("1996-01-01"), day("1998-12-31"), 0.4)


@query("A1", f"{P}, {POOL} SELECT code, valid_rows, {rd('average_amount')} AS average_amount, {rd('coverage')} AS coverage FROM liq")
def a1(spark, sf):
    return out(pool_stats(spark, sf), "code", "valid_rows", average_amount="average_amount", coverage="coverage")


@query("K1", f"{P}, {POOL} SELECT code, {rd('average_amount')} AS average_amount FROM (SELECT * FROM liq ORDER BY average_amount DESC, code LIMIT 20)")
def k1(spark, sf):
    return out(screens.top_pool(pool_stats(spark, sf), 20), "code", average_amount="average_amount")


@query("K2", f"""{P}, s AS (SELECT *, close / lag(close, 4) OVER {WC} - 1 AS score FROM pw)
 SELECT date, code, {rd('score')} AS score, row_number() OVER w AS rank FROM s WHERE score IS NOT NULL
 WINDOW w AS (PARTITION BY date ORDER BY score DESC, code) QUALIFY row_number() OVER w <= 10""")
def k2(spark, sf):
    df = weekly(spark, sf).withColumn("score", F.col("close") / ts.delay("close", 4) - 1)
    got = screens.top_k(df, "score", 10)
    return out(got.withColumn("rank", F.col("rank").cast("bigint")), *KEYS, "rank", score="score")


@query("K3", f"""{P}, s AS (SELECT *, Ifsuspend = 0 AS eligible, round(close / open, 2) AS score FROM pw),
 k AS (SELECT *, CASE WHEN eligible THEN row_number() OVER (PARTITION BY date, eligible ORDER BY score DESC, code) END AS rank FROM s)
 SELECT date, code, eligible, rank, coalesce(eligible AND rank <= 10, false) AS selected,
 CASE WHEN NOT eligible THEN 'suspended' WHEN rank > 10 THEN 'outside_top_n' ELSE '' END AS reason FROM k""")
def k3(spark, sf):
    df = weekly(spark, sf).withColumns({"eligible": F.col("Ifsuspend") == 0, "score": F.round(F.col("close") / F.col("open"), 2)})
    df = df.withColumn("reason", F.when(F.col("eligible"), "").otherwise("suspended"))
    got = screens.ranking(df, "score", 10, by=("date",))
    return got.select(*KEYS, "eligible", F.col("rank").cast("bigint").alias("rank"), "selected", "reason")


@query("K4", f"""{P}, b AS (SELECT code, year(date)::INT AS yr, row_number() OVER {WC} AS batch, round(close / open, 1) AS objective FROM pw)
 SELECT code, yr, batch, objective FROM b QUALIFY row_number() OVER (PARTITION BY code, yr ORDER BY objective DESC, batch) = 1""")
def k4(spark, sf):
    df = weekly(spark, sf).select("code", F.year("date").alias("yr"), ts.ts_step().alias("s"), F.round(F.col("close") / F.col("open"), 1).alias("objective"))
    df = df.select("code", "yr", (F.col("s") + 1).cast("bigint").alias("batch"), "objective")
    return screens.best_checkpoint(df, "objective", "batch", by=("code", "yr"))


@query("K5", f"""{P} SELECT date, {rd("max(close) FILTER (category = 'O')")} AS incumbent_utility, {rd('max(close)')} AS best_utility,
 coalesce(max(close) > max(close) FILTER (category = 'O') + 100, false) AS changed FROM pw GROUP BY date""")
def k5(spark, sf):
    got = screens.keep_incumbent(weekly(spark, sf), "close", F.col("category") == "O", 100.0, ("date",))
    return out(got, "date", "changed", incumbent_utility="incumbent_utility", best_utility="best_utility")


@query("K6", f"WITH {CAND} SELECT factor_id, pool_id, {rd('score')} AS score FROM candp ORDER BY score DESC NULLS LAST, factor_id")
def k6(spark, sf):
    got = screens.ordered(candidates(spark, sf), "score", "factor_id")
    return out(got, "factor_id", "pool_id", score="score")


@query("K7", f"""{P}, k AS (SELECT *, row_number() OVER {WC} AS from_head, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS from_tail FROM pw)
 SELECT date, code, from_head, from_tail FROM k WHERE from_head <= 2 OR from_tail <= 2""")
def k7(spark, sf):
    got = screens.head_tail(weekly(spark, sf), ("code",), "date", 2)
    return got.select(*KEYS, F.col("from_head").cast("bigint").alias("from_head"), F.col("from_tail").cast("bigint").alias("from_tail"))


# ---- sets ----------------------------------------------------------------------------

@query("U1", f"""WITH {PW}, {PD} SELECT date, code, close, industry, NULL::DOUBLE AS if_up, 'weekly' AS run FROM pw
 UNION ALL SELECT date, code, close, NULL, if_up, 'daily' FROM pd""")
def u1(spark, sf):
    a = weekly(spark, sf).select(*KEYS, "close", "industry", F.lit("weekly").alias("run"))
    b = daily(spark, sf).select(*KEYS, "close", "if_up", F.lit("daily").alias("run"))
    return a.unionByName(b, allowMissingColumns=True)


@query("U2", f"{P} SELECT DISTINCT date, industry FROM pw")
def u2(spark, sf):
    return weekly(spark, sf).select("date", "industry").distinct()


@query("U3", f"""{D}, a AS (SELECT DISTINCT code FROM pd WHERE volume > 3), b AS (SELECT DISTINCT code FROM pd WHERE if_up = 1 AND close > 5),
 s AS (SELECT count(*) FILTER (a.code IS NOT NULL AND b.code IS NOT NULL) AS common, count(*) FILTER (b.code IS NULL) AS left_only, count(*) FILTER (a.code IS NULL) AS right_only
  FROM a FULL JOIN b ON a.code = b.code)
 SELECT *, left_only = 0 AND right_only = 0 AS same, 'turnover' AS missing_fields FROM s""")
def u3(spark, sf):
    from ..operators.quality import universe_check
    df = daily(spark, sf)
    return universe_check(df.filter("volume > 3"), df.filter("if_up = 1 AND close > 5"), required=("close", "turnover"))


@query("U4", f"{P} SELECT lpad((s_suppkey * 2)::VARCHAR, 6, '0') AS code FROM supplier EXCEPT SELECT code FROM pw")
def u4(spark, sf):
    # Pool codes that the store has no row of.
    pool = read(spark, sf, "supplier").select(zero_pad((F.col("s_suppkey") * 2).cast("string")).alias("code"))
    return pool.subtract(weekly(spark, sf).select("code"))
