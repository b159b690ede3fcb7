"""Composition, scoring and selection queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import features as ft, timeseries as ts
from ..functions.clean import zero_pad
from ..operators import compose as cp, evaluate as ev, factors as fs, pairs as pr, portfolio as pf
from ..session import cut
from ..sources.panel import read, weekly_panel
from . import query
from .accounting import FEE, K, OBJ, SUM_SQL, accounts_sql, market
from .common import KEYS, PW, WC, full_sql, out, r, rank_sql, rd, wn
from .evaluation import (DP, FL, FW, METRICS, NAMES, SPEAR, SPEAR_NAMES, SPLITS, STATES, Z, floored_sql, tagged_daily,
                         performance, states, wide, zscores)
from .history import DAYS
from .joining import COND, catalog_of, conditional

WEIGHTS = {"mom4": 0.5, "rev1": -0.3, "rng": 0.2}


def dot(weights, names=None, fmt="{n}"):
    return " + ".join(f"{fmt.format(n=n)} * {w!r}::DOUBLE" for n, w in weights.items())


@query("X1", f"""WITH {FW} SELECT date, code, {rd("CASE WHEN coalesce(mom4, rev1, vol8) IS NOT NULL THEN coalesce(mom4 * 0.5::DOUBLE, 0) + coalesce(rev1 * -0.3::DOUBLE, 0) + coalesce(vol8 * 0.2::DOUBLE, 0) END")} AS alpha FROM fw""")
def x1(spark, sf):
    df = wide(spark, sf)
    return out(df, *KEYS, alpha=cp.weighted_alpha({"mom4": 0.5, "rev1": -0.3, "vol8": 0.2}))


@query("X2", f"WITH {Z} SELECT date, code, {rd(dot(WEIGHTS))} AS alpha FROM zw")
def x2(spark, sf):
    df = zscores(spark, sf)
    return out(df, *KEYS, alpha=cp.weighted_sum(WEIGHTS))


KEPT = ", ".join(f"CASE WHEN eligible THEN {n} END AS k_{n}" for n in WEIGHTS)
ZE = ", ".join(f"coalesce((k_{n} - avg(k_{n}) OVER d) / greatest(stddev_pop(k_{n}) OVER d, 1e-12), 0) AS z_{n}" for n in WEIGHTS)


@query("X3", f"""WITH {FW}, k AS (SELECT *, {KEPT} FROM fw), z AS (SELECT *, {ZE} FROM k WINDOW d AS (PARTITION BY date))
 SELECT date, code, {rd(dot(WEIGHTS, fmt='z_{n}'))} AS score, {rd('z_mom4 * 0.5')} AS mom4_part, k_mom4 IS NULL AS mom4_missing, 3::INT AS parts,
 eligible AND k_mom4 IS NULL AND k_rev1 IS NULL AND k_rng IS NULL AS violation FROM z""")
def x3(spark, sf):
    df = wide(spark, sf)
    got = cp.frozen_score(df, WEIGHTS)
    first = F.col("contributions")[0]
    return out(got.withColumns({"mom4_missing": first["missing"], "parts": F.size("contributions")}),
               *KEYS, "mom4_missing", "parts", "violation", score="score", mom4_part=first["contribution"])


ZN = "(({n} - avg({n}) OVER d) / nullif(stddev_pop({n}) OVER d, 0))"


@query("X4", f"""{DAYS}, {FW.removeprefix(PW + ',')}, z AS (SELECT date, code, {', '.join(ZN.format(n=n) + f' AS {n}' for n in ('mom4', 'rev1', 'rng'))} FROM fw WINDOW d AS (PARTITION BY date)),
 w AS (SELECT z.*, up_ratio AS wa, 1 - up_ratio AS wb, 0.5::DOUBLE AS wc FROM z JOIN days USING (date))
 SELECT date, code, {rd('CASE WHEN coalesce(mom4, rev1, rng) IS NOT NULL THEN (coalesce(mom4 * wa, 0) + coalesce(rev1 * wb, 0) + coalesce(rng * wc, 0)) / nullif((CASE WHEN mom4 IS NOT NULL THEN wa ELSE 0 END) + (CASE WHEN rev1 IS NOT NULL THEN wb ELSE 0 END) + (CASE WHEN rng IS NOT NULL THEN wc ELSE 0 END), 0) END')} AS alpha FROM w""")
def x4(spark, sf):
    df = wide(spark, sf)
    days = ft.market_features(weekly_panel(spark, sf).df)
    weights = days.select("date", F.explode(F.array(
        F.struct(F.lit("mom4").alias("factor_id"), F.col("up_ratio").alias("weight")),
        F.struct(F.lit("rev1").alias("factor_id"), (1 - F.col("up_ratio")).alias("weight")),
        F.struct(F.lit("rng").alias("factor_id"), F.lit(0.5).alias("weight")))).alias("w")).select("date", "w.*")
    return out(cp.dated_weights_alpha(df, weights, ("mom4", "rev1", "rng")), *KEYS, alpha="alpha")


@query("X5", f"""WITH {FW}, pool AS (SELECT lpad((s_suppkey * 2)::VARCHAR, 6, '0') AS code FROM supplier),
 fp AS (SELECT * FROM fw WHERE code IN (FROM pool)),
 d0 AS (SELECT * FROM fp WHERE date = (SELECT max(date) FROM fp WHERE date <= TIMESTAMP '2001-06-07')),
 dz AS (SELECT code, close, Ifsuspend, ((mom4 IS NOT NULL)::INT + (rev1 IS NOT NULL)::INT + (rng IS NOT NULL)::INT) / 3.0::DOUBLE AS coverage,
  {' + '.join(f'coalesce({ZN.format(n=n)}, 0) * {w!r}::DOUBLE' for n, w in WEIGHTS.items())} AS score,
  {', '.join(f'coalesce({ZN.format(n=n)}, 0) * {w!r}::DOUBLE AS contribution_{n}' for n, w in WEIGHTS.items())} FROM d0 WINDOW d AS (PARTITION BY date)),
 j AS (SELECT pool.code, close, {', '.join(f'coalesce(contribution_{n}, 0) AS contribution_{n}' for n in WEIGHTS)}, coalesce(score, 0) AS score, coalesce(coverage, 0) AS coverage, CASE WHEN dz.code IS NULL THEN 'missing_as_of_date' WHEN close IS NULL OR close <= 0 THEN 'invalid_close'
  WHEN Ifsuspend IS NULL THEN 'suspension_status_unknown' WHEN Ifsuspend <> 0 THEN 'suspended' WHEN coverage <= 0 THEN 'all_factors_missing' WHEN coverage + 1e-12 < 0.5 THEN 'insufficient_factor_coverage' ELSE '' END AS reason
  FROM pool LEFT JOIN dz ON dz.code = pool.code),
 k AS (SELECT *, reason = '' AS eligible, CASE WHEN reason = '' THEN row_number() OVER (PARTITION BY reason = '' ORDER BY score DESC, code) END AS rank FROM j)
 SELECT code, {', '.join(f"{rd(f'contribution_{n}')} AS contribution_{n}" for n in WEIGHTS)}, {rd('score')} AS score, {rd('coverage')} AS coverage, eligible, rank, coalesce(rank <= 10, false) AS selected, CASE WHEN rank > 10 THEN 'outside_top_n' ELSE reason END AS reason FROM k""")
def x5(spark, sf):
    pool = read(spark, sf, "supplier").select(zero_pad((F.col("s_suppkey") * 2).cast("string")).alias("code"))
    got = cp.asof_scores(weekly_panel(spark, sf), pool, fs.scoring_factors(), WEIGHTS, "2001-06-07", 10, 0.5)
    return out(got.withColumn("rank", F.col("rank").cast("bigint")), "code", "eligible", "rank", "selected", "reason", score="score", coverage="coverage",
               **{f"contribution_{n}": f"contribution_{n}" for n in WEIGHTS})


@query("X6", f"""WITH {FL}, dl AS (SELECT *, close - lag(close, 4) OVER {WC} AS d4, {full_sql(f'avg(close) OVER {wn(4)}', 'close', 4)} AS m4 FROM pw),
 rk AS (SELECT *, {rank_sql('d4')} AS rank_delta, (m4 - avg(m4) OVER (PARTITION BY date)) / nullif(stddev_pop(m4) OVER (PARTITION BY date), 0) AS z_mean,
  d4 - avg(d4) OVER (PARTITION BY date, sector) AS sector_gap, avg(d4) OVER (PARTITION BY date, sector) AS sector_mean FROM dl),
 r3 AS (SELECT *, {full_sql(f'avg(rank_delta) OVER {wn(3)}', 'rank_delta', 3)} AS mr FROM rk),
 xs AS (SELECT *, (mr - avg(mr) OVER (PARTITION BY date)) / nullif(stddev_pop(mr) OVER (PARTITION BY date), 0) AS z_mean_rank FROM r3),
 al AS (SELECT factor_id, value FROM fl UNION ALL SELECT unnest(['rank_delta', 'z_mean', 'sector_gap', 'z_mean_rank', 'label', 'damped', 'unchanged', 'sector_filled']),
  unnest([rank_delta, z_mean, sector_gap, z_mean_rank, volume, close, 1, last_value(coalesce(d4, sector_mean) IGNORE NULLS) OVER {wn(4)}]) FROM xs)
 SELECT factor_id, 'ok' AS status, count(*) AS row_count, count(value) AS valid_count, {rd('count(value)::DOUBLE / count(*)')} AS coverage FROM al GROUP BY factor_id
 UNION ALL SELECT unnest(['unknown_field', 'unknown_operator', 'too_few_inputs', 'wrong_argument']), 'error', 0, 0, NULL""")
def x6(spark, sf):
    from ..sources.sinks import materialize_factors
    stored = weekly_panel(spark, sf)
    panel = stored.df.withColumn("category_number", F.ascii("category").cast("double"))
    status = materialize_factors(panel, {**fs.demo_factors(), **fs.demo_cross_sections(), **fs.more_cross_sections(),
                                         "unknown_field": ts.ts_mean("no_such_field", 4), "unknown_operator": fs.Step("no_such_operator", ("close",)),
                                         "too_few_inputs": fs.Step("ts_mean", ("close",)),
                                         "wrong_argument": fs.Step("densify", ("close",), how={"levels": 3})}, stored.buckets)
    return out(status, "factor_id", "status", "row_count", "valid_count", coverage="coverage")


@query("X16", f"""WITH {PW}, dl AS (SELECT *, close - lag(close, 4) OVER {WC} AS d4 FROM pw), rk AS (SELECT *, {rank_sql('d4')} AS rank_delta FROM dl),
 r3 AS (SELECT *, {full_sql(f'avg(rank_delta) OVER {wn(3)}', 'rank_delta', 3)} AS mr, d4 - avg(d4) OVER (PARTITION BY date, sector) AS sector_gap FROM rk)
 SELECT date, code, {rd('rank_delta')} AS rank_delta, {rd('sector_gap')} AS sector_gap, {rd('(mr - avg(mr) OVER (PARTITION BY date)) / nullif(stddev_pop(mr) OVER (PARTITION BY date), 0)', 4)} AS z_mean_rank FROM r3""")
def x16(spark, sf):
    """Values of nested cross-sections (composition across X6's operators)."""
    stored = weekly_panel(spark, sf)
    got = fs.composed(stored.df, fs.demo_cross_sections(), buckets=stored.buckets)
    return got.select(*KEYS, r("rank_delta").alias("rank_delta"), r("sector_gap").alias("sector_gap"), r("z_mean_rank", 4).alias("z_mean_rank"))


@query("X7", f"""WITH {COND} SELECT category, {rd('avg(sc)')} AS score, count(DISTINCT factor_id) AS factor_count, {rd('avg(rank_ic_mean)')} AS mean_rank_ic, {rd('avg(icir)')} AS mean_icir
 FROM cmj WHERE state_id = 'A' AND split = 'train' AND sample_count >= 2 GROUP BY category""")
def x7(spark, sf):
    m = conditional(spark, sf).filter("state_id = 'A' AND split = 'train' AND sample_count >= 2")
    got = cp.category_scores(_categorized(spark, sf, m))
    return out(got, "category", "factor_count", score="score", mean_rank_ic="mean_rank_ic", mean_icir="mean_icir")


def _categorized(spark, sf, m):
    cat = catalog_of(spark, sf)
    return cp.with_catalog(m.join(cat.select("factor_id", F.col("own").alias("category")), "factor_id"), cat.drop("own"))


@query("A5", f"""WITH {COND} SELECT state_id, category, {rd('avg(sc)')} AS score, count(DISTINCT factor_id) AS factor_count, {rd('avg(rank_ic_mean)')} AS mean_rank_ic, {rd('avg(icir)')} AS mean_icir
 FROM (SELECT * EXCLUDE (category), catalog_category AS category FROM cmj) GROUP BY ALL""")
def a5(spark, sf):
    # Without a category of their own, uncatalogued factors stay in the NULL group.
    got = cp.category_scores(cp.with_catalog(conditional(spark, sf), catalog_of(spark, sf).drop("own")), by=("state_id",))
    return out(got, "state_id", "category", "factor_count", score="score", mean_rank_ic="mean_rank_ic", mean_icir="mean_icir")


# Greedy selection: candidates by state, conflicts from pooled rank correlations.
STATE_METRICS = f"{DP}, {STATES}, {SPLITS}, sm0 AS (SELECT factor_id, state_id, avg(rank_ic) AS rank_ic_mean, CASE WHEN count(ic) >= 2 THEN avg(ic) / nullif(stddev_samp(ic), 0) END AS icir, count(ic) AS sample_count FROM dp JOIN states USING (date) JOIN splits USING (date) WHERE split = 'train' GROUP BY ALL), cand0 AS (SELECT *, coalesce(rank_ic_mean, 0) * 0.7 + coalesce(icir, 0) * 0.3 AS sc FROM sm0 WHERE sample_count >= 10)"


def walk_sql(candidates, by, top_n, conflict):
    """SQL walk over candidates cw(by, factor_id, sc) with conflict pairs (a, b)."""
    return f"""cf AS ({conflict}), cw AS (SELECT {by} AS g, factor_id, sc, row_number() OVER (PARTITION BY {by} ORDER BY sc DESC, factor_id) AS i,
  coalesce((SELECT list(b) FROM cf WHERE a = factor_id), []) AS rivals FROM ({candidates})),
 walk AS (SELECT g, 0::BIGINT AS i, []::VARCHAR[] AS chosen FROM (SELECT DISTINCT g FROM cw) UNION ALL
  SELECT w.g, w.i + 1, CASE WHEN len(chosen) < {top_n} AND NOT list_has_any(chosen, rivals) THEN list_append(chosen, factor_id) ELSE chosen END FROM walk w JOIN cw ON cw.g = w.g AND cw.i = w.i + 1),
 picks AS (SELECT cw.g, cw.factor_id, cw.sc, list_contains(w.chosen, cw.factor_id) AS selected, CASE WHEN list_contains(w.chosen, cw.factor_id) THEN '' WHEN len(w.chosen) >= {top_n} THEN 'top_n_limit' ELSE 'mutual_correlation' END AS reason
  FROM cw JOIN walk w ON w.g = cw.g AND w.i = cw.i)"""


def both_ways(table, measure, test):
    return f"SELECT f1 AS a, f2 AS b FROM {table} WHERE {test} UNION ALL SELECT f2, f1 FROM {table} WHERE {test}"


X8_SQL = f"WITH RECURSIVE {STATE_METRICS}, {SPEAR}, {walk_sql('SELECT * FROM cand0', 'state_id', 3, both_ways('spear', 'spearman', 'abs(spearman) >= 0.2'))}"


def state_candidates(spark, sf):
    # Selection sees the training sessions only.
    daily = tagged_daily(spark, sf).filter("split = 'train'")
    m = ev.conditional_metrics(daily, ["factor_id", "state_id"]).filter("sample_count >= 10")
    return m.withColumn("selection_score", cp.selection_score())


def rivals(spark, sf):
    df = wide(spark, sf)
    return cp.conflicts(pr.pooled_spearman(df, SPEAR_NAMES), "spearman", 0.2)


def x8_picks(spark, sf):
    return cp.greedy_pick(state_candidates(spark, sf), rivals(spark, sf), ("state_id",), "selection_score", 3)


@query("X8", f"{X8_SQL} SELECT g AS state_id, factor_id, {rd('sc')} AS score, selected, reason FROM picks")
def x8(spark, sf):
    return out(x8_picks(spark, sf), "state_id", "factor_id", "selected", "reason", score="score")


@query("X9", f"{X8_SQL} SELECT g AS state_id, factor_id, {rd('1.0::DOUBLE / count(*) OVER (PARTITION BY g)')} AS weight FROM picks WHERE selected")
def x9(spark, sf):
    got = cp.equal_weights(x8_picks(spark, sf).filter("selected"), ("state_id",))
    return out(got, "state_id", "factor_id", weight="weight")


MUTUAL = f"""zl AS (SELECT date, code, unnest([{', '.join(f"'{n}'" for n in NAMES)}]) AS f, unnest([{', '.join(NAMES)}]) AS z FROM zw),
 md AS (SELECT a.f AS f1, b.f AS f2, a.date, {floored_sql('a.z', 'b.z')} AS ic FROM zl a JOIN zl b ON a.date = b.date AND a.code = b.code AND a.f < b.f GROUP BY ALL),
 mutual AS (SELECT f1, f2, avg(ic) AS mutual_ic FROM md GROUP BY f1, f2)"""


@query("X10", f"""WITH RECURSIVE {DP}, {Z.removeprefix(FW + ',')}, {MUTUAL}, m0 AS (SELECT 'pool' AS pool_id, factor_id, avg(ic) AS sc FROM dp GROUP BY factor_id),
 {walk_sql('SELECT * FROM m0', 'pool_id', 100, both_ways('mutual', 'mutual_ic', 'mutual_ic > 0.02'))} SELECT factor_id, {rd('sc')} AS score, selected, reason FROM picks""")
def x10(spark, sf):
    daily = performance(spark, sf)
    cands = daily.groupBy("factor_id").agg(F.avg("ic").alias("ic")).withColumn("pool_id", F.lit("pool"))
    df = zscores(spark, sf)
    pairs = cp.conflicts(pr.mutual_ic(df, NAMES), "mutual_ic", 0.02, signed=True)
    return out(cp.greedy_pick(cands, pairs, ("pool_id",), "ic", 100), "factor_id", "selected", "reason", score="score")


def descent_sql(names, alpha: float, sweeps: int) -> str:
    """Coordinate descent in SQL: a row for each step, which changes one weight."""
    k = len(names)
    sums = ", ".join([f"sum(w * {a} * {b}) / sum(w) AS m{i}_{j}" for i, a in enumerate(names) for j, b in enumerate(names)]
                     + [f"sum(w * {a} * yy) / sum(w) AS c{i}" for i, a in enumerate(names)])
    rest = {i: f"(c{i} - ({' + '.join(f'm{i}_{j} * b{j}' for j in range(k) if j != i)}))" for i in range(k)}
    moved = ", ".join(f"CASE WHEN step % {k} = {i} THEN sign({r}) * greatest(abs({r}) - {alpha / 2}::DOUBLE, 0) / m{i}_{i} ELSE b{i} END"
                      for i, r in rest.items())
    return f"""WITH RECURSIVE {Z}, y AS (SELECT *, coalesce((target - avg(target) OVER d) / nullif(stddev_pop(target) OVER d, 0), 0) AS yy, 1.0::DOUBLE / count(*) OVER d AS w
  FROM zw WHERE target IS NOT NULL WINDOW d AS (PARTITION BY date)), m AS MATERIALIZED (SELECT {sums} FROM y),
 it AS (SELECT 0 AS step, {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(k))} UNION ALL SELECT step + 1, {moved} FROM it, m WHERE step < {k * sweeps})
 SELECT unnest([{', '.join(f"'{n}'" for n in names)}]) AS factor_id, unnest([{', '.join(rd(f'b{i}') for i in range(k))}]) AS weight FROM it WHERE step = {k * sweeps}"""


@query("X11", descent_sql(NAMES, 0.001, 60))
def x11(spark, sf):
    weights = cp.l1_weights(zscores(spark, sf), NAMES, "target", 0.001)
    return out(spark.createDataFrame([(n, float(w)) for n, w in zip(NAMES, weights)], "factor_id string, weight double"), "factor_id", weight="weight")


def composite_sql(strategies):
    """SQL composite metrics cmx(strategy_id, ...) of strategies over z-scores zw."""
    names = ", ".join(f"'{n}'" for n in strategies)
    scores = ", ".join(dot(w) for w in strategies.values())
    pairs = "CASE WHEN target IS NOT NULL THEN score END AS px, CASE WHEN score IS NOT NULL THEN target END AS py"
    return f"""ss AS (SELECT unnest([{names}]) AS strategy_id, date, code, target, unnest([{scores}]) AS score FROM zw),
 sp AS (SELECT *, {pairs} FROM ss), srk AS (SELECT *, {rank_sql('px', 'strategy_id, date', False)} AS rx, {rank_sql('py', 'strategy_id, date', False)} AS ry FROM sp),
 sdd AS (SELECT strategy_id, date, count(*) AS n, count(px) AS pairs, {floored_sql('px', 'py')} AS ic, {floored_sql('rx', 'ry')} AS rank_ic FROM srk GROUP BY ALL),
 cmx AS (SELECT strategy_id, avg(ic) AS ic, avg(rank_ic) AS rank_ic, avg(ic) / greatest(stddev_pop(ic), 1e-6) AS icir, sum(pairs)::DOUBLE / sum(n) AS coverage FROM sdd GROUP BY strategy_id)"""


def scored(spark, sf, strategies):
    df = zscores(spark, sf)
    return cp.strategy_scores(df, strategies, keep=(*KEYS, "target"))


POOL, TRIALS = ("mom4", "rev1"), ("vol8", "liq4", "rng")
MARGINAL = cp.marginal_strategies(POOL, TRIALS)


@query("X12", f"""WITH {Z}, {composite_sql(MARGINAL)} SELECT c.strategy_id AS factor_id, {', '.join(f'{rd(f"c.{m} - b.{m}")} AS {m}' for m in ('ic', 'rank_ic', 'icir', 'coverage'))},
 c.ic - b.ic >= 0 AND c.rank_ic - b.rank_ic >= 0.001 AS passed FROM cmx c, cmx b WHERE b.strategy_id = 'base' AND c.strategy_id <> 'base'""")
def x12(spark, sf):
    rows = scored(spark, sf, MARGINAL)
    m = ev.composite_metrics(rows, "score", "target", ("strategy_id",))
    whole = Window.partitionBy()      # one row per trial
    names = ("ic", "rank_ic", "icir", "coverage")
    base = {n: F.max(F.when(F.col("strategy_id") == "base", F.col(n))).over(whole) for n in names}
    delta = m.select(F.col("strategy_id").alias("factor_id"), *[(F.col(n) - base[n]).alias(n) for n in names]).filter("factor_id <> 'base'")
    return out(delta.withColumn("passed", (F.col("ic") >= 0) & (F.col("rank_ic") >= 0.001)), "factor_id", "passed", **{n: n for n in names})


SWEEP = cp.prefix_strategies(list(NAMES), (1, 2, 3, 4, 5))
ACCOUNTS = accounts_sql().replace("FROM sg JOIN", "FROM sg JOIN")


@query("X13", f"""WITH {Z}, {composite_sql(SWEEP)}, sg AS (SELECT strategy_id, date, code, score FROM ss), {ACCOUNTS}, {SUM_SQL}
 SELECT su.strategy_id, {rd('ic')} AS ic, {rd('rank_ic')} AS rank_ic, {rd('icir')} AS icir, {rd('total_return')} AS total_return, {rd('su.sharpe')} AS sharpe FROM su JOIN cmx USING (strategy_id)""")
def x13(spark, sf):
    # Metrics and accounts read the same z-scores, which are stored once.
    df = cut(zscores(spark, sf).select(*KEYS, "target", *NAMES), "zscores")
    rows = cp.strategy_scores(df, SWEEP, keep=(*KEYS, "target"))
    m = ev.composite_metrics(rows, "score", "target", ("strategy_id",)).drop("coverage")
    perf = pf.summary(pf.account(rows.select("strategy_id", *KEYS, "score"), market(spark, sf), K, FEE))
    return out(m.join(perf, "strategy_id"), "strategy_id", **{n: n for n in ("ic", "rank_ic", "icir", "total_return", "sharpe")})


GRID = {f"w{i}{j}": {"mom4": i / 4, "rev1": j / 4, "rng": (4 - i - j) / 4} for i in range(3) for j in range(3)}


@query("X14", f"""WITH {Z}, {composite_sql(GRID)}, sg AS (SELECT strategy_id, date, code, score FROM ss), {ACCOUNTS}, ob AS (SELECT strategy_id, {OBJ} AS objective FROM ac GROUP BY strategy_id)
 SELECT strategy_id, {rd('objective')} AS objective, row_number() OVER (ORDER BY {rd('objective')} DESC, strategy_id) = 1 AS best FROM ob""")
def x14(spark, sf):
    rows = scored(spark, sf, GRID)
    daily = pf.account(rows.select("strategy_id", *KEYS, "score"), market(spark, sf), K, FEE)
    ob = daily.groupBy("strategy_id").agg(pf.growth_objective("net_return").alias("objective"))
    place = F.row_number().over(Window.orderBy(r("objective").desc(), "strategy_id"))   # one row per vector; ties on the grid
    return out(ob.withColumn("best", place == 1), "strategy_id", "best", objective="objective")


@query("J13", f"""WITH {Z}, {composite_sql(GRID)} SELECT strategy_id, date, count(*) AS n, {rd('max(score)')} AS hi, {rd('min(score)')} AS lo FROM ss GROUP BY ALL""")
def j13(spark, sf):
    rows = scored(spark, sf, GRID)
    got = rows.groupBy("strategy_id", "date").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("hi"), F.min("score").alias("lo"))
    return out(got, "strategy_id", "date", "n", hi="hi", lo="lo")


CATEGORIES = {"mom4": "trend", "rev1": "trend", "vol8": "volatility", "liq4": "price", "rng": "price"}
CAT_SQL = "CASE factor_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORIES.items()) + " END"


@query("X15", f"""WITH RECURSIVE {STATE_METRICS}, {SPEAR}, cc AS (SELECT *, {CAT_SQL} AS category FROM cand0 WHERE state_id = 'bull'),
 bc AS (SELECT category FROM cc GROUP BY category ORDER BY avg(sc) DESC, category LIMIT 1),
 {walk_sql("SELECT * FROM cc WHERE category IN (FROM bc)", 'category', 3, both_ways('spear', 'spearman', 'abs(spearman) >= 0.2'))}
 SELECT g AS category, factor_id, {rd('1.0::DOUBLE / count(*) OVER (PARTITION BY g)')} AS weight FROM picks WHERE selected""")
def x15(spark, sf):
    got = cp.pick_for_state(state_candidates(spark, sf), CATEGORIES, rivals(spark, sf), "bull", 3)
    return out(got, "category", "factor_id", weight="weight")
