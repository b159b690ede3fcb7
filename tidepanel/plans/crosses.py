"""Cross-sectional operators, per date and per date and group."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeseries as ts
from ..operators import cross
from ..sources.panel import weekly_panel
from . import query
from .common import KEYS, PW, WC, out, r, rank_sql, rd, wn

MOM = f"WITH {PW}, b AS (SELECT *, close / lag(close, 4) OVER {WC} - 1 AS x, Ifsuspend = 0 AS eligible FROM pw)"
STATS = f"{MOM}, s AS (SELECT *, avg(x) OVER d AS mu, stddev_pop(x) OVER d AS sd FROM b WINDOW d AS (PARTITION BY date))"


def mom(spark, sf):
    p = weekly_panel(spark, sf)
    df = p.df.withColumns({"x": F.col("close") / ts.delay("close", 4) - 1,
                           "eligible": F.col("Ifsuspend") == 0})
    return df


def register(key, sql, apply):
    """An operator from ``x`` to ``z`` over the weekly momentum panel."""
    @query(key, sql)
    def run(spark, sf):
        df = mom(spark, sf)
        return out(apply(df), *KEYS, z="z")
    return run


register("C1", f"{MOM} SELECT date, code, {rd(rank_sql('x'))} AS z FROM b",
         lambda df: cross.rank(df, "x", "z"))
register("C2", f"{MOM}, e AS (SELECT *, CASE WHEN eligible THEN x END AS ex FROM b)"
               f" SELECT date, code, {rd(rank_sql('ex'))} AS z FROM e",
         lambda df: cross.eligible_rank(df, "x", "z"))
register("C3", f"{STATS} SELECT date, code, {rd('(x - mu) / nullif(sd, 0)')} AS z FROM s",
         lambda df: cross.zscore(df, "x", "z"))
register("C4", f"{STATS} SELECT date, code, {rd('coalesce((x - mu) / nullif(sd, 0), 0)')} AS z FROM s",
         lambda df: cross.zscore_filled(df, "x", "z"))


@query("C5", f"""{MOM}, e AS (SELECT *, CASE WHEN eligible THEN x END AS ex FROM b)
 SELECT date, code, {rd("coalesce((ex - avg(ex) OVER d) / greatest(stddev_pop(ex) OVER d, 1e-12), 0)")} AS z,
 ex IS NULL AS missing FROM e WINDOW d AS (PARTITION BY date)""")
def c5(spark, sf):
    df = mom(spark, sf)
    df = cross.zscore_scored(df, "x", "z", "missing")
    return out(df, *KEYS, "missing", z="z")


@query("C6", f"""{STATS} SELECT date, code, {rd('x - mu')} AS centered, {rd('(x - mu) / nullif(sd, 0)')} AS scaled,
 {rd('CASE WHEN x IS NOT NULL THEN greatest(least(x - mu, 0.3), -0.3) END')} AS clipped FROM s""")
def c6(spark, sf):
    df = mom(spark, sf)
    df = cross.normalize(df, "x", "centered")
    df = cross.normalize(df, "x", "scaled", use_std=True)
    df = cross.normalize(df, "x", "clipped", limit=0.3)
    return out(df, *KEYS, centered="centered", scaled="scaled", clipped="clipped")


@query("C7", f"""{MOM}, s AS (SELECT *, sum(abs(x)) OVER d AS gross, sum(greatest(x, 0)) OVER d AS lo,
  sum(-least(x, 0)) OVER d AS sh FROM b WINDOW d AS (PARTITION BY date))
 SELECT date, code, {rd('x / nullif(gross, 0)')} AS whole,
 {rd('CASE WHEN coalesce(sh, 0) = 0 THEN greatest(x, 0) / nullif(lo, 0) * 2 ELSE coalesce(greatest(x, 0) / nullif(lo, 0) * 2, 0) + coalesce(least(x, 0) / nullif(sh, 0) * 0.5, 0) END')} AS sides
 FROM s""")
def c7(spark, sf):
    df = mom(spark, sf)
    df = cross.scale(df, "x", "whole")
    df = cross.scale(df, "x", "sides", long_size=2.0, short_size=0.5)
    return out(df, *KEYS, whole="whole", sides="sides")


register("C8", f"{STATS} SELECT date, code, {rd('CASE WHEN x IS NOT NULL THEN greatest(least(x, mu + 1.5 * sd), mu - 1.5 * sd) END')} AS z FROM s",
         lambda df: cross.winsorize(df, "x", "z", 1.5))


def _horner(t, coefficients):
    text = repr(coefficients[0])
    for k in coefficients[1:]:
        text = f"({text} * {t} + {k!r})"
    return text


def probit_sql(p: str) -> str:
    from ..functions import probit as ps
    q = f"({p} - 0.5::DOUBLE)"
    t = f"(0.180625::DOUBLE - {q} * {q})"
    tail = f"(sqrt(-ln(least({p}, 1.0 - {p}))) - 1.6::DOUBLE)"
    return (f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {_horner(t, ps.CENTRAL_NUM)} / {_horner(t, ps.CENTRAL_DEN)}"
            f" ELSE sign({q}) * {_horner(tail, ps.TAIL_NUM)} / {_horner(tail, ps.TAIL_DEN)} END")


@query("C9", f"""{MOM}, k AS (SELECT *, {rank_sql('x')} AS k0 FROM b),
 c AS (SELECT *, CASE WHEN k0 IS NOT NULL THEN greatest(least(k0, 1 - 1e-6), 1e-6) END AS k FROM k)
 SELECT date, code, {rd(probit_sql('k'))} AS gaussian, {rd('k - 0.5')} AS uniform,
 {rd('tan(pi() * (k - 0.5)) * 0.1', 3)} AS cauchy FROM c""")
def c9(spark, sf):
    df = mom(spark, sf)
    df = cross.quantile(df, "x", "gaussian")
    df = cross.quantile(df, "x", "uniform", "uniform")
    df = cross.quantile(df, "x", "cauchy", "cauchy", 0.1)
    return df.select(*KEYS, r("gaussian").alias("gaussian"), r("uniform").alias("uniform"),
                     r("cauchy", 3).alias("cauchy"))


@query("C10", f"""WITH {PW} SELECT date, code, (dense_rank() OVER (ORDER BY industry) - 1)::DOUBLE AS label,
 (dense_rank() OVER (ORDER BY volume) - 1)::DOUBLE AS level FROM pw""")
def c10(spark, sf):
    df = cross.densify(weekly_panel(spark, sf).df, "industry", "label")
    return cross.densify(df, "volume", "level").select(*KEYS, "label", "level")


@query("C11", f"""{MOM} SELECT date, {rd('coalesce(count(x) FILTER (eligible) / nullif(count(*) FILTER (eligible), 0), 1)')} AS coverage,
 (count(*) FILTER (eligible) > 0 AND (count(x) FILTER (eligible) < 2 OR coalesce(stddev_pop(x) FILTER (eligible), 0) < 1e-12)) AS degenerate
 FROM b GROUP BY date""")
def c11(spark, sf):
    from ..operators.evaluate import day_quality
    df = mom(spark, sf)
    return out(day_quality(df, "x"), "date", "degenerate", coverage="coverage")


register("G1", f"{MOM} SELECT date, code, {rd(rank_sql('x', 'date, sector'))} AS z FROM b",
         lambda df: cross.rank(df, "x", "z", by=("date", "sector")))
register("G2", f"{MOM} SELECT date, code, {rd('x - avg(x) OVER (PARTITION BY date, sector)')} AS z FROM b",
         lambda df: cross.group_neutralize(df, "x", "sector", "z"))
register("G3", f"{MOM} SELECT date, code, {rd('(x - avg(x) OVER g) / nullif(stddev_pop(x) OVER g, 0)')} AS z FROM b WINDOW g AS (PARTITION BY date, sector)",
         lambda df: cross.zscore(df, "x", "z", by=("date", "sector")))
register("G4", f"{MOM} SELECT date, code, {rd('x / nullif(sum(abs(x)) OVER g, 0) * 10')} AS z FROM b WINDOW g AS (PARTITION BY date, sector)",
         lambda df: cross.group_scale(df, "x", "sector", "z", 10.0))
register("G5", f"{MOM} SELECT date, code, {rd('coalesce(sum(x * volume) OVER g, 0) / nullif(sum(volume) OVER g, 0)')} AS z FROM b WINDOW g AS (PARTITION BY date, sector)",
         lambda df: cross.group_mean(df, "x", "volume", "sector", "z"))


@query("G6", f"""{MOM}, s AS (SELECT *, CASE WHEN Ifsuspend = 0 THEN x END AS v FROM b),
 m AS (SELECT *, avg(v) OVER d AS mu, stddev_pop(v) OVER d AS sd FROM s WINDOW d AS (PARTITION BY date)),
 w AS (SELECT *, CASE WHEN v IS NOT NULL THEN greatest(least(v, mu + 2 * sd), mu - 2 * sd) END AS wv FROM m),
 f AS (SELECT *, coalesce(v, avg(wv) OVER (PARTITION BY date, industry)) AS fv FROM w)
 SELECT date, code, {rd(f"last_value(fv IGNORE NULLS) OVER {wn(4)}")} AS z FROM f""")
def g6(spark, sf):
    df = mom(spark, sf)
    df = df.withColumn("v", F.when(F.col("Ifsuspend") == 0, F.col("x")))
    df = cross.group_backfill(df, "v", "industry", "f", 3, 2.0)
    return out(df, *KEYS, z="f")
