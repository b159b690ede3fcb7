"""Filters, reasons, thresholds, rankings and set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clean import c
from .order import places


def universe(panel: DataFrame, category: str | None = None, min_amount: float | None = None,
             min_listed_days: int = 0) -> DataFrame:
    """Listed, traded rows of a category; NULL fails every test."""
    keep = (F.col("Ifsuspend") == 0) & (F.col("volume") > 0)
    if category is not None:
        keep = keep & (F.lower("category") == category.lower())
    if min_amount is not None:
        keep = keep & (F.col("amount") >= min_amount)
    if min_listed_days > 0:
        keep = keep & (F.datediff("date", "ListedDate") >= min_listed_days)
    return panel.filter(keep)


def selection_window(panel: DataFrame, start, stop, min_listed_days: int = 0) -> DataFrame:
    """Rows usable for pool selection: unknown suspension counts as suspended and an
    unknown amount or volume as zero."""
    keep = (F.col("date").between(start, stop)
            & (F.coalesce(F.col("Ifsuspend"), F.lit(1.0)) == 0)
            & (F.coalesce(F.col("volume"), F.lit(0.0)) > 0)
            & (F.coalesce(F.col("amount"), F.lit(0.0)) > 0))
    if min_listed_days > 0:
        keep = keep & (F.datediff("date", "ListedDate") >= min_listed_days)
    return panel.filter(keep)


def tradable() -> Column:
    return (F.coalesce(F.col("Ifsuspend"), F.lit(0.0)) == 0) & (F.coalesce(F.col("open"), F.lit(0.0)) > 0)


def unlimited(flag: str) -> Column:
    """No limit move by that flag: a stock at its upper limit cannot be bought, one at
    its lower limit cannot be sold. A missing flag is no limit."""
    return F.coalesce(F.col(flag), F.lit(0.0)) != 1


def within(bounds: dict[str, tuple], members: dict[str, list] | None = None) -> Column:
    """Inclusive ranges and member lists; NULL fails."""
    keep = F.lit(True)
    for name, (low, high) in bounds.items():
        keep = keep & F.col(name).isNotNull()
        if low is not None:
            keep = keep & (F.col(name) >= low)
        if high is not None:
            keep = keep & (F.col(name) <= high)
    for name, values in (members or {}).items():
        keep = keep & F.coalesce(F.col(name).isin(values), F.lit(False))
    return keep


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first check that holds, '' if none; a NULL check does not hold."""
    value = None
    for name, test in checks:
        value = F.when(test, name) if value is None else value.when(test, name)
    return value.otherwise("")


def selection_reason(close: Column, suspended: Column, coverage: Column, score: Column, min_coverage: float,
                     seen: Column | None = None) -> Column:
    """Why a code cannot be selected on a day: the first of seven reasons, '' if none holds. ``seen`` says whether the
    day has a row of the code at all (else a missing close says that it has none)."""
    return first_reason([
        ("missing_as_of_date", close.isNull() if seen is None else ~seen),
        ("invalid_close", close.isNull() | (close <= 0)), ("suspension_status_unknown", suspended.isNull()),
        ("suspended", suspended != 0), ("all_factors_missing", coverage <= 0),
        ("insufficient_factor_coverage", coverage + 1e-12 < min_coverage),
        ("invalid_score", score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")))])


def pass_minima(minima: dict[str, float]) -> Column:
    """All metrics at or above their minimum; a missing metric fails."""
    keep = F.lit(True)
    for name, low in minima.items():
        keep = keep & F.coalesce(F.col(name) >= low, F.lit(False))
    return keep


def acceptance(coverage: dict[str, Column], ics: dict[str, tuple[Column, float]], min_coverage: float,
               icir: Column, min_icir: float) -> Column:
    """Reason for rejecting a factor from its split metrics, '' if accepted."""
    def weak(value, floor):
        return F.coalesce(F.abs(value) < floor, F.lit(True))
    train_ic, floor = ics["train"]
    checks = [("train coverage", coverage["train"] < min_coverage), ("train IC", weak(train_ic, floor)),
              ("train ICIR", weak(icir, min_icir))]
    for split in ("valid", "test"):
        value, floor = ics[split]
        checks += [(f"{split} coverage", coverage[split] < min_coverage), (f"{split} IC", weak(value, floor))]
    return first_reason(checks)


def top_k(df: DataFrame, score: str, k: int, by=("date",), tie: str = "code", place: str = "rank") -> DataFrame:
    """Best k rows per group; Spark limits each partition before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie).asc())
    return (df.filter(F.col(score).isNotNull()).withColumn(place, F.row_number().over(w))
            .filter(F.col(place) <= k))


def ranking(df: DataFrame, score: str, top_n: int, by=(), tie: str = "code") -> DataFrame:
    """Eligible rows first by score, with rank, selected flag and outside_top_n reason.

    ``eligible`` and ``reason`` are columns of ``df``. A date with a very large universe is
    ranked in ranges and is no single task.
    """
    key = F.when(F.col("eligible"), F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t")))
    df = places(df.withColumn("_key", key), "_key", by, place="rank").drop("_key")
    return _selected(df.withColumn("rank", F.col("rank").cast("int")), top_n)


def _selected(out: DataFrame, top_n: int) -> DataFrame:
    selected = F.coalesce(F.col("eligible") & (F.col("rank") <= top_n), F.lit(False))
    return out.withColumns({"selected": selected, "reason": F.when(
        F.col("eligible") & ~selected, "outside_top_n").otherwise(F.col("reason"))})


def liquid_pool(panel: DataFrame, start, stop, min_coverage: float, min_listed_days: int = 0) -> DataFrame:
    """Mean amount, valid rows and coverage per code in the selection window."""
    days = panel.filter(F.col("date").between(start, stop)).agg(F.countDistinct("date")).scalar()
    rows = selection_window(panel, start, stop, min_listed_days)
    stats = rows.groupBy("code").agg(
        (F.sum(F.col("amount").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("average_amount"),
        F.count(F.lit(1)).alias("valid_rows"))
    return (stats.withColumn("coverage", F.col("valid_rows") / days)
            .filter(F.col("valid_rows") >= F.ceil(days * F.lit(min_coverage))))


def top_pool(stats: DataFrame, n: int) -> DataFrame:
    """The n codes with the largest mean amount; the plan fails if there are fewer."""
    best = stats.orderBy(F.col("average_amount").desc(), F.col("code").asc()).limit(n)
    have = best.agg(F.count(F.lit(1))).scalar()
    return best.filter(F.assert_true(
        have == n, F.lit(f"fewer than {n} codes met the pool rules")).isNull())


def best_checkpoint(df: DataFrame, objective: str, batch: str, by=()) -> DataFrame:
    """Row of the largest objective, the earliest batch on ties: first the earliest row of each objective, then the
    largest objective of those. Both keys are numbers, so that numeric columns stay in hash aggregation."""
    rest = [x for x in df.columns if x not in (*by, objective, batch)]
    first = df.filter(F.col(objective).isNotNull()).groupBy(*by, objective).agg(
        F.min(batch).alias(batch), *[F.min_by(x, batch).alias(x) for x in rest])
    return first.groupBy(*by).agg(F.max(objective).alias("_best"), *[
        F.max_by(x, objective).alias(x) for x in (batch, *rest)]).withColumnRenamed("_best", objective).select(*df.columns)


def keep_incumbent(df: DataFrame, utility: str, incumbent: Column, delta: float, by) -> DataFrame:
    """Best utility against the incumbent's: a change needs more than ``delta``."""
    best = F.max(utility)
    inc = F.max(F.when(incumbent, F.col(utility)))
    return df.groupBy(*by).agg(
        inc.alias("incumbent_utility"), best.alias("best_utility"),
        F.coalesce(best > inc + delta, F.lit(False)).alias("changed"))


def ordered(df: DataFrame, metric: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(metric).desc_nulls_last(), F.col(tie).asc())


def head_tail(df: DataFrame, by, order: str, n: int) -> DataFrame:
    """First and last n rows of each (calendar-bounded) group."""
    up = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).asc()))
    down = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc()))
    return (df.withColumns({"from_head": up, "from_tail": down})
            .filter((F.col("from_head") <= n) | (F.col("from_tail") <= n)))


def keep_last(df: DataFrame, keys, seq: str) -> DataFrame:
    """Latest version of each key. ``max_by`` combines map-side, so a key repeated very
    often shrinks before the shuffle (a row_number window would not). All columns of a
    group follow the same row; with a numeric ``seq`` and numeric columns the hash
    aggregate needs no sort."""
    rest = [x for x in df.columns if x not in keys]
    return df.groupBy(*keys).agg(*[F.max_by(x, seq).alias(x) for x in rest]).select(*keys, *rest)


def with_fallback(left: DataFrame, extra: DataFrame, key: str, other: str, columns) -> DataFrame:
    """Extra metrics by key, else by a second key; present values win over old ones."""
    a = extra.select(F.col(key), *[F.col(x).alias(f"_a_{x}") for x in columns], F.lit(True).alias("_hit"))
    b = keep_last(extra.filter(F.col(other).isNotNull()), [other], key).select(
        F.col(other), *[F.col(x).alias(f"_b_{x}") for x in columns])
    df = left.join(a, key, "left").join(b, other, "left")
    for x in columns:
        found = F.when(F.col("_hit"), F.col(f"_a_{x}")).otherwise(F.col(f"_b_{x}"))
        df = df.withColumn(x, F.coalesce(found, F.col(x)) if x in left.columns else found)
    return df.drop("_hit", *[f"_a_{x}" for x in columns], *[f"_b_{x}" for x in columns])
