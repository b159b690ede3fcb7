"""Places in an order, for groups of any size, by one route.

A group is cut into ranges of about ``ROWS_PER_RANGE`` rows, as many as its size asks for (one, for most groups), and
a row's place is its place in its range plus the rows of the ranges before. Rows are shuffled and sorted once, by group
and range. The cuts of larger groups come from a sample of their rows, and a value that alone fills a good part of a range
is a cut of its own, whose rows get their place from its count and are spread over tasks. Counts of rows by hash tell
which values may be that frequent; all rows of a range are counted, so that places never rest on the sample. Rows without a value, or with a NULL in their key,
have no place and are spread as well. Cuts are at most ``MOST_CUTS`` for a table of any size, which is why they are
broadcast.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

ROWS_PER_RANGE = 1_000_000
STRIDE = 16               # sampled values to a cut
MOST_CUTS = 200_000       # beyond that many the ranges get longer


def _temp(name: str) -> str:
    return f"__{name}_{uuid.uuid4().hex[:6]}"


def _searched(df: DataFrame, cuts: str, value: Column, out: str, most: int) -> DataFrame:
    """Add the number of cuts (of ``most`` at most) at or below the value. One projection for each step: these are
    compiled with the join before them, so that no row ever holds a copy of the cuts."""
    df = df.withColumn(out, F.lit(0))
    for i in reversed(range(most.bit_length())):
        here = F.get(F.col(cuts), F.col(out) + F.lit((1 << i) - 1))["x"]
        df = df.withColumn(out, F.when(here <= value, F.col(out) + F.lit(1 << i)).otherwise(F.col(out)))
    return df


def _most_cuts(cuts: DataFrame) -> int:
    return cuts.agg(F.max(F.size("cuts"))).first()[0] or 0


def large_groups(df: DataFrame, by, rows_per_range: int | None = None) -> DataFrame | None:
    """Keys and number of rows of the groups of more rows than a range may have (limit). The count needs no values, and
    one row of it comes to the driver: where no group is that large, plans hold nothing about cuts."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    most, total = sizes.agg(F.max("rows"), F.sum("rows")).first()
    # A fifth of the cuts come from the sample, the others from values that fill a quarter of a range.
    limit = max(rows_per_range or ROWS_PER_RANGE, (total or 0) * 5 // MOST_CUTS)
    return sizes.filter(F.col("rows") > limit).withColumn("limit", F.lit(limit)) if (most or 0) > limit else None


def ranges(df: DataFrame, by, x: str, large: DataFrame, dense: bool = True) -> DataFrame:
    """For the large groups their keys, cuts (x, ties if x is a range of its own, rows and, if ``dense``, values before it)
    and rows with a value (n). Rows are only counted: a value may be frequent if the rows of its hash are, and only such
    values are told apart, so that nothing as large as the values is shuffled unless ``dense`` asks for it."""
    rows = df.select(*by, F.col(x).alias("x")).filter(F.col("x").isNotNull()).join(F.broadcast(large), by)
    slot = F.pmod(F.xxhash64("x"), F.ceil(F.col("rows") * 64 / F.col("limit")))
    full = rows.groupBy(*by, slot.alias("slot")).agg(F.count(F.lit(1)).alias("held"), F.first("limit").alias("limit")).filter(
        F.col("held") * 4 > F.col("limit")).select(*by, "slot")
    alone = rows.withColumn("slot", slot).join(F.broadcast(full), [*by, "slot"], "left_semi").groupBy(*by, "limit", "x").agg(
        F.count(F.lit(1)).alias("ties")).filter(F.col("ties") * 4 > F.col("limit")).select(*by, "x", "ties")
    picks = rows.filter(F.rand(7) < F.lit(float(STRIDE)) / F.col("limit")).select(*by, "x", F.lit(0).cast("bigint").alias("ties"))
    lists = alone.unionByName(picks).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("x", "ties"))).alias("all"))
    some = F.filter("all", lambda e: e["ties"] == 0)
    own = F.filter("all", lambda e: e["ties"] > 0)
    apart = F.transform("own", lambda e: e["x"])
    cuts = lists.select(*by, some.alias("some"), own.alias("own")).select(*by, F.sort_array(F.concat("own", F.array_distinct(
        F.filter("some", lambda e, i: (i > 0) & (i % STRIDE == 0) & ~F.array_contains(apart, e["x"]))))).alias("cuts"))
    cuts = cut(cuts, "cuts")        # the sample is drawn once
    most = _most_cuts(cuts)
    held = rows.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("ties")) if dense else rows.withColumn("ties", F.lit(1).cast("bigint"))
    totals = _searched(held.join(F.broadcast(cuts), by), "cuts", F.col("x"), "at", most).groupBy(*by, "at").agg(
        F.sum("ties").alias("rows"), F.count(F.lit(1)).alias("values"))
    # One row for each range: at most MOST_CUTS and one more for each large group.
    past = Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"{c}_before") for c in ("rows", "values")]
    sums = totals.select(*by, "at", "rows", *before).groupBy(*by).agg(
        F.sum("rows").alias("n"), F.map_from_entries(F.collect_list(F.struct("at", F.struct(
            "rows_before", "values_before")))).alias("sums"))
    return cuts.join(sums, by).select(*by, "n", F.transform("cuts", lambda e, i: F.struct(
        e["x"].alias("x"), e["ties"].alias("ties"), F.col("sums")[i + 1]["rows_before"].alias("rows"),
        F.col("sums")[i + 1]["values_before"].alias("values"))).alias("cuts"))


def places(df: DataFrame, x: str, by=(), rows_per_range: int | None = None, **names: str) -> DataFrame:
    """``df`` with what ``names`` ask for, under the given names: ``place`` (mean place of the ties, from 1), ``size``
    (rows of the group with a value), ``ties`` (rows with this value) and ``dense`` (different values up to this one)."""
    return placed(df, {x: names}, by, rows_per_range)


def placed(df: DataFrame, names: dict[str, dict[str, str]], by=(), rows_per_range: int | None = None, alike: bool = False) -> DataFrame:
    """``places`` of several columns (column: names) in the same groups, which are counted once. With ``alike`` they are NULL
    on the same rows, which are then shuffled once unless groups are large."""
    whole = _temp("whole")
    by, rows = list(by), df
    if not by:
        df, by = df.withColumn(whole, F.lit(0)), [whole]
        rows = df
    large = large_groups(rows, by, rows_per_range)
    if large is None and alike:
        span = _temp("span")
        df = df.withColumn(span, _span(next(iter(names)), by))
        for x, asked in names.items():
            df = _ordered(df, x, by, span, asked)
        return df.drop(span, whole)
    for x, asked in names.items():
        df = _placed(df, x, by, None if large is None else cut(ranges(rows, by, x, large, "dense" in asked), "ranges"), asked)
    return df.drop(whole)


def _known(x: str, by: list) -> Column:
    known = F.col(x).isNotNull()
    for key in by:
        known = known & F.col(key).isNotNull()
    return known


def _span(x: str, by: list) -> Column:
    """0, and for rows without a place the task they are in."""
    return F.when(_known(x, by), 0).otherwise(-1 - F.spark_partition_id())


def _ordered(df: DataFrame, x: str, by: list, span: str, names: dict[str, str]) -> DataFrame:
    """Places in groups that are one range."""
    line = Window.partitionBy(*by, span).orderBy(F.col(x).asc_nulls_last())
    first, last = F.rank().over(line), F.count(x).over(line.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    made = {"place": (first + last) / F.lit(2.0), "ties": last - first + 1, "dense": F.dense_rank().over(line),
            "size": F.count(x).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}
    return df.withColumns({name: F.when(_known(x, by), made[k]) for k, name in names.items()})


def _placed(df: DataFrame, x: str, by: list, large: DataFrame | None, names: dict[str, str]) -> DataFrame:
    n, cuts, at, here, span = (_temp(t) for t in ("n", "cuts", "at", "cut", "span"))
    if large is None:
        return _ordered(df.withColumn(span, _span(x, by)), x, by, span, names).drop(span)
    known, spread = _known(x, by), -1 - F.spark_partition_id()
    out = df.join(F.broadcast(large.withColumnsRenamed({"n": n, "cuts": cuts})), by, "left")
    out = _searched(out, cuts, F.when(known, F.col(x)), at, _most_cuts(large))
    out = out.withColumn(here, F.get(F.col(cuts), F.col(at) - 1)).drop(cuts)
    alone = (F.col(f"{here}.ties") > 0) & (F.col(f"{here}.x") == F.col(x))
    out = out.withColumn(span, F.when(known & ~F.coalesce(alone, F.lit(False)), F.col(at)).otherwise(spread))
    line = Window.partitionBy(*by, span).orderBy(F.col(x).asc_nulls_last())
    first, last = F.rank().over(line), F.count(x).over(line.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    inside = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    past = lambda c: F.coalesce(F.col(f"{here}.{c}"), F.lit(0))
    single = F.coalesce(alone, F.lit(False))
    made = {
        "place": F.when(single, past("rows") + (past("ties") + 1) / F.lit(2.0)).otherwise(
            past("rows") + past("ties") + (first + last) / F.lit(2.0)),
        "size": F.coalesce(F.col(n), F.count(x).over(inside)),
        "ties": F.when(single, past("ties")).otherwise(last - first + 1),
        "dense": F.when(single, past("values") + 1).otherwise(
            past("values") + (past("ties") > 0).cast("int") + F.dense_rank().over(line))}
    return out.withColumns({name: F.when(known, made[k]) for k, name in names.items()}).drop(n, at, here, span)
