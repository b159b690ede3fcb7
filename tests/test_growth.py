"""What plans shuffle and hold must follow the input."""

import random

import pandas as pd
import pytest

from pyspark.sql import functions as F

from tidepanel.functions.clean import ratio
from tidepanel.operators import evaluate as ev, order, pairs
from tidepanel.sources.panel import price_panel

SCHEMA = "day string, who string, price double, n long, m int, flag double"


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def facts(table):
    draw = random.Random(3)
    rows = [(f"2024-01-{draw.randrange(1, 5):02d}", f"{draw.randrange(40)}", draw.choice([None, 1.0, 2.0, 3.5]),
             draw.choice([None, *range(50)]), draw.randrange(3), float(draw.randrange(2))) for _ in range(600)]
    df = table([*rows, *rows[:9], (None, "1", 1.0, 1, 1, 1.0)], SCHEMA)
    return df.withColumn("day", F.col("day").cast("timestamp"))


def made(df, buckets):
    return price_panel(df, F.col("day"), F.col("who"), ratio("price", F.lit(2.0)), ((F.col("n"), 12), (F.col("m"), 1)),
                       {"flag_last": F.col("flag")}, {"rows": F.count(F.lit(1))}, buckets)


def test_panels_by_code_equal_combined_ones(table):
    df = facts(table)
    # The order leaves ties between equal numbers, which both routes may break in their own way.
    alone = df.groupBy("day", "who", "n", "m").count().filter("count = 1").drop("count")
    df = df.join(alone, ["day", "who", "n", "m"])
    columns = ["date", "code", "open", "close", "high", "low", "flag_last", "rows"]
    one, two = (sorted(map(repr, made(df, b).select(columns).collect())) for b in (4, None))
    assert one == two and len(one) > 50


def test_panels_shuffle_facts_once(table):
    assert shuffles(made(facts(table), 4)) == 1


def test_pair_ranks_share_a_shuffle(table):
    df = table([("2024-01-01", float(i % 7), float(i % 5)) for i in range(40)], "date string, value double, target double")
    assert shuffles(ev.with_pair_ranks(df, "value", "target", ("date",))) == 1


def test_ranges_are_found_without_copies_of_the_cuts(spark):
    """Cuts of a group are searched by compiled steps, whose number follows the cuts and not their limit."""
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 > 0, F.pmod(F.hash("id"), F.lit(900))).otherwise(5).alias("x"))
    got = order.places(df, "x", ("g",), 100, place="p")
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = got.collect()
    for g in (0, 1):
        values = sorted(r["x"] for r in rows if r["g"] == g)
        for r in rows:
            if r["g"] == g:
                assert r["p"] == values.index(r["x"]) + (values.count(r["x"]) + 1) / 2


def test_frequent_values_are_told_from_counts_by_hash(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), F.when(F.col("id") < 2000, 7).otherwise(F.col("id").cast("int")).alias("x"))
    large = order.large_groups(df, ["g"], 200)
    cuts = order.ranges(df, ["g"], "x", large, dense=False).first()["cuts"]
    assert [(c["x"], c["ties"]) for c in cuts if c["ties"]] == [(7, 2000)] and len(cuts) > 5


def test_few_factors_are_not_shuffled_by_row(spark):
    rows = spark.range(500).select(F.lit(1).alias("g"), F.array(*[F.when(F.col("id") % (k + 2) > 0, F.sin(F.col("id") * (k + 1))) for k in range(3)]).alias("x"))
    few = pairs._moments_of_few(rows, "x", 3, ("g",))
    assert "MapInArrow" not in few._jdf.queryExecution().optimizedPlan().toString()
    same = pairs.moments(rows, "x", 3, ("g",))
    for a, b in zip(few.orderBy("i", "j").collect(), same.orderBy("i", "j").collect(), strict=True):
        assert all(abs(a[k] - b[k]) < 1e-9 for k in ("i", "j", *pairs.SUMS))


@pytest.mark.parametrize("rows_per_range, rows_per_chunk", [(500_000, 65_536), (90, 200), (40, 70)])
def test_pooled_ranks_from_one_sort_of_each_factor(spark, rows_per_range, rows_per_chunk):
    """Nested and crossing gaps, ties, and values that fill ranges of their own, in ranges and chunks of any size."""
    draw = random.Random(8)
    rows = []
    for i in range(400):
        gap = draw.random()
        a, b = draw.gauss(0, 1), float(draw.randrange(6))
        rows.append((a, a + draw.gauss(0, 1) if gap > 0.2 else None, 0.0 if i % 3 else b if gap > 0.1 else None,
                     b if draw.random() > 0.3 else None, None, 7.0))
    names = [*"abcdef"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {(r.f1, r.f2): (r.spearman, r.pairs) for r in pairs.pooled_spearman(df, names, rows_per_range, rows_per_chunk).collect()}
    cells, seen = pd.DataFrame(rows, columns=names, dtype=float), 0
    for i, x in enumerate(names):
        for y in names[i + 1:]:
            both = cells[[x, y]].dropna()
            assert ((x, y) in got) == (len(both) > 0)
            if len(both):
                seen += 1
                assert got[x, y][1] == len(both)
                assert got[x, y][0] is None if "f" in (x, y) else got[x, y][0] == pytest.approx(both[x].rank().corr(both[y].rank()), abs=1e-12)
    assert seen == 10


def test_pooled_ranks_deal_each_value_once(spark):
    """A factor is shuffled once for all sets of rows it is ranked in, not once for each."""
    df = spark.range(300).select(*[F.when(F.col("id") >= 20 * k, F.sin(F.col("id") * (k + 1))).alias(f"f{k}") for k in range(5)])
    plan = pairs.pooled_spearman(df, [f"f{k}" for k in range(5)])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate explode" not in plan


def test_strategies_make_their_scores_once(spark):
    """Metrics and accounts of the sweep read stored z-scores instead of making the factors twice."""
    from tidepanel import plans
    plans.load()
    plan = plans.QUERIES["X13"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "stddev_samp(close" not in plan


def test_ranks_shuffle_no_columns_of_other_factors(spark, monkeypatch):
    """Stored levels hold what later steps read, and rows dealt by code are not dealt again by factor."""
    from tidepanel import session
    from tidepanel.operators import factors as fs
    from tidepanel.sources import sinks
    from tidepanel.sources.panel import weekly_panel
    stored, written = weekly_panel(spark, "/root/testdata/sf0.001"), []
    panel = stored.df.withColumn("category_number", F.ascii("category").cast("double"))
    keep = session.cut_by_code
    monkeypatch.setattr(fs, "cut_by_code", lambda df, *a: written.append(df.columns) or keep(df, *a))
    monkeypatch.setattr(sinks, "write_partitioned", lambda *a: pytest.fail("values are shuffled by factor"))
    sets = {**fs.demo_factors(), **fs.demo_cross_sections(), **fs.more_cross_sections()}
    status = {r.factor_id: r for r in sinks.materialize_factors(panel, sets, stored.buckets).collect()}
    assert status.keys() == sets.keys() and {r.row_count for r in status.values()} == {stored.rows}
    assert written and all(len(w) <= 6 and not {"mom4", "liq4"} & set(w) for w in written)
    assert sorted(map(sorted, fs.parts(sets))) == sorted(map(sorted, [
        [*fs.demo_factors(), "unchanged"], ["z_mean", "sector_gap"], ["sector_filled"], ["rank_delta", "z_mean_rank"], ["damped"], ["label"]]))


def test_small_statistics_and_labels_leave_the_rows_in_place(spark):
    """Statistics of (date, sector) and labels are stored, so that the join knows that they are small."""
    from tidepanel.operators import cross, factors as fs
    from tidepanel.sources.panel import weekly_panel
    panel = weekly_panel(spark, "/root/testdata/sf0.001").df
    gap = fs.composed(panel, {"z": fs.Step("group_neutralize", ("close",), "sector")})
    for df in (gap, cross.densify(panel, "volume", "level")):
        assert shuffles(df) == 0 and "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    filled = fs.composed(panel, {"z": fs.Step("group_backfill", ("close", 3), "sector")})
    assert shuffles(filled) == 0
