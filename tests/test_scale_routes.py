"""Ranges of large groups against brute force, on groups that are large and full of ties; plans and levels."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import timeseries as ts
from tidepanel.operators import cluster, cross, order, screens


@pytest.fixture(scope="module")
def skewed(spark):
    """One date holds most rows, and a third of all values are the same number."""
    rng = random.Random(7)
    rows = []
    for i in range(9000):
        day = "2024-01-01" if i % 10 else "2024-01-02"
        x = 1.5 if i % 3 == 0 else None if i % 17 == 0 else rng.gauss(0, 1) ** 3
        rows.append((day, f"{i:05d}", x))
    return pd.DataFrame(rows, columns=["date", "code", "x"])


def frame(spark, skewed):
    rows = [(d, k, None if x != x else x) for d, k, x in skewed.itertuples(index=False)]
    return spark.createDataFrame(rows, "date string, code string, x double")


@pytest.fixture(params=[1_000_000, 500, 60])
def rows_per_range(request, monkeypatch):
    """All groups in one range, and a large one in few or in many."""
    monkeypatch.setattr(order, "ROWS_PER_RANGE", request.param)
    return request.param


def test_ranks_are_exact_in_any_number_of_ranges(spark, skewed, rows_per_range):
    df = frame(spark, skewed)
    want = skewed.groupby("date").x.rank(pct=True)
    got = cross.rank(df, "x", "r").toPandas().sort_values("code").r.reset_index(drop=True)
    assert got.isna().equals(want.isna()) and (got - want).abs().max() < 1e-12


def test_places_sizes_ties_and_dense_places(spark, skewed, rows_per_range):
    got = order.places(frame(spark, skewed), "x", ("date",), place="p", size="n", ties="k", dense="d").toPandas().sort_values("code")
    group = skewed.groupby("date").x
    for name, want in (("p", group.rank()), ("n", group.transform("count").where(skewed.x.notna())),
                       ("k", skewed.groupby(["date", "x"]).x.transform("count")), ("d", group.rank("dense"))):
        assert got[name].reset_index(drop=True).astype(float).equals(want.astype(float)), name


def test_a_large_group_is_dealt_over_ranges(spark, skewed, monkeypatch):
    """Tasks of the window hold a range each; the value that a third of the rows share is in none of them."""
    monkeypatch.setattr(order, "ROWS_PER_RANGE", 500)
    df = frame(spark, skewed)
    cuts = order.ranges(df, ["date"], "x", order.large_groups(df, ["date"])).filter("date = '2024-01-01'").first().cuts
    assert any(c.x == 1.5 and c.ties == (skewed[skewed.date == "2024-01-01"].x == 1.5).sum() for c in cuts)
    spans = [b.rows - a.rows - a.ties for a, b in zip(cuts, cuts[1:])]
    assert len(cuts) > 8 and max(spans) < 2_000
    assert order.large_groups(df.filter("date = '2024-01-02'"), ["date"]) is not None
    assert order.large_groups(df, ["date"], 10_000) is None


def test_null_keys_and_values_have_no_place(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", None), ("a", 2.0), ("a", 2.0), ("b", 5.0)], "k string, x double")
    got = sorted(order.places(df, "x", ("k",), place="p", size="n").select("k", "x", "p", "n").collect(), key=repr)
    assert [tuple(r) for r in got] == sorted([(None, 1.0, None, None), ("a", None, None, None), ("a", 2.0, 1.5, 2),
                                              ("a", 2.0, 1.5, 2), ("b", 5.0, 1.0, 1)], key=repr)


def test_densify_is_exact(spark, skewed, rows_per_range):
    df = frame(spark, skewed)
    got = cross.densify(df, "x", "k").toPandas().sort_values("code").k.reset_index(drop=True)
    codes = pd.Series(pd.Categorical(skewed.x).codes.astype(float))
    assert got.fillna(-1).equals(codes)


def test_ranking_is_exact(spark, skewed, rows_per_range):
    rows = skewed.fillna({"x": -9.0})
    df = (spark.createDataFrame(rows, "date string, code string, x double")
          .withColumns({"eligible": F.col("x") > -1, "reason": F.lit("")}))
    got = screens.ranking(df, "x", 50, by=("date",)).toPandas().sort_values("code")["rank"].reset_index(drop=True)
    good = rows[rows.x > -1].sort_values(["x", "code"], ascending=[False, True])
    want = (good.groupby("date").cumcount() + 1).reindex(rows.index)
    assert got.astype(float).equals(want.astype(float))


def test_exact_medians(spark, skewed, rows_per_range):
    df = frame(spark, skewed).withColumn("y", F.col("x") * 3 + 1)
    got = {r.field: r.median for r in cluster.medians(df, ["x", "y"]).collect()}
    assert got["x"] == pytest.approx(skewed.x.median(), abs=1e-12) and got["y"] == pytest.approx((skewed.x * 3 + 1).median(), abs=1e-12)


def test_keep_last_of_a_hot_key(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("seq"), (F.col("id") * 2).alias("v"))
    got = screens.keep_last(df, ["k"], "seq")
    assert got.filter("k = 0").first().v == 2 * 29_997 and got.count() == 20_001


def test_rolling_windows_on_the_stored_panel_need_no_shuffle(spark, capsys):
    from tidepanel.sources.panel import weekly_panel
    df = weekly_panel(spark, "/root/testdata/sf0.001").df
    df.select("date", "code", ts.ts_mean("close", 4)).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_scan_filters_reach_parquet(spark, capsys):
    from tidepanel import plans
    plans.load()
    plans.QUERIES["S3"](spark, "/root/testdata/sf0.001").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(l_shipdate" in plan and "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_shipdate" in plan


def test_future_rows_change_nothing(spark):
    from tidepanel import plans
    plans.load()
    assert all(r.max_error == 0 and r.missing_differs == 0 for r in plans.QUERIES["Q8"](spark, "/root/testdata/sf0.001").collect())


def test_nested_cross_sections_grow_linearly(spark):
    """The plan of a level reads its stored table a fixed number of times, whatever the depth."""
    from tidepanel.operators import factors as fs
    panel = spark.range(60).selectExpr("timestamp'2024-01-01' + make_dt_interval(int(id / 6)) AS date", "cast(id % 6 AS string) AS code",
                                       "cast((id * 7) % 11 AS double) AS close")
    def nested(n):
        x = F.col("close")
        for _ in range(n):
            x = fs.Step("zscore", (x,))
        return x
    plans = [fs.composed(panel, {"z": nested(n)})._jdf.queryExecution().optimizedPlan().toString().count("Relation") for n in (2, 3, 4, 6)]
    assert plans == [2, 2, 2, 2]
    values = fs.composed(panel, {"z": nested(3), "again": nested(1)}).toPandas()
    assert (values.z - values.again).abs().max() < 1e-9


def test_cross_sections_of_one_level_share_their_aggregates(spark):
    base = spark.range(20).selectExpr("timestamp'2024-01-01' AS date", "id AS code", "id % 3 AS g", "cast(id AS double) AS x")
    df = cross.with_stats(base, {f"z{k}": cross.zscore_stat("x") for k in range(6)} | {
        f"g{k}": cross.group_neutralize_stat("x", "g") for k in range(6)})
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 3
