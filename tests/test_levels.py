"""Factor sets over levels, lookbacks, period slices and the damped signal."""

import random

import pytest
from pyspark.sql import functions as F

from tidepanel import session
from tidepanel.functions import timeseries as ts
from tidepanel.functions.registry import list_operators, resolve
from tidepanel.operators import factors as fs, stateful
from tidepanel.sources.panel import weekly_panel
from tidepanel.sources.sinks import materialize_factors

SF = "/root/testdata/sf0.001"


def plan_of(df, mode="formatted"):
    return df._jdf.queryExecution().explainString(getattr(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode, "fromString")(mode))


def test_one_write_for_each_level_and_no_shuffle_by_code(spark, monkeypatch):
    stored, written = weekly_panel(spark, SF), []
    cut = session.cut_by_code
    monkeypatch.setattr(fs, "cut_by_code", lambda df, *a: written.append(df.columns) or cut(df, *a))
    rank = fs.Step("rank", (ts.delta("close", 4),))
    mean = fs.Step("ts_mean", (rank, 3))
    score = fs.Step("zscore", (mean,))
    sets = {"a": rank, "b": mean, "c": score, "d": fs.Step("ts_max", (score, 2))}
    made = fs.composed(stored.df, sets, buckets=stored.buckets)
    assert len(written) == 2 and all(set(w) <= {"date", "code", "_step0", "_step1", "_step2", "_step3"} for w in written)
    plan = plan_of(made)
    assert "hashpartitioning(code" not in plan and "Bucketed: true" in plan
    assert made.filter("d IS NOT NULL").count() > 100


def test_all_kinds_of_operators_in_one_set_and_error_rows(spark):
    stored = weekly_panel(spark, SF)
    panel = stored.df.withColumn("category_number", F.ascii("category").cast("double"))
    bad = {"no_field": fs.Step("ts_mean", ("nothing", 3)), "no_operator": fs.Step("nothing", ("close",)),
           "no_group": fs.Step("group_mean", ("close", "volume")), "extra": fs.Step("rank", ("close",), how={"nothing": 1}),
           "deep": fs.Step("ts_mean", (fs.Step("hump", ("close",)), 2))}
    good, errors = fs.resolvable(panel, {**fs.demo_factors(), **fs.more_cross_sections(), **bad})
    assert errors.keys() == bad.keys() and good.keys() == {**fs.demo_factors(), **fs.more_cross_sections()}.keys()
    status = {r.factor_id: r.status for r in materialize_factors(panel, {**fs.more_cross_sections(), **bad}).collect()}
    assert status == {**dict.fromkeys(fs.more_cross_sections(), "ok"), **dict.fromkeys(bad, "error")}


def test_levels_equal_operators_applied_by_hand(spark):
    from tidepanel.operators import cross
    panel = weekly_panel(spark, SF).df
    damped = fs.composed(panel, {"z": fs.Step("hump", (fs.Step("rank", ("close",)), 0.05))})
    by_hand = stateful.hump(cross.rank(panel, "close", "r"), "r", "z", 0.05).select("date", "code", "z")
    assert damped.exceptAll(by_hand).count() == 0
    filled = fs.composed(panel, {"z": fs.Step("group_backfill", (ts.delta("close", 4), 3), "sector")})
    by_hand = cross.group_backfill(panel.withColumn("v", ts.delta("close", 4)), "v", "sector", "z", 3).select("date", "code", "z")
    rows = filled.join(by_hand.withColumnRenamed("z", "y"), ["date", "code"])
    assert rows.filter("abs(z - y) > 1e-9 OR (z IS NULL) <> (y IS NULL)").count() == 0 and rows.count() == panel.count()


def test_lookbacks_add_up():
    mean = fs.Step("ts_mean", ("close", 5))
    assert fs.lookback("close") == 0 and fs.lookback(3.0) == 0 and fs.lookback(mean) == 4
    assert fs.lookback(fs.Step("delay", (mean, 3))) == 7
    assert fs.lookback(fs.Step("div", (fs.Step("ts_corr", ("close", "volume", 10)), fs.Step("rank", (mean,))))) == 9
    assert fs.lookback(fs.Step("group_backfill", (fs.Step("delta", ("close", 4)), 3), "sector")) == 7
    assert fs.lookback(fs.Step("hump", ("close", 1.0))) is None and fs.lookback(F.col("close")) is None
    assert fs.lookback(fs.Step("add", (mean, fs.Step("trade_when", ("close", "open", "high"))))) is None
    assert {k: fs.lookback(v) for k, v in fs.scoring_factors().items()} == {"mom4": 4, "rev1": 1, "rng": 0}


def test_lookbacks_are_enough(spark):
    """Every operator with a lookback gives the same last value from its slice as from the whole history."""
    panel = weekly_panel(spark, SF).df.filter("code = '000001'")
    rows = panel.orderBy("date").collect()
    two = {"kth_element": ("close", 5, 3), "bucket": ("close", "0,1,0.1"), "power": ("close", 2.0), "signed_power": ("close", 2.0)}
    for op in list_operators():
        if op.kind != "column" or op.name in ("if_else", "where", "ts_step") or op.category == "custom":
            continue
        inputs = two.get(op.name) or {"time_series": {2: ("close", 5), 3: ("close", "volume", 5)}}.get(op.category, {}).get(
            op.inputs) or ("close", "volume", "open")[:op.inputs]
        far = fs.lookback(fs.Step(op.name, inputs))
        if far is None:
            continue
        part = spark.createDataFrame(rows[-far - 1:], panel.schema)
        value = op.make(*inputs).alias("z")
        a, b = (d.select("date", value).orderBy(F.col("date").desc()).first().z for d in (panel, part))
        assert a == b or a == pytest.approx(b), op.name


def test_a_span_of_dates_reads_its_periods_alone(spark):
    stored = weekly_panel(spark, SF)
    part = stored.between("1997-01-01", "1997-06-30")
    assert "PartitionFilters: [isnotnull(period" in plan_of(part)
    assert part.exceptAll(stored.df.filter("date BETWEEN '1997-01-01' AND '1997-06-30'")).count() == 0
    day = stored.session("2000-07-08")
    assert day == stored.df.filter("date <= '2000-07-08'").agg(F.date_format(F.max("date"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    last = stored.last_sessions("2000-07-08", 3)
    assert last.select("date").distinct().count() == 3 and stored.session("1901-01-01") is None
    assert stored.last_sessions("1901-01-01", 3).count() == 0


def test_as_of_scores_read_no_more_than_their_lookback(spark):
    stored = weekly_panel(spark, SF)
    codes = stored.df.select("code").distinct()
    part, day = stored.history("2001-06-07", 4, codes)
    assert "PartitionFilters: [isnotnull(period" in plan_of(part)
    rows = stored.df.filter(F.col("date") <= F.lit(day).cast("timestamp"))
    today = rows.filter(F.col("date") == F.lit(day).cast("timestamp")).select("code")
    need = rows.join(today, "code", "left_semi").withColumn("i", F.expr(
        "row_number() OVER (PARTITION BY code ORDER BY date DESC)")).filter("i <= 5")
    assert need.select("date", "code").exceptAll(part.select("date", "code")).count() == 0
    assert part.agg(F.min("date")).first()[0] == need.agg(F.min("date")).first()[0]
    alone, day = stored.history("2001-06-07", 0, codes)
    assert alone.select("date").distinct().count() == 1
    whole, _ = stored.history("2001-06-07", None, codes)
    assert whole.count() == rows.count()
    assert stored.history("1901-01-01", 3, codes)[1] is None
    none, day = stored.history("2001-06-07", 3, codes.limit(0))
    assert day is None and none.count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_hump_equals_the_recurrence_on_random_walks(spark, seed):
    rng, rows, want = random.Random(seed), [], {}
    for code, n in (("a", 1), ("b", 63), ("c", 64), ("d", 65), ("e", 300)):
        x, y = 0.0, None
        for i in range(n):
            x += rng.gauss(0, 1)
            v = None if rng.random() < 0.05 else x
            y = v if v is None or y is None else max(min(v, y + 0.7), y - 0.7)
            rows.append((i, code, v, i * 2))
            want[i, code] = y
    df = spark.createDataFrame(rows, "date int, code string, x double, other int").repartition(5)
    made = stateful.hump(df, "x", "z", 0.7)
    assert not any(n in plan_of(made) for n in ("EvalPython", "InPandas", "InArrow"))
    got = {(r.date, r.code): r.z for r in made.collect()}
    assert got.keys() == want.keys() and made.columns == [*df.columns, "z"]
    assert all(a == want[k] if a is None or want[k] is None else abs(a - want[k]) < 1e-12 for k, a in got.items())
    assert made.filter("other <> date * 2").count() == 0


def test_operators_have_arity_and_aliases():
    assert resolve("Mean").name == "ts_mean" and resolve("ts_corr").inputs == 3 and resolve("group_backfill").kind == "macro"
    assert len(list_operators()) > 70
