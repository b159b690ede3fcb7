"""Pairs of many factors by blocks, the weight fit, label joins, run folders, plans of keep-last: against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import compose as cp, evaluate as ev, joins, pairs, screens
from tidepanel.sources import ingest
from tidepanel.sources.panel import weekly_panel


@pytest.fixture(scope="module")
def cells():
    """Nine factors on 90 rows of three dates: gaps of their own, shared gaps, ties, a constant and one that is never there."""
    rng = np.random.default_rng(5)
    df = pd.DataFrame(rng.normal(size=(90, 9)), columns=[f"f{k}" for k in range(9)])
    df["f1"] = (df.f0 * 3).round()
    df["f2"] = 1e6 + df.f0 * 0.01 + df.f2 * 0.01
    df.loc[rng.random(90) < 0.3, "f3"] = np.nan
    df.loc[df.f3.isna(), "f4"] = np.nan
    df.loc[rng.random(90) < 0.4, "f5"] = np.nan
    df["f6"] = 0.1
    df["f7"] = np.nan
    df["date"] = np.repeat(["d1", "d2", "d3"], [50, 38, 2])
    df["code"] = [f"{i:03}" for i in range(90)]
    return df


NAMES = [f"f{k}" for k in range(9)]


def frame(spark, cells):
    rows = [tuple(None if x != x else x for x in r) for r in cells[["date", "code", *NAMES]].itertuples(index=False)]
    return spark.createDataFrame(rows, "date string, code string, " + ", ".join(f"{n} double" for n in NAMES)).repartition(3)


@pytest.mark.parametrize("block, rows_per_task", [(256, 200_000), (2, 7), (4, 20)])
def test_correlations_in_blocks_and_tasks(spark, cells, monkeypatch, block, rows_per_task):
    monkeypatch.setattr(pairs, "BLOCK", block)
    monkeypatch.setattr(pairs, "ROWS_PER_TASK", rows_per_task)
    got = {(r.date, r.f1, r.f2): (r.ic, r.pairs) for r in pairs.correlations(frame(spark, cells), NAMES).collect()}
    for date, part in cells.groupby("date"):
        for i, a in enumerate(NAMES):
            for b in NAMES[i + 1:]:
                both = part[[a, b]].dropna()
                if not len(both):
                    assert (date, a, b) not in got
                    continue
                ic, n = got[date, a, b]
                assert n == len(both)
                want = both[a].corr(both[b]) if n >= 3 and both[a].nunique() > 1 and both[b].nunique() > 1 else None
                assert ic is None if want is None else ic == pytest.approx(want, abs=1e-9), (date, a, b)


def test_pooled_ranks_depend_on_the_rows_of_the_pair(spark, cells):
    got = {(r.f1, r.f2): (r.spearman, r.pairs) for r in pairs.pooled_spearman(frame(spark, cells), NAMES).collect()}
    for i, a in enumerate(NAMES):
        for b in NAMES[i + 1:]:
            both = cells[[a, b]].dropna()
            if not len(both):
                assert (a, b) not in got
                continue
            want = None if "f6" in (a, b) else both[a].rank().corr(both[b].rank())
            assert got[a, b][1] == len(both)
            assert got[a, b][0] is None if want is None else got[a, b][0] == pytest.approx(want, abs=1e-12)


def test_two_hundred_factors_in_one_plan(spark):
    """19,900 pairs of all dates; the plan is as long as for three factors."""
    panel = weekly_panel(spark, "/root/testdata/sf0.001").df
    rows = panel.select("date", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda k: F.sin(
        F.col("close") * k) + F.col("volume") / k).alias("x"))
    plans = [pairs.moments(rows, "x", k, ("date",))._jdf.queryExecution().optimizedPlan().toString().count("\n") for k in (3, 200)]
    assert plans[0] == plans[1]
    made = pairs.moments(rows, "x", 200, ("date",)).withColumn("ic", pairs.pearson(3)).groupBy("i", "j").agg(F.count("ic").alias("n"))
    assert made.count() == 19_900 and made.filter("n < 100").count() == 0


def test_l1_weights_meet_the_optimality_conditions(spark, cells):
    z = frame(spark, cells).fillna(0.0)
    names = ["f0", "f1", "f3", "f4", "f5", "f6"]
    for alpha in (0.0, 0.05, 0.3, 10.0):
        m, v = cp.sample_moments(z, names, "f8")
        w = cp.l1_weights(z, names, "f8", alpha)
        slope = v - m @ w                       # inside alpha / 2 where a weight is zero, on its border elsewhere
        assert np.all(np.abs(slope) <= alpha / 2 + 1e-9)
        assert np.allclose(slope[w != 0], np.sign(w[w != 0]) * alpha / 2, atol=1e-9)
        assert w[-1] == 0 or np.any(m[-1])
    assert not w.any()


def test_label_join_reports_or_refuses_repeated_keys(table):
    values = table([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0), ("c", 1, 4.0)], "code string, k int, value double")
    labels = table([("a", 1, 9.0), ("a", 1, 9.0), ("a", 2, 8.0), ("b", 1, None)], "code string, k int, y double")
    got = joins.many_to_one(values, labels, ("code", "k"), repeated="again").orderBy("code", "k").collect()
    assert [tuple(r) for r in got] == [("a", 1, 1.0, 9.0, True), ("a", 2, 2.0, 8.0, False), ("b", 1, 3.0, None, False)]
    with pytest.raises(Exception, match="repeats a key of code, k: a, 1"):
        joins.many_to_one(values, labels, ("code", "k")).collect()
    assert joins.many_to_one(values, labels.filter("code = 'b'"), ("code", "k")).count() == 1


def test_ranking_parity_counts_moved_codes(spark):
    schema = "date string, code string, s double"
    a = spark.createDataFrame([("d1", "a", 3.0), ("d1", "b", 2.0), ("d1", "c", None), ("d2", "a", 1.0), ("d2", "b", 1.0), ("d3", "a", 1.0)], schema)
    b = spark.createDataFrame([("d1", "a", 9.0), ("d1", "b", 9.5), ("d2", "a", 5.0), ("d2", "b", 4.0), ("d3", "b", 1.0)], schema)
    got = sorted(tuple(r) for r in ev.ranking_parity(a, b, "s").collect())
    assert got == [("d1", 2, 2, False), ("d2", 2, 0, True), ("d3", 2, 2, False)]


def test_run_folders_are_read_by_header(spark, tmp_path):
    for k in range(30):
        run = tmp_path / "store" / f"group{k % 4}" / f"run{k:02}"
        run.mkdir(parents=True)
        head, row = ("factor_id,pool_id,backtest_sharpe", f"f{k},p{k % 2},{k}.5") if k % 3 else (
            "factor_id,sharpe,backtest_sharpe,split", f"f{k},{k}.25,9,train")
        (run / "factor_backtest_summary.csv").write_text(f"{head}\n{row}\n")
    made = ingest.union_runs(spark, [str(tmp_path / "store")], "p1")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2
    got = {r.run_id: (r.factor_id, r.sharpe) for r in made.collect()}
    assert got == {f"run{k:02}": (f"f{k}", f"{k}.5" if k % 3 else f"{k}.25") for k in range(30) if k % 3 == 0 or k % 2}
    metrics = ingest.backtest_metrics(made)
    assert {r.split for r in metrics.collect()} == {"train", "unknown"}
    assert dict(metrics.dtypes)["sharpe"] == "double" and "start_date" in metrics.columns


def test_last_rows_and_best_checkpoints_stay_in_hash_aggregation(spark):
    from tidepanel import plans
    plans.load()
    for key in ("S7", "K4"):
        made = plans.QUERIES[key](spark, "/root/testdata/sf0.001")
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and ("SortAggregate" not in plan or key == "K4"), key
    numbers = spark.range(100).selectExpr("id % 5 AS k", "id AS batch", "cast(id % 7 AS double) AS objective", "id * 2 AS v")
    best = screens.best_checkpoint(numbers, "objective", "batch", by=("k",))
    assert "SortAggregate" not in best._jdf.queryExecution().executedPlan().toString()
    want = numbers.toPandas().sort_values(["k", "objective", "batch"], ascending=[True, False, True]).groupby("k").first()
    got = best.toPandas().set_index("k").sort_index()
    assert (got.batch == want.batch).all() and (got.v == want.v).all() and (got.objective == want.objective).all()


def test_selection_reasons_in_order(table):
    df = table([(None, 0.0, 1.0, 1.0), (0.0, 0.0, 1.0, 1.0), (1.0, None, 1.0, 1.0), (1.0, 1.0, 0.0, 1.0), (1.0, 0.0, 0.0, 1.0),
                (1.0, 0.0, 0.4, 1.0), (1.0, 0.0, 1.0, None), (1.0, 0.0, 0.5, float("inf")), (1.0, 0.0, 0.5, 1.0)],
               "close double, halted double, coverage double, score double")
    reason = screens.selection_reason(F.col("close"), F.col("halted"), F.col("coverage"), F.col("score"), 0.5)
    assert [r[0] for r in df.select(reason).collect()] == [
        "missing_as_of_date", "invalid_close", "suspension_status_unknown", "suspended", "all_factors_missing",
        "insufficient_factor_coverage", "invalid_score", "invalid_score", ""]
