"""Small literal panels with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tidepanel.functions import features as ft, scalar as m, timeseries as ts
from tidepanel.functions.clean import normalize_code
from tidepanel.operators import (cluster, compose as cp, cross, evaluate as ev, pairs, portfolio as pf, screens, stateful)
from tidepanel.sources import ingest


def values(df, col, order=("date", "code")):
    return [r[col] for r in df.orderBy(*order).select(*order, col).collect()]


def near(got, want, tol=1e-9):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert (a is None and b is None) or a == pytest.approx(b, abs=tol), (got, want)


@pytest.fixture(scope="module")
def panel(table):
    rows = [("2024-01-01", "a", 10.0, 100.0, 1), ("2024-01-01", "b", 20.0, 200.0, 2),
            ("2024-01-02", "a", 11.0, 120.0, 1), ("2024-01-02", "b", 18.0, 180.0, 2)]
    return table(rows, "date string, code string, close double, volume double, industry int")


def test_rank_plus_delay(panel):
    df = cross.rank(panel, "close", "r").withColumn("z", F.col("r") + ts.delay("close", 1))
    near(values(df, "z"), [None, None, 10.5, 21.0])


def test_conditional_and_signed_power(panel):
    z = m.if_else(m.greater("close", 15.0), m.reverse("close"), m.signed_power("close", 0.5))
    near(values(panel.withColumn("z", z), "z"), [3.16227766, -20.0, 3.31662479, -18.0], 1e-6)


def test_scaled_normalized(panel):
    df = cross.scale(cross.normalize(panel, "close", "n"), "n", "z")
    near(values(df, "z"), [-0.5, 0.5, -0.5, 0.5])


def test_ts_rank_plus_corr(panel):
    z = ts.ts_rank("close", 2) + ts.ts_corr("close", "volume", 2)
    near(values(panel.withColumn("z", z), "z"), [None, None, 2.0, 1.5])


def test_single_member_groups(panel):
    df = cross.group_neutralize(panel, "close", "industry", "a")
    df = cross.rank(df, "close", "b", by=("date", "industry"))
    near(values(df.withColumn("z", F.col("a") + F.col("b")), "z"), [1.0] * 4)


def test_null_group_gives_null(table):
    df = table([("2024-01-01", "a", 1.0, None), ("2024-01-01", "b", 3.0, 1)], "date string, code string, x double, g int")
    assert values(cross.group_neutralize(df, "x", "g", "z"), "z") == [None, 0.0]
    assert values(cross.rank(df, "x", "z", by=("date", "g")), "z") == [None, 1.0]
    assert values(cross.rank(df, "x", "z", by=("date", "g")), "z") == [None, 1.0]


def test_composition_zscore(table):
    rows = [("2024-01-01", str(i), float(i)) for i in range(1, 5)] + [
        ("2024-01-02", "1", 5.0), ("2024-01-02", "2", 5.0), ("2024-01-02", "3", 5.0), ("2024-01-02", "4", None)]
    df = cross.zscore_filled(table(rows, "date string, code string, alpha double"), "alpha", "z")
    got = values(df, "z")
    assert sum(got[:4]) == pytest.approx(0) and sum(v * v for v in got[:4]) / 4 == pytest.approx(1)
    assert got[4:] == [0.0] * 4


def test_scored_zscore_ignores_ineligible(table):
    df = table([("2024-01-01", "a", 1.0, True), ("2024-01-01", "b", 3.0, True), ("2024-01-01", "c", 1000.0, False)],
               "date string, code string, x double, eligible boolean")
    got = cp.frozen_score(df, {"x": 1.0})
    near(values(got, "score"), [-1.0, 1.0, 0.0])
    assert values(got, "violation") == [False, False, False]


def test_all_missing_is_a_violation(table):
    df = table([("2024-01-01", "a", None, True), ("2024-01-01", "b", 3.0, True)], "date string, code string, x double, eligible boolean")
    assert values(cp.frozen_score(df, {"x": 1.0}), "violation") == [True, False]


def test_logic_with_missing_values(table):
    df = table([(None, 1.0), (2.0, 1.0)], "x double, y double")
    row = df.select(m.not_equal("x", "y").alias("ne"), m.equal("x", "y").alias("eq"), m.greater("x", "y").alias("gt"),
                    m.and_("x", "y").alias("both"), m.add("x", "y").alias("add"), m.add("x", "x").alias("none"),
                    m.maximum("x", "y").alias("mx")).collect()
    assert row[0].asDict() == {"ne": True, "eq": False, "gt": False, "both": True, "add": 1.0, "none": None, "mx": 1.0}
    assert row[1].asDict() == {"ne": True, "eq": False, "gt": True, "both": True, "add": 3.0, "none": 4.0, "mx": 2.0}


def test_zero_denominators_and_domains(table):
    df = table([(0.0, -1.0)], "z double, n double")
    row = df.select(m.divide("n", "z").alias("a"), m.inverse("z").alias("b"), m.log("n").alias("c"), m.sqrt("n").alias("d"),
                    m.power("n", 0.5).alias("e"), m.power("z", -1.0).alias("f"), m.floor_mod("n", "z").alias("g")).first()
    assert all(v is None for v in row)


def test_code_normalization(table):
    df = table([(" 1.0",), ("600000",), ("1234567",), ("sh600",)], "c string")
    assert [r[0] for r in df.select(normalize_code("c")).collect()] == ["000001", "600000", "1234567", "SH600"]


def history(table, xs):
    return table([(f"2024-01-{i + 1:02d}", "a", x) for i, x in enumerate(xs)], "date string, code string, x double")


def test_hump_restarts_after_gap(table):
    df = stateful.hump(history(table, [0.0, 5.0, 5.0, None, 9.0, 8.5]), "x", "z", 1.0)
    near(values(df, "z"), [0.0, 1.0, 2.0, None, 9.0, 8.5])


def test_days_from_last_change(table):
    df = stateful.days_from_last_change(history(table, [1.0, 1.0, None, None, 2.0, 2.0]), "x", "z")
    assert values(df, "z") == [0.0, 1.0, 0.0, 1.0, 0.0, 1.0]


def test_trade_when_leave_wins(table):
    df = table([(f"2024-01-0{i + 1}", "a", *v) for i, v in enumerate(
        [(1.0, 5.0, 0.0), (0.0, 6.0, 0.0), (1.0, 7.0, 1.0), (0.0, 8.0, 0.0), (1.0, None, 0.0), (1.0, 9.0, 0.0)])],
        "date string, code string, x double, y double, z double")
    near(values(df.withColumn("h", ts.trade_when("x", "y", "z")), "h"), [5.0, 5.0, None, None, None, 9.0])


def test_weighted_windows(table):
    df = history(table, [1.0, 2.0, 4.0])
    got = df.select("date", "code", ts.ts_decay_linear("x", 3).alias("d"), ts.ts_wma("x", 3).alias("w0"),
                    ts.ts_wma("x", 3, 1).alias("w1"), ts.ts_ema("x", 3).alias("e"), ts.ts_wma("x", 1).alias("one")).orderBy("date").collect()[-1]
    assert got["d"] == pytest.approx(17 / 6) and got["w0"] == pytest.approx(10 / 3) and got["w1"] == pytest.approx(17 / 6)
    assert got["e"] == pytest.approx((0.125 * 1 + 0.25 * 2 + 0.5 * 4) / 0.875) and got["one"] == 4.0


def test_daily_ic_of_a_perfect_factor(table):
    rows = [(f"2024-01-0{d}", str(c), "f", float(c), c / 100) for d in range(1, 6) for c in (1, 2, 3)]
    df = table(rows, "date string, code string, factor_id string, value double, target double")
    got = ev.daily_ic(df, horizon=20).orderBy("date").first()
    assert got.ic == pytest.approx(1) and got.rank_ic == pytest.approx(1) and got.slope == pytest.approx(0.01)
    assert str(got.label_available_date)[:10] == "2024-01-21"


def test_only_mature_rows_count(table):
    rows = [(f"2024-01-0{d}", "f", float(d), d * 0.8, d * 2.0, f"2024-01-0{d + 2}") for d in range(1, 5)]
    df = table(rows, "date string, factor_id string, ic double, rank_ic double, slope double, label_available_date string")
    past = ev.mature(df, F.lit("2024-01-04").cast("timestamp"))
    row = ev.behavior_summary(past).first()
    assert (row.ic_mean, row.rank_ic_mean, row.slope_mean, row.ic_std) == (1.0, 0.8, 2.0, None)
    rolled = ev.rolling_behavior(df, df, 2, 40).filter("as_of_date = '2024-01-04'").first()
    assert (rolled.ic_mean, rolled.mature_sample_count, rolled.ic_ir) == (1.0, 1, None)


def test_time_splits(table):
    df = table([(f"2024-01-{d:02d}",) for d in range(1, 11)], "date string")
    assert [r.split for r in ft.time_splits(df).orderBy("date").collect()] == ["train"] * 6 + ["valid"] * 2 + ["test"] * 2


def test_category_score_and_catalog_fallback(table):
    metrics = table([("f1", "price", 0.4, 0.3), ("f2", "own", 0.1, None)], "factor_id string, category string, rank_ic_mean double, icir double")
    catalog = table([("f1", "trend"), ("f2", None)], "factor_id string, category string")
    got = {r.category: r.score for r in cp.category_scores(cp.with_catalog(metrics, catalog)).collect()}
    assert got["trend"] == pytest.approx(0.37) and got["own"] == pytest.approx(0.07)


def test_correlated_factor_is_rejected(table):
    wide = table([(f"2024-01-0{d}", str(c), float(c * d), 2.0 * c * d, float((c * 7 + d * 3) % 5)) for d in (1, 2) for c in (1, 2, 3)],
                 "date string, code string, f1 double, f2 double, f3 double")
    found = cp.conflicts(pairs.pooled_spearman(wide, ("f1", "f2", "f3")), "spearman", 0.95)
    cands = table([("bull", "f1", 0.9), ("bull", "f2", 0.8), ("bull", "f3", 0.7)], "state_id string, factor_id string, s double")
    got = {r.factor_id: (r.selected, r.reason, r.with_factor) for r in cp.greedy_pick(cands, found, ("state_id",), "s", 2).collect()}
    assert got == {"f1": (True, "", None), "f2": (False, "mutual_correlation", "f1"), "f3": (True, "", None)}
    full = {r.factor_id: r.reason for r in cp.greedy_pick(cands, found, ("state_id",), "s", 1).collect()}
    assert full == {"f1": "", "f2": "top_n_limit", "f3": "top_n_limit"}


def test_portfolio_by_hand(table):
    market = table([("2024-01-01", "A", 100.0, 0.0), ("2024-01-02", "A", 110.0, 0.0), ("2024-01-03", "A", 110.0, 0.0),
                    ("2024-01-01", "B", 50.0, 0.0), ("2024-01-02", "B", 50.0, 0.0), ("2024-01-03", "B", 50.0, 0.0)],
                   "date string, code string, close double, Ifsuspend double")
    signals = table([("s", "2024-01-01", "A", 2.0), ("s", "2024-01-01", "B", 1.0)], "strategy_id string, date string, code string, score double")
    row = pf.account(signals, market, 1, 0.01).first()
    assert str(row.date)[:10] == "2024-01-02" and row.turnover == pytest.approx(1)
    assert (row.gross_return, row.cost, row.net_return) == tuple(pytest.approx(v) for v in (0.10, 0.01, 0.09))


def test_suspended_names_are_dropped_and_renormalized(table):
    market = table([(f"2024-01-0{d}", c, 10.0, 1.0 if (c, d) == ("A", 2) else 0.0) for d in (1, 2, 3) for c in "ABC"],
                   "date string, code string, close double, Ifsuspend double")
    signals = table([("s", f"2024-01-0{d}", c, s) for d in (1, 2) for c, s in (("A", 3.0), ("B", 2.0), ("C", None))],
                    "strategy_id string, date string, code string, score double")
    best = pf.best_signals(signals, 2)
    held = pf.target_weights(best, pf.executions(best, market), market).orderBy("date", "code").collect()
    assert [(str(r.date)[8:10], r.code, r.weight) for r in held] == [("02", "B", 1.0), ("03", "A", 0.5), ("03", "B", 0.5)]
    daily = {str(r.date)[8:10]: r for r in pf.account(signals, market, 2, 0.0).collect()}
    assert daily["03"].turnover == pytest.approx(1.0) and daily["02"].turnover == pytest.approx(1.0)


def test_ruin_has_no_annual_return(table):
    daily = table([("s", f"2024-01-0{d}", r, 0.0, 0.0, 1) for d, r in ((1, 0.1), (2, -1.5), (3, 0.1))],
                  "strategy_id string, date string, net_return double, cost double, turnover double, holding_count int")
    row = pf.summary(pf.equity(daily, "net_return")).first()
    assert row.annual_return is None and row.total_return == pytest.approx(1.1 * -0.5 * 1.1 - 1)
    assert daily.groupBy("strategy_id").agg(pf.growth_objective("net_return").alias("o")).first().o is None


def test_drawdown(table):
    daily = table([("s", f"2024-01-0{d}", r) for d, r in ((1, 0.1), (2, -1 / 11), (3, 0.05))], "strategy_id string, date string, net_return double")
    assert pf.equity(daily, "net_return").agg(F.min("drawdown")).first()[0] == pytest.approx(-0.090909, abs=1e-6)


def test_liquid_pool_order(table):
    rows = [(f"2024-01-0{d}", f"00000{c}", 100.0 * c, 10.0, 0.0, "2020-01-01" if c < 3 else "2024-01-01") for d in (2, 3) for c in (1, 2, 3)]
    df = table(rows, "date string, code string, amount double, volume double, Ifsuspend double, ListedDate string")
    span = (F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-31").cast("timestamp"))
    top = screens.top_pool(screens.liquid_pool(df, *span, 0.5), 2)
    assert [r.code for r in top.orderBy(F.col("average_amount").desc()).collect()] == ["000003", "000002"]
    old = screens.top_pool(screens.liquid_pool(df, *span, 0.5, 1000), 2)
    assert [r.code for r in old.orderBy(F.col("average_amount").desc()).collect()] == ["000002", "000001"]
    with pytest.raises(Exception, match="fewer than 9"):
        screens.top_pool(screens.liquid_pool(df, *span, 0.5), 9).collect()


def test_behavior_matrix_and_representatives(table):
    df = table([("f1", 1.0, 1), ("f2", 1.1, 1), ("f3", -1.0, 0), ("f4", -1.1, 0), ("f5", None, 0)], "factor_id string, ic double, cluster int")
    matrix = cluster.behavior_matrix(df, ["ic"])
    assert {r.factor_id: r.ic for r in matrix.collect()}["f5"] == pytest.approx(0.0)
    four = matrix.filter("factor_id <> 'f5'")
    picks = cluster.representatives(four, cluster.raw_centers(four, ["ic"]), ["ic"], "factor_id")
    assert sorted(r.factor_id for r in picks.collect()) == ["f1", "f3"]


def test_raw_rows_to_panel(table):
    raw = table([("1", "2024-01-02", "10", "11", "12", "9", "5", "55", "0.5", "A"), ("2", "bad", "10", "11", "12", "9", "5", "55", "1", "A"),
                 ("3", "2024-01-02", "x", "11", "12", "9", "5", "55", "1", "A"), ("4", "2024-01-02", "10", "11", "12", "9", "0", "55", "1", "A"),
                 ("5", "1500-01-01", "10", "11", "12", "9", "5", "55", "1", "A"), ("6", "2024-01-02", "10", "11", None, "9", "5", "55", "1", "A"),
                 ("7", "2024-01-02", "10", "11", "12", "x", "5", "55", "1", "A"), ("8", "2024-01-02", "10", "11", "12", "9", "5", "55", "n/a", None)],
                "code string, timestamps string, open string, close string, high string, low string, vol string, amount string, ycp string, category string")
    rows = ingest.normalize_panel(raw).orderBy("code").collect()
    assert [(r.code, r.volume, r.vwap, r.ycp, r.category) for r in rows] == [
        ("000001", 5.0, 11.0, 0.5, "A"), ("000008", 5.0, 11.0, None, None)]


def test_a_missing_score_is_admitted_last(table):
    cands = table([("s", "f1", None), ("s", "f2", 0.5)], "state_id string, factor_id string, s double")
    pairs = table([("f1", "f2"), ("f2", "f1")], "factor_id string, other string")
    got = {r.factor_id: (r.selected, r.reason) for r in cp.greedy_pick(cands, pairs, ("state_id",), "s", 2).collect()}
    assert got == {"f2": (True, ""), "f1": (False, "mutual_correlation")}


def test_incomplete_prices_are_not_complete(table):
    from tidepanel.operators import quality as q
    rows = [("2024-01-01", "1", 1.0, 1.0), ("2024-01-01", "2", 1.0, 1.0), ("2024-01-02", "1", 1.0, 0.0), ("2024-01-02", "2", 1.0, 1.0),
            ("2024-01-03", "1", 1.0, 1.0)]
    df = table(rows, "date string, code string, close double, high double").withColumns(
        {"open": F.col("close"), "low": F.col("close"), "volume": F.col("close"), "amount": F.col("close"), "Ifsuspend": F.lit(0.0)})
    days = [(r.present, r.complete) for r in q.session_completeness(df).orderBy("date").collect()]
    assert days == [(2, True), (1, False), (1, False)]
    r = q.import_quality(df).first()
    assert (r.observed_rows, r.padded_rows, r.missing_price_rows, r.incomplete_sessions, r.complete_sessions) == (5, 1, 1, 1, 1)


def test_first_target_and_missing_tail(table):
    rows = [(f"2024-01-0{d}", str(c), 10.0 * c * 1.1 ** (d - 1)) for d in range(1, 5) for c in (1, 2, 3)]
    df = table(rows, "date string, code string, close double").withColumn("t", ts.forward_return("close", 1))
    got = values(df, "t")
    assert got[0] == pytest.approx(0.1) and sum(v is None for v in got) == 3


def test_probit_matches_normal_distribution(table):
    from statistics import NormalDist
    from tidepanel.functions.probit import probit
    ps = [1e-6, 1e-4, 0.05, 0.0749, 0.0751, 0.3, 0.5, 0.7, 0.93, 0.999999]
    df = table([(p,) for p in ps], "p double")
    for r in df.select("p", probit("p").alias("q")).collect():
        assert math.isclose(r.q, NormalDist().inv_cdf(r.p), abs_tol=1e-12)
