"""Operator registry: names, categories, aliases and field checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from . import scalar as m, timeseries as ts
from .text import ALIASES

# Column names that are no features.
FORBIDDEN_FIELDS = ("code", "category", "timestamps", "date", "industry", "name", "chiname",
                    "engname", "infopubldate", "enddate")
RESERVED = ("date", "code")


@dataclass(frozen=True)
class Operator:
    """``kind`` says what ``make`` takes and gives: 'column' (inputs to a Column), 'cross' (inputs, and a group, to a
    statistic of the row's group), 'history' and 'frame' (a DataFrame, inputs and the name of the result to a
    DataFrame, along one code's history or across codes) or 'macro' (inputs to other steps). ``inputs`` counts
    them with a group; ``past`` gives the rows before the current one that a value needs, by the inputs (None: all)."""
    name: str
    category: str
    kind: str
    inputs: int
    make: Callable
    description: str = ""
    past: Callable = lambda *inputs: 0


_OPERATORS: dict[str, Operator] = {}
KINDS = ("column", "cross", "history", "frame", "macro")


def register_operator(name: str, category: str, make: Callable, inputs: int = 1, kind: str = "column",
                      description: str = "", past: Callable | None = None) -> None:
    if not name.isidentifier() or name in RESERVED:
        raise ValueError(f"invalid operator name: {name}")
    if kind not in KINDS:
        raise ValueError(f"invalid operator kind: {kind}")
    _OPERATORS[name] = Operator(name, category, kind, inputs, make, description or (make.__doc__ or "").strip(),
                                past or (lambda *inputs: 0))


def resolve(name: str) -> Operator:
    """Operator by name or alias."""
    return _OPERATORS[name if name in _OPERATORS else ALIASES.get(name, name)]


def list_operators(category: str | None = None) -> list[Operator]:
    return sorted((o for o in _OPERATORS.values() if category in (None, o.category)), key=lambda o: (o.category, o.name))


def aliases_of(name: str) -> list[str]:
    return sorted(a for a, n in ALIASES.items() if n == name)


def check_fields(df: DataFrame, names) -> dict[str, str]:
    """'ok', 'unknown' or 'forbidden' per requested field, before a plan is built."""
    return {n: "forbidden" if n.lower() in FORBIDDEN_FIELDS else "ok" if n in df.columns else "unknown" for n in names}


def _fill() -> None:
    from ..operators import cross, stateful
    one = {"abs": m.abs_, "log": m.log, "sqrt": m.sqrt, "sign": m.sign, "reverse": m.reverse, "inverse": m.inverse}
    two = {"add": m.add, "sub": m.subtract, "mul": m.multiply, "div": m.divide, "max": m.maximum, "min": m.minimum,
           "subtract": m.subtract, "multiply": m.multiply, "divide": m.divide, "power": m.power, "signed_power": m.signed_power}
    logic1 = {"is_nan": m.is_nan, "not_": m.not_}
    logic2 = {"equal": m.equal, "not_equal": m.not_equal, "greater": m.greater, "greater_equal": m.greater_equal,
              "less": m.less, "less_equal": m.less_equal, "and_": m.and_, "or_": m.or_}
    logic3 = {"if_else": m.if_else, "where": m.if_else}
    roll = {"delay": ts.delay, "delta": ts.delta, "ts_delay": ts.delay, "ts_delta": ts.delta, "ts_mean": ts.ts_mean,
            "ts_sum": ts.ts_sum, "ts_std": ts.ts_std, "ts_std_dev": ts.ts_std, "ts_var": ts.ts_var, "ts_min": ts.ts_min,
            "ts_max": ts.ts_max, "ts_median": ts.ts_median, "ts_mad": ts.ts_mad, "ts_product": ts.ts_product,
            "ts_backfill": ts.ts_backfill, "ts_rank": ts.ts_rank, "ts_quantile": ts.ts_quantile, "ts_scale": ts.ts_scale,
            "ts_zscore": ts.ts_zscore, "ts_av_diff": ts.ts_av_diff, "ts_arg_max": ts.ts_arg_max, "ts_arg_min": ts.ts_arg_min,
            "ts_decay_linear": ts.ts_decay_linear, "ts_wma": ts.ts_wma, "ts_ema": ts.ts_ema, "ts_count_nans": ts.ts_count_nans,
            "last_diff_value": ts.last_diff_value}
    pair = {"ts_corr": ts.ts_corr, "ts_covariance": ts.ts_covariance, "ts_regression": ts.ts_regression}
    section = {"zscore": cross.zscore_stat, "normalize": cross.normalize_stat, "scale": cross.scale_stat,
               "winsorize": cross.winsorize_stat}
    group = {"group_neutralize": (cross.group_neutralize_stat, 2), "group_scale": (cross.group_scale_stat, 2),
             "group_zscore": (lambda x, g: cross.zscore_stat(x, ("date", g)), 2),
             "group_mean": (cross.group_mean_stat, 3), "group_fill": (cross.group_fill_stat, 3)}
    # A value n rows back needs n rows before the current one, a window of n rows one less.
    back, window = (lambda x, n: int(n)), (lambda *inputs: int(inputs[-1]) - 1)
    shifts = ("delay", "delta", "ts_delay", "ts_delta", "ts_backfill")
    for table, category, inputs in ((one, "arithmetic", 1), (two, "arithmetic", 2), (logic1, "logic", 1), (logic2, "logic", 2),
                                    (logic3, "logic", 3), (roll, "time_series", 2), (pair, "time_series", 3)):
        for name, make in table.items():
            past = None if category != "time_series" else back if name in shifts else window
            register_operator(name, category, make, inputs, past=past)
    whole = lambda *inputs: None
    register_operator("kth_element", "time_series", ts.kth_element, 3, past=lambda x, n, k: int(n) - 1)
    register_operator("ts_step", "time_series", ts.ts_step, 0, past=whole)
    register_operator("bucket", "transformational", m.bucket, 2)
    register_operator("trade_when", "transformational", ts.trade_when, 3, past=whole)
    register_operator("vec_avg", "vector", m.vec_scalar, 1)
    register_operator("vec_sum", "vector", m.vec_scalar, 1)
    for name, make in section.items():
        register_operator(name, "cross_section", make, 1, "cross")
    for name, (make, inputs) in group.items():
        register_operator(name, "group", make, inputs, "cross")
    register_operator("rank", "cross_section", cross.rank, 1, "frame")
    register_operator("quantile", "cross_section", cross.quantile, 1, "frame")
    register_operator("group_rank", "group", lambda df, x, g, out: cross.rank(df, x, out, ("date", g)), 2, "frame")
    register_operator("densify", "arithmetic", cross.densify, 1, "frame")
    register_operator("hump", "time_series", lambda df, x, limit, out: stateful.hump(df, x, out, limit), 2, "history", past=whole)
    register_operator("days_from_last_change", "time_series", stateful.days_from_last_change, 1, "history", past=whole)

    def group_backfill(x, d, group, std=4.0):
        """Group mean of winsorized values for missing ones, then the last value within ``d`` rows."""
        from ..operators.factors import Step
        return Step("ts_backfill", (Step("group_fill", (x, Step("winsorize", (x,), how={"std": std})), group), d))
    register_operator("group_backfill", "group", group_backfill, 3, "macro")


_fill()
