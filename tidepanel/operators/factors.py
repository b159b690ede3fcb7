"""Factor sets: many named Columns evaluated in one pass over the panel."""

from __future__ import annotations

import inspect
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import timeseries as ts
from ..functions.clean import ratio
from ..session import cut_by_code


def wide(panel: DataFrame, factors: dict[str, Column], keep=("date", "code")) -> DataFrame:
    """All factors as columns: windows per code share the panel's layout."""
    return panel.select(*keep, *[v.alias(k) for k, v in factors.items()])


@dataclass(frozen=True, eq=False)
class Step:
    """A registered operator over Columns, column names or other steps.

    Steps compose freely: a rolling mean of a rank of a difference is
    ``Step("ts_mean", (Step("rank", (ts.delta("close", 5),)), 4))``. ``group`` names the
    group column of group operators (their last input), ``how`` holds further arguments.
    """
    operator: str
    inputs: tuple
    group: str | None = None
    how: dict = field(default_factory=dict)


def _expanded(x, seen: dict | None = None):
    """Macros replaced by their steps; a step that is used several times stays one step."""
    from ..functions.registry import resolve
    seen = {} if seen is None else seen
    if not isinstance(x, Step):
        return x
    if id(x) not in seen:
        made = Step(x.operator, tuple(_expanded(y, seen) for y in x.inputs), x.group, x.how)
        op = resolve(x.operator)
        seen[id(x)] = x, _expanded(op.make(*made.inputs, *_group(x), **x.how), seen) if op.kind == "macro" else made
    return seen[id(x)][1]


def _group(x: Step) -> tuple:
    return () if x.group is None else (x.group,)


def lookback(x: Column | Step | str | float) -> int | None:
    """Rows of a code before the current one that a value needs: what the operator itself looks back, added to the most
    that one of its inputs does. None means all of them, as for a Column, which does not tell."""
    from ..functions.registry import resolve
    if not isinstance(x, Step):
        return None if isinstance(x, Column) else 0
    x = _expanded(x)
    own = resolve(x.operator).past(*x.inputs)
    below = [lookback(y) for y in x.inputs]
    return None if own is None or None in below else own + max(below, default=0)


def composed(panel: DataFrame, factors: dict[str, Column | Step], keep=("date", "code"), buckets: int | None = None) -> DataFrame:
    """A factor set whose members may nest cross-sections and rolling operators.

    Operators along a code's history are projections and windows of one pass. Each cross-section closes a level: the
    statistics of a level are one aggregate for each kind of group, its ranks follow, and what later steps need (keys
    and steps only) is stored once, bucketed by code, so that the windows of the next level are not shuffled. What the
    last level adds is not stored. The plan of a level grows with its number of steps.
    """
    from ..functions.registry import resolve
    from . import cross
    shared: dict = {}
    factors = {k: _expanded(v, shared) for k, v in factors.items()}
    found: dict[int, tuple[Step, str, object, int, int]] = {}

    def collect(x) -> tuple[int, int]:
        """Level and depth of a value; fields and Columns are made before all levels."""
        if not isinstance(x, Step):
            return 0, 0
        if id(x) not in found:
            below = [collect(y) for y in x.inputs]
            op = resolve(x.operator)
            level = max((b[0] for b in below), default=0) + (op.kind in ("cross", "frame"))
            depth = 1 + max((b[1] for b in below), default=0)
            found[id(x)] = x, f"_step{len(found)}", op, level, depth
        return found[id(x)][3:]

    for x in factors.values():
        collect(x)
    steps = sorted(found.values(), key=lambda s: s[3:])
    last = max((s[3] for s in steps), default=0)
    # Columns that are read by name, or in a later level, are made first.
    leaves = {f"{name}_in{k}": y for s, name, op, level, _ in steps for k, y in enumerate(s.inputs)
              if isinstance(y, Column) and (level or op.kind != "column")}
    plain = {k: v for k, v in factors.items() if not isinstance(v, Step)}
    fields = set(panel.columns)

    def inputs(s: Step, name: str) -> list:
        return [found[id(y)][1] if isinstance(y, Step) else f"{name}_in{k}" if f"{name}_in{k}" in leaves else y
                for k, y in enumerate(s.inputs)]

    def reads(s: Step, name: str) -> set:
        known = fields | leaves.keys() | {f[1] for f in found.values()}
        return {y for y in (*inputs(s, name), *_group(s)) if isinstance(y, str) and y in known}

    kept = dict.fromkeys((*keep, "date", "code"))
    outputs = [found[id(v)][1] if isinstance(v, Step) else k for k, v in factors.items()]
    wanted = set().union(*[reads(s, n) for s, n, *_ in steps], kept) & fields
    df = panel.select(*sorted(wanted), *[v.alias(k) for k, v in {**leaves, **plain}.items()])
    for level in range(last + 1):
        here = [s for s in steps if s[3] == level]
        if level:
            df = cross.with_stats(df, {name: op.make(*inputs(s, name), *_group(s), **s.how)
                                       for s, name, op, *_ in here if op.kind == "cross"}, stored=True)
            ranks = [(s, name, op) for s, name, op, *_ in here if op.kind == "frame"]
            for s, name, op in ranks:
                df = op.make(df, *inputs(s, name), *_group(s), name, **s.how)
            later = [s for s in steps if s[3] > level or s[3] == level and s[2].kind in ("column", "history")]
            if later:
                needed = set().union(*[reads(s, n) for s, n, *_ in later], outputs, kept)
                df = cut_by_code(df.select(*[x for x in df.columns if x in needed]), "level", buckets)
        along = [s for s in here if s[2].kind in ("column", "history")]
        for depth in sorted({s[4] for s in along}):
            now = [s for s in along if s[4] == depth]
            df = df.withColumns({name: op.make(*inputs(s, name), **s.how) for s, name, op, *_ in now if op.kind == "column"})
            for s, name, op, *_ in now:
                if op.kind == "history":
                    df = op.make(df, *inputs(s, name), name, **s.how)
    return df.select(*keep, *[F.col(n).alias(k) for n, k in zip(outputs, factors)])


def parts(factors: dict[str, Column | Step]) -> list[dict[str, Column | Step]]:
    """A factor set as sets that can be made apart, each with the columns that it needs alone: ranks and labels shuffle
    rows, so that a factor that uses one goes with those that share it, and the others by their number of levels."""
    from ..functions.registry import resolve
    shared: dict = {}

    def reach(x) -> tuple[int, set]:
        """Levels of a value, and the steps in it that shuffle rows."""
        if not isinstance(x, Step):
            return 0, set()
        below, kind = [reach(y) for y in x.inputs], resolve(x.operator).kind
        moved = set().union(*[m for _, m in below], {id(x)} if kind == "frame" else ())
        return max((n for n, _ in below), default=0) + (kind in ("cross", "frame")), moved

    kept: dict[int, dict] = {}
    groups: list[tuple[set, dict]] = []
    for name, x in factors.items():
        level, moved = reach(_expanded(x, shared))
        if not moved:
            kept.setdefault(level, {})[name] = x
            continue
        alike = [g for g in groups if g[0] & moved]
        groups = [g for g in groups if not g[0] & moved]
        groups.append((moved.union(*[g[0] for g in alike]), {k: v for g in alike for k, v in g[1].items()} | {name: x}))
    return [*kept.values(), *[g[1] for g in groups]]


def resolvable(panel: DataFrame, factors: dict[str, Column | Step]) -> tuple[dict[str, Column | Step], dict[str, str]]:
    """Split a factor set into those that the panel can compute and errors by name: unknown fields and operators, a
    wrong number of inputs, or arguments that an operator does not take. Only the analyzer runs here; no data is read."""
    from ..functions.registry import resolve

    def check(x) -> None:
        if isinstance(x, Column):
            panel.select(x).schema
        elif isinstance(x, Step):
            op = resolve(x.operator)
            if len(x.inputs) + len(_group(x)) != op.inputs and not _variadic(op.make):
                raise TypeError(f"{x.operator} takes {op.inputs} inputs")
            panel.select(*_group(x)).schema
            for y in x.inputs:
                check(y)
            values = [y if isinstance(y, (int, float)) or isinstance(y, str) and y not in panel.columns and op.name == "bucket"
                      else F.lit(1.0) if isinstance(y, Step) else F.col(y) if isinstance(y, str) else y for y in x.inputs]
            if op.kind == "column":
                panel.select(op.make(*values, **x.how)).schema
            elif op.kind in ("cross", "macro"):
                op.make(*values, *_group(x), **x.how)
            else:
                inspect.signature(op.make).bind(panel, *x.inputs, *_group(x), "out", **x.how)
                panel.select(*[y for y in x.inputs if isinstance(y, str)]).schema

    good, bad = {}, {}
    for name, expr in factors.items():
        try:
            check(expr)
            good[name] = expr
        except AnalysisException as error:
            bad[name] = error.getCondition() or "ANALYSIS_ERROR"
        except KeyError as error:
            bad[name] = f"UNKNOWN_OPERATOR {error.args[0]}"
        except (TypeError, ValueError) as error:
            bad[name] = f"INVALID_ARGUMENTS {error}"
    return good, bad


def _variadic(make) -> bool:
    return any(p.kind is p.VAR_POSITIONAL for p in inspect.signature(make).parameters.values())


def factor_status(values: DataFrame) -> DataFrame:
    """Rows, valid rows and coverage per factor of a long value table."""
    return values.groupBy("factor_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("value").alias("valid_count"),
        (F.count("value") / F.count(F.lit(1))).alias("coverage"))


def demo_factors() -> dict[str, Column]:
    """Momentum, reversal, volatility, liquidity and range: the set used in queries."""
    return {"mom4": ratio("close", ts.delay("close", 4)) - 1.0,
            "rev1": ratio(ts.delay("close", 1), "close") - 1.0,
            "vol8": ratio(ts.ts_std("close", 8), ts.ts_mean("close", 8)),
            "liq4": ts.ts_mean("amount", 4),
            "rng": ratio(F.col("high") - F.col("low"), "open")}


def demo_cross_sections() -> dict[str, Step]:
    """Cross-sections of rolling values, in a group, and a rolling mean of a rank, standardized."""
    change = Step("rank", (ts.delta("close", 4),))
    return {"rank_delta": change, "z_mean": Step("zscore", (ts.ts_mean("close", 4),)),
            "sector_gap": Step("group_neutralize", (ts.delta("close", 4),), "sector"),
            "z_mean_rank": Step("zscore", (Step("ts_mean", (change, 3)),))}


def more_cross_sections() -> dict[str, Step]:
    """Operators over the whole panel, along a code's history and in groups, in one set with others."""
    return {"label": Step("densify", ("volume",)), "damped": Step("hump", (Step("rank", ("close",)), 0.05)),
            "unchanged": Step("days_from_last_change", ("category_number",)),
            "sector_filled": Step("group_backfill", (ts.delta("close", 4), 3), "sector")}


def scoring_factors() -> dict[str, Step]:
    """Momentum, reversal and range as steps, which tell how far they look back."""
    return {"mom4": Step("sub", (Step("div", ("close", Step("delay", ("close", 4)))), 1.0)),
            "rev1": Step("sub", (Step("div", (Step("delay", ("close", 1)), "close")), 1.0)),
            "rng": Step("div", (Step("sub", ("high", "low")), "open"))}


GRID_OPERATORS = {
    "delta": lambda x, n: ratio(ts.delta(x, n), ts.delay(x, n)),
    "ts_zscore": ts.ts_zscore,
    "ts_scale": ts.ts_scale,
    "mean_gap": lambda x, n: ratio(x, ts.ts_mean(x, n)) - 1.0,
}


def grid(fields=("close", "volume", "amount"), windows=(4, 8)) -> dict[str, Column]:
    """Field x operator x window candidates."""
    return {f"{op}_{field}_{n}": make(field, n) for field in fields
            for op, make in GRID_OPERATORS.items() for n in windows}


def matrix(panel: DataFrame, field: str, codes) -> DataFrame:
    """Date x code matrix of one field; the codes are listed, which saves a pass."""
    return panel.groupBy("date").pivot("code", list(codes)).agg(F.first(field))
