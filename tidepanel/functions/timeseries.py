"""Rolling operators over the rows of one code, as Columns.

A code has at most one row per session, so every window partition is bounded by the
calendar however many codes there are. A window of n rows yields a value only when
all n rows are present.
"""

from __future__ import annotations

from functools import reduce
from operator import add as _plus

from pyspark.sql import Column, Window, WindowSpec, functions as F

from .clean import c, ratio
from .probit import bind, spread_rank

def history() -> WindowSpec:
    return Window.partitionBy("code").orderBy("date")


def rows(n: int, spec: WindowSpec | None = None) -> WindowSpec:
    return (spec or history()).rowsBetween(-(int(n) - 1), 0)


def so_far(spec: WindowSpec | None = None) -> WindowSpec:
    return (spec or history()).rowsBetween(Window.unboundedPreceding, 0)


def full(x, n: int, spec: WindowSpec | None = None) -> Column:
    return F.count(c(x)).over(rows(n, spec)) == int(n)


def rolling(agg: Column, x, n: int, spec: WindowSpec | None = None) -> Column:
    return F.when(full(x, n, spec), agg.over(rows(n, spec)))


def window_array(x, n: int, spec: WindowSpec | None = None) -> Column:
    """The window as an array, oldest first, NULL slots kept (at most n entries)."""
    packed = F.collect_list(F.struct(c(x).alias("x"))).over(rows(n, spec))
    return F.transform(packed, lambda e: e["x"])


def delay(x, n: int, spec: WindowSpec | None = None) -> Column:
    return F.lag(c(x), int(n)).over(spec or history())


def delta(x, n: int, spec: WindowSpec | None = None) -> Column:
    return c(x) - delay(x, n, spec)


def ts_mean(x, n: int) -> Column:
    return rolling(F.avg(c(x)), x, n)


def ts_sum(x, n: int) -> Column:
    return rolling(F.sum(c(x)), x, n)


def ts_std(x, n: int) -> Column:
    return rolling(F.stddev_samp(c(x)), x, n)


def ts_std_pop(x, n: int) -> Column:
    return rolling(F.stddev_pop(c(x)), x, n)


def ts_var(x, n: int) -> Column:
    return rolling(F.var_samp(c(x)), x, n)


def ts_min(x, n: int) -> Column:
    return rolling(F.min(c(x)), x, n)


def ts_max(x, n: int) -> Column:
    return rolling(F.max(c(x)), x, n)


def ts_median(x, n: int) -> Column:
    return rolling(F.percentile(c(x), F.lit(0.5)), x, n)


def ts_product(x, n: int) -> Column:
    return rolling(F.product(c(x)), x, n)


def ts_backfill(x, n: int, spec: WindowSpec | None = None) -> Column:
    """Carry the last value forward over at most n missing rows."""
    return F.last(c(x), ignorenulls=True).over((spec or history()).rowsBetween(-int(n), 0))


def ts_mad(x, n: int) -> Column:
    mean = F.avg(c(x)).over(rows(n))
    spread = F.aggregate(window_array(x, n), F.lit(0.0), lambda acc, e: acc + F.abs(e - mean))
    return F.when(full(x, n), spread / F.lit(float(n)))


def ts_rank(x, n: int) -> Column:
    """Percentile of the current value in its window, ties averaged."""
    x, a = c(x), window_array(x, n)
    below = F.size(F.filter(a, lambda e: e < x))
    same = F.size(F.filter(a, lambda e: e == x))
    return F.when(full(x, n), (below + (same + 1) / F.lit(2.0)) / F.lit(float(n)))


def ts_quantile(x, n: int, driver: str = "gaussian", sigma: float = 1.0) -> Column:
    return bind(ts_rank(x, n), lambda p: spread_rank(p, driver, sigma))


def ts_scale(x, n: int) -> Column:
    low, high = ts_min(x, n), ts_max(x, n)
    return ratio(c(x) - low, high - low)


def ts_zscore(x, n: int) -> Column:
    return ratio(c(x) - ts_mean(x, n), ts_std(x, n))


def ts_av_diff(x, n: int) -> Column:
    return c(x) - ts_mean(x, n)


def _since(x, n: int, extreme) -> Column:
    a = window_array(x, n)
    place = F.array_position(a, extreme(a)).cast("double")
    return F.when(full(x, n), F.lit(float(n)) - place)


def ts_arg_max(x, n: int) -> Column:
    """Rows since the first maximum of the window."""
    return _since(x, n, F.array_max)


def ts_arg_min(x, n: int) -> Column:
    return _since(x, n, F.array_min)


def _paired(x, y):
    x, y = c(x), c(y)
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def ts_covariance(x, y, n: int) -> Column:
    px, py = _paired(x, y)
    return rolling(F.covar_samp(px, py), px, n)


def ts_corr(x, y, n: int) -> Column:
    """Rolling correlation; a constant side gives NULL."""
    px, py = _paired(x, y)
    w = rows(n)
    spread = F.stddev_pop(px).over(w) * F.stddev_pop(py).over(w)
    return F.when(full(px, n), ratio(F.covar_pop(px, py).over(w), spread))


def ts_regression(y, x, n: int) -> Column:
    """Rolling slope of y on x."""
    return ratio(ts_covariance(y, x, n), ts_var(x, n))


def weighted_window(x, weights) -> Column:
    """Weighted mean of the last rows; ``weights`` run from the oldest to the newest."""
    n, total = len(weights), float(sum(weights))
    return reduce(_plus, [delay(x, n - 1 - i) * F.lit(w / total)
                          for i, w in enumerate(weights)])


def ts_decay_linear(x, n: int) -> Column:
    return weighted_window(x, [float(i + 1) for i in range(int(n))])


def ts_wma(x, n: int, first: int = 0) -> Column:
    """Linear weights starting at ``first``: 0 in one dialect, 1 in the other."""
    weights = [float(first + i) for i in range(int(n))]
    return weighted_window(x, weights) if sum(weights) else ts_mean(x, n)


def ts_ema(x, n: int) -> Column:
    """Exponential weights with smoothing 1 - 2 / (1 + n), newest heaviest."""
    n = int(n)
    keep = 1.0 - 2.0 / (1.0 + n)
    return weighted_window(x, [keep ** (n - i) for i in range(n)]) if keep else c(x)


def kth_element(x, n: int, k: int) -> Column:
    if not 0 < k <= n:
        return F.lit(None).cast("double")
    return F.when(full(x, n), delay(x, k - 1))


def last_diff_value(x, n: int) -> Column:
    """Most recent value in the window that differs from the current one."""
    x, a = c(x), window_array(x, n)
    return F.when(full(x, n), F.get(F.filter(F.reverse(a), lambda e: e != x), F.lit(0)))


def ts_count_nans(x, n: int) -> Column:
    missing = F.count_if(c(x).isNull()).over(rows(n))
    return F.when(F.row_number().over(history()) >= int(n), missing.cast("double"))


def ts_step() -> Column:
    return (F.row_number().over(history()) - 1).cast("double")


def forward_return(price="close", horizon: int = 4) -> Column:
    """price(t + h rows) / price(t) - 1; a zero or missing price gives NULL."""
    return ratio(F.lead(c(price), int(horizon)).over(history()), price) - 1.0


def trade_when(enter, value, leave) -> Column:
    """Hold ``value`` from an enter signal until a leave signal; leave wins."""
    mark = (F.when(c(leave) > 0, F.struct(F.lit(None).cast("double").alias("held")))
             .when(c(enter) > 0, F.struct(c(value).cast("double").alias("held"))))
    return F.last(mark, ignorenulls=True).over(so_far())["held"]


def previous_mark(price="close") -> Column:
    """Last positive price strictly before the current row."""
    positive = F.when(c(price) > 0, c(price))
    before = history().rowsBetween(Window.unboundedPreceding, -1)
    return F.last(positive, ignorenulls=True).over(before)


def current_mark(price="close") -> Column:
    positive = F.when(c(price) > 0, c(price))
    return F.last(positive, ignorenulls=True).over(so_far())
