"""Correlation aggregates from moments: partial aggregation, no error on constants."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .clean import c, ratio


def paired(x, y) -> tuple[Column, Column]:
    x, y = c(x), c(y)
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def pair_count(x, y) -> Column:
    return F.count(paired(x, y)[0])


def pearson(x, y, min_pairs: int = 3) -> Column:
    """Grouped correlation of complete pairs; too few or constant gives NULL."""
    px, py = paired(x, y)
    spread = F.stddev_pop(px) * F.stddev_pop(py)
    return F.when(F.count(px) >= min_pairs, ratio(F.covar_pop(px, py), spread))


def pearson_floored(x, y, floor: float = 1e-3, min_pairs: int = 2) -> Column:
    """Grouped correlation that is 0 when a side hardly varies."""
    px, py = paired(x, y)
    sx, sy = F.stddev_pop(px), F.stddev_pop(py)
    value = F.when((sx < floor) | (sy < floor), F.lit(0.0)).otherwise(
        ratio(F.covar_pop(px, py), sx * sy))
    return F.when(F.count(px) >= min_pairs, value)


def pearson_over_eps(x, y, eps: float, min_pairs: int = 2) -> Column:
    """Grouped correlation where both deviations exceed ``eps``, else NULL."""
    px, py = paired(x, y)
    sx, sy = F.stddev_pop(px), F.stddev_pop(py)
    return F.when((F.count(px) >= min_pairs) & (sx > eps) & (sy > eps),
                  ratio(F.covar_pop(px, py), sx * sy))


def slope(x, y, min_pairs: int = 2) -> Column:
    """Grouped least-squares slope of y on x."""
    px, py = paired(x, y)
    return F.when(F.count(px) >= min_pairs, ratio(F.covar_pop(px, py), F.var_pop(px)))


def information_ratio(x) -> Column:
    """mean / sample deviation; NULL below two values or without variation."""
    x = c(x)
    return F.when(F.count(x) >= 2, ratio(F.avg(x), F.stddev_samp(x)))


def floored_ratio(x, floor: float = 1e-6) -> Column:
    """mean / population deviation with a lower bound on the deviation."""
    x = c(x)
    return F.avg(x) / F.greatest(F.stddev_pop(x), F.lit(floor))
