"""Element-wise operators. NULL in, NULL out unless the operator says otherwise."""

from __future__ import annotations

from functools import reduce
from operator import add as _plus, mul as _times, sub as _minus

from pyspark.sql import Column, functions as F

from .clean import c, finite, ratio


def abs_(x) -> Column:
    return F.abs(c(x))


def log(x) -> Column:
    x = c(x)
    return F.when(x > 0, F.ln(x))


def sqrt(x) -> Column:
    x = c(x)
    return F.when(x >= 0, F.sqrt(x))


def sign(x) -> Column:
    return F.signum(c(x))


def reverse(x) -> Column:
    return -c(x)


def inverse(x) -> Column:
    return ratio(F.lit(1.0), x)


def power(x, y) -> Column:
    return finite(F.pow(c(x), c(y)))


def signed_power(x, y) -> Column:
    x = c(x)
    return finite(F.signum(x) * F.pow(F.abs(x), c(y)))


def add(*args, filter: bool = False) -> Column:
    """Sum that skips NULL operands; NULL only if all are NULL (0 with ``filter``)."""
    cols = [c(a) for a in args]
    total = reduce(_plus, [F.coalesce(a, F.lit(0.0)) for a in cols])
    return total if filter else F.when(F.coalesce(*cols).isNotNull(), total)


def _fold(op, args, filter):
    cols = [F.coalesce(c(a), F.lit(0.0)) if filter else c(a) for a in args]
    return reduce(op, cols)


def subtract(*args, filter: bool = False) -> Column:
    return _fold(_minus, args, filter)


def multiply(*args, filter: bool = False) -> Column:
    return _fold(_times, args, filter)


def divide(x, y, eps: float | None = None) -> Column:
    return ratio(x, y, eps)


def maximum(*args) -> Column:
    return F.greatest(*[c(a) for a in args])


def minimum(*args) -> Column:
    return F.least(*[c(a) for a in args])


def floor_mod(x, y) -> Column:
    """Remainder with the sign of the divisor; zero divisor gives NULL."""
    x, y = c(x), c(y)
    return x - F.floor(ratio(x, y)) * y


def bucket(x, spec: str = "0,1,0.1") -> Column:
    """Bucket number of ``x`` in the range text 'start,end,step', clamped to it."""
    start, end, step = (float(part) for part in spec.split(","))
    last = -(-(end - start) // step) - 1
    place = F.floor((c(x) - start) / step).cast("double")
    return F.when(place.isNotNull(),
                  F.greatest(F.least(place, F.lit(float(last))), F.lit(0.0)))


def equal(x, y) -> Column:
    return F.coalesce(c(x) == c(y), F.lit(False))


def not_equal(x, y) -> Column:
    """True whenever a side is missing, like a float comparison with NaN."""
    return F.coalesce(c(x) != c(y), F.lit(True))


def greater(x, y) -> Column:
    return F.coalesce(c(x) > c(y), F.lit(False))


def greater_equal(x, y) -> Column:
    return F.coalesce(c(x) >= c(y), F.lit(False))


def less(x, y) -> Column:
    return F.coalesce(c(x) < c(y), F.lit(False))


def less_equal(x, y) -> Column:
    return F.coalesce(c(x) <= c(y), F.lit(False))


def truth(x) -> Column:
    """Truthiness of a number: zero is false, missing counts as true."""
    return F.coalesce(c(x) != 0, F.lit(True))


def and_(x, y) -> Column:
    return truth(x) & truth(y)


def or_(x, y) -> Column:
    return truth(x) | truth(y)


def not_(x) -> Column:
    return ~truth(x)


def if_else(condition: Column, a, b) -> Column:
    return F.when(condition, c(a)).otherwise(c(b))


def is_nan(x) -> Column:
    return c(x).isNull()


def vec_sum(x: Column) -> Column:
    """Sum of an array column (daily scalars pass through ``vec_scalar``)."""
    return F.aggregate(x, F.lit(0.0), lambda acc, e: acc + F.coalesce(e, F.lit(0.0)))


def vec_avg(x: Column) -> Column:
    present = F.filter(x, lambda e: e.isNotNull())
    return ratio(vec_sum(present), F.size(present).cast("double"))


def vec_scalar(x) -> Column:
    return c(x)


def paired_delta(new, base, new_cost, base_cost, beta: float) -> Column:
    """Improvement of one objective over another after a complexity charge."""
    return c(new) - c(base) - F.lit(float(beta)) * (c(new_cost) - c(base_cost))


def paired_reward(delta, used: Column, tau: float) -> Column:
    return F.tanh(F.when(used, c(delta)).otherwise(F.lit(0.0)) / F.lit(float(tau)))
