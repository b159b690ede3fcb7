"""Ingest rules: only NULL means missing once data has passed through here."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Domain of a nanosecond timestamp; dates outside become NULL and are dropped.
# It bounds every date-level table: no more than MAX_SESSIONS distinct days.
FIRST_DAY = "1677-09-22"
LAST_DAY = "2262-04-11"
MAX_SESSIONS = 213_503


def c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def finite(x) -> Column:
    """NaN and infinities become NULL."""
    x = c(x)
    inf = F.lit(float("inf"))
    return F.when(~F.isnan(x) & (x != inf) & (x != -inf), x)


def to_number(x) -> Column:
    """Numeric text or number as double; anything unreadable becomes NULL."""
    return finite(c(x).try_cast("double"))


def session_day(x) -> Column:
    """Timestamp text or value truncated to the day, NULL outside the date domain."""
    day = F.date_trunc("day", c(x).try_cast("timestamp"))
    return F.when(day.between(F.lit(FIRST_DAY).cast("timestamp"),
                              F.lit(LAST_DAY).cast("timestamp")), day)


def zero_pad(x, width: int = 6) -> Column:
    """Left zero padding that never truncates longer text."""
    x = c(x)
    return F.concat(F.expr("repeat('0', 0)") if width <= 0 else
                    F.repeat(F.lit("0"), F.lit(width) - F.length(x)), x)


def normalize_code(x) -> Column:
    """Trim, drop a trailing ``.0``, zero-pad digits to six, upper-case the rest."""
    text = F.regexp_replace(F.trim(c(x).cast("string")), r"\.0$", "")
    return F.when(text.rlike(r"^\d+$"), zero_pad(text)).otherwise(F.upper(text))


def first_text(*columns) -> Column:
    """First column that is neither NULL nor blank; '' if there is none."""
    parts = [F.nullif(F.trim(c(x).cast("string")), F.lit("")) for x in columns]
    return F.coalesce(*parts, F.lit(""))


def ratio(a, b, eps: float | None = None) -> Column:
    """a / b with a zero (or, with ``eps``, near-zero) denominator giving NULL."""
    a, b = c(a), c(b)
    if eps is None:
        return F.try_divide(a, F.nullif(b, F.lit(0.0)))
    return F.try_divide(a, F.when(F.abs(b) > eps, b))
