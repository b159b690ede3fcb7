"""Session flags of a padded panel; a missing value fails the test."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def session_flags() -> dict[str, Column]:
    open_, close = F.col("open"), F.col("close")
    active = F.col("Ifsuspend") == 0
    can = _sure((open_ > 0) & active)
    return {"observed": close.isNotNull() & open_.isNotNull(),
            "eligible": _sure((close > 0) & (open_ > 0) & (F.col("volume") > 0) & active),
            "can_buy_open": can, "can_sell_open": can}
