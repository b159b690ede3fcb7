"""Registered queries: operator id -> (Spark plan, equivalent SQL)."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a callable (spark, sf_dir) -> DataFrame under an operator id."""
    def register(fn):
        assert key not in QUERIES, key
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return register


def load() -> None:
    from . import (accounting, composing, crosses, evaluation, history, joining,  # noqa: F401
                   learning, quality, scalars, sourcing, streams)
