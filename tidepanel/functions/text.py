"""Text operators over catalog columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .clean import c

# Spellings of operators and their canonical names.
ALIASES = {
    "Abs": "abs", "Log": "log", "Add": "add",
    "Sub": "sub", "subtract": "sub", "Mul": "mul", "multiply": "mul",
    "Div": "div", "divide": "div", "Greater": "max", "Less": "min",
    "Ref": "delay", "Mean": "ts_mean", "Sum": "ts_sum", "Std": "ts_std",
    "Var": "ts_var", "Max": "ts_max", "Min": "ts_min", "Med": "ts_median",
    "Mad": "ts_mad", "Delta": "delta", "WMA": "ts_wma", "EMA": "ts_ema",
    "Cov": "ts_covariance", "Corr": "ts_corr",
}

# Field names by family, and operator names that decide a category.
FIELD_FAMILIES = {
    "price": ("open", "close", "high", "low", "ycp", "HighestPrice", "LowestPrice",
              "max_high_9", "min_low_9"),
    "liquidity": ("volume", "amount", "TurnoverRate"),
    "volatility": ("RangePCT", "ts_std", "ts_var", "ts_mad", "volatility"),
    "trend": ("ema12", "ema26", "dif", "dea", "macd", "ma4", "ma5", "ma8", "ma12",
              "ma16", "ma20", "ma47", "RisingUpDays", "FallingDownDays"),
    "technical": ("RSV", "kdj_k", "kdj_d", "kdj_j", "if_up", "if_flat", "if_down"),
}
VOLATILITY_OPERATORS = ("ts_std", "std", "ts_var", "var", "ts_mad", "mad")
TREND_OPERATORS = ("ts_mean", "mean", "ts_ema", "ema", "ts_wma", "wma", "delta",
                   "ts_delta", "delay", "ref")


def normalize_expression(x) -> Column:
    """Strip ``$``, drop the ``d`` suffix of windows, rewrite aliases."""
    text = F.regexp_replace(F.trim(c(x)), r"\$", "")
    text = F.regexp_replace(text, r"\b(\d+)d\b", "$1")
    for alias, name in ALIASES.items():
        text = F.regexp_replace(text, rf"\b{alias}\s*\(", f"{name}(")
    return text


def word_pattern(names) -> str:
    return rf"(^|[^A-Za-z0-9_])({'|'.join(names)})([^A-Za-z0-9_]|$)"


def call_pattern(names) -> str:
    return rf"(?i)(^|[^A-Za-z0-9_])({'|'.join(names)})\s*\("


def families(x) -> Column:
    flags = [F.when(c(x).rlike(word_pattern(names)), F.lit(family))
             for family, names in FIELD_FAMILIES.items()]
    return F.array_compact(F.array(*flags))


def trending(x) -> Column:
    """A trend operator, no field of that family, and no volatility operator."""
    return (c(x).rlike(call_pattern(TREND_OPERATORS)) & ~c(x).rlike(call_pattern(VOLATILITY_OPERATORS))
            & ~F.array_contains(families(x), "trend"))


def all_families(x) -> Column:
    """Field families of an expression, and trend where its operators make it one."""
    return F.when(trending(x), F.array_append(families(x), F.lit("trend"))).otherwise(families(x))


def infer_category(x) -> Column:
    """Category of an expression from its operators and field families."""
    fam = families(x)
    return (F.when(c(x).rlike(call_pattern(VOLATILITY_OPERATORS)), F.lit("volatility"))
             .when(c(x).rlike(call_pattern(TREND_OPERATORS)) & ~F.array_contains(fam, "trend"),
                   F.lit("trend"))
             .when(F.size(fam) == 0, F.lit("other"))
             .when(F.size(fam) == 1, fam[0])
             .otherwise(F.lit("mixed")))


def operators_used(x) -> Column:
    """Sorted distinct names that are called in the expression."""
    return F.sort_array(F.array_distinct(
        F.regexp_extract_all(c(x), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))))


def stable_id(number, expression) -> Column:
    """factor_NNNN_ plus the first ten hex digits of the expression's SHA-256."""
    return F.concat(F.lit("factor_"), F.format_string("%04d", c(number)), F.lit("_"),
                    F.substring(F.sha2(c(expression), 256), 1, 10))


def sheet_safe(x) -> Column:
    """Quote text that a spreadsheet would take for a formula."""
    return F.when(c(x).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c(x))).otherwise(c(x))
