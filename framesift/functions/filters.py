"""Conditions on rows, as a mapping, SQL or a column."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Filters = str | Mapping[str, Any] | Column | None


def filter_condition(filters: Filters) -> Column | None:
    """Condition from a SQL string, a Column, or a mapping.

    Mapping keys are a column name, optionally followed by NOT, <, <=, > or >=;
    a list, tuple or set of values means any of them.
    """
    if filters is None or isinstance(filters, Column):
        return filters
    if isinstance(filters, str):
        return F.expr(filters)
    tests = {
        "<": lambda c, v: c < v,
        "<=": lambda c, v: c <= v,
        ">": lambda c, v: c > v,
        ">=": lambda c, v: c >= v,
    }
    condition = F.lit(True)
    for spelled, value in filters.items():
        name, _, operator = spelled.strip().partition(" ")
        operator = operator.strip().upper()
        column = F.col(name)
        values = list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value]
        if operator in tests:
            condition = condition & tests[operator](column, value)
        elif operator in ("", "NOT"):
            member = column.isin(values)
            condition = condition & (~member if operator else member)
        else:
            raise ValueError(f"unknown filter operator in {spelled!r}")
    return condition


def filtered(table: DataFrame, filters: Filters) -> DataFrame:
    condition = filter_condition(filters)
    return table if condition is None else table.filter(condition)
