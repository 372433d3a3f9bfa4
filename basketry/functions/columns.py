"""Scalar column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_symbol(c="symbol") -> Column:
    """``.`` in a ticker becomes ``_`` (a dot would read as a struct field)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(c, ".", "_")


def date_parts(dt="dt") -> list[Column]:
    """year, month, day (integers) of a date column."""
    d = F.col(dt) if isinstance(dt, str) else dt
    return [F.year(d).cast("int").alias("year"),
            F.month(d).cast("int").alias("month"),
            F.dayofmonth(d).cast("int").alias("day")]


def rescale_range(x, old_min, old_max, new_min, new_max) -> Column:
    """Linear map of [old_min, old_max] onto [new_min, new_max]; new_min when the
    old range is empty; no clamping."""
    def c(v):
        return v if isinstance(v, Column) else F.lit(float(v))
    x, old_min, old_max, new_min, new_max = map(c, (x, old_min, old_max, new_min, new_max))
    old_range = old_max - old_min
    return F.when(old_range == 0, new_min).otherwise(
        ((x - old_min) * (new_max - new_min)) / old_range + new_min)


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0 (ANSI mode raises on plain division)."""
    return F.try_divide(num, den)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where the body reads it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


EXACT = "decimal(38,18)"


def exact_sum(c) -> Column:
    """Sum of doubles accumulated as decimal(38,18): independent of row order, so a
    re-run or another partitioning gives the same bits (a float sum does not)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast(EXACT))


def sql_exact_sum(expr: str) -> str:
    return f"cast(sum(cast({expr} as {EXACT})) as double)"
