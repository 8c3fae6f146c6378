"""Scenario parameter arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelloom.functions.nullsafe import col


def spread(value: str | Column, n: int) -> Column:
    """Repeat a scalar over ``n`` years; an absent scalar counts as zero."""
    return F.array_repeat(F.coalesce(col(value).cast("double"), F.lit(0.0)), n)


def checked(values: str | Column, n: int) -> Column:
    """The array itself, failing the job if its length is not ``n``."""
    values = col(values)
    return F.when(F.size(values) == n, values).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {n} yearly values, got "), F.size(values).cast("string")))
    )


def window_slice(values: str | Column, horizon: int, width: int) -> Column:
    """The last ``width`` values up to ``horizon``."""
    start = max(1, horizon - width + 1)
    return F.slice(col(values), start, horizon - start + 1)


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)
