"""Registered queries and their SQL counterparts."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

# Added before rounding on both sides: engines disagree on exact decimal ties,
# and sums differ in the last bit.
TIE_SHIFT = 1e-9

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int | None = 4) -> Callable[[Query], Query]:
    """Register a query; its double columns are rounded for comparison."""

    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            if digits is None:
                return out
            return out.withColumns({
                f.name: F.round(F.col(f"`{f.name}`") + F.lit(TIE_SHIFT), digits) + F.lit(0.0) for f in out.schema.fields
                if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            })

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def sql(ctes: Sequence[str], body: str, keep: str = "", rounded: str = "", digits: int = 4) -> str:
    """``with ctes select keep, round(rounded) from (body)``."""
    cols = [f'"{c}"' for c in keep.split()]
    cols += [f'round("{c}" + 1e-9, {digits}) + 0.0::double as "{c}"' for c in rounded.split()]
    head = f"with {', '.join(ctes)} " if ctes else ""
    return f"{head}select {', '.join(cols) if cols else '*'} from ({body}) q"
