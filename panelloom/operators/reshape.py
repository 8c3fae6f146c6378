"""Pivot and unpivot shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions.nullsafe import first_value
from panelloom.spec import PanelSpec


def period_pivot(df: DataFrame, spec: PanelSpec, value: str, periods: Sequence[int]) -> DataFrame:
    """Entity x period table of first non-null values; the period list is given, so no extra scan."""
    reduced = df.groupBy(spec.entity, spec.period).agg(
        (first_value(value, spec.order) if spec.order else F.min(value)).alias("_v")
    )
    out = reduced.groupBy(spec.entity).pivot(spec.period, list(periods)).agg(F.max("_v"))
    return out.select(spec.entity, *[F.col(f"`{p}`").alias(f"p{p}") for p in periods])


def index_pivot(indices: DataFrame, row: str, column: str, value: str, columns: Sequence) -> DataFrame:
    out = indices.groupBy(row).pivot(column, list(columns)).agg(F.avg(value))
    return out.select(row, *[F.col(f"`{c}`").alias(str(c)) for c in columns])


def widen(long: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    return long.groupBy(*keys).pivot(name, list(names)).agg(F.first(value, ignorenulls=True))


def lengthen(wide: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "target",
             value: str = "value") -> DataFrame:
    return wide.unpivot(list(keys), list(columns), name, value)


def trajectories_to_long(df: DataFrame, keys: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Yearly arrays, one column per target, to (keys, year, target, value)."""
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    wide = df.select(*keys, F.posexplode(zipped).alias("_i", "_z")).select(
        *keys, (F.col("_i") + 1).alias("year"), *[F.col(f"_z.{a}").alias(a) for a in arrays]
    )
    return lengthen(wide, [*keys, "year"], arrays)


def attribution_long(df: DataFrame, keys: Sequence[str], features: Sequence[str], prefix: str = "attr_") -> DataFrame:
    """Attribution and feature-value matrices side by side to (keys, feature, shap_value, feature_value).

    Both values sit in one row, so no join on a row number is needed; a
    feature value that is not a number becomes NULL.
    """
    def number(f: str):
        # The text of a double or an integer names the same number.
        exact = isinstance(df.schema[f].dataType, (T.DoubleType, T.IntegralType))
        return F.col(f).cast("double") if exact else F.col(f).cast("string").try_cast("double")

    pairs = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"{prefix}{f}").cast("double").alias("shap_value"), number(f).alias("feature_value"))
        for f in features
    ])
    return df.select(*keys, F.explode(pairs).alias("s")).select(*keys, "s.*")


def attribution_summary(long: DataFrame, keys: Sequence[str] = ("target", "feature"), value: str = "shap_value") -> DataFrame:
    return long.groupBy(*keys).agg(F.avg(F.abs(value)).alias("mean_abs"), F.count(value).alias("n"))
