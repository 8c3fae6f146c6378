"""File sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions.nullsafe import nan_to_null

# Spellings of a missing value in CSV files.
NULL_SPELLINGS = ["NA", "NaN", ""]

FORMATS = {"parquet": "parquet", "csv": "csv", "orc": "orc", "json": "json"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with three spellings of missing; typed with ``try_cast`` where a schema is given."""
    names = [f.name for f in schema.fields] if schema else None
    reader = spark.read.option("header", True)
    if schema is not None:
        # Reading as strings with a declared header avoids an inference pass.
        reader = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
    raw = reader.csv(path)
    types = {f.name: f.dataType for f in schema.fields} if schema else {}
    cols = []
    for c in raw.columns:
        cleaned = F.when(~F.col(c).isin(NULL_SPELLINGS), F.col(c))
        cols.append((cleaned.try_cast(types[c]) if c in types else cleaned).alias(c))
    return raw.select(*cols)


def load(spark: SparkSession, path: str, fmt: str | None = None,
         schema: T.StructType | None = None) -> DataFrame:
    """Read a file or folder, the format taken from the extension unless given."""
    fmt = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {sorted(FORMATS)}")
    if fmt == "csv":
        return read_csv(spark, path, schema)
    if fmt == "parquet":
        return read_parquet(spark, path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return nan_to_null(reader.format(FORMATS[fmt]).load(path))


def with_constants(df: DataFrame, constants: Mapping[str, object]) -> DataFrame:
    """Add constant columns; columns already present are never overwritten."""
    return df.withColumns({c: F.lit(v) for c, v in constants.items() if c not in df.columns})


def load_plan(spark: SparkSession, path: str, constants: Mapping[str, object],
              schema: T.StructType | None = None) -> DataFrame:
    return with_constants(read_csv(spark, path, schema), constants)


def load_reference_distribution(spark: SparkSession, path: str) -> DataFrame:
    """Long reference table (year, target, value)."""
    return read_csv(spark, path, T.StructType([
        T.StructField("year", T.LongType()),
        T.StructField("target", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]))


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
