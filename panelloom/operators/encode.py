"""Label encoding: sorted classes of the training rows, unseen values become class 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.operators.lookup import lookup_join
from panelloom.operators.ranks import bucket_number
from panelloom.session import materialize, materialize_counted


def _as_text(df: DataFrame, c: str):
    # Booleans are encoded as 0/1, everything else by its text.
    kind = df.schema[c].dataType
    return (F.col(c).cast("int") if isinstance(kind, T.BooleanType) else F.col(c)).cast("string")


def fit_encoding(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, class, code); one row per distinct class of a categorical column."""
    long = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), _as_text(train, c).alias("class")) for c in columns
    ])).alias("s")).select("s.*").where(F.col("class").isNotNull()).distinct()
    return dense_rank(long, ["variable"], "class", "code").withColumn("code", F.col("code").cast("int"))


def dense_rank(distinct: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    """0-based rank of each value (text too) within its group; ``distinct`` holds every value of a group once.

    Values are cut into ranges at sampled points; a rank is the number of values in the ranges before plus the rank inside its own. Which cuts are
    drawn decides about the load alone, as ranges are written before anything is counted.
    """
    groups = list(groups)
    whole, seen = materialize_counted(distinct)
    parts = bucket_number(seen["n"])
    cut = materialize(whole.repartitionByRange(parts, *groups, value).withColumn("_part", F.spark_partition_id()))
    sizes = cut.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*groups, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # ranges, not values
    inside = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(value)) - 1
    return cut.join(offsets, [*groups, "_part"]).withColumn(out, F.col("_before") + inside).drop("_part", "_before")


def apply_encoding(df: DataFrame, encoding: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Codes in place of classes; few classes are broadcast after counting them, of many only the crowded ones (see ``lookup_join``)."""
    for c in columns:
        codes = encoding.where(F.col("variable") == c).select(F.col("class").alias("_class"), F.col("code").alias("_code"))
        df = lookup_join(df.withColumn("_class", _as_text(df, c)), codes, ["_class"]).withColumn(
            c, F.coalesce("_code", F.lit(0))
        ).drop("_class", "_code")
    return df
