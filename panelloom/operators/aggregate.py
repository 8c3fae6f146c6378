"""Entity-level and report aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom import spec as S
from panelloom.functions.nullsafe import clip, first_value, last_value
from panelloom.operators.ranks import column_quantiles, exact_quantiles, unpivot
from panelloom.spec import PanelSpec


def signatures(df: DataFrame, entity: str, category: str) -> DataFrame:
    """Sorted distinct categories joined by ``-``; the set is combined map-side."""
    return df.groupBy(entity).agg(
        F.array_join(F.array_sort(F.collect_set(category)), "-").alias("signature")
    )


def has_multiple(df: DataFrame, entity: str, category: str) -> DataFrame:
    """Whether any entity has more than one category: min and max differ somewhere."""
    per = df.groupBy(entity).agg((F.min(category) != F.max(category)).alias("_multi"))
    return per.agg(F.coalesce(F.bool_or("_multi"), F.lit(False)).alias("has_multiple"))


def share_table(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count and percentage per key."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def na_rates(df: DataFrame, entity: str, columns: Sequence[str]) -> DataFrame:
    """Mean over columns of each column's missing share, per entity."""
    rates: list[Column] = [F.avg(F.col(c).isNull().cast("int")) for c in columns]
    return df.groupBy(entity).agg((sum(rates[1:], rates[0]) / len(rates)).alias("na_rate"))


def stunted_entities(df: DataFrame, spec: PanelSpec, stock: str, crop: str, train: DataFrame,
                     fail=S.TREE_FAIL, stunt=S.TREE_STUNT) -> DataFrame:
    """Training entities with a final stock in ``[fail, stunt)`` and their crop."""
    return (
        df.join(train.select(spec.entity), spec.entity, "left_semi")
        .groupBy(spec.entity)
        .agg(last_value(stock, spec.ordering).alias("final_stock"),
             last_value(crop, spec.ordering).alias("crop"))
        .where((F.col("final_stock") >= fail) & (F.col("final_stock") < stunt))
    )


def stunted_medians(entities: DataFrame) -> DataFrame:
    """Median final stock per crop and over all (crop NULL), exact."""
    both = entities.select(
        "final_stock",
        F.explode(F.array(
            F.struct(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("crop")),
            F.struct(F.lit("crop").alias("scope"), F.col("crop").cast("string").alias("crop")),
        )).alias("g"),
    ).select("final_stock", "g.*").where((F.col("scope") == "all") | F.col("crop").isNotNull())
    keyed = both.withColumn("_key", F.coalesce("crop", F.lit("")))
    out = exact_quantiles(keyed, ["scope", "_key"], "final_stock", {"median": 0.5})
    return out.select(
        F.when(F.col("scope") == "crop", F.col("_key")).alias("crop"), "median",
        F.col("n_values").cast("bigint").alias("n_entities"),
    )


def stunted_profile(df: DataFrame, spec: PanelSpec, stock: str, entities: DataFrame) -> DataFrame:
    """Median over entities of ``clip(stock / final stock, 0, 1)`` per period."""
    final = entities.where(F.col("final_stock") > 0).select(spec.entity, "final_stock")
    shares = df.join(final, spec.entity).select(
        spec.period, clip(F.try_divide(F.col(stock), F.col("final_stock")), 0, 1).alias("profile")
    )
    return exact_quantiles(shares, [spec.period], "profile", {"profile": 0.5}).select(spec.period, "profile")


def entity_targets(df: DataFrame, spec: PanelSpec, means: Sequence[str], lasts: Sequence[str]) -> DataFrame:
    return df.groupBy(spec.entity).agg(
        *[F.avg(c).alias(c) for c in means],
        *[last_value(c, spec.ordering).alias(c) for c in lasts],
    )


def one_row_guard(df: DataFrame, keys: Sequence[str], ordering: Sequence[str],
                  firsts: Sequence[str], means: Sequence[str]) -> DataFrame:
    """One row per key: first feature value, mean target."""
    return df.groupBy(*keys).agg(
        *[first_value(c, ordering).alias(c) for c in firsts],
        *[F.avg(c).alias(c) for c in means],
    )


def dominant_category(df: DataFrame, period: str, category: str) -> DataFrame:
    """Most frequent category per period, smallest on ties."""
    counts = df.where(F.col(category).isNotNull()).groupBy(period, category).agg(F.count("*").alias("n"))
    return counts.groupBy(period).agg(
        F.min_by(category, F.struct(-F.col("n"), F.col(category))).alias("dominant")
    )


def probability_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """mean, std (ddof=1), p10, median, p90 per column, 4 dp."""
    basic = unpivot(df, [], columns).groupBy("variable").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
    q = column_quantiles(df, columns, {"p10": 0.1, "median": 0.5, "p90": 0.9}).drop("n_values")
    out = basic.join(q, "variable")
    return out.select("variable", *[F.round(c, 4).alias(c) for c in out.columns[1:]])


def boot_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """mean, std (ddof=0) and 95% interval over the bootstraps of one key.

    A key has one value per bootstrap, a fixed small number, so the built-in
    exact percentile is bounded.
    """
    return df.groupBy(*keys).agg(
        F.avg(value).alias("hsic_mean"),
        F.stddev_pop(value).alias("hsic_std"),
        F.percentile(value, F.lit(0.025)).alias("hsic_ci_low"),
        F.percentile(value, F.lit(0.975)).alias("hsic_ci_high"),
    )


def order_by_best(summary: DataFrame, slices: Sequence[str] = ()) -> DataFrame:
    """Features ranked by their largest index over targets.

    Windows over features x targets of one slice, not a join with itself, which
    would compute the indices twice.
    """
    best = F.max("hsic_mean").over(Window.partitionBy(*slices, "feature"))
    order = Window.partitionBy(*slices, F.lit(0)).orderBy(F.desc("_best"), "feature")
    return summary.withColumn("_best", best).withColumn(
        "feature_rank", F.dense_rank().over(order).cast("bigint")).drop("_best")
