"""Entity classification: populations, label builders, diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom import spec as S
from panelloom.functions import labels as L
from panelloom.functions.nullsafe import is_below, last_row, last_value, share
from panelloom.operators.ranks import cumulate, unpivot
from panelloom.spec import PanelSpec

#: Largest n * m for which the two-sample test counts paths.
EXACT_CELLS = 10_000


def crop_failure(af: str, ta: str, threshold: float) -> Column:
    return is_below(af, threshold) | is_below(ta, threshold)


def entity_health(df: DataFrame, spec: PanelSpec, stock: str, af: str, ta: str,
                  threshold: float = S.YIELD_FAIL) -> DataFrame:
    """Last non-null stock and share of failed rows, one map-side combined aggregate."""
    return df.groupBy(spec.entity).agg(
        last_value(stock, spec.ordering).alias("final_stock"),
        share(crop_failure(af, ta, threshold)).alias("fail_rate"),
    )


def populations(health: DataFrame, fail=S.TREE_FAIL, stunt=S.TREE_STUNT,
                rate=S.YIELD_FAIL_RATE) -> DataFrame:
    """Adds the 6-class and 4-class labels.  The given tree thresholds are honoured."""
    failed = F.col("fail_rate") > rate
    return health.withColumns({
        "yield_failed": failed,
        "population": L.pair_label(L.crop_part(failed), L.tree_part_3("final_stock", fail, stunt)),
        "population_binary": L.pair_label(L.crop_part(failed), L.tree_part_2("final_stock", stunt)),
    })


def keep_population(df: DataFrame, labelled: DataFrame, spec: PanelSpec,
                    population: str | None = S.NOMINAL) -> DataFrame:
    """Panel rows with their label, optionally of one population only."""
    if population is not None and population not in S.POPULATIONS_6:
        raise ValueError(f"unknown population {population!r}")
    labels = labelled.select(spec.entity, "population", "population_binary")
    if population is None:
        return df.join(labels, spec.entity, "left")
    return df.join(labels.where(F.col("population") == population), spec.entity)


def population_distribution(labelled: DataFrame, labels: Sequence[str], column: str = "population") -> DataFrame:
    """Count and percentage (1 dp) per label of a fixed list, zero-filled."""
    spark = labelled.sparkSession
    wanted = spark.createDataFrame([(x,) for x in labels], f"{column} string")
    # One row per label from here on.
    counts = labelled.groupBy(column).agg(F.count("*").alias("n")).withColumn(
        "_total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    return (
        wanted.join(counts, column, "left")
        .select(
            column,
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
            F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.col("n"), F.col("_total")), F.lit(0.0)), 1).alias("pct"),
        )
    )


def sensitivity_populations(df: DataFrame, entity: str, cycle: str, stock: str, af: str, ta: str,
                            threshold: float = S.YIELD_FAIL, rate: float = S.YIELD_FAIL_RATE,
                            fail: float = S.TREE_FAIL) -> DataFrame:
    """The sensitivity study's own labels: AF and TA rates judged separately, stock of
    the row with the highest cycle number (missing kept), tree failed only below ``fail``."""
    out = df.groupBy(entity).agg(
        last_row([stock], [cycle]).getField(stock).alias("final_stock"),
        share(is_below(af, threshold)).alias("fail_rate_af"),
        share(is_below(ta, threshold)).alias("fail_rate_ta"),
    )
    crop_failed = (F.col("fail_rate_af") > rate) | (F.col("fail_rate_ta") > rate)
    tree = F.when(is_below("final_stock", fail), F.lit("tree_failed")).otherwise(F.lit("tree_ok"))
    return out.withColumn("population", L.pair_label(L.crop_part(crop_failed), tree))


def tree_labels(health: DataFrame, entity: str, fail=S.TREE_FAIL, stunt=S.TREE_STUNT) -> DataFrame:
    """Failed flag, ok flag and 3-class bin from the final stock.

    A missing stock gives a NULL bin (a cast error in eager code).
    """
    return health.select(
        entity,
        is_below("final_stock", fail).cast("int").alias("tree_failed"),
        F.coalesce(F.col("final_stock") >= stunt, F.lit(False)).cast("int").alias("tree_ok"),
        L.bin_index("final_stock", [fail, stunt]).alias("tree_class"),
    )


def yield_labels(health: DataFrame, entity: str, rate=S.YIELD_FAIL_RATE) -> DataFrame:
    return health.select(entity, (F.col("fail_rate") > rate).cast("int").alias("yield_failed"))


# Names of the four exclusion criteria.
CRITERIA = ["carbon_dead_AF", "carbon_dead_TF", "yield_failure", "high_na"]


def diagnostic_flags(df: DataFrame, spec: PanelSpec, stock_af: str, stock_tf: str, ta: str,
                     key_columns: Sequence[str], final_min: float = 1.0, ta_min: float = 0.05,
                     ta_share: float = 0.30, na_share: float = 0.20) -> DataFrame:
    """One row per entity with one boolean per criterion."""
    missing = sum((F.avg(F.col(c).isNull().cast("int")) for c in key_columns[1:]),
                  F.avg(F.col(key_columns[0]).isNull().cast("int"))) / len(key_columns)
    stats = df.groupBy(spec.entity).agg(
        last_row([stock_af, stock_tf], spec.ordering).alias("_last"),
        share(is_below(ta, ta_min)).alias("_ta"),
        missing.alias("_na"),
    )
    return stats.select(
        spec.entity,
        is_below(F.col("_last").getField(stock_af), final_min).alias("carbon_dead_AF"),
        is_below(F.col("_last").getField(stock_tf), final_min).alias("carbon_dead_TF"),
        (F.col("_ta") > ta_share).alias("yield_failure"),
        (F.col("_na") > na_share).alias("high_na"),
    )


def flagged(flags: DataFrame) -> DataFrame:
    return flags.where(F.greatest(*CRITERIA))


def diagnostic_summary(flags: DataFrame) -> DataFrame:
    """Number of flagged entities per criterion, both stocks, and the union."""
    counts = flags.agg(
        *[F.count_if(c).alias(c) for c in CRITERIA],
        F.count_if(F.col("carbon_dead_AF") & F.col("carbon_dead_TF")).alias("carbon_dead_BOTH"),
        F.count_if(F.greatest(*CRITERIA)).alias("TOTAL (union)"),
    )
    return counts.unpivot([], counts.columns, "criterion", "n_flagged")


def ks_exact(n: Column, m: Column, stat: Column) -> Column:
    """Probability that two samples of n and m values from one continuous distribution lie at least ``stat`` apart.

    Sorted together, the samples are a path from (0, 0) to (n, m); p(i, j) is the probability that it comes by (i, j) without having been
    that far off the diagonal. One fold over i holds the row of all j.
    """
    far = F.round(stat * n * m).cast("long")

    def cell(before: Column, row: Column, i: Column, j: Column) -> Column:
        left = (n + m - i - j + 1).cast("double")
        from_a = F.when(i > 0, F.get(before, j.cast("int")) * (n - i + 1) / left).otherwise(F.lit(0.0))
        from_b = F.when(j > 0, F.get(row, (j - 1).cast("int")) * (m - j + 1) / left).otherwise(F.lit(0.0))
        here = F.when((i == 0) & (j == 0), F.lit(1.0)).otherwise(from_a + from_b)
        return F.when(F.abs(i * m - j * n) >= far, F.lit(0.0)).otherwise(here)

    def row_of(before: Column, i: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0).cast("long"), m), F.array().cast("array<double>"), lambda row, j: F.array_append(row, cell(before, row, i, j)))

    last = F.aggregate(F.sequence(F.lit(0).cast("long"), n), F.array().cast("array<double>"), row_of)
    return F.when(far <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.get(last, m.cast("int")))))


def ks_two_sample(df: DataFrame, flag: str, parameters: Sequence[str], min_size: int = 10) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov per parameter, flagged against the rest.

    Both empirical distributions come from one distributed running count over
    distinct values.  The p-value is exact up to ``EXACT_CELLS`` = n * m, beyond it
    the asymptotic series.
    """
    long = unpivot(df.withColumn("_f", F.col(flag).cast("int")), ["_f"], parameters, "parameter")
    steps = cumulate(long, ["parameter"], "value", {"a": F.col("_f"), "b": 1 - F.col("_f")})
    gap = F.abs(
        F.try_divide(F.col("a_below") + F.col("a"), F.col("a_total"))
        - F.try_divide(F.col("b_below") + F.col("b"), F.col("b_total"))
    )
    out = steps.groupBy("parameter").agg(
        F.max(gap).alias("ks_stat"), F.max("a_total").alias("n_flagged"), F.max("b_total").alias("n_rest")
    ).where((F.col("n_flagged") > min_size) & (F.col("n_rest") > min_size))
    effective = F.col("n_flagged") * F.col("n_rest") / (F.col("n_flagged") + F.col("n_rest"))
    out = out.withColumn("_lam", F.sqrt(effective) * F.col("ks_stat"))

    def term(total, k):
        sign = F.when(k % 2 == 1, 1.0).otherwise(-1.0)
        return total + sign * F.exp(-2.0 * k * k * F.col("_lam") * F.col("_lam"))

    series = 2.0 * F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), term)
    p = F.when(F.col("_lam") < 0.1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))
    n, m = F.col("n_flagged"), F.col("n_rest")
    p = F.when(n * m <= EXACT_CELLS, ks_exact(n, m, F.col("ks_stat"))).otherwise(p)
    return out.withColumn("p_value", p).drop("_lam").orderBy(F.desc("ks_stat"), "parameter")
