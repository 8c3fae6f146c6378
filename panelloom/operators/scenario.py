"""Scenario analytics on long predictions (scenario_id, year, target, value)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom import spec as S
from panelloom.functions.nullsafe import clip, percent_of, ratio_nonzero
from panelloom.operators.reshape import lengthen, widen

# Strip width and the control forest's plot, in metres.
STRIP = 3.0
FOREST_WIDTH, FOREST_HEIGHT = 3.0, 3.0


def effective_stocks(wide: DataFrame, strip: float = STRIP) -> DataFrame:
    """Area-corrected stocks; the cultivated share is not clipped here."""
    pw, ph = F.col("plotWidth"), F.col("plotHeight")
    return wide.withColumns({
        "yield_AF_eff": clip("yield_AF", 0) * F.try_divide(pw - strip, pw),
        "carbonStem_AF_eff": clip("carbonStem_AF", 0) * F.try_divide(F.lit(10000.0), pw * ph),
        "carbonStem_TF_eff": clip("carbonStem_TF", 0) * (10000.0 / (FOREST_WIDTH * FOREST_HEIGHT)),
    })


def relative_yields(wide: DataFrame) -> DataFrame:
    """RYR of crop and tree and their sum; NULL only where a denominator is exactly 0."""
    return wide.withColumns({
        "RYR_crop": ratio_nonzero("yield_AF_eff", "yield_TA"),
        "RYR_tree": ratio_nonzero("carbonStem_AF_eff", "carbonStem_TF_eff"),
    }).withColumn("LER", F.col("RYR_crop") + F.col("RYR_tree"))


# Names of the six derived series.
DERIVED = ["yield_AF_eff", "carbonStem_AF_eff", "carbonStem_TF_eff", "RYR_crop", "RYR_tree", "LER"]


def add_derived(long: DataFrame, plots: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Long predictions to wide, six derived columns, back to long."""
    keys = ["scenario_id", "year", *extra]
    wide = widen(long, keys, "target", "value", S.CURVE_TARGETS).join(plots, "scenario_id")
    return lengthen(relative_yields(effective_stocks(wide)), keys, [*S.CURVE_TARGETS, *DERIVED])


def mean_ler(wide: DataFrame) -> DataFrame:
    return wide.groupBy("scenario_id").agg(F.avg("LER").alias("LER_mean"))


def trajectories(wide: DataFrame) -> DataFrame:
    """Running crop ratio, yearly tree ratio and their sum.  A scenario has at most one row per year."""
    w = Window.partitionBy("scenario_id").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    top, bottom = F.sum("yield_AF_eff").over(w), F.sum("yield_TA").over(w)
    return wide.withColumn("RR_crop_cumul", F.when(bottom > 0, F.try_divide(top, bottom))).withColumn(
        "LER_running", F.col("RR_crop_cumul") + F.col("RYR_tree")
    )


def hybrid_ratios(wide: DataFrame, guard: float = 0.1) -> DataFrame:
    """Cumulative crop ratio plus final tree ratio per scenario, with guard diagnostics."""
    valid = F.coalesce(F.col("yield_TA") > guard, F.lit(False))
    sums = wide.groupBy("scenario_id").agg(
        F.sum("yield_AF_eff").alias("_af"), F.sum("yield_TA").alias("_ta"),
        F.avg(F.when(valid, F.try_divide("yield_AF_eff", "yield_TA"))).alias("RR_crop_mean_annual"),
        F.max_by("RYR_tree", "year").alias("RR_tree"),
        F.count_if(~valid).alias("n_years_yield_excluded"),
        F.max_by(F.try_divide(F.col("plotWidth") - STRIP, F.col("plotWidth")), "year").alias("cult_frac"),
        *[F.max_by(t, "year").alias(f"{t}_final") for t in S.CURVE_TARGETS],
    )
    return sums.withColumn("RR_crop_cumul", F.when(F.col("_ta") > 0, F.try_divide("_af", "_ta"))).withColumn(
        "LER", F.col("RR_crop_cumul") + F.col("RR_tree")
    ).drop("_af", "_ta")


def percentile_positions(values: DataFrame, reference: DataFrame) -> DataFrame:
    """Share of reference values at the last year that are <= each user value, x100, 1 dp.

    ``values`` is (scenario_id, target, value).  Reference and user values are
    merged in one bucketed running count, so no user is compared with every
    reference row.
    """
    from panelloom.operators.ranks import cumulate

    last = reference.agg(F.max("year").alias("_last"))
    at_end = reference.join(F.broadcast(last), F.col("year") == F.col("_last")).where(F.col("value").isNotNull())
    merged = at_end.select("target", F.col("value").cast("double").alias("value"), F.lit(1).alias("ref")).unionByName(
        values.where(F.col("value").isNotNull()).select("target", F.col("value").cast("double").alias("value"), F.lit(0).alias("ref"))
    )
    steps = cumulate(merged, ["target"], "value", {"ref": F.col("ref")}).where(F.col("ref_total") > 0)
    share = steps.select("target", "value", percent_of(F.col("ref_below") + F.col("ref"), F.col("ref_total")).alias("percentile"))
    return values.withColumn("value", F.col("value").cast("double")).join(share, ["target", "value"])


def sweep_grid(scenarios: DataFrame, parameter: str, steps: int,
               bounds: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """One copy of each scenario per step of one parameter, evenly over its bounds.

    A yearly climate array becomes a scalar when it is the varied parameter.
    """
    if not 3 <= steps <= 10:
        raise ValueError("steps must be between 3 and 10")
    lo, hi = (bounds or S.SWEEP_BOUNDS)[parameter]
    values = F.array(*[F.lit(lo + (hi - lo) * i / (steps - 1)) for i in range(steps)])
    return scenarios.drop(parameter).select("*", F.posexplode(values).alias("step", parameter))


def compare(long: DataFrame, target: str, scenarios: Sequence) -> DataFrame:
    """One target by year, one column per stored scenario."""
    out = long.where(F.col("target") == target).groupBy("year").pivot("scenario_id", list(scenarios)).agg(F.max("value"))
    return out.select("year", *[F.col(f"`{s}`").alias(f"s{s}") for s in scenarios])


def final_table(long: DataFrame) -> DataFrame:
    """Value at the last year per target with its unit, 2 dp."""
    unit = F.create_map(*[F.lit(x) for pair in S.TARGET_UNITS.items() for x in pair])
    return long.groupBy("scenario_id", "target").agg(F.round(F.max_by("value", "year"), 2).alias("value")).withColumn(
        "unit", F.coalesce(F.element_at(unit, F.col("target")), F.lit("—"))
    )
