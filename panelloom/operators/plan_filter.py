"""Screening of an experimental plan by class scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.labels import pair_label
from panelloom.operators.aggregate import probability_stats
from panelloom.session import materialize

# Annotation columns.
ANNOTATIONS = [
    "clf1_tree_status", "clf1_p_tree_ok", "clf2_yield_failed", "clf2_p_yield_ok", "keep", "predicted_population",
]


def annotate(plan: DataFrame, p_tree_ok: Column, p_yield_fail: Column | None, geo_failed: Column | None = None,
             by_probability: bool = False, threshold_tree: float = 0.5, threshold_yield: float = 0.5) -> DataFrame:
    """Six annotation columns.  The label follows the vote in both modes; without a
    yield classifier the location rule decides."""
    failed = (p_yield_fail > 0.5).cast("int") if p_yield_fail is not None else geo_failed.cast("int")
    p_yield_ok = 1.0 - p_yield_fail if p_yield_fail is not None else (1 - geo_failed).cast("double")
    out = plan.withColumns({
        "clf1_tree_status": (p_tree_ok > 0.5).cast("int"), "clf1_p_tree_ok": p_tree_ok,
        "clf2_yield_failed": failed, "clf2_p_yield_ok": p_yield_ok,
    })
    tree_ok, yield_ok = F.col("clf1_tree_status") == 1, F.col("clf2_yield_failed") == 0
    if by_probability:
        keep = (F.col("clf1_p_tree_ok") >= threshold_tree) & (F.col("clf2_p_yield_ok") >= threshold_yield)
    else:
        keep = tree_ok & yield_ok
    label = pair_label(
        F.when(yield_ok, "yield_ok").otherwise("yield_fail"), F.when(tree_ok, "tree_ok").otherwise("tree_degraded")
    )
    return out.withColumns({"keep": keep, "predicted_population": label})


def kept(annotated: DataFrame) -> DataFrame:
    return annotated.where("keep").drop(*ANNOTATIONS)


def rejected(annotated: DataFrame) -> DataFrame:
    return annotated.where(~F.col("keep")).drop(*ANNOTATIONS)


def propagate(sibling: DataFrame, annotated: DataFrame, entity: str = "SimID") -> DataFrame:
    """Flags a sibling plan by the rejected ids, compared as text."""
    gone = annotated.where(~F.col("keep")).select(F.col(entity).cast("string").alias("_id")).distinct().withColumn(
        "_hit", F.lit(True))
    flagged = sibling.join(gone, sibling[entity].cast("string") == F.col("_id"), "left")
    keep = F.col("_hit").isNull()
    return flagged.withColumns({
        "keep": keep,
        "predicted_population": F.when(keep, "propagated_ok").otherwise("propagated_rejected"),
    }).drop("_id", "_hit")


def propagation_report(plans: Mapping[str, DataFrame | None], annotated: DataFrame, entity: str = "SimID") -> DataFrame:
    """Counts per sibling plan; an absent plan or id column gives a skipped record."""
    spark = annotated.sparkSession
    parts = []
    for name, plan in plans.items():
        if plan is None or entity not in plan.columns:
            reason = "file_not_found" if plan is None else "simid_column_missing"
            parts.append(spark.range(1).select(
                F.lit(name).alias("plan"), F.lit(True).alias("skipped"), F.lit(reason).alias("reason"),
                *[F.lit(None).cast("bigint").alias(c) for c in ("n_total", "n_kept", "n_rejected")],
                F.lit(None).cast("double").alias("keep_rate_pct")))
            continue
        parts.append(propagate(plan, annotated, entity).agg(
            F.count("*").alias("n_total"), F.count_if("keep").alias("n_kept")
        ).select(
            F.lit(name).alias("plan"), F.lit(False).alias("skipped"), F.lit(None).cast("string").alias("reason"),
            "n_total", "n_kept", (F.col("n_total") - F.col("n_kept")).alias("n_rejected"),
            F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.col("n_kept"), F.col("n_total")), F.lit(0.0)), 2).alias("keep_rate_pct")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report(annotated: DataFrame) -> DataFrame:
    """Long report (section, name, value): counts, keep rate, label shares, score statistics.

    The four columns it reads are written once.
    """
    annotated = materialize(annotated.select("keep", "predicted_population", "clf1_p_tree_ok", "clf2_p_yield_ok"))
    totals = annotated.agg(
        F.count("*").cast("double").alias("n_total"), F.count_if("keep").cast("double").alias("n_kept"),
    ).withColumn("n_rejected", F.col("n_total") - F.col("n_kept")).withColumn(
        "keep_rate_pct", F.round(F.try_divide(F.lit(100.0) * F.col("n_kept"), F.col("n_total")), 2))
    counts = totals.unpivot([], totals.columns, "name", "value").select(F.lit("counts").alias("section"), "name", "value")
    # One row per label.
    labels = annotated.groupBy("predicted_population").agg(F.count("*").alias("n")).withColumn(
        "_t", F.sum("n").over(Window.partitionBy(F.lit(0))))
    shares = labels.select(F.lit("population_pct").alias("section"), F.col("predicted_population").alias("name"),
                           F.round(F.lit(100.0) * F.col("n") / F.col("_t"), 2).alias("value"))
    sizes = labels.select(F.lit("population_n").alias("section"), F.col("predicted_population").alias("name"),
                          F.col("n").cast("double").alias("value"))
    stats = probability_stats(annotated, ["clf1_p_tree_ok", "clf2_p_yield_ok"])
    scores = stats.unpivot(["variable"], stats.columns[1:], "stat", "value").select(
        F.lit("scores").alias("section"), F.concat_ws(".", "variable", "stat").alias("name"), "value")
    return counts.unionByName(shares).unionByName(sizes).unionByName(scores)
