"""Panels derived from the TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.sources.readers import read_table
from panelloom.spec import PanelSpec

EVENTS = PanelSpec("entity", "period", "category")
ORDERS = PanelSpec("entity", "year", "category", order=("category",))
FIELD = PanelSpec("SimID", "Harvest_Year_Absolute", "Crop_Name", order=("Cycle_Nb",))


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (user, day).

    The first aggregate combines on the map side, so a user with a third of all
    events still arrives as at most one row per calendar day; the windows after
    it therefore see bounded groups.
    """
    e = read_table(spark, sf_dir, "events")

    def only(kind: str):
        return F.sum(F.when(F.col("event_type") == kind, F.col("value")))

    daily = e.groupBy(F.col("user_id").alias("entity"), F.col("ts").cast("date").alias("day")).agg(
        only("click").alias("crop_af"),
        only("view").alias("crop_ta"),
        only("purchase").alias("inc_af"),
        only("signup").alias("inc_tf"),
        F.avg("value").alias("clim_mean"),
        F.max("value").alias("clim_max"),
        F.count("*").alias("clim_n"),
        F.min("event_type").alias("category"),
    )
    run = Window.partitionBy("entity").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("entity")
    return daily.select(
        "entity", "day",
        (F.datediff("day", F.min("day").over(whole)) + 1).cast("bigint").alias("period"),
        "category", "crop_af", "crop_ta",
        F.when(F.col("inc_af").isNotNull(), F.sum("inc_af").over(run)).alias("tree_af"),
        F.when(F.col("inc_tf").isNotNull(), F.sum("inc_tf").over(run)).alias("tree_tf"),
        "clim_mean", "clim_max", "clim_n",
    )


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (customer, order year, priority)."""
    o = read_table(spark, sf_dir, "orders")
    li = read_table(spark, sf_dir, "lineitem")
    return (
        o.join(li, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(
            F.col("o_custkey").alias("entity"),
            F.year("o_orderdate").cast("bigint").alias("year"),
            F.col("o_orderpriority").alias("category"),
        )
        .agg(
            F.sum("l_quantity").alias("qty"),
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
            F.avg("l_discount").alias("disc"),
        )
    )


def scored_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate per customer with reproducible class scores and plan parameters."""
    k = F.col("c_custkey")
    return read_table(spark, sf_dir, "customer").select(
        k.alias("SimID"),
        (k * 7919 % 1000 / 1000.0).alias("p_ok"),
        (k * 104729 % 1000 / 1000.0).alias("p_fail"),
        (F.lit(41.0) + k * 37 % 100 / 10.0).alias("latitude"),
        (F.lit(-5.0) + k * 53 % 145 / 10.0).alias("longitude"),
        F.when(F.col("c_nationkey") % 2 == 0, F.lit("wheat")).otherwise(F.lit("maize")).alias("main_crop"),
        F.when(F.col("c_nationkey") % 3 == 0, F.lit("CONST")).otherwise(F.lit("VAR")).alias("w_type"),
        (F.lit(4.0) + k % 21).alias("plotWidth"),
        (F.lit(6.0) + k % 25).alias("plotHeight"),
        (F.lit(0.5) + k * 7 % 75 / 10.0).alias("soilDepth"),
        (F.lit(10.0) + k * 13 % 71).alias("sand"),
        (F.lit(5.0) + k * 17 % 46).alias("clay"),
        (k * 29 % 31).cast("double").alias("stone"),
        (k % 2).cast("double").alias("waterTable"),
        "c_acctbal",
    )


def field_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events panel plus customer plan parameters under the agroforestry column names."""
    p = events_panel(spark, sf_dir)
    plan = scored_plan(spark, sf_dir).drop("p_ok", "p_fail", "main_crop").join(
        read_table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("SimID"), "c_nationkey", "c_mktsegment"
        ), "SimID",
    )
    width_height = F.col("plotWidth") * F.col("plotHeight")
    return (
        p.join(plan, p.entity == plan.SimID)
        .select(
            "SimID",
            (F.year("day") + F.dayofyear("day")).cast("bigint").alias("Harvest_Year_AF"),
            F.col("period").alias("Cycle_Nb"),
            F.col("category").alias("Crop_Name"),
            F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None))
            .when(F.col("c_mktsegment") == "MACHINERY", F.lit("  "))
            .otherwise(F.col("c_mktsegment")).alias("rot_id"),
            F.when(F.col("c_nationkey") % 3 == 0, F.lit("wheat"))
            .when(F.col("c_nationkey") % 3 == 1, F.lit("maize")).alias("main_crop"),
            F.lit("FUT").alias("period"), "w_type", "latitude", "longitude",
            "plotWidth", "plotHeight", F.lit(3.0).alias("strip_width"),
            "soilDepth", "sand", "clay", "stone", "waterTable",
            (F.lit(10000.0) / width_height).alias("density_AF"),
            (F.lit(10000.0) / 9).alias("density_TF"),
            (F.col("crop_af") / 20 - 0.1).alias("yield_AF"),
            (F.col("crop_ta") / 20 - 0.1).alias("yield_TA"),
            (F.col("crop_af") / 8).alias("biomass_AF"),
            (F.col("crop_ta") / 8).alias("biomass_TA"),
            (F.col("tree_af") / 10).alias("carbonStem_AF"),
            (F.col("tree_tf") / 10).alias("carbonStem_TF"),
            (F.col("clim_mean") / 50 - 0.2).alias("waterStress_AF"),
            (F.lit(800.0) + F.col("clim_mean") * 10).alias("GDD_cycle_AF"),
            (F.lit(300.0) + F.col("clim_max")).alias("ETP_cycle_AF"),
            (F.lit(250.0) + F.col("clim_max") * 2).alias("precipitation_AF"),
            F.col("clim_n").cast("double").alias("frost_events_cycle_AF"),
            (F.lit(4000.0) - F.col("clim_mean") * 3).alias("globalRadiation_AF"),
            (F.lit(30.0) + F.col("clim_max") / 50).alias("maxTemperature_extreme_AF"),
            (F.lit(-5.0) + F.col("clim_mean") / 20).alias("minTemperature_extreme_AF"),
            F.lit(None).cast("double").alias("unused_AF"),
        )
    )
