"""Sources and sinks: write files in the shared folder, read them back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom import spec as S
from panelloom.catalog.ctes import EVENTS, PLAN
from panelloom.catalog.q_scenarios import ANN, REPORT, VOTE
from panelloom.catalog.registry import query, sql
from panelloom.operators import plan_filter as K
from panelloom.session import scratch_path
from panelloom.sources import presets, readers, sinks

CUSTOMER = ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("src_auto", sql([], "select * from customer", "c_custkey c_name c_nationkey c_mktsegment", "c_acctbal"))
def src_auto(spark, sf):
    return readers.load(spark, f"{sf}/customer.parquet")


@query("src_parquet", sql([], "select * from supplier", "s_suppkey s_name s_nationkey", "s_acctbal"))
def src_parquet(spark, sf):
    return readers.read_parquet(spark, f"{sf}/supplier.parquet")


@query("src_csv", sql([], """select c_custkey, c_nationkey,
    case when c_mktsegment in ('BUILDING', 'MACHINERY') then null else c_mktsegment end as c_mktsegment,
    case when c_nationkey = 7 then null else c_acctbal end as c_acctbal from customer""",
    "c_custkey c_nationkey c_mktsegment", "c_acctbal"))
def src_csv(spark, sf):
    """Three spellings of missing survive a round trip through text."""
    df = readers.read_table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey",
        F.when(F.col("c_nationkey") == 7, "NaN").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
        F.when(F.col("c_mktsegment") == "BUILDING", "NA").when(F.col("c_mktsegment") == "MACHINERY", "")
        .otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    path = sinks.write_csv(df, scratch_path(spark, "src_csv") + ".csv")
    schema = T.StructType([
        T.StructField("c_custkey", T.LongType()), T.StructField("c_nationkey", T.IntegerType()),
        T.StructField("c_acctbal", T.DoubleType()), T.StructField("c_mktsegment", T.StringType())])
    return readers.load(spark, path, schema=schema)


@query("src_plan", sql([PLAN], """select "SimID", "plotWidth", 90 as "northOrientation", 2.5::double as strip_width,
    false as rotation, 'FUT' as "period", 4.0::double as w_amp, -7.0::double as w_mean, 60 as w_peak_doy from plan""",
    "SimID northOrientation rotation period w_peak_doy", "plotWidth strip_width w_amp w_mean"))
def src_plan(spark, sf):
    """The plan brings its own strip width, which the constants must not overwrite."""
    plan = presets.scored_plan(spark, sf).select("SimID", "plotWidth", F.lit(2.5).alias("strip_width"))
    path = sinks.write_csv(plan, scratch_path(spark, "src_plan") + ".csv")
    schema = T.StructType([T.StructField("SimID", T.LongType()), T.StructField("plotWidth", T.DoubleType()),
                           T.StructField("strip_width", T.DoubleType())])
    return readers.load_plan(spark, path, S.FIXED_PLAN_PARAMETERS, schema)


@query("src_reference_dist", sql([EVENTS], """select period as year, 'yield_AF' as target, crop_af as value from panel
    union all select period, 'yield_TA', crop_ta from panel""", "year target", "value"))
def src_reference_dist(spark, sf):
    panel = presets.events_panel(spark, sf).select(
        F.col("period").alias("year"), F.col("crop_af").alias("yield_AF"), F.col("crop_ta").alias("yield_TA"))
    long = panel.unpivot(["year"], ["yield_AF", "yield_TA"], "target", "value")
    return readers.load_reference_distribution(spark, sinks.write_csv(long, scratch_path(spark, "reference")))


def _annotated(spark, sf):
    plan = presets.scored_plan(spark, sf)
    return K.annotate(plan, F.col("p_ok"), F.col("p_fail"))


@query("snk_csv", sql([PLAN], """select p_ok > 0.5 and not (p_fail > 0.5) as keep, count(*) as n, sum("SimID") as id_sum
    from plan group by 1""", "keep n id_sum"))
def snk_csv(spark, sf):
    """Filtered and rejected plan rows from one flagged table."""
    path = sinks.write_plan(_annotated(spark, sf).select("SimID", "latitude", "keep"), scratch_path(spark, "snk_csv"))
    back = spark.read.option("header", True).csv(path)
    return back.groupBy(F.col("keep").cast("boolean").alias("keep")).agg(
        F.count("*").alias("n"), F.sum(F.col("SimID").cast("bigint")).alias("id_sum"))


@query("snk_metrics", sql([], """select 'first' as run_id, avg(l_discount) as disc, avg(l_tax) as tax from lineitem
    union all select 'second', max(l_discount), max(l_tax) from lineitem""", "run_id", "disc tax"))
def snk_metrics(spark, sf):
    li = readers.read_table(spark, sf, "lineitem")
    r = li.agg(F.avg("l_discount"), F.avg("l_tax"), F.max("l_discount"), F.max("l_tax")).first()
    path = scratch_path(spark, "snk_metrics")
    sinks.save_metrics(spark, {"disc": r[0], "tax": r[1]}, path, "first")
    for _ in range(2):  # a rerun leaves one row
        sinks.save_metrics(spark, {"disc": r[2], "tax": r[3]}, path, "second")
    return sinks.read_runs(spark, path).select("run_id", "disc", "tax")


@query("snk_predictions", sql([], """select l_orderkey, l_linenumber, l_extendedprice as y, l_quantity * 1000 as p,
    l_quantity * 1000 - l_extendedprice as residual from lineitem""", "l_orderkey l_linenumber", "y p residual"))
def snk_predictions(spark, sf):
    df = readers.read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("p"))
    path = scratch_path(spark, "snk_predictions")
    return spark.read.parquet(sinks.save_predictions(df, "y", "p", path, ["l_orderkey", "l_linenumber"]))


FOLDS = """select l_orderkey % 5 as fold, avg(l_quantity) as rmse, count(*) as n from lineitem group by 1"""


@query("snk_cv", sql([], f"select * from ({FOLDS}), (values ('first'), ('second')) r(run_id)", "run_id fold n", "rmse"))
def snk_cv(spark, sf):
    folds = readers.read_table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 5).alias("fold")).agg(
        F.avg("l_quantity").alias("rmse"), F.count("*").alias("n"))
    path = scratch_path(spark, "snk_cv")
    for run in ("first", "second", "first"):
        sinks.save_fold_results(folds, path, run)
    return sinks.read_runs(spark, path)


@query("snk_sobol", sql([], """select index_type, feature, avg(v) as value from (
    select 'S1' as index_type, l_returnflag as feature, l_discount as v from lineitem
    union all select 'ST', l_returnflag, l_tax from lineitem) group by 1, 2""", "index_type feature", "value"))
def snk_sobol(spark, sf):
    li = readers.read_table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("feature"), F.col("l_discount").alias("S1"), F.col("l_tax").alias("ST"))
    table = li.unpivot(["feature"], ["S1", "ST"], "index_type", "v").groupBy("index_type", "feature").agg(
        F.avg("v").alias("value"))
    return spark.read.parquet(sinks.save_indices(table, scratch_path(spark, "snk_sobol")))


@query("snk_importance", sql([EVENTS], """select 'clim_max' as feature, avg(abs(clim_max - 50)) as mean_abs from panel
    union all select 'clim_mean', avg(abs(clim_mean - 50)) from panel""", "feature", "mean_abs"))
def snk_importance(spark, sf):
    p = presets.events_panel(spark, sf)
    raw = p.select("entity", "period", *[(F.col(c) - 50).alias(c) for c in ("clim_max", "clim_mean")])
    path = sinks.save_attributions(raw, ["entity", "period"], ["clim_max", "clim_mean"], scratch_path(spark, "importance"))
    return spark.read.parquet(f"{path}/summary")


@query("snk_report", sql([PLAN, ANN.format(keep=VOTE)], REPORT, "section name", "value"))
def snk_report(spark, sf):
    path = sinks.write_report(K.report(_annotated(spark, sf)), scratch_path(spark, "report"))
    return spark.read.schema("section string, name string, value double").json(path)
