"""A panel is derived once, and rows from few files are spread before models score them."""

from pyspark.sql import functions as F

from panelloom.operators.prepare import prepare_panel
from panelloom.plans import screening
from panelloom.sources import presets


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_prepared_panel_reads_written_rows(spark, sf_dir):
    p = prepare_panel(presets.field_panel(spark, sf_dir), ["error"])
    # Before, every reader of the panel ran its joins and windows again, after a first run that only looked for empty columns.
    assert "Join" not in plan_of(p) and "Window" not in plan_of(p)
    assert "unused_AF" not in p.columns and "GDD_cycle_AF" in p.columns
    assert p.where("Crop_Name = 'error'").count() == 0 and p.count() == p.distinct().count() > 0


def test_column_emptied_by_exclusion_is_dropped(spark):
    rows = [("a", 1, "x", None, 1.0, 1.0), ("a", 1, "x", None, 1.0, 1.0), ("a", 2, "error", 5.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "SimID string, Harvest_Year_AF long, Crop_Name string, extra double, yield_AF double, yield_TA double")
    df = df.withColumns({"rot_id": F.lit("r"), "main_crop": F.lit("wheat")})
    p = prepare_panel(df, ["error"])
    assert "extra" not in p.columns and p.count() == 1
    assert prepare_panel(df, ["error"], deduplicate=False).count() == 2


def test_screened_plan_is_spread(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(screening.M, "classify", lambda model, rows, *args: seen.append(plan_of(rows)) or rows.withColumns({args[1]: F.lit(0.5), args[2]: F.lit(1)}))
    encoding = spark.createDataFrame([("main_crop", "wheat", 0)], "variable string, class string, code int")
    plan = presets.scored_plan(spark, sf_dir)
    models = {"encoding": encoding, "tree": None, "tree_features": [], "yield": None, "yield_features": []}
    assert screening.screen(plan, models).count() == plan.count()
    assert "Repartition" in seen[0]
