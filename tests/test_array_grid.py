"""Horizon features of yearly arrays against the general operator, and the boosted path of a prediction."""

import pytest
from pyspark.sql import functions as F

from panelloom import spec as S
from panelloom.models import boosting as B
from panelloom.operators import inference as I
from panelloom.plans import predict


@pytest.fixture(scope="module")
def scenarios(spark):
    k, years = F.col("scenario_id"), F.sequence(F.lit(1), F.lit(S.N_YEARS))
    hole = F.transform(years, lambda t: F.when((t + k) % 3 > 0, ((t * k) % 11).cast("double")))
    return spark.range(60).select(F.col("id").alias("scenario_id")).withColumns({
        "sand": k.cast("double"), "main_crop": F.when(k % 5 > 0, (k % 2).cast("int")),
        "GDD_cycle_AF": F.transform(years, lambda t: 800.1 + (k * t) % 97), "ETP_cycle_AF": hole,
        "precipitation_AF": F.transform(years, lambda t: F.lit(400.1)), "frost_events_cycle_AF": F.transform(years, lambda t: F.when(t > 12, (t % 5).cast("double"))),
        "globalRadiation_AF": F.transform(years, lambda t: F.lit(None).cast("double")), "maxTemperature_extreme_AF": F.transform(years, lambda t: F.when(k > 9, t / 7.0)),
        "minTemperature_extreme_AF": F.transform(years, lambda t: F.when(t == 3, F.lit(2.5)))})


def test_array_grid_equals_general_grid(scenarios):
    statics = ["sand", "main_crop"]
    plain = I.inference_grid(I.yearly_rows(scenarios), statics)
    fast = I.grid_of_arrays(scenarios, statics)
    assert fast.columns == plain.columns
    want, found = ({(r["scenario_id"], r["horizon"]): r.asDict() for r in df.collect()} for df in (plain, fast))
    assert want.keys() == found.keys() and len(want) == 300
    for key, row in want.items():
        for c, x in row.items():
            assert found[key][c] == (x if x is None else pytest.approx(x, rel=1e-9, abs=1e-9)), (key, c)
    assert {r["precipitation_AF_std"] for r in found.values()} == {0.0}


def test_scenario_without_any_value_has_no_rows(scenarios):
    none = scenarios.where("scenario_id < 2").withColumns({c: F.transform(F.col(c), lambda x: F.lit(None).cast("double")) for c in S.CLIMATE})
    assert I.grid_of_arrays(none, ["sand"]).count() == I.inference_grid(I.yearly_rows(none), ["sand"]).count() == 0


def test_boosted_knots_in_one_pass(spark, scenarios):
    features = ["sand", "GDD_cycle_AF_cum", "ETP_cycle_AF_p90"]
    grid = I.inference_grid(I.yearly_rows(scenarios), ["sand"]).withColumns({"y": F.log1p(F.col("sand") + F.col("horizon")), "data": F.col("horizon").cast("string")})
    models = B.fit(grid, [B.Job(h, str(h), features, B.Boost(4, 2)) for h in (5, 20)], "y", "data")
    trained = {"stage1": {("carbonStem_AF", 5): (models[5], features), ("carbonStem_AF", 20): (models[20], features), ("carbonStem_TF", 20): (models[5], features)}}
    out = predict.stage1_knots(scenarios, trained)
    assert out.columns == ["scenario_id", "target", "horizon", "value"]
    found = {(r["scenario_id"], r["target"], r["horizon"]): r["value"] for r in out.collect()}
    assert len(found) == 180
    for (target, h), (m, _) in trained["stage1"].items():
        for r in B.predict(m, grid.where(F.col("horizon") == h), "p").select("scenario_id", F.greatest(F.lit(0.0), F.expm1("p")).alias("v")).collect():
            assert found[r["scenario_id"], target, h] == pytest.approx(r["v"])
    # No union of a scan by model: the written grid is read once.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_yearly_scores_of_arrays_equal_scores_of_rows(spark, scenarios):
    features = ["Harvest_Year_Absolute", "sand", "ETP_cycle_AF", "frost_events_cycle_AF", "main_crop", "absent"]
    yearly = I.yearly_rows(scenarios).withColumns({"Harvest_Year_Absolute": F.col("year").cast("double"), "absent": F.col("sand") % 3})
    rows = yearly.withColumn("y", F.col("sand") / 10 + F.coalesce(F.col("ETP_cycle_AF"), F.lit(30.0)) + F.col("year") / 4)
    models = {k: B.fit(rows, [B.Job(k, "rows", fs, B.Boost(6, 4))], "y")[k] for k, fs in (("a", features), ("b", features[:3]))}
    plain = B.predict_side_by_side(models, yearly.drop("absent")).select("scenario_id", "year", "a", "b")
    arrays = B.predict_by_year(models, scenarios, S.CLIMATE, S.TEMPORAL, S.N_YEARS).select("scenario_id", F.posexplode(F.arrays_zip("a", "b")).alias("i", "z"))
    want, found = (sorted(map(tuple, df.collect())) for df in (plain, arrays.select("scenario_id", (F.col("i") + 1).alias("year"), "z.a", "z.b")))
    assert found == want and len(want) == 2400


def test_cascade_by_arrays_equals_cascade_by_rows(spark, scenarios):
    routed = scenarios.select("scenario_id", "GDD_cycle_AF", F.when(F.col("scenario_id") % 3 > 0, "model").otherwise("stunted").alias("branch"), F.lit("maize").alias("main_crop"),
                              (F.col("scenario_id") % 4 == 0).cast("int").alias("yield_failed"))
    knots = scenarios.select("scenario_id", F.explode(F.array(F.lit(10), F.lit(40))).alias("horizon")).select(
        "scenario_id", F.lit("carbonStem_AF").alias("target"), "horizon", (F.col("horizon") + F.col("scenario_id")).cast("double").alias("value"))
    medians = spark.createDataFrame([("maize", 6.0)], "crop string, median double")
    profile = spark.createDataFrame([(1, 0.1), (40, 1.0)], "period long, profile double")
    by_rows = I.cascade(routed, knots, medians, profile, lambda r: r.withColumns({"yield_AF_raw": F.col("carbonStem_AF") - 20, "yield_TA_raw": F.col("GDD_cycle_AF") / 9}), ["GDD_cycle_AF"])
    by_arrays = I.cascade(routed, knots, medians, profile, lambda r: r.withColumns({
        "yield_AF_raw": F.transform("carbonStem_AF", lambda x: x - 20), "yield_TA_raw": F.transform("GDD_cycle_AF", lambda x: x / 9)}), ["GDD_cycle_AF"], by_arrays=True)
    kept = ["scenario_id", "year", *S.CURVE_TARGETS]
    want, found = (sorted(map(tuple, df.select(kept).collect())) for df in (by_rows, by_arrays))
    assert found == want and len(want) == 2400
