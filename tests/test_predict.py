"""Prediction with fitted models, on small models fitted here."""

import pytest
from pyspark.sql import functions as F

from panelloom import spec as S
from panelloom.models import tabular as M
from panelloom.operators import inference as I
from panelloom.operators.encode import fit_encoding
from panelloom.plans import predict

SMALL = M.TreeOptions(max_iter=2, max_depth=2)


@pytest.fixture(scope="module")
def trained(spark):
    k = F.col("id")
    rows = spark.range(60).select(
        k.alias("SimID"), (k % 10).cast("double").alias("sand"), (k % 7).cast("double").alias("carbonStem_AF"),
        (800 + k).cast("double").alias("GDD_cycle_AF_cum"), (k % 5).cast("double").alias("yield_AF"), (k % 3).cast("double").alias("yield_TA"),
        F.when(k % 2 == 0, "maize").otherwise("wheat").alias("main_crop"), (k % 10 >= 5).cast("int").alias("tree_ok"))
    encoding = fit_encoding(rows, ["main_crop"])
    stage1 = {("carbonStem_AF", h): (M.fit_regressor(rows, ["sand", "GDD_cycle_AF_cum"], "carbonStem_AF", SMALL, log_target=True),
                                     ["sand", "GDD_cycle_AF_cum"]) for h in (10, 20)}
    af = rows.withColumn("main_crop", (F.col("main_crop") == "wheat").cast("double"))
    return {
        "tree_classifier": (M.fit_classifier(rows, ["sand"], "tree_ok", SMALL), ["sand"]), "yield_classifier": None,
        "classifier_encoding": encoding, "encoding": encoding, "stage1": stage1,
        "stage2": {"yield_AF": (M.fit_regressor(af, ["carbonStem_AF", "main_crop"], "yield_AF", SMALL), ["carbonStem_AF", "main_crop"])},
        "stunted_medians": spark.createDataFrame([("maize", 6.0), (None, 4.0)], "crop string, median double"),
        "stunted_profile": spark.createDataFrame([(1, 0.1), (20, 0.5), (40, 1.0)], "Harvest_Year_Absolute long, profile double"),
    }


@pytest.fixture(scope="module")
def scenarios(spark):
    years = F.sequence(F.lit(1), F.lit(S.N_YEARS))
    return spark.createDataFrame(
        [(1, 8.0, "wheat", 47.0), (2, 1.0, "maize", 47.0), (3, 8.0, "oats", 42.0), (4, None, "maize", 47.0)],
        "scenario_id long, sand double, main_crop string, latitude double",
    ).withColumn("GDD_cycle_AF", F.transform(years, lambda t: (F.lit(20) + t).cast("double")))


def test_every_runnable_scenario_gets_all_targets(trained, scenarios):
    long, rejects = predict.predict(scenarios, trained)
    seen = long.groupBy("scenario_id").agg(F.count("value").alias("n"), F.countDistinct("target", "year").alias("cells"), F.min("value").alias("low"))
    assert {r["scenario_id"]: (r["n"], r["cells"]) for r in seen.collect()} == {i: (160, 160) for i in (1, 2, 3)}
    assert all(r["low"] >= 0 for r in seen.collect())
    assert [tuple(r) for r in rejects.select("scenario_id", "reject_reason").collect()] == [(4, "missing sand")]
    # South of the location rule no yield is left.
    assert long.where("scenario_id = 3 and target like 'yield%' and value <> 0").count() == 0


def test_curve_meets_stage1_values(spark, trained, scenarios):
    long = predict.predict(scenarios, trained)[0].where("scenario_id = 1 and target = 'carbonStem_AF'")
    found = {r["year"]: r["value"] for r in long.collect()}
    for h in (10, 20):
        model, features = trained["stage1"][("carbonStem_AF", h)]
        row = spark.createDataFrame([(8.0, float(sum(20 + t for t in range(1, h + 1))))], "sand double, GDD_cycle_AF_cum double")
        expected = M.predict(model, row, features, log_target=True).first()["predicted"]
        assert expected > 0
        assert found[h] == pytest.approx(expected)


def test_one_row_takes_the_same_path(trained, scenarios):
    def values(rows):
        return {(r["year"], r["target"]): r["value"] for r in predict.predict(rows, trained)[0].where("scenario_id = 1").collect()}

    assert values(scenarios.where("scenario_id = 1")) == values(scenarios)


def test_sweep_returns_each_step(trained, scenarios):
    out = predict.sweep_values(scenarios.where("scenario_id in (1, 2)"), trained, "sand", 3, 40)
    assert out.groupBy("id", "step", "sand").count().where("count = 4").count() == 6


def test_no_stunted_profile_means_ratio_one(spark):
    routed = spark.createDataFrame([(1, "stunted", "maize", 0)], "scenario_id long, branch string, main_crop string, yield_failed int")
    knots = spark.createDataFrame([], "scenario_id long, target string, horizon int, value double")
    medians = spark.createDataFrame([("maize", 6.0)], "crop string, median double")
    profile = spark.createDataFrame([], "period long, profile double")
    out = I.cascade(routed, knots, medians, profile, lambda rows: rows.withColumns({"yield_AF_raw": F.lit(1.0), "yield_TA_raw": F.lit(1.0)}))
    assert [r["carbonStem_AF"] for r in out.collect()] == [6.0] * S.N_YEARS
