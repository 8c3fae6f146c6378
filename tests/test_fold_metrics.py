"""Errors of all models of a cross-validation from one pass over the rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelloom.models import boosting as B
from panelloom.models import tabular as M
from panelloom.operators.metrics import regression_metrics


def rows_of(spark):
    """Two datasets with gaps in a feature, labels far from 0, rows of no fold, and one fold of equal labels."""
    k = F.col("id")
    return spark.range(600).select(
        F.when(k % 2 == 0, "a").otherwise("b").alias("d"), F.when(k % 13 == 0, None).otherwise((k % 3).cast("int")).alias("fold"), ((k * 7) % 31).cast("double").alias("x"),
        F.when(k % 5 != 0, ((k * 11) % 17).cast("double")).alias("z")).withColumn(
        "y", F.when((F.col("fold") == 2) & (F.col("d") == "b"), 1e6).otherwise(1e6 + F.col("x") * 2 + F.coalesce("z", F.lit(-3.0)) + F.rand(3)))


def test_fold_metrics_equal_those_of_copied_rows(spark):
    rows = rows_of(spark).cache()
    jobs = [B.Job(f"{d}|{i}", d, ["x", "z"] if d == "a" else ["z"], B.Boost(trees=3, depth=2, step=0.5), held=i) for d in "ab" for i in range(3)]
    models = B.fit(rows, jobs, "y", "d", "fold")
    found = {r["model"]: r for r in B.fold_metrics(models, {j.name: (j.data, j.held) for j in jobs}, rows, "y", "fold", "d").collect()}
    assert len(found) == 6 and found["b|2"]["r2_val"] is None
    each = rows.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("_key", F.concat_ws("|", "d", F.col("held").cast("string")))
    plain = regression_metrics(B.predict(models, each, "p", "_key").withColumn("val", F.col("held") == F.col("fold")).where("val is not null and not (val and _key = 'b|2')"), "y", "p", ["_key", "val"])
    for r in plain.collect():
        own = found[r["_key"]]
        if not r["val"]:
            assert own["r2_train"] == pytest.approx(r["r2"], abs=1e-6)
            continue
        assert own["n"] == r["n"] and own["rmse"] == pytest.approx(r["rmse"], rel=1e-7) and own["mae"] == pytest.approx(r["mae"], rel=1e-7)
        assert own["r2_val"] == pytest.approx(r["r2"], abs=1e-6)


def test_cross_validation_copies_no_row(spark, monkeypatch):
    """Every row is scored where it lies: nothing is expanded by model ahead of the scores."""
    def refuse(*a, **k):
        raise AssertionError("rows were copied")

    monkeypatch.setattr(B, "score_column", refuse)
    rows = rows_of(spark).where("d = 'a'").drop("d")
    options = {"p|q": B.Boost(trees=2, depth=2), "r": B.Boost(trees=1, depth=1)}
    found = M.boosted_folds(rows, ["x", "z"], "y", "fold", 3, options, train_scores=False)
    assert found.columns == ["model", "fold", "n", "r2_val", "rmse", "mae"]
    assert {(r["model"], r["fold"]) for r in found.collect()} == {(m, i) for m in options for i in range(3)}


def test_non_finite_labels_fail(spark):
    rows = spark.createDataFrame([(1.0, 0, 1.0), (2.0, 0, float("nan"))], "x double, fold int, y double")
    model = B.Model(["x"], [B.np.empty(0)], 0.0, "squared")
    with pytest.raises(Exception, match="non-finite"):
        B.fold_metrics({"m|0": model}, {"m|0": ("rows", 0)}, rows, "y", "fold").collect()
