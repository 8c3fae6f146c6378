"""Sinks that a rerun cannot double."""

from panelloom.session import scratch_path
from panelloom.sources import sinks


def test_a_rerun_replaces_its_rows_and_no_others(spark):
    path = scratch_path(spark, "runs")
    for run, value in (("007", 1.0), ("b/c", 2.0), ("007", 3.0), ("007", 3.0)):
        sinks.save_metrics(spark, {"r2": value}, path, run)
    assert sorted((r["run_id"], r["r2"]) for r in sinks.read_runs(spark, path).collect()) == [("007", 3.0), ("b/c", 2.0)]
    sinks.save_metrics(spark, {"r2": 4.0, "mae": 1.0}, path, "new")
    assert {r["run_id"]: r["mae"] for r in sinks.read_runs(spark, path).collect()} == {"007": None, "b/c": None, "new": 1.0}
    sinks.save_metrics(spark, {"r2": 5.0}, path, "only", append=False)
    assert [r["run_id"] for r in sinks.read_runs(spark, path).collect()] == ["only"]


def test_folds_of_runs_stand_side_by_side(spark):
    path = scratch_path(spark, "folds")
    folds = spark.createDataFrame([(0, 0.5), (1, 0.25)], "fold int, r2 double")
    assert not sinks.save_fold_results(folds.limit(0), path, "a")
    for run in ("a", "b", "a"):
        assert sinks.save_fold_results(folds, path, run)
    got = sorted((r["run_id"], r["fold"], r["r2"]) for r in sinks.read_runs(spark, path).collect())
    assert got == [("a", 0, 0.5), ("a", 1, 0.25), ("b", 0, 0.5), ("b", 1, 0.25)]
