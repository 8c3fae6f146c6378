"""A search ends by its rungs, not by the time that a large input takes."""

import itertools

from pyspark.sql import functions as F

from panelloom.models import tabular as M


def test_slow_rungs_do_not_end_the_search(spark, monkeypatch):
    k = F.col("id")
    rows = spark.range(90).select(((k * 7) % 31).cast("double").alias("x"), ((k * 7) % 31 + k % 2).cast("double").alias("y"), (k % 2).cast("int").alias("fold"))
    clock = itertools.count(step=10_000)  # every look at the clock is hours later
    monkeypatch.setattr(M.time, "monotonic", lambda: float(next(clock)))
    report = M.halving_search(rows, ["x"], "y", "fold", 2, trials=5, space={"depth": [1, 2]}, first_trees=1)[1]
    rungs = report.groupBy("rung").agg(F.count(F.lit(1)).alias("n"), F.max("trees").alias("trees")).orderBy("rung").collect()
    assert [(r["rung"], r["n"], r["trees"]) for r in rungs] == [(0, 5, 1), (1, 2, 2)]
