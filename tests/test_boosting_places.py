"""Models that are done leave the written state: its scores are those of the models that still grow."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from panelloom.models import boosting as B


def test_finished_models_leave_the_state(spark, monkeypatch):
    k = F.col("id")
    rows = spark.range(400).select(F.when(k % 2 == 0, "a").otherwise("b").alias("d"), ((k * 7) % 31).cast("double").alias("x"), ((k * 11) % 17).cast("double").alias("y"))
    o = B.Boost(depth=2, step=0.5)
    jobs = [B.Job("b1", "b", ["x"], replace(o, trees=1)), *(B.Job(f"a{n}", "a", ["x"], replace(o, trees=n)) for n in (1, 3, 2, 4))]
    alone = {j.name: B.fit(rows, [j], "y", "d")[j.name] for j in jobs}
    sizes, given = [], B.materialize_at

    def seen(df, path, **options):
        out = given(df, path, **options)
        sizes.append(sorted((r["data"], len(r["scores"]) // max(len(r["labels"]), 1)) for r in out.select("data", "scores", "labels").collect()))
        return out

    monkeypatch.setattr(B, "materialize_at", seen)
    monkeypatch.setattr(B, "SMALL", 0)  # scores are written after every tree
    together = B.fit(rows, jobs, "y", "d")
    assert {d for d, _ in sizes[0]} == {0, 1}
    assert [set(s) for s in sizes[1:]] == [{(0, 3)}, {(0, 2)}, {(0, 1)}]
    for name, model in together.items():
        assert [t.feature for t in model.trees] == [t.feature for t in alone[name].trees] and [t.bin for t in model.trees] == [t.bin for t in alone[name].trees]
        for one, other in zip(model.trees, alone[name].trees):
            assert one.value == pytest.approx(other.value)
