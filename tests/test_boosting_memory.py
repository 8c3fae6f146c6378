"""Memory of a fit of very many models: their scores are not moved tree by tree, and the writer of large rows lets go of them."""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from panelloom import session
from panelloom.models import boosting as B


def fitted(spark, monkeypatch, small: int, wide: int):
    """Trees of five models by the number of times that the state is written."""
    rng = np.random.default_rng(11)
    rows = spark.createDataFrame([(float(a), float(b), float(a * 0.37 + b / 3 + c / 7)) for a, b, c in rng.normal(size=(300, 3))], "a double, b double, y double").coalesce(1)
    o = B.Boost(trees=4, depth=2, step=0.3)
    jobs = [B.Job(f"m{i}", "d", ["a", "b"], replace(o, ridge=0.1 + i, trees=4 - (i > 2))) for i in range(5)]
    written, given = [], B.materialize_at
    with monkeypatch.context() as m:
        m.setattr(B, "SMALL", small)
        m.setattr(B, "WIDE", wide)
        m.setattr(B, "materialize_at", lambda df, path, **o: written.append(path) or given(df, path, **o))
        models = B.fit(rows, jobs, "y")
    return len(written), {k: [(t.feature, t.bin, t.value) for t in m.trees] for k, m in models.items()}


def test_scores_of_many_models_are_not_written_tree_by_tree(spark, monkeypatch):
    one, plain = fitted(spark, monkeypatch, 500_000, 64)
    each, narrow = fitted(spark, monkeypatch, 0, 64)
    wide_all, wide = fitted(spark, monkeypatch, 0, 1)
    assert (one, each, wide_all) == (1, 4, 1)
    # Three models grow to the end: their scores are written once the other two are done.
    assert fitted(spark, monkeypatch, 0, 3) == (2, plain)
    # The same bits, however often the scores are written.
    assert narrow == plain and wide == plain


def test_large_rows_leave_the_writer(spark):
    at = session.scratch_path(spark, "large")
    rows = spark.range(0, 12, 1, 1).select("id", F.expr("cast(repeat(cast(id % 10 as string), 1000000) as binary)").alias("block"))
    back = session.materialize_at(rows, at, compression="none", group_bytes=2 << 20)
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in Path(at.replace("file:", "")).glob("*.parquet")]
    assert sum(groups) >= 4
    assert back.agg(F.count("id"), F.sum(F.length("block"))).first() == (12, 12_000_000)
