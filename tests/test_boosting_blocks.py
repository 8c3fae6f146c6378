"""The boosters' state: spread over tasks, in blocks, with scores written after every tree."""

import numpy as np
import pytest

from panelloom.models import boosting as B
from panelloom.models import climate as K


def test_one_partition_is_spread_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 2)).round(2)
    table = [(float(a), None if i % 11 == 0 else float(b), float(a > 0) + 0.1 * float(b), i % 3) for i, (a, b) in enumerate(x)]
    rows = spark.createDataFrame(table, "a double, b double, y double, fold int").coalesce(1)
    jobs = [B.Job(f"m{h}", "d", ["a", "b"], B.Boost(trees=4, depth=3, step=0.5), held=h) for h in (0, 1, None)]
    want = B.fit(rows, jobs, "y", fold="fold")
    seen = []
    kept = B.materialize_at
    monkeypatch.setattr(B, "materialize_at", lambda df, path, **o: seen.append(kept(df, path, **o)) or seen[-1])
    read = []
    grow = B._grow
    monkeypatch.setattr(B, "_grow", lambda state, *rest: read.append((state.rdd.getNumPartitions(), state.count())) or grow(state, *rest))
    monkeypatch.setattr(B, "FILE_WORK", 100)
    monkeypatch.setattr(B, "SMALL", 0)
    monkeypatch.setattr(B, "BLOCK_ROWS", 256)
    got = B.fit(rows, jobs, "y", fold="fold")
    assert len(seen) == 4  # once at first and after all trees but the last
    assert all(parts >= 4 and blocks < 3000 / 100 for parts, blocks in read)
    for name in want:
        assert got[name].score(x) == pytest.approx(want[name].score(x))


def test_split_search_over_many_histograms_at_once():
    rng = np.random.default_rng(5)
    hists = rng.integers(0, 5, (40, B.SLOTS, 3)).astype(float)
    hists[3] = 0
    together = B.best_splits(hists, B.Boost(least_rows=20))
    assert together == [B.best_splits(h[None], B.Boost(least_rows=20))[0] for h in hists] and together[3] is None


def test_sites_are_spread_before_their_years_and_scored_in_one_pass(spark):
    rng = np.random.default_rng(7)
    fields = "SimID long, latitude double, longitude double, main_crop double"
    sites = spark.createDataFrame([(i, float(rng.integers(40, 50)), float(rng.integers(0, 9)), None if i % 9 == 0 else 1.0) for i in range(60)], fields).coalesce(1)
    rows = spark.createDataFrame([(*map(float, r),) for r in rng.integers(0, 50, (200, 5))], "latitude double, longitude double, main_crop double, Harvest_Year_Absolute double, y double")
    models = {v: B.fit(rows, [B.Job(v, "d", K.FEATURES, B.Boost(trees=2, depth=2, seed=i))], "y")[v] for i, v in enumerate(("GDD_cycle_AF", "ETP_cycle_AF"))}
    out = K.predict_sites(sites, models, 5)
    assert out.count() == 300 and out.rdd.getNumPartitions() > 1
    one = B.predict(models["ETP_cycle_AF"], out, "again").toPandas()
    assert one["again"].clip(lower=0).to_numpy() == pytest.approx(one["ETP_cycle_AF"].to_numpy())
