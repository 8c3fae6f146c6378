"""Attributions by the sides of a tree, and errors of swapped columns, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.models import attribution as A
from panelloom.models import boosting as B
from panelloom.models import tabular as M

FEATURES = ["x", "z", "hole"]


@pytest.fixture(scope="module")
def rows(spark):
    k = F.col("id")
    return spark.range(400).select(
        k.cast("string").alias("id"), (k * 7919 % 101).cast("double").alias("x"), (k % 3).cast("int").alias("z"), F.when(k % 4 > 0, (k * 31 % 17).cast("double")).alias("hole"),
        ((k * 7919 % 101) / 20 + k % 3 + F.when(k % 4 > 0, 0).otherwise(2)).cast("double").alias("y"))


@pytest.fixture(scope="module")
def model(rows):
    return B.fit(rows, [B.Job("m", "rows", FEATURES, B.Boost(trees=6, depth=4))], "y")["m"]


def test_swapped_columns_in_one_pass(rows, model, monkeypatch):
    """Same figures as the long table, without a row copied by feature."""
    seen = []
    plain = B.swapped_errors
    monkeypatch.setattr(B, "swapped_errors", lambda m, paired, *a: seen.append(paired) or plain(m, paired, *a))
    found = {r["feature"]: (r["attribution"], r["base_rmse"]) for r in M.permutation_attribution(model, rows, FEATURES, "y", "id").collect()}
    pdf = seen[0].toPandas()
    assert len(pdf) == 400
    y, own = pdf["y"].to_numpy(), pdf[model.features].to_numpy(float)
    donor = np.array([[np.nan if d[f] is None else d[f] for f in model.features] for d in pdf["_donor"]], float)
    base = np.sqrt(((model.score(own) - y) ** 2).mean())
    assert set(found) == set(FEATURES)
    for f in FEATURES:
        x = own.copy()
        x[:, model.features.index(f)] = donor[:, model.features.index(f)]
        rise = np.sqrt(((model.score(x) - y) ** 2).mean()) - base
        assert found[f] == (pytest.approx(rise, abs=1e-9), pytest.approx(base))
    assert found["x"][0] > 0.1


def test_values_are_kept_by_sides(rows, model):
    """A combination of sides is worked out once; later rows look it up, and the sum of the leaves is the same."""
    x = rows.toPandas()[model.features].to_numpy(float)
    own = A.Explainer(model)
    found = own.values(x)
    assert np.allclose(found.sum(1) + own.base, model.score(x))
    assert all(len(t.known) < len(x) for t in own.trees if t.features)
    known = [len(t.known) for t in own.trees]
    assert np.array_equal(own.values(x), found) and [len(t.known) for t in own.trees] == known
    for t in own.trees:
        t.place = None  # deeper trees sum their leaves for every row
    assert np.allclose(own.values(x), found, rtol=0, atol=1e-12)
