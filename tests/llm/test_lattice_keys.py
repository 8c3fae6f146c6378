"""Lattice keys: recall at the threshold, pruning that grows with the vectors, and crowded cells."""

import numpy as np
import pytest

from panelloom.llm import lattice_dedup as L


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pairs_at(cosine, n, width, seed):
    rng = np.random.default_rng(seed)
    a, b = unit(rng.standard_normal((n, width))), rng.standard_normal((n, width))
    b = unit(b - (a * b).sum(1, keepdims=True) * a)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


@pytest.mark.parametrize("width", [24, 64, 768])
def test_recall_holds_and_candidates_do_not_grow_with_the_vectors(width):
    a, b = pairs_at(0.98, 1500, width, 1)
    other = unit(np.random.default_rng(2).standard_normal((1500, width)))
    candidates = []
    for n in (2_000, 20_000, 500_000, 20_000_000):
        codes = L.codes_for(n)
        x, y, z = (L.cells(v, L.TABLES, L.PROBES, 0.98, codes) for v in (a, b, other))
        met = ((x == y[:, :, :1]).any(2) | (y == x[:, :, :1]).any(2)).any(1).mean()
        share = sum(np.isin(x[:, t], z[i : i + 1, t, 0]).any(1).mean() for t in range(L.TABLES) for i in range(0, 1500, 15)) / 100
        assert met >= 0.98
        candidates.append(share * n)
    assert max(candidates) < 0.05 * 20_000  # a twentieth of what one code would give at the second size, at every size


def test_own_cell_comes_first_and_cells_differ():
    a, _ = pairs_at(0.98, 50, 64, 3)
    for codes in (1, 2, 3):
        keys = L.cells(a, 3, 3, 0.98, codes)
        assert keys.shape == (50, 3, min(L.MOST_CELLS, 4**codes))
        assert all(len(set(row)) == len(row) for row in keys.reshape(-1, keys.shape[2]).tolist())


@pytest.mark.parametrize("enough", [4096, 16])
def test_crowded_cells_lose_few_links(spark, monkeypatch, enough):
    """Vectors of one label close together, many just above and just below the threshold; with a low ``ENOUGH`` names take several codes."""
    monkeypatch.setattr(L, "ENOUGH", enough)
    monkeypatch.setattr(L, "BLOCK", 64)
    rng = np.random.default_rng(5)
    centre = unit(rng.standard_normal((3, 64)))
    x = np.concatenate([unit(c + 0.02 * rng.standard_normal((150, 64))) for c in centre] + [unit(rng.standard_normal((200, 64)))]).astype(np.float32)
    rows = [(i, [float(v) for v in r], i % 2) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    own = unit(x.astype(float))
    links = (own @ own.T >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2) & ~np.eye(len(x), dtype=bool)
    got = {r["vec_id"]: r for r in L.near_duplicates(df, 0.98).collect()}
    found = sum(r["n_links"] for r in got.values())
    assert links.sum() > 2000 and 0.95 * links.sum() <= found <= links.sum()
    assert all(got[i]["n_links"] <= links[i].sum() and (got[i]["n_links"] > 0 or got[i]["component_id"] == i) for i in got)
