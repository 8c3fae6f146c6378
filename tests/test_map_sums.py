"""Feature-map sums of columns with few values against the plain products."""

import numpy as np
import pytest

from panelloom.operators import sensitivity as N


def test_sums_by_value_are_those_over_rows(monkeypatch):
    rng = np.random.default_rng(1)
    x = {"few": rng.integers(0, 9, 2000) / 3, "less": rng.integers(0, 3, 2000) * 1.0, "one": np.ones(2000), "many": rng.normal(size=2000), "more": rng.normal(size=2000)}
    pairs, waves = [(a, b) for a in x for b in x], N.frequencies(8)
    mapped, cos = [], np.cos
    monkeypatch.setattr(np, "cos", lambda p: mapped.append(len(p)) or cos(p))
    got = N.map_sums(x, pairs, waves)
    monkeypatch.undo()
    assert mapped == [9, 3, 1, 2000, 2000]
    maps = {c: np.concatenate([np.cos(v[:, None] * waves), np.sin(v[:, None] * waves)], 1) for c, v in x.items()}
    for c in x:
        assert got[c] == pytest.approx(np.append(maps[c].sum(0), 2000))
    for i, (a, b) in enumerate(pairs):
        assert got[str(i)] == pytest.approx(maps[a].T @ maps[b], abs=1e-8)
