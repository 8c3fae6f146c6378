"""Bootstrap draws: one digest per key and bootstrap; the warm start's two runs share their table and bandwidths."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from panelloom.operators import sensitivity as N
from panelloom.operators import split as X


def plain(rows, n_boot, size, seed=42):
    out, slices = set(), {}
    for s, k in rows:
        slices.setdefault(s, []).append(k)
    for s, keys in slices.items():
        for b in range(n_boot):
            order = sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{b}:{k}".encode()).hexdigest(), k))
            out |= {(s, b, k) for k in order[:size]}
    return out


def test_draws_take_one_digest_per_key(spark, monkeypatch):
    rows = [(s, k) for s in range(4) for k in range(40 if s == 3 else 700)]
    df = spark.createDataFrame(rows, "s int, k long")
    plans, given = [], X.materialize
    monkeypatch.setattr(X, "materialize", lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or given(d))
    found = X.bootstrap_samples(df, ["s"], "k", 3, 20)
    assert found.columns == ["s", "k", "boot"]
    assert {(r["s"], r["boot"], r["k"]) for r in found.collect()} == plain(rows, 3, 20)
    # Bootstraps are expanded above the aggregate by key, not above the rows.
    assert re.search(r"Generate explode.*Aggregate \[_id", plans[0], re.S)


def test_draws_that_fall_short_use_every_row(spark):
    # Rows that share a key fall together: the limit by the number of rows then leaves too few in some draws.
    df = spark.range(3000).select((F.col("id") % 3).cast("string").alias("k"), "id")
    counts = X.bootstrap_samples(df, [], "k", 30, 20).groupBy("boot").count().collect()
    assert [r["count"] for r in counts] == [20] * 30


def test_warm_start_shares_bandwidths_unless_rows_differ(spark, monkeypatch):
    calls, given = [], N.bandwidths
    monkeypatch.setattr(N, "bandwidths", lambda *a: calls.append(1) or given(*a))
    rows = [(e, 1, "c", float(e % 7), float(e % 5), None if e % 11 == 0 else float(e % 3), float(e % 7 + e % 2)) for e in range(60)]
    df = spark.createDataFrame(rows, "e long, p long, c string, f double, g double, h double, t double")
    options = dict(top_n=1, cheap_boot=2, n_boot=3, boot_size=20, min_obs=10)
    found = N.warm_start(df, "e", "p", "c", ["f", "g"], [], ["t"], **options).collect()
    assert len(calls) == 1 and [r["n_obs"] for r in found] == [60]
    best = found[0]["feature"]
    alone = N.hsic_by_period(df, "e", "p", "c", [best], ["t"], n_boot=3, boot_size=20, min_obs=10).collect()
    assert [r.asDict() for r in found] == [r.asDict() for r in alone]
    calls.clear()
    # "h" has gaps, so the run on the best feature alone sees more rows.
    assert [r["n_obs"] for r in N.warm_start(df, "e", "p", "c", ["f", "h"], [], ["t"], **options).collect()] == [60]
    assert len(calls) == 2
