"""Ranks of text, hot-value joins, greedy folds and exact test probabilities against plain versions."""

import itertools
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from panelloom.operators import classify, encode, lookup, ranks, split


def test_text_ranks_need_no_window_over_all_classes(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 20)
    rng = random.Random(1)
    words = {"".join(rng.choice("abÄzé ") for _ in range(rng.randint(0, 6))) for _ in range(600)}
    rows = [(w, "xyz"[len(w) % 3], len(w) % 2 == 0) for w in words for _ in range(2)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "w string, c string, b boolean")
    got = {(r["variable"], r["class"]): r["code"] for r in encode.fit_encoding(df, ["w", "c", "b"]).collect()}
    want = {("w", w): i for i, w in enumerate(sorted(words))} | {("c", c): i for i, c in enumerate("xyz")} | {("b", "0"): 0, ("b", "1"): 1}
    assert got == want
    assert encode.fit_encoding(df.limit(0), ["w"]).count() == 0


@pytest.fixture(scope="module")
def crowd(spark):
    """A third of the rows hold one value, others have two or none in the table."""
    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"v{i % 700}") for i in range(6000)]
    table = [("hot", 1.0), *[(f"v{k}", float(k)) for k in range(0, 700, 2)], ("other", 9.0)]
    return spark.createDataFrame(rows, "id long, key string"), spark.createDataFrame(table, "key string, value double")


def test_hot_join_gives_the_rows_of_a_broadcast_join(crowd, monkeypatch):
    df, table = crowd
    for how in ("left", "inner"):
        want = sorted(map(tuple, lookup.lookup_join(df, table, ["key"], how).collect()), key=str)
        with monkeypatch.context() as m:
            m.setattr(lookup, "broadcast_if_small", lambda frozen: frozen)
            assert sorted(map(tuple, lookup.lookup_join(df, table, ["key"], how).collect()), key=str) == want
    assert sum(v is not None for *_, v in lookup.lookup_join(df, table, ["key"]).collect()) < df.count()


def test_hot_rows_do_not_reach_the_exchange(crowd):
    df, _ = crowd
    hot = lookup.hot_values(df, ["key"])
    assert {r["key"] for r in hot.collect()} == {"hot", *()} | {r["key"] for r in df.groupBy("key").count().where("count > 6 and key is not null").collect()}
    apart, rest = lookup.split_rows(df, ["key"], hot)
    assert rest.where("key = 'hot' or key is null").count() == 0 and apart.count() + rest.count() == df.count()
    assert max(r["count"] for r in rest.groupBy("key").count().collect() or [{"count": 0}]) * lookup.HOT_SHARE <= df.count()


def test_encoding_and_ranks_beyond_the_broadcast_bound(spark, crowd, monkeypatch):
    df, _ = crowd
    codes = encode.fit_encoding(df, ["key"])
    plain = sorted(map(tuple, encode.apply_encoding(df, codes, ["key"]).collect()))
    tied = df.withColumn("x", F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.col("id") % 97))
    ranked = sorted(map(tuple, ranks.rank_average(tied, [], "x").select("id", "rank").collect()))
    monkeypatch.setattr(lookup, "broadcast_if_small", lambda frozen: frozen)
    assert sorted(map(tuple, encode.apply_encoding(df, codes, ["key"]).collect())) == plain
    assert sorted(map(tuple, ranks.rank_average(tied, [], "x").select("id", "rank").collect())) == ranked
    assert sum(r for _, r in ranked) == 6000 * 6001 / 2


def greedy(sizes, k):
    held, out = [0] * k, []
    for s in sorted(sizes, reverse=True):
        f = min(range(k), key=lambda f: (held[f], f))
        held[f] += s
        out.append((s, f))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_folds_of_sizes_equal_a_plain_loop(seed):
    rng = random.Random(seed)
    k = rng.randint(2, 7)
    sizes = [rng.choice([1, 1, 1, 2, 3, 7, 40, rng.randint(1, 300)]) for _ in range(rng.randint(0, 200))]
    counted = [(s, sizes.count(s)) for s in set(sizes)]
    got = [(s, folds[(i - a) % len(folds)]) for s, a, b, folds in split.deal_sizes(counted, k) for i in range(a, b)]
    assert got == greedy(sizes, k)


def test_folds_of_entities(spark):
    rng = random.Random(3)
    sizes = {f"e{i}": rng.choice([1, 1, 2, 5, 30]) for i in range(120)}
    df = spark.createDataFrame([(e,) for e, n in sizes.items() for _ in range(n)], "e string")
    got = split.group_folds(df, "e", 4).collect()
    assert {r["e"]: r["n_rows"] for r in got} == sizes
    assert sorted((r["n_rows"], r["fold"]) for r in got) == sorted(greedy(sizes.values(), 4))


def test_ks_probability_equals_enumeration(spark):
    cases = [(n, m, d) for n in range(1, 9) for m in range(1, 9) for d in range(0, n * m + 1, max(1, n * m // 6))]
    df = spark.createDataFrame([(n, m, d / (n * m)) for n, m, d in cases], "n long, m long, stat double")
    got = [r["p"] for r in df.select(classify.ks_exact(F.col("n"), F.col("m"), F.col("stat")).alias("p")).collect()]

    def distances(n, m):
        for picks in itertools.combinations(range(n + m), n):
            i = j = far = 0
            for step in range(n + m):
                i, j = (i + 1, j) if step in picks else (i, j + 1)
                far = max(far, abs(i * m - j * n))
            yield far

    known = {(n, m): list(distances(n, m)) for n in range(1, 9) for m in range(1, 9) if n + m <= 12}
    checked = 0
    for (n, m, d), p in zip(cases, got):
        if (n, m) in known:
            want = Fraction(sum(x >= d for x in known[n, m]), len(known[n, m]))
            assert p == pytest.approx(float(want), abs=1e-12), (n, m, d)
            checked += 1
    assert checked > 200
