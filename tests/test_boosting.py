"""Boosted trees and their attribution against plain versions."""

import itertools
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.models import attribution as A
from panelloom.models import boosting as B


def make_rows(n=600, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, z, w = rng.uniform(-2, 2), rng.choice([0.0, 1.0, 2.0]), rng.gauss(0, 1)
        hole = None if rng.random() < 0.4 else rng.random()
        y = 2 * (x > 0.5) + z + (3 if hole is None else 0) + 0.1 * w
        out.append((i, x, z, float("nan") if i % 50 == 7 else w, hole, 1.0, None, y, float(y > 3), i % 3, "ab"[i % 2]))
    return out


SCHEMA = "id long, x double, z double, w double, hole double, same double, void double, y double, flag double, fold int, part string"
FEATURES = ["x", "z", "w", "hole", "same", "void"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(make_rows(), SCHEMA).repartition(4)


def matrix(pdf, model):
    return pdf[model.features].to_numpy(float)


@pytest.fixture(scope="module")
def fitted(rows):
    jobs = [B.Job("all", "d", FEATURES, B.Boost(12, 4)), B.Job("short", "d", ["x", "hole"], B.Boost(3, 2, step=0.5, least_rows=20)),
            B.Job("held", "d", FEATURES, B.Boost(9, 3, subsample=0.7, columns=0.7), held=1)]
    return B.fit(rows.withColumn("data", F.lit("d")), jobs, "y", "data", "fold")


def test_models_fit_and_use_missing_values(rows, fitted):
    pdf = rows.toPandas()
    model = fitted["all"]
    left = pdf["y"] - model.score(matrix(pdf, model))
    assert left.var() < 0.2 * pdf["y"].var()
    short = fitted["short"]  # the only signal in "hole" is that it is missing
    place = short.features.index("hole")
    splits = [(b, c) for t in short.trees for f, b, c in zip(t.feature, t.bin, t.null_left) if f == place]
    assert splits and any(b >= len(short.cuts[place]) for b, _ in splits)
    used = {model.features[f] for t in model.trees for f in t.feature if f >= 0}
    assert "same" not in used and "void" not in used


def test_models_grown_together_equal_models_grown_alone(rows, fitted):
    pdf = rows.toPandas()
    alone = B.fit(rows, [B.Job("all", "one", FEATURES, B.Boost(12, 4))], "y")["all"]
    np.testing.assert_allclose(alone.score(matrix(pdf, alone)), fitted["all"].score(matrix(pdf, fitted["all"])), atol=1e-9)
    rest = rows.where("fold <> 1")
    apart = B.fit(rest, [B.Job("m", "one", FEATURES, B.Boost(9, 3))], "y")["m"]
    full = B.fit(rows, [B.Job("m", "one", FEATURES, B.Boost(9, 3), held=1)], "y", fold="fold")["m"]
    assert abs(apart.base - full.base) < 1e-12  # cuts differ, as the quantiles are those of the whole dataset


def test_first_splits_equal_a_sql_histogram(rows, fitted):
    """Root and second level of the first tree, from sums by (node, feature, bin) in SQL over the same cuts."""
    model, o = fitted["all"], B.Boost(12, 4)
    pdf = rows.toPandas()
    bins = model.bins(matrix(pdf, model))
    con, tree = duckdb.connect(), model.trees[0]
    long = pd.DataFrame([(i, j, int(bins[i, j]), pdf["y"][i] - model.base) for i in range(len(pdf)) for j in range(len(model.features))], columns=["r", "f", "b", "g"])

    con.register("long", long)

    def best(where):
        return con.execute(f"""with h as (select f, b, sum(-g) as g, count(*) as n from long where r in (select r from long where {where}) group by 1, 2),
            c as (select h.f, k.b, side, sum(case when h.b = 0 then (case when side then g else 0 end) when h.b <= k.b then g else 0 end) as gl,
                sum(case when h.b = 0 then (case when side then n else 0 end) when h.b <= k.b then n else 0 end) as nl, sum(g) as gt, sum(n) as nt
                from h join (select unnest(range(1, 65)) as b) k on true cross join (values (true), (false)) s(side) group by h.f, k.b, side)
            select f, b, gl * gl / (nl + 1) + (gt - gl) * (gt - gl) / (nt - nl + 1) - gt * gt / (nt + 1) as gain, nl from c
            where nl >= {o.least_rows} and nt - nl >= {o.least_rows} order by gain desc, f, b limit 1""").fetchall()[0]

    f, b, gain, nl = best("true")
    assert (tree.feature[0], tree.bin[0]) == (f, b) and math.isclose(tree.gain[0], gain, rel_tol=1e-9)
    assert tree.cover[tree.left[0]] == nl and tree.cover[0] == len(pdf)
    for child, side in ((tree.left[0], f"(b <= {b} and (b > 0 or {tree.null_left[0]}))"), (tree.right[0], f"not (b <= {b} and (b > 0 or {tree.null_left[0]}))")):
        if tree.feature[child] >= 0:
            g, _, gain, _ = best(f"f = {f} and {side}")
            assert tree.feature[child] == g and math.isclose(tree.gain[child], gain, rel_tol=1e-9)


def test_leaf_values_are_shrunk_means(fitted, rows):
    model = fitted["short"]
    tree, pdf = model.trees[0], rows.toPandas()
    ends = tree.leaves(model.bins(matrix(pdf, model)))
    for leaf in np.unique(ends):
        own = (pdf["y"] - model.base)[ends == leaf]
        assert math.isclose(tree.value[leaf], 0.5 * own.sum() / (len(own) + 1), rel_tol=1e-9) and tree.cover[leaf] == len(own) >= 20


def test_logistic_models_and_importances(spark, rows):
    model = B.fit(rows, [B.Job("c", "d", FEATURES, B.Boost(15, 3, step=0.3, loss="logistic"))], "flag")
    scored = B.predict(model, rows, "p").select("p", "flag").toPandas()
    assert scored["p"].between(0, 1).all() and ((scored["p"] > 0.5) == (scored["flag"] > 0.5)).mean() > 0.95
    got = {r["feature"]: r["importance"] for r in B.importances(model, spark).collect()}
    assert sum(got.values()) == pytest.approx(1) and got["hole"] > got["w"] and got["void"] == 0


def test_awkward_inputs(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    model = B.fit(none, [B.Job("e", "d", FEATURES)], "y")["e"]
    assert model.base == 0 and model.score(np.zeros((2, len(model.features)))).tolist() == [0, 0]
    few = B.fit(rows.limit(3), [B.Job("f", "d", ["x"], B.Boost(2))], "y")["f"]
    assert all(t.feature == [-1] for t in few.trees)
    mixed = rows.withColumn("part", F.when(F.col("id") > 0, F.col("part")))
    two = B.fit(mixed, [B.Job(k, k, ["x", "z"], B.Boost(2)) for k in "ab"], "y", "part")
    scored = B.predict(two, mixed, "p", "part")
    assert scored.where("p is null").count() == 1 and B.predict(two, mixed.drop("z"), "p", "part").where("p is null").count() == 1


def test_forest_is_the_mean_of_its_trees(rows):
    o = [B.forest(B.Boost(depth=4), k) for k in range(5)]
    trees = B.fit(rows, [B.Job(k, "d", FEATURES, x) for k, x in enumerate(o)], "y")
    whole, pdf = B.average(list(trees.values())), rows.toPandas()
    np.testing.assert_allclose(whole.score(matrix(pdf, whole)), np.mean([m.score(matrix(pdf, m)) for m in trees.values()], 0))
    assert len({tuple(m.trees[0].bin) for m in trees.values()}) > 1


# -- attribution


def expectation(tree, bins, known, node=0):
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    left, right = tree.left[node], tree.right[node]
    if f in known:
        b = bins[f]
        return expectation(tree, bins, known, left if (tree.null_left[node] if b == 0 else b <= tree.bin[node]) else right)
    share = tree.cover[left] / tree.cover[node]
    return share * expectation(tree, bins, known, left) + (1 - share) * expectation(tree, bins, known, right)


def test_attribution_equals_all_subsets(rows, fitted):
    model, pdf = fitted["all"], rows.toPandas().head(25)
    x = matrix(pdf, model)
    bins, n = model.bins(x), len(model.features)
    explainer = A.Explainer(model)
    got = explainer.values(x)
    for r in range(len(x)):
        value = {s: sum(expectation(t, bins[r], s) for t in model.trees) for k in range(n + 1) for s in map(frozenset, itertools.combinations(range(n), k))}
        for i in range(n):
            want = sum(math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (value[s | {i}] - value[s]) for s in value if i not in s)
            assert got[r, i] == pytest.approx(want, abs=1e-9)
        assert model.base + value[frozenset()] == pytest.approx(explainer.base)


def test_attributions_add_up_to_every_prediction(rows, fitted):
    both = B.predict({k: fitted[k] for k in ("all", "short")}, A.attribute(
        {k: fitted[k] for k in ("all", "short")}, rows.withColumn("name", F.when(F.col("id") % 2 == 0, "all").when(F.col("id") % 3 == 0, "short")), "name"), "p", "name")
    columns = [c for c in both.columns if c.startswith("attr_")]
    assert set(columns) == {f"attr_{f}" for f in FEATURES} | {"attr_base"}
    off = F.abs(sum((F.col(c) for c in columns), F.lit(0.0)) - F.col("p"))
    seen = both.agg(F.max(off).alias("off"), F.count_if(F.col("p").isNull() & F.col("attr_x").isNull()).alias("none"), F.count("p").alias("n")).first()
    assert seen["off"] < 1e-9 and seen["none"] == 200 and seen["n"] == 400


def test_a_feature_met_twice_on_a_path():
    tree = B.Tree()
    for _ in range(5):
        tree.add(0.0, 1.0)
    tree.feature, tree.bin, tree.null_left = [0, 0, -1, -1, -1], [3, 1, 0, 0, 0], [False] * 5
    tree.left, tree.right, tree.value, tree.cover = [1, 3, 0, 0, 0], [2, 4, 0, 0, 0], [0, 0, 10.0, 1.0, 4.0], [10, 6, 4, 2, 4]
    model = B.Model(["x"], [np.array([1.0, 2.0, 3.0])], 0.5, "squared", [tree])
    own = A.Explainer(model)
    x = np.array([[0.5], [2.5], [9.0], [np.nan]])
    np.testing.assert_allclose(own.values(x)[:, 0] + own.base, model.score(x))
    assert own.base == pytest.approx(0.5 + 0.2 * 1 + 0.4 * 4 + 0.4 * 10)


def test_halving_keeps_the_better_third(spark, rows):
    from panelloom.models import tabular as M

    best, report = M.halving_search(rows.where("fold is not null"), FEATURES, "y", "fold", 3, trials=7, space={"depth": [1, 2], "step": [0.01, 0.3], "least_rows": [5]}, first_trees=1)
    rungs = report.groupBy("rung", "trees").agg(F.count(F.lit(1)).alias("n"), F.count_if("survived").alias("kept"), F.min(F.when(F.col("survived"), F.col("mean_r2"))).alias("low"),
                                                F.max(F.when(~F.col("survived"), F.col("mean_r2"))).alias("high")).orderBy("rung").collect()
    assert [(r["rung"], r["trees"], r["n"], r["kept"]) for r in rungs] == [(0, 1, 7, 3), (1, 2, 3, 1)]
    assert all(r["low"] >= r["high"] for r in rungs) and best.step == 0.3 and best.trees == 2
    assert M.halving_search(rows, FEATURES, "y", "fold", 3, trials=5, space={"depth": [1]}, seconds=0)[1].count() == 5
