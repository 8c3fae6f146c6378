"""Micro-panels, known answers, and the large-table paths against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.functions import labels, nullsafe
from panelloom.functions.curves import yearly_curve
from panelloom.operators import classify, horizon, metrics, prepare, ranks, sensitivity, sequence, split
from panelloom.operators.encode import apply_encoding, fit_encoding
from panelloom.spec import PanelSpec, prefilter_features

P = PanelSpec("id", "t")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- missing values --------------------------------------------------------

def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (2.0,)], "x double")
    assert [r[0] for r in df.select(nullsafe.clip("x", 0, 1)).collect()] == [None, 0.0, 1.0]


def test_last_value_and_last_row_differ(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (2, 1, None)], "id int, t int, v double")
    last = df.groupBy("id").agg(nullsafe.last_value("v", ["t"]).alias("v"))
    assert rows(last.where("id = 1"), "v") == [(5.0,)]
    assert prepare.row_last(df, P, ["v"]).where("id = 1").first()["v"] is None


def test_rate_counts_null_as_false(spark):
    df = spark.createDataFrame([(1, 1, 0.1, None), (1, 2, None, None)], "id int, t int, a double, b double")
    h = classify.entity_health(df.withColumn("s", F.lit(None).cast("double")), P, "s", "a", "b", 0.5).first()
    assert h["fail_rate"] == 0.5 and h["final_stock"] is None


def test_missing_stock_labels(spark):
    df = spark.createDataFrame([(1, None, 0.0)], "id int, final_stock double, fail_rate double")
    r = classify.populations(df).first()
    assert (r["population"], r["population_binary"]) == ("yield_ok × tree_ok", "yield_ok × tree_degraded")
    assert classify.tree_labels(df, "id").first()["tree_class"] is None


def test_bins_are_left_closed(spark):
    df = spark.createDataFrame([(0.99,), (1.0,), (50.0,)], "x double")
    assert [r[0] for r in df.select(labels.bin_index("x", [1.0, 50.0])).collect()] == [0, 1, 2]


def test_ratios_guard(spark):
    df = spark.createDataFrame([(1.0, 0.001), (1.0, 0.002)], "a double, b double")
    assert [r[0] for r in df.select(nullsafe.ratio_above("a", "b", 0.001)).collect()] == [None, 500.0]


def test_nan_becomes_null(spark):
    df = nullsafe.nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"))
    assert [r[0] for r in df.collect()] == [None, 1.0]


def test_flag_nonblank(spark):
    df = spark.createDataFrame([(None,), ("  ",), ("a",)], "x string")
    assert [r[0] for r in df.select(prepare.flag_nonblank("x")).collect()] == [0, 0, 1]


def test_null_category_is_kept(spark):
    df = spark.createDataFrame([(None,), ("a",), ("b",)], "c string")
    assert prepare.exclude_categories(df, "c", ["a"]).count() == 2


# --- sequences -------------------------------------------------------------

def test_interpolation_by_position_with_edges(spark):
    data = [(1, t, v) for t, v in [(1, None), (2, 1.0), (9, None), (10, 3.0), (11, None)]]
    df = spark.createDataFrame(data, "id int, t int, stock double")
    out = sequence.interpolate(df, P, ["stock"], 0.6)
    assert [v for _, v in rows(out, "t", "stock")] == [1.0, 1.0, 2.0, 3.0, 3.0]
    kept = sequence.interpolate(df, P, ["stock"], 0.5)
    assert kept.where("stock is null").count() == 3
    exact = sequence.interpolate(df, P, ["stock"], 3 / 5)
    assert exact.where("stock is null").count() == 0


def test_never_interpolated_columns(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 1.0)], "id int, t int, yield_AF double")
    assert sequence.interpolate(df, P, ["yield_AF"], 1.0).where("yield_AF is null").count() == 1


def curve(spark, knots, **options):
    df = spark.createDataFrame([(1, x, y) for x, y in knots], "k int, x int, y double")
    return dict(rows(yearly_curve(df, ["k"], "x", "y", 40, **options), "year", "value"))


def test_curve_reproduces_a_line(spark):
    c = curve(spark, [(h, 2.0 * h + 1) for h in (5, 10, 20, 30, 40)])
    assert len(c) == 40 and all(c[y] == 0 for y in range(1, 5))
    assert all(abs(c[y] - (2 * y + 1)) < 1e-9 for y in range(5, 41))


def test_curve_is_monotone_and_hits_knots(spark):
    knots = [(5, 0.0), (10, 1.0), (20, 1.0), (30, 9.0), (40, 9.5)]
    c = curve(spark, knots)
    values = [c[y] for y in range(5, 41)]
    assert all(b >= a - 1e-12 for a, b in zip(values, values[1:]))
    assert all(c[x] == pytest.approx(y) for x, y in knots)


def test_curve_with_few_knots(spark):
    assert set(curve(spark, [(10, 4.0)]).values()) == {4.0}
    assert set(curve(spark, [(10, None)]).values()) == {0.0}
    two = curve(spark, [(10, 1.0), (20, 2.0), (30, None)])
    assert two[15] == pytest.approx(1.5) and two[21] == 0.0 and two[9] == 0.0
    assert set(curve(spark, [(10, 0.4)], lone_value=1.0).values()) == {1.0}
    ext = curve(spark, [(10, 0.5), (20, 0.9)], extrapolate=True, hi=1.0)
    assert ext[5] == pytest.approx(0.3) and ext[40] == 1.0


def test_slope_of_a_line_is_two(spark):
    df = spark.createDataFrame([(1, t, 2.0 * t + 1) for t in range(1, 13)], "id int, t bigint, v double")
    out = horizon.horizon_features(df, P, [], ["v"], horizons=[12]).first()
    assert out["v_trend"] == pytest.approx(2.0)
    legacy = horizon.horizon_features(df, P, [], ["v"], horizons=[12], legacy_trend=True).first()
    assert legacy["v_trend"] == pytest.approx(2.0 / 12)
    same = horizon.horizon_features(df.repartition("id"), P, [], ["v"], horizons=[12], prepared=True).first()
    assert same["v_trend"] == pytest.approx(2.0) and same["v_recent_mean"] == out["v_recent_mean"]


def test_horizon_drops_entities_without_climate(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 1, 3.0)], "id int, t bigint, v double")
    assert rows(horizon.horizon_features(df, P, ["v"], [], horizons=[5]), "id", "v_cum") == [(2, 3.0)]


# --- ranks and quantiles: large-table paths --------------------------------

@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    # A third of all rows in one group, a third of its rows one value.
    data = [("hot" if i % 3 == 0 else f"g{i % 5}", 5.0 if i % 9 == 0 else rng.lognormvariate(0, 2)) for i in range(3000)]
    return data, spark.createDataFrame(data, "g string, v double").repartition(4).cache()


def test_bucketed_ranks_equal_brute_force(spark, skewed):
    data, df = skewed
    out = {(r["g"], r["v"]): (r["n"], r["n_below"], r["n_total"]) for r in
           ranks.cumulate(df, ["g"], "v", buckets=16).collect()}
    for g in {g for g, _ in data}:
        values = [v for h, v in data if h == g]
        for v in set(values):
            assert out[(g, v)] == (values.count(v), sum(x < v for x in values), len(values))


def test_bucketed_quantiles_equal_numpy(spark, skewed):
    data, df = skewed
    for buckets in (None, 16, 256):
        for r in ranks.exact_quantiles(df, ["g"], "v", {"a": 0.01, "b": 0.5, "c": 0.99}, buckets=buckets).collect():
            values = [v for h, v in data if h == r["g"]]
            assert [r["a"], r["b"], r["c"]] == pytest.approx(list(np.percentile(values, [1, 50, 99])))


def test_bucket_search(spark):
    cuts = [1.0, 2.0, 4.0]
    df = spark.createDataFrame([(cuts, v) for v in (0.0, 1.0, 1.5, 4.0, 9.0)], "c array<double>, v double")
    assert [r[0] for r in df.select(ranks.count_below("c", "v", 8)).collect()] == [0, 0, 1, 2, 3]


def test_hash_rank_equals_brute_force(spark, monkeypatch):
    df = spark.range(500).withColumn("s", F.when(F.col("id") % 3 == 0, "hot").otherwise("cold")).withColumn("k", F.col("id") % 4)
    order = sorted(range(500), key=lambda i: (hashlib.md5(f"1:{i}".encode()).hexdigest(), i))
    strata = {True: [i for i in order if i % 3 == 0], False: [i for i in order if i % 3]}
    wanted = sorted((i, own.index(i), len(own)) for own in strata.values() for i in own)
    led = sorted(order, key=lambda i: i % 4)
    for held in (50_000, 5):  # one hex digit, and two
        monkeypatch.setattr(ranks, "BUCKET_ROWS", held)
        assert sorted(rows(ranks.hash_rank(df.repartition(7), ["s"], "id", 1), "id", "rank", "n_stratum")) == wanted
        assert sorted(rows(ranks.hash_rank(df, [], "id", 1, lead=["k"]), "id", "rank")) == sorted((i, led.index(i)) for i in order)



# --- splits and samples ----------------------------------------------------

def test_split_sizes_and_reproducibility(spark):
    df = spark.range(103).withColumnRenamed("id", "e")
    a = rows(split.entity_split(df, "e", 0.2), "e", "split")
    assert sum(s == "test" for _, s in a) == 20
    assert a == rows(split.entity_split(df.repartition(9), "e", 0.2), "e", "split")


def test_singleton_stratum_goes_to_test(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "b")], "e int, s string")
    out = dict(rows(split.stratified_split(df, "e", "s"), "e", "split"))
    assert out[1] == "test" and sum(out[e] == "test" for e in (2, 3, 4)) == 1


def test_folds_are_balanced_and_disjoint(spark):
    df = spark.range(200).select((F.col("id") % 37).alias("e"))
    f = split.group_folds(df, "e", 5)
    sizes = [n for _, n in rows(f.groupBy("fold").agg(F.sum("n_rows").alias("n")), "fold", "n")]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 6
    assert f.count() == 37


def test_bootstrap_with_threshold_equals_brute_force(spark):
    # Slices far larger than the threshold, so most draws are dropped before the shuffle.
    df = spark.range(1500).select(F.col("id").alias("k"), F.when(F.col("id") < 900, "a").otherwise("b").alias("s"))
    got = {}
    for s, b, k in rows(split.bootstrap_samples(df, ["s"], "k", 3, 20), "s", "boot", "k"):
        got.setdefault((s, b), set()).add(k)
    for s, ids in (("a", range(900)), ("b", range(900, 1500))):
        for b in range(3):
            order = sorted(ids, key=lambda i: hashlib.md5(f"42:{b}:{i}".encode()).hexdigest())
            assert got[(s, b)] == set(order[:20])


# --- statistics ------------------------------------------------------------

def brute_sigma(x):
    d = [(a - b) ** 2 for i, a in enumerate(x) for b in x[i + 1:]]
    m = float(np.median(d)) if d else 0.0
    return math.sqrt(m / 2) if m > 0 else 1.0


@pytest.mark.parametrize("first, step", [(6, 3), (2, 1), (1, 2)])
def test_bandwidth_equals_brute_force(spark, monkeypatch, first, step):
    """Also with so few buckets that every round has to cut the straddling ones finer."""
    monkeypatch.setattr(sensitivity, "FIRST_BITS", first)
    monkeypatch.setattr(sensitivity, "STEP_BITS", step)
    monkeypatch.setattr(sensitivity, "TRIED", 5)
    rng = random.Random(3)
    slices = {"u": [rng.random() for _ in range(60)], "ties": [float(i % 3) for i in range(41)],
              "flat": [2.0] * 30, "pair": [1.0, 4.0], "one": [7.0], "hot": [0.0] * 70 + [rng.random() for _ in range(50)], "heavy": [rng.paretovariate(1.2) for _ in range(80)]}
    df = spark.createDataFrame([(s, v) for s, xs in slices.items() for v in xs], "s string, v double")
    out = {r["s"]: r["sigma"] for r in sensitivity.bandwidths(df, ["s"], ["v"]).collect()}
    assert {s: pytest.approx(brute_sigma(x), rel=1e-12) for s, x in slices.items()} == out


def test_bandwidth_of_many_values_takes_few_jobs_and_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.lognormal(size=3000)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    spark.sparkContext.setJobGroup("sigma", "")
    got = sensitivity.bandwidths(df, [], ["v"]).first()["sigma"]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("sigma"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == pytest.approx(math.sqrt(np.median((x[:, None] - x)[np.triu_indices(3000, 1)] ** 2) / 2), rel=1e-12)
    assert jobs < 80  # adaptive execution counts every stage of the three tables a round writes


def test_whole_slices_by_feature_maps_equal_the_exact_index(spark):
    rng = np.random.default_rng(2)
    x, e = rng.normal(size=1000), rng.normal(size=1000)
    table = {"x": x, "skew": np.exp(e), "y": x**2 + 0.3 * e, "z": rng.uniform(size=1000), "flat": np.ones(1000), "g": np.repeat([1, 2], 500), "h": np.repeat(["a", "b"], 500)}
    df = spark.createDataFrame([tuple(v[i].item() if hasattr(v[i], "item") else v[i] for v in table.values()) for i in range(1000)], list(table)).repartition(5)
    extra = spark.createDataFrame([(None, 1.0, 1.0, 1.0, 1.0, 1, "a")], df.schema)
    got = {(r["g"], r["h"], r["feature"], r["target"]): r for r in sensitivity.hsic_whole(df.unionByName(extra), ["x", "skew", "flat"], ["y", "z"], ["g", "h"]).collect()}
    for g, h, at in ((1, "a", slice(0, 500)), (2, "b", slice(500, 1000))):
        sample = {c: table[c][at] for c in ("x", "skew", "flat", "y", "z")}
        exact = sensitivity.hsic_of_sample(sample, {c: brute_sigma(v) for c, v in sample.items()}, ["x", "skew", "flat"], ["y", "z"])
        for f, t, value in exact:
            r = got[g, h, f, t]
            assert abs(r["hsic"] - value) < 0.01 and r["n_obs"] == 500
    assert len(got) == 12 and sensitivity.hsic_whole(df.limit(0), ["x"], ["y"]).count() == 0


def test_index_of_itself_is_one():
    x = np.arange(40.0) ** 2
    out = sensitivity.hsic_of_sample({"x": x, "c": np.ones(40)}, {"x": 200.0, "c": 1.0}, ["x", "c"], ["x"])
    assert out[0][2] == pytest.approx(1.0) and out[1][2] == 0.0


def test_spearman_paths_agree(spark):
    rng = random.Random(5)
    data = [(float(i % 7), rng.random(), float(rng.randint(0, 4))) for i in range(300)]
    df = spark.createDataFrame(data, "a double, b double, y double").cache()
    a = rows(sensitivity._spearman_complete(df, ["a", "b"], ["y"]), "feature", "target", "n", "rho")
    b = rows(sensitivity._spearman_pairwise(df, ["a", "b"], ["y"]), "feature", "target", "n", "rho")
    assert [r[:3] for r in a] == [r[:3] for r in b]
    assert [r[3] for r in a] == pytest.approx([r[3] for r in b])


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, s double")
    assert metrics.auc(df, "y", "s").first()["roc_auc"] is None


def test_non_finite_prediction_fails(spark):
    df = spark.createDataFrame([(1.0, None)], "y double, p double")
    with pytest.raises(Exception, match="non-finite"):
        metrics.regression_metrics(df, "y", "p").collect()


def test_perfect_prediction(spark):
    r = metrics.regression_metrics(spark.createDataFrame([(1.0, 1.0), (3.0, 3.0)], "y double, p double"), "y", "p").first()
    assert (r["r2"], r["rmse"], r["bias"]) == (1.0, 0.0, 0.0)


# --- encoding and roles ----------------------------------------------------

def test_unseen_class_becomes_zero(spark):
    train = spark.createDataFrame([("b",), ("a",)], "c string")
    enc = fit_encoding(train, ["c"])
    out = apply_encoding(spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string"), enc, ["c"])
    assert sorted(r[0] for r in out.collect()) == [0, 0, 0, 1]


def test_prefilter_features_replace_climate():
    assert prefilter_features(["a", "GDD_cycle_AF", "ETP_cycle_AF", "b"]) == ["a", "longitude", "b"]


def test_unknown_population_raises(spark):
    df = spark.createDataFrame([(1, None, 0.0)], "id int, final_stock double, fail_rate double")
    with pytest.raises(ValueError):
        classify.keep_population(df, classify.populations(df), P, "nope")


def test_kernel_index_uses_complete_rows_of_a_pair():
    import numpy as np

    from panelloom.operators.sensitivity import _own_bandwidth, hsic_of_sample

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=60), rng.normal(size=60)
    y += x
    holes = np.where(np.arange(60) % 7 == 0, np.nan, x)
    kept = ~np.isnan(holes)
    own = {"x": x[kept], "y": y[kept]}
    wanted = hsic_of_sample(own, {c: _own_bandwidth(v) for c, v in own.items()}, ["x"], ["y"])[0][2]
    got = {f: v for f, _, v in hsic_of_sample({"x": holes, "z": x, "y": y}, {"x": 1.0, "z": 1.0, "y": 1.0}, ["x", "z"], ["y"])}
    assert got["x"] == wanted > 0 and got["z"] > 0


def test_constant_columns(spark):
    from panelloom.operators.prepare import constant_columns

    df = spark.createDataFrame([(1, 2.0, None, "a"), (1, 3.0, None, "a")], "a int, b double, c long, d string")
    assert sorted(r["variable"] for r in constant_columns(df).collect()) == ["a", "c"]
    assert constant_columns(df.limit(0)).count() == 0
