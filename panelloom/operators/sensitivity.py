"""Kernel dependence (HSIC) and rank correlation between features and targets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions.nullsafe import first_value
from panelloom.operators import ranks
from panelloom.operators.aggregate import boot_summary, dominant_category, order_by_best
from panelloom.operators.ranks import unpivot
from panelloom.operators.split import bootstrap_samples
from panelloom.session import broadcast_if_small, freeze, materialize, materialize_counted

#: Value buckets of a group at the start, as a power of two, and how many bits finer each round makes them.
FIRST_BITS, STEP_BITS = 7, 3
#: Quantiles of the bucket pairs' distance bounds that a round tries as limits.
TRIED = 31
CONSTANT = 1e-10


# --- bandwidth -------------------------------------------------------------

def _bucket_pairs(points: DataFrame, keys: list[str], state: DataFrame, before: DataFrame | None) -> DataFrame:
    """(keys, i, j, pairs, near, far): pairs of value buckets under the shift of ``state``, their number of row pairs and bounds of their distances.

    All pairs of the few buckets of the first round; later only the parts of the bucket pairs that ``before`` has kept.
    """
    at = F.floor(F.col("place") / F.pow(F.lit(2.0), F.col("shift"))).cast("long").alias("b")
    buckets = points.join(state.select(*keys, "shift"), keys).select(*keys, at, "value", "n").groupBy(*keys, "b").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("rows"))
    left, right = (buckets.select(*keys, F.col("b").alias(i), F.col("lo").alias(f"lo_{i}"), F.col("hi").alias(f"hi_{i}"), F.col("rows").alias(f"rows_{i}")) for i in "ij")
    if before is None:
        met = left.join(right, keys).where("i <= j")
    else:
        parts = F.pow(F.lit(2.0), F.col("finer")).cast("long")
        children = [F.sequence(F.col(c) * parts, F.col(c) * parts + parts - 1) for c in "ij"]
        asked = before.join(state.select(*keys, "finer", "low", "high"), keys).where("far >= low and near <= high")
        asked = asked.select(*keys, F.explode(children[0]).alias("i"), children[1].alias("js")).select(*keys, "i", F.explode("js").alias("j")).where("i <= j")
        met = asked.join(left, [*keys, "i"]).join(right, [*keys, "j"])
    same = F.col("i") == F.col("j")
    return met.select(
        *keys, "i", "j", F.when(same, F.expr("rows_i * (rows_i - 1) div 2")).otherwise(F.col("rows_i") * F.col("rows_j")).alias("pairs"),
        F.when(same, F.lit(0.0)).otherwise(F.col("lo_j") - F.col("hi_i")).alias("near"), (F.col("hi_j") - F.col("lo_i")).alias("far")).where("pairs > 0")


def _narrowed(pairs: DataFrame, keys: list[str], state: DataFrame) -> DataFrame:
    """``state`` with limits between which the wanted distances still lie, and the number of row pairs surely below them.

    Limits are tried at quantiles of the bounds; which of them hold follows from exact counts, so approximate quantiles do not matter.
    """
    probs = [i / (TRIED + 1) for i in range(1, TRIED + 1)]
    tried = F.array_sort(F.array_union(F.percentile_approx("near", probs, 1000), F.percentile_approx("far", probs, 1000)))
    limits = materialize(pairs.groupBy(*keys).agg(tried.alias("limits")))
    slots = [("far_upto", "far", False), ("near_below", "near", True), ("far_below", "far", True)]
    marks = pairs.join(limits, keys).select(*keys, "pairs", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), ranks.count_below("limits", v, 2 * TRIED + 2, equal).alias("slot")) for k, v, equal in slots])).alias("m"))
    counted = marks.groupBy(*keys, "m.kind", "m.slot").agg(F.sum("pairs").alias("pairs"))
    # At most three rows a limit and group.
    facts = counted.groupBy(*keys).agg(F.collect_list(F.struct("kind", "slot", "pairs")).alias("counts")).join(limits, keys).join(state, keys)

    def upto(kind: str, place) -> Column:
        return F.aggregate("counts", F.lit(0).cast("long"), lambda total, c: total + F.when((c["kind"] == kind) & (c["slot"] <= place), c["pairs"]).otherwise(0))

    place = F.sequence(F.lit(0), F.size("limits") - 1)
    low = F.filter(place, lambda p: F.col("below") + upto("near_below", p) <= F.col("first"))
    high = F.filter(place, lambda p: F.col("below") + upto("far_upto", p) > F.col("second"))
    found = facts.withColumns({"_low": F.when(F.size(low) > 0, F.array_max(low)), "_high": F.when(F.size(high) > 0, F.array_min(high))})
    finer = F.least(F.lit(STEP_BITS), F.col("shift"))
    moved = found.select(
        *keys, "first", "second", (F.col("shift") - finer).alias("shift"), finer.alias("finer"),
        F.coalesce(F.get("limits", F.col("_low")), F.col("low")).alias("_new_low"), F.least(F.get("limits", F.col("_high")), F.col("high")).alias("high"),
        F.when(F.col("_low").isNotNull(), F.col("below") + upto("far_below", F.col("_low"))).otherwise(F.col("below")).alias("_new_below"), "low", "below")
    # A limit below the former one tells nothing new: pairs below that one are gone from the table.
    rises = F.col("_new_low") > F.col("low")
    return moved.select(*keys, "first", "second", "shift", "finer", F.when(rises, F.col("_new_low")).otherwise(F.col("low")).alias("low"), "high",
                        F.when(rises, F.col("_new_below")).otherwise(F.col("below")).alias("below"))


def _middle_distances(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, d0, d1): the two middle distances of all row pairs of each group; groups with one row have none.

    A selection in the implicit matrix of pairs. Sorted distinct values are cut into buckets; bucket pairs whose distances lie wholly below the
    wanted rank are counted from the bucket totals, those wholly above it are dropped, and only pairs of buckets that straddle it are cut finer,
    until buckets hold one value each. About as many bucket pairs as buckets straddle, so rows grow with the values, never with their pairs.
    """
    groups = points.groupBy(*keys).agg(F.max("n_total").alias("total"), F.max("place_total").alias("values"))
    pairs_of = F.expr("total * (total - 1) div 2")
    shift = F.greatest(F.lit(0), F.ceil(F.log2(F.col("values").cast("double"))) - FIRST_BITS).cast("int")
    state, seen = materialize_counted(
        groups.withColumn("all", pairs_of).where("all > 0").select(
            *keys, F.expr("(all - 1) div 2").alias("first"), F.expr("all div 2").alias("second"), shift.alias("shift"), F.lit(0).alias("finer"),
            F.lit(0.0).alias("low"), F.lit(float("inf")).alias("high"), F.lit(0).cast("long").alias("below")),
        coarsest=F.max("shift"))
    pairs = materialize(_bucket_pairs(points, keys, state, None))
    for _ in range(-(-(seen["coarsest"] or 0) // STEP_BITS)):
        state = materialize(_narrowed(pairs, keys, state))
        pairs = materialize(_bucket_pairs(points, keys, state, pairs))
    # One value in each bucket: distances are exact.
    steps = ranks.cumulate(pairs, keys, "near", {"pairs": F.col("pairs")}).join(state.select(*keys, "first", "second", "below"), keys)
    under = F.col("below") + F.col("pairs_below")

    def at(rank: str):
        return F.max(F.when((under <= F.col(rank)) & (F.col(rank) < under + F.col("pairs")), F.col("near")))

    return steps.groupBy(*keys).agg(at("first").alias("d0"), at("second").alias("d1"))


def bandwidths(df: DataFrame, slices: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Median-heuristic bandwidth ``sqrt(median(d^2) / 2)`` over all pairs of a slice, per variable.

    Rows are first reduced to distinct values with counts.  1.0 if degenerate.
    """
    keys = [*slices, "variable"]
    totals, seen = materialize_counted(
        unpivot(df, slices, columns).where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count("*").alias("n"), F.lit(1).cast("long").alias("place"))
    )
    ranked = ranks.cumulate_totals(totals, keys, "value", ["n", "place"], ranks.bucket_number(seen["n"]))
    points = materialize(ranked.select(*keys, "value", "n", F.col("place_below").alias("place"), "n_total", "place_total"))
    groups = points.select(*keys).distinct()
    distances = groups.join(_middle_distances(points, keys), keys, "left")
    middle = (F.col("d0") * F.col("d0") + F.col("d1") * F.col("d1")) / 2
    return distances.select(*keys, F.when(middle > 0, F.sqrt(middle / 2)).otherwise(1.0).alias("sigma"))


# --- index -----------------------------------------------------------------

def _centred_kernel(x: np.ndarray, sigma: float) -> np.ndarray:
    k = np.subtract.outer(x, x)
    np.square(k, out=k)
    k /= -2.0 * max(sigma, 1e-10) ** 2
    np.exp(k, out=k)
    mean = k.mean(axis=0)
    k -= mean[None, :]
    k -= mean[:, None]
    k += mean.mean()
    return k


def _own_bandwidth(values: np.ndarray) -> float:
    apart = np.abs(values[:, None] - values[None, :])[np.triu_indices(len(values), 1)]
    middle = float(np.median(apart**2)) if len(apart) else 0.0
    return (middle / 2) ** 0.5 or 1.0


def hsic_of_sample(sample: dict[str, np.ndarray], sigma: dict[str, float], features: Sequence[str],
                   targets: Sequence[str]) -> list[tuple[str, str, float]]:
    """Normalised index in [0, 1] for every feature x target of one bounded sample.

    A pair with missing values is compared over its own complete rows, with their own bandwidths; 0 without any.
    """
    kernels, norms = {}, {}
    for c in dict.fromkeys([*features, *targets]):
        if sample[c].std() > CONSTANT:
            kernels[c] = _centred_kernel(sample[c], sigma[c])
            norms[c] = float(np.vdot(kernels[c], kernels[c]))
    scale = 1.0 / max(len(sample[features[0]]) - 1, 1) ** 2
    out = []
    for f in features:
        for t in targets:
            value = 0.0
            seen = np.isfinite(sample[f]) & np.isfinite(sample[t])
            if not seen.all():
                if seen.any():
                    own = {c: sample[c][seen] for c in (f, t)}
                    value = hsic_of_sample(own, {c: _own_bandwidth(v) for c, v in own.items()}, [f], [t])[0][2]
            elif f in kernels and t in kernels:
                cross = scale * float(np.vdot(kernels[f], kernels[t]))
                floor = max(scale * norms[f] * scale * norms[t], 1e-24)
                value = min(max(cross / floor**0.5, 0.0), 1.0)
            out.append((f, t, value))
    return out


def hsic_values(samples: DataFrame, sigmas: DataFrame, slices: Sequence[str], features: Sequence[str],
                targets: Sequence[str]) -> DataFrame:
    """Index per (slice, bootstrap, feature, target); one task holds one bounded sample."""
    columns = list(dict.fromkeys([*features, *targets]))
    keys = [*slices, "boot"]
    marked = sigmas.withColumn("_one", F.lit(0)).groupBy("_one", *slices).agg(
        F.map_from_entries(F.collect_list(F.struct("variable", "sigma"))).alias("_sigma"))
    rows = samples.withColumn("_one", F.lit(0)).join(broadcast_if_small(freeze(marked), 20_000), ["_one", *slices]).select(
        *keys, *[F.col(c).cast("double").alias(c) for c in columns], *[F.col("_sigma")[c].alias(f"_s_{c}") for c in columns]
    )
    schema = T.StructType([rows.schema[k] for k in keys] + [
        T.StructField("feature", T.StringType()), T.StructField("target", T.StringType()),
        T.StructField("hsic", T.DoubleType())])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        sample = {c: pdf[c].to_numpy(float) for c in columns}
        sigma = {c: float(pdf[f"_s_{c}"].iloc[0]) for c in columns}
        out = pd.DataFrame(hsic_of_sample(sample, sigma, features, targets), columns=["feature", "target", "hsic"])
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    return rows.groupBy(*keys).applyInPandas(solve, schema)


#: Frequencies of the feature map for whole slices, and slices whose sums a task holds before it sends them.
FREQUENCIES, HELD_SLICES = 64, 64


def frequencies(n: int = FREQUENCIES, seed: int = 42) -> np.ndarray:
    """Standard normal frequencies, one drawn from each of ``n`` equally likely strata, so that their mean cosine is close to the kernel."""
    place = (np.arange(n) + np.random.default_rng(seed).random(n)) / n
    return np.array([NormalDist().inv_cdf(min(max(p, 1e-9), 1 - 1e-9)) for p in place])


def map_sums(scaled: dict[str, np.ndarray], pairs: Sequence[tuple[str, str]], waves: np.ndarray) -> dict[str, np.ndarray]:
    """Sums of the feature maps of a block's columns, the row count last, and, by the pair's number, of their products.

    A column of few different values is mapped once per value, and its products come from counts or sums by value; the sums are the same.
    """
    n = len(next(iter(scaled.values())))
    maps, place, out = {}, {}, {}
    for c, x in scaled.items():
        values, at = np.unique(x, return_inverse=True)
        if 4 * len(values) <= n:
            x, place[c] = values, at
        phase = x[:, None] * waves
        maps[c] = np.concatenate([np.cos(phase), np.sin(phase)], 1)
        whole = np.bincount(place[c], minlength=len(x)) @ maps[c] if c in place else maps[c].sum(0)
        out[c] = np.concatenate([whole, [n]])

    def by_value(few: str, other: str) -> np.ndarray:
        if other in place:
            size = len(maps[few]), len(maps[other])
            return np.bincount(place[few] * size[1] + place[other], minlength=size[0] * size[1]).reshape(size).astype(float) @ maps[other]
        order = np.argsort(place[few], kind="stable")
        return np.add.reduceat(maps[other][order], np.searchsorted(place[few][order], np.arange(len(maps[few]))))

    for i, (a, b) in enumerate(pairs):
        if a in place:
            out[str(i)] = maps[a].T @ by_value(a, b)
        else:
            out[str(i)] = (maps[b].T @ by_value(b, a)).T if b in place else maps[a].T @ maps[b]
    return out


def hsic_whole(df: DataFrame, features: Sequence[str], targets: Sequence[str], slices: Sequence[str] = (), n: int = FREQUENCIES, seed: int = 42) -> DataFrame:
    """(slices, feature, target, n_obs, hsic) over all complete rows of every slice, without any sample.

    The kernel of bandwidth s is the mean of cos(w (x - y) / s) over normal frequencies w, so with the feature map (cos(w x / s), sin(w x / s))
    the index is the squared norm of the two maps' cross-covariance, normalised. Its sums are added up in the tasks: rows x frequencies work and one
    matrix per slice and pair, whatever the number of rows. Against the exact index on 500 rows it is off by less than 0.01 (tested).
    """
    columns = list(dict.fromkeys([*features, *targets]))
    pairs = list(dict.fromkeys([(f, t) for f in features for t in targets] + [(c, c) for c in columns]))
    rows = materialize(df.select(*slices, *[F.col(c).cast("double").alias(c) for c in columns]).na.drop(subset=columns))
    sigmas = bandwidths(rows, slices, columns)
    marked = sigmas.withColumn("_one", F.lit(0)).groupBy("_one", *slices).agg(F.map_from_entries(F.collect_list(F.struct("variable", "sigma"))).alias("_sigma"))
    joined = rows.withColumn("_one", F.lit(0)).join(broadcast_if_small(freeze(marked), 20_000), ["_one", *slices])
    # Slices travel as one text, so that a key of any types fits the tasks' tables.
    label = F.to_json(F.struct(*slices)) if slices else F.lit("{}")
    given = joined.select(label.alias("_slice"), *columns, *[F.greatest(F.col("_sigma")[c], F.lit(1e-10)).alias(f"_s_{c}") for c in columns])
    waves = frequencies(n, seed)

    def send(held: dict[str, dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for name, sums in held.items():
            yield pa.RecordBatch.from_pydict({"_slice": [name] * len(sums), "part": list(sums), "sums": [v.tobytes() for v in sums.values()]})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, np.ndarray]] = {}
        for batch in batches:
            pdf = batch.to_pandas()
            for name, part in pdf.groupby("_slice"):
                sums = held.setdefault(name, {})
                for at in range(0, len(part), 2048):
                    block = part.iloc[at : at + 2048]
                    for k, v in map_sums({c: (block[c] / block[f"_s_{c}"]).to_numpy() for c in columns}, pairs, waves).items():
                        sums[k] = sums.get(k, 0) + v
            if len(held) > HELD_SLICES:
                yield from send(held)
                held = {}
        yield from send(held)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                sums = held.setdefault(r["_slice"], {})
                sums[r["part"]] = sums.get(r["part"], 0) + np.frombuffer(r["sums"])
        for name, sums in held.items():
            count = sums[columns[0]][-1]
            centre = {c: sums[c][:-1] / count for c in columns}
            norm = {p: float(((sums[str(i)].reshape(2 * n, 2 * n) / count - np.outer(centre[p[0]], centre[p[1]])) ** 2).sum()) for i, p in enumerate(pairs)}
            out = []
            for f in features:
                for t in targets:
                    floor = norm[f, f] * norm[t, t]
                    value = min(norm[f, t] / floor**0.5, 1.0) if norm[f, f] > 1e-18 and norm[t, t] > 1e-18 else 0.0
                    out.append((name, f, t, int(count), value))
            yield pa.RecordBatch.from_pydict(dict(zip(("_slice", "feature", "target", "n_obs", "hsic"), map(list, zip(*out)))))

    summed = given.mapInArrow(partial, "_slice string, part string, sums binary").repartition("_slice")
    found = summed.mapInArrow(total, "_slice string, feature string, target string, n_obs long, hsic double")
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in slices)
    keys = [F.from_json("_slice", kinds)[k].alias(k) for k in slices]
    return found.select(*keys, "feature", "target", "n_obs", "hsic")


def hsic_indices(df: DataFrame, key: str, features: Sequence[str], targets: Sequence[str],
                 slices: Sequence[str] = (), n_boot: int = 100, boot_size: int = 500, seed: int = 42,
                 written: bool = False, sigmas: DataFrame | None = None) -> DataFrame:
    """Bootstrap summary per (slice, feature, target); all slices are one grouped job.

    ``written`` says that ``df`` is already a stored table of complete rows; ``sigmas`` are its bandwidths if they are known.
    """
    columns = list(dict.fromkeys([*features, *targets]))
    rows = df if written else materialize(df.select(*slices, key, *columns).na.drop(subset=columns))
    sigmas = bandwidths(rows, slices, columns) if sigmas is None else sigmas
    samples = bootstrap_samples(rows, slices, key, n_boot, boot_size, seed)
    values = hsic_values(samples, sigmas, slices, features, targets)
    return order_by_best(boot_summary(values, [*slices, "feature", "target"], "hsic"), slices)


def hsic_by_period(df: DataFrame, entity: str, period: str, category: str, features: Sequence[str],
                   targets: Sequence[str], mode: str = "all", min_obs: int = 100, n_boot: int = 100,
                   boot_size: int = 400, seed: int = 42, ids: DataFrame | None = None) -> DataFrame:
    """Indices per period (and category).  ``mode``: all, dominant or per_crop.

    The dominant category is chosen before rows are reduced to one per entity.
    """
    one = materialize(_entity_rows(df, entity, period, category, features, targets, mode, ids).na.drop(subset=[*features, *targets]))
    slices = [period, "crop_name"]
    kept, enough = _large_slices(one, slices, min_obs)
    return hsic_indices(kept, entity, features, targets, slices, n_boot, boot_size, seed, written=True).join(enough, slices)


def _entity_rows(df: DataFrame, entity: str, period: str, category: str, features: Sequence[str], targets: Sequence[str], mode: str = "all",
                 ids: DataFrame | None = None) -> DataFrame:
    """One row per (period, crop_name, entity), incomplete ones too."""
    if mode not in ("all", "dominant", "per_crop"):
        raise ValueError(f"unknown mode {mode!r}")
    df = df.where(F.col(period).isNotNull())
    if ids is not None:
        df = df.join(ids.select(entity), entity, "left_semi")
    if mode == "dominant":
        top = dominant_category(df, period, category)
        df = df.join(top, [period]).where(F.col(category) == F.col("dominant")).drop("dominant")
    if mode == "per_crop":
        df = df.where(F.col(category).isNotNull())
    label = F.lit("all") if mode == "all" else F.col(category)
    return df.withColumn("crop_name", label).groupBy(period, "crop_name", entity).agg(
        *[first_value(f, [category, f]).alias(f) for f in features], *[F.avg(t).alias(t) for t in targets]
    )


def _large_slices(rows: DataFrame, slices: list[str], min_obs: int) -> tuple[DataFrame, DataFrame]:
    """The rows of slices with ``min_obs`` rows at least, and those slices with ``n_obs``."""
    enough = rows.groupBy(*slices).agg(F.count("*").alias("n_obs")).where(F.col("n_obs") >= min_obs)
    return rows.join(enough.drop("n_obs"), slices, "left_semi"), enough


def top_features(indices: DataFrame, n: int) -> DataFrame:
    """Features with the largest mean index."""
    return indices.groupBy("feature").agg(F.avg("hsic_mean").alias("mean_index")).orderBy(
        F.desc("mean_index"), "feature"
    ).limit(n)


def warm_start(df: DataFrame, entity: str, period: str, category: str, numeric: Sequence[str],
               categorical: Sequence[str], targets: Sequence[str], top_n: int = 10, cheap_boot: int = 10,
               n_boot: int = 100, boot_size: int = 400, min_obs: int = 100, seed: int = 42) -> DataFrame:
    """Cheap ranking run, then a precise run on the best numeric and all categorical features.

    The requested ``top_n`` is honoured.
    """
    features = [*numeric, *categorical]
    slices, columns = [period, "crop_name"], [*features, *targets]
    incomplete = reduce(Column.__or__, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in columns])
    # Both runs read one table; where no row lacks a value they see the same rows, hence the same bandwidths.
    one, seen = materialize_counted(_entity_rows(df, entity, period, category, features, targets), gaps=F.count_if(F.coalesce(incomplete, F.lit(False))))
    sigmas = None if seen["gaps"] else materialize(bandwidths(_large_slices(one, slices, min_obs)[0], slices, columns))

    def run(used: list[str], boots: int) -> DataFrame:
        rows = materialize(one.na.drop(subset=[*used, *targets])) if seen["gaps"] else one
        kept, enough = _large_slices(rows, slices, min_obs)
        return hsic_indices(kept, entity, used, targets, slices, boots, boot_size, seed, written=True, sigmas=sigmas).join(enough, slices)

    ranked = top_features(run(features, cheap_boot).where(F.col("feature").isin(list(numeric))), top_n)
    best = [r["feature"] for r in ranked.collect()]  # at most top_n names
    return run([*best, *categorical], n_boot)


# --- rank correlation ------------------------------------------------------

def spearman(df: DataFrame, features: Sequence[str], targets: Sequence[str], min_pairs: int = 10) -> DataFrame:
    """Spearman rho and its square per (feature, target) over all complete pairs.

    Where no column has a missing value each variable is ranked once for all its
    pairs; otherwise every pair is ranked over its own complete rows.
    """
    columns = list(dict.fromkeys([*features, *targets]))
    rows, seen = materialize_counted(
        df.select(*[F.col(c).cast("double").alias(c) for c in columns]),
        missing=F.count_if(sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) > 0))
    ranked = _spearman_pairwise if seen["missing"] else _spearman_complete
    out = ranked(rows, features, targets).where(F.col("n") >= min_pairs)
    return out.select(
        "feature", "target", "n", F.round("rho", 4).alias("spearman_r"), F.round(F.col("rho") * F.col("rho"), 4).alias("spearman_r2"))


def _spearman_complete(rows: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """One rank table per variable (value -> centred rank), then all correlations in one aggregate."""
    columns = list(dict.fromkeys([*features, *targets]))
    steps = ranks.cumulate(unpivot(rows, [], columns), ["variable"], "value")
    # The rank minus its mean, so large tables lose no precision in the products.
    centred = materialize(steps.select(
        "variable", "value", (F.col("n_below") + (F.col("n") + 1) / 2 - (F.col("n_total") + 1) / 2).alias("r")))
    for c in columns:
        one = centred.where(F.col("variable") == c).select(F.col("value").alias(c), F.col("r").alias(f"_r_{c}"))
        rows = rows.join(one, c)
    pairs = [(f, t) for f in features for t in targets]
    products = {tuple(sorted((a, b))) for f, t in pairs for a, b in ((f, t), (f, f), (t, t))}
    names = {p: f"_p{i}" for i, p in enumerate(sorted(products))}
    sums = rows.agg(F.count("*").alias("n"), *[
        F.sum(F.col(f"_r_{a}") * F.col(f"_r_{b}")).alias(n) for (a, b), n in names.items()])

    def total(a: str, b: str):
        return F.col(names[tuple(sorted((a, b)))])

    return sums.select(F.explode(F.array(*[
        F.struct(
            F.lit(f).alias("feature"), F.lit(t).alias("target"), F.col("n"),
            F.when((total(f, f) > 0) & (total(t, t) > 0), total(f, t) / F.sqrt(total(f, f) * total(t, t))).alias("rho"))
        for f, t in pairs])).alias("s")).select("s.*")


def _spearman_pairwise(rows: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Rows collapse to distinct (x, y) per pair with counts before the two ranks are joined."""
    pairs = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(t).alias("target"), F.col(f).alias("x"), F.col(t).alias("y"))
        for f in features for t in targets
    ])
    group = ["feature", "target"]
    cells = materialize(rows.select(F.explode(pairs).alias("s")).select("s.*").where(
        F.col("x").isNotNull() & F.col("y").isNotNull()
    ).groupBy(*group, "x", "y").agg(F.count("*").alias("c")))
    return _rank_correlation(cells, group)


def _rank_correlation(cells: DataFrame, group: list[str]) -> DataFrame:
    """(group, n, rho) from distinct (x, y) with their counts c."""
    weight = {"n": F.col("c")}
    centred = F.col("n_below") + (F.col("n") + 1) / 2 - (F.col("n_total") + 1) / 2
    rx = ranks.cumulate(cells, group, "x", weight).select(*group, "x", centred.alias("rx"))
    ry = ranks.cumulate(cells, group, "y", weight).select(*group, "y", centred.alias("ry"))
    joined = cells.join(rx, [*group, "x"]).join(ry, [*group, "y"])
    dx, dy, c = F.col("rx"), F.col("ry"), F.col("c")
    sums = joined.groupBy(*group).agg(
        F.sum(c * dx * dy).alias("xy"), F.sum(c * dx * dx).alias("xx"), F.sum(c * dy * dy).alias("yy"), F.sum("c").alias("n"))
    rho = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    return sums.select(*group, "n", rho.alias("rho"))


def spearman_by(df: DataFrame, groups: Sequence[str], x: str, y: str, min_pairs: int = 10) -> DataFrame:
    """(groups, n, rho) of one pair of columns over the complete rows of each group."""
    cells = materialize(df.select(*groups, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop(subset=["x", "y"])
                        .groupBy(*groups, "x", "y").agg(F.count("*").alias("c")))
    return _rank_correlation(cells, list(groups)).where(F.col("n") >= min_pairs)


def rank_concordance(compared: DataFrame) -> DataFrame:
    """Per target: rank agreement over features of the index with the squared correlation.

    A target has one row per feature, a number fixed by the schema.
    """
    def rank(c: str):
        w = Window.partitionBy("target")
        below = F.rank().over(w.orderBy(F.desc(c)))
        ties = F.count("*").over(Window.partitionBy("target", c))
        return below + (ties - 1) / 2

    return compared.withColumns({"_a": rank("hsic"), "_b": rank("spearman_r2")}).groupBy("target").agg(
        F.when(F.count("*") >= 3, F.corr("_a", "_b")).alias("concordance"), F.count("*").alias("n_features")
    )


def validate_against_spearman(df: DataFrame, key: str, features: Sequence[str], targets: Sequence[str],
                              sample_size: int = 400, seed: int = 42) -> DataFrame:
    """Index next to squared rank correlation on one uniform sample; each pair over its own complete rows."""
    sample = bootstrap_samples(df, [], key, 1, sample_size, seed)
    sample = materialize(sample)
    sigmas = bandwidths(sample, [], list(dict.fromkeys([*features, *targets])))
    index = hsic_values(sample, sigmas, [], features, targets).select(
        "feature", "target", F.round("hsic", 4).alias("hsic"))
    return spearman(sample, features, targets).join(index, ["feature", "target"]).withColumn(
        "ratio_hsic_over_r2", F.round(F.col("hsic") / F.greatest(F.col("spearman_r2"), F.lit(1e-6)), 2)
    )


