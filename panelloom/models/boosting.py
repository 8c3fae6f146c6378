"""Gradient-boosted trees with a branch for missing values, for many models at once.

All models of a call grow together: one Spark job per tree level. Its tasks add up gradient histograms by (model, node, feature, bin) over the
rows they hold, the histograms meet by (model, node, slice of features), and every meeting place returns the best split it has seen. What
comes to the driver is a few rows per open node. A missing value has a bin of its own and goes to the side where it helps most, so nothing is
imputed. Models may share a dataset and leave out one of its folds each, which makes cross-validation and a search one set of jobs too.

Rows are binned once and written in blocks of some thousand rows, so that tasks work on long arrays; every few trees (every tree on large tables, unless
very many models grow) the scores so far are written beside them and the former table is dropped. How often does not change the scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.session import drop_written, materialize, materialize_at, scratch_path, spread

#: Bins of a feature besides the one for missing values.
BINS = 64
SLOTS = BINS + 1
#: Features whose histograms travel together.
SLICE = 16
#: Trees between two writings of the scores where all models together see fewer than ``SMALL`` rows; beyond, scores are written after every tree.
REFRESH, SMALL = 8, 500_000
#: Models of a dataset beyond which scores are not written after every tree, whatever the rows: adding up the trees since is cheaper than moving so many scores.
WIDE = 32
#: Rows and bytes of a block at most, rows times models a file should hold at least, and bytes it should hold at most.
BLOCK_ROWS, BLOCK_BYTES, FILE_WORK, FILE_BYTES = 16_384, 8 << 20, 1 << 16, 48 << 20
#: Bytes after which the writer of blocks lets go of what it holds.
GROUP_BYTES = 2 * BLOCK_BYTES
_NAMES = ["model", "node", "feature", "bin", "null_left", "gain", "gl", "hl", "nl", "gr", "hr", "nr"]


@dataclass(frozen=True)
class Boost:
    trees: int = 30
    depth: int = 5
    step: float = 0.1
    ridge: float = 1.0
    lasso: float = 0.0
    least_rows: int = 5
    subsample: float = 1.0
    columns: float = 1.0
    loss: str = "squared"  # or "logistic"
    seed: int = 42


@dataclass
class Job:
    """A model to fit: rows of dataset ``data`` outside fold ``held``."""

    name: object
    data: str
    features: Sequence[str]
    options: Boost = field(default_factory=Boost)
    held: int | None = None


@dataclass
class Tree:
    """Flat arrays by node; ``feature`` is -1 at a leaf. Values up to ``cut`` (bins up to ``bin``) go left."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    null_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for name, x in (("feature", -1), ("bin", 0), ("null_left", False), ("left", 0), ("right", 0), ("value", value), ("cover", cover), ("gain", 0.0)):
            getattr(self, name).append(x)
        return len(self.feature) - 1

    def steps(self) -> tuple[np.ndarray, np.ndarray, int]:
        """(feature, next node by node and bin, depth); a leaf leads to itself."""
        feature, nexts, depth = np.array(self.feature), np.empty((len(self.feature), SLOTS), np.int64), np.zeros(len(self.feature), int)
        for i, f in enumerate(self.feature):  # children come after their parent
            if f < 0:
                nexts[i] = i
                continue
            nexts[i, : self.bin[i] + 1], nexts[i, self.bin[i] + 1 :] = self.left[i], self.right[i]
            nexts[i, 0] = self.left[i] if self.null_left[i] else self.right[i]
            depth[[self.left[i], self.right[i]]] = depth[i] + 1
        return np.maximum(feature, 0), nexts.ravel(), int(depth.max())

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Node in which each row of ``bins`` ends."""
        feature, nexts, depth = self.steps()
        n, width = bins.shape
        if not depth:
            return np.zeros(n, np.int64)
        by_column = not bins.flags.c_contiguous
        flat = np.ascontiguousarray(bins.T if by_column else bins).ravel()
        place = np.arange(n) if by_column else np.arange(n) * width
        node = nexts.take(bins[:, feature[0]])
        feature = feature * n if by_column else feature
        for _ in range(depth - 1):
            node = nexts.take(node * SLOTS + flat.take(feature.take(node) + place))
        return node


@dataclass
class Model:
    features: list[str]
    cuts: list[np.ndarray]
    base: float
    loss: str
    trees: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return to_bins(x, self.cuts)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Raw score of rows of feature values; NaN is missing."""
        return self.score_bins(self.bins(x))

    def score_bins(self, bins: np.ndarray) -> np.ndarray:
        """Raw score of rows that are binned already."""
        out = np.full(len(bins), self.base)
        for tree in self.trees:
            out += np.array(tree.value).take(tree.leaves(bins))
        return out


def to_bins(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """0 where a value is missing, else 1 + number of cuts below it."""
    out = np.zeros(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        seen = ~np.isnan(x[:, j])
        out[seen, j] = 1 + np.searchsorted(c, x[seen, j], side="left")
    return out


def _gradients(score: np.ndarray, label: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    if loss == "squared":
        return score - label, np.ones(len(label))
    p = 1 / (1 + np.exp(-score))
    return p - label, p * (1 - p)


def _weight(g, o: Boost):
    """Gradient after the lasso."""
    return np.sign(g) * np.maximum(np.abs(g) - o.lasso, 0)


def leaf_value(g: float, h: float, o: Boost) -> float:
    return float(-o.step * _weight(g, o) / (h + o.ridge)) if h + o.ridge > 0 else 0.0


def best_splits(hist: np.ndarray, o: Boost) -> list[tuple | None]:
    """(gain, bin, null_left, gl, hl, nl, gr, hr, nr) for each of several histograms [histogram, bin, (g, h, n)], or None.

    A split after the last bin parts the missing values from all others. Ties go to the smaller bin, then to missing values on the left.
    """
    total = hist.sum(1)[:, None]
    left = np.cumsum(hist[:, 1:], 1)  # up to each bin, without the missing ones
    out: list[tuple | None] = [None] * len(hist)
    for null_left in (True, False):
        own = left + hist[:, :1] if null_left else left
        rest = total - own
        ok = (own[..., 2] >= o.least_rows) & (rest[..., 2] >= o.least_rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = _weight(own[..., 0], o) ** 2 / (own[..., 1] + o.ridge) + _weight(rest[..., 0], o) ** 2 / (rest[..., 1] + o.ridge) - _weight(total[..., 0], o) ** 2 / (total[..., 1] + o.ridge)
        gain = np.where(ok & np.isfinite(gain), gain, -np.inf)
        best = gain.argmax(1)
        for i in np.flatnonzero(gain.max(1) > 0).tolist():
            k = int(best[i])
            if out[i] is None or gain[i, k] > out[i][0]:
                # Without missing values here, those that come later follow the larger side.
                side = null_left if hist[i, 0, 2] else bool(own[i, k, 2] >= rest[i, k, 2])
                out[i] = (float(gain[i, k]), k + 1, side, *map(float, own[i, k]), *map(float, rest[i, k]))
    return out


def feature_cuts(rows: DataFrame, features: Mapping[str, Sequence[str]], bins: int = BINS) -> dict[str, dict[str, np.ndarray]]:
    """Approximate quantiles that part each feature of each dataset into at most ``bins`` bins."""
    wanted = sorted({f for fs in features.values() for f in fs})
    probs = [i / bins for i in range(1, bins)]
    found = rows.groupBy("_data").agg(*[F.percentile_approx(F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None)), probs, 100 * bins).alias(f"c{i}") for i, f in enumerate(wanted)],
                                      *[F.max(F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None))).alias(f"m{i}") for i, f in enumerate(wanted)])
    out: dict[str, dict[str, np.ndarray]] = {}
    for r in found.collect():  # datasets x features x bins numbers
        out[r["_data"]] = {f: np.array([c for c in sorted(set(r[f"c{i}"] or [])) if c < r[f"m{i}"]], float) for i, f in enumerate(wanted) if f in features.get(r["_data"], ())}
    return out


def _chosen(rows: np.ndarray, o: Boost, tree: int) -> np.ndarray:
    """Rows drawn for a tree, by a hash of their number."""
    if o.subsample >= 1:
        return np.ones(len(rows), bool)
    x = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((o.seed * 1_000_003 + tree + 1) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(40)).astype(float) / (1 << 24) < o.subsample


def _columns(n: int, o: Boost, tree: int) -> np.ndarray:
    keep = max(1, math.ceil(o.columns * n))
    return np.arange(n) if keep >= n else np.sort(np.random.default_rng([o.seed, tree]).permutation(n)[:keep])


class _Grown:
    """What the tasks of a job need of one model."""

    def __init__(self, number: int, place: int, job: Job, data: int, base: float) -> None:
        self.number, self.place, self.held, self.o, self.data, self.base = number, place, job.held, job.options, data, base
        self.since: list[Tree] = []  # trees since the scores were written
        self.tree: Tree | None = None
        self.open: list[int] = []
        self.at = 0  # number of the tree that grows

    def sums(self, stored: np.ndarray | None, bins: np.ndarray) -> np.ndarray:
        """Scores without the base of the rows of ``bins``, of which ``stored`` are the written ones; the same bits however often they are written."""
        out = np.zeros(len(bins)) if stored is None else stored
        for tree in self.since:
            out = out + np.array(tree.value).take(tree.leaves(bins))
        return out


def fit(rows: DataFrame, jobs: Sequence[Job], label: str, data: str | None = None, fold: str | None = None) -> dict[object, Model]:
    """Fit all ``jobs`` on ``rows`` (columns: features, ``label``, optionally the dataset's name and the fold).

    Rows without a label are left out; a job without any row gets a model that says 0. Features are read as doubles, NaN counts as missing. A
    feature without two different values is never split on (but its missing values may be).
    """
    spark = rows.sparkSession
    features: dict[str, list[str]] = {}
    for job in jobs:
        features[job.data] = sorted({*features.get(job.data, []), *job.features})
    wanted = sorted({f for fs in features.values() for f in fs})
    datasets = sorted(features)
    given = rows.where(F.col(label).isNotNull()).select(
        (F.col(data) if data else F.lit(datasets[0])).cast("string").alias("_data"), (F.col(fold).cast("int") if fold else F.lit(0)).alias("_fold"),
        F.col(label).cast("double").alias("_label"), *[F.col(f"`{f}`").cast("double").alias(f) for f in wanted])
    given = given.where(F.col("_data").isin(datasets))
    cuts = feature_cuts(given, features)
    means = {(r["_data"], r["_fold"]): (r["s"], r["n"]) for r in given.groupBy("_data", "_fold").agg(F.sum("_label").alias("s"), F.count(F.lit(1)).alias("n")).collect()}
    grown, models, places = [], {}, {}
    for number, job in enumerate(jobs):
        parts = [v for (d, f), v in means.items() if d == job.data and (job.held is None or f != job.held)]
        total, n = sum(p[0] for p in parts), sum(p[1] for p in parts)
        mean = total / n if n else 0.0
        if job.options.loss == "logistic":
            mean = min(max(mean, 1e-6), 1 - 1e-6)
            mean = math.log(mean / (1 - mean)) if n else 0.0
        place = places[job.data] = places.get(job.data, -1) + 1
        grown.append(_Grown(number, place, job, datasets.index(job.data), mean))
        own = features[job.data]
        models[job.name] = Model(own, [cuts.get(job.data, {}).get(f, np.empty(0)) for f in own], mean, job.options.loss)
    used = [np.array([features[j.data].index(f) for f in j.features]) for j in jobs]
    at = scratch_path(spark, "boosted")
    rows_of = {d: sum(n for (of, _), (_, n) in means.items() if of == d) for d in datasets}
    row_bytes = {d: len(features[d]) + 8 * (places[d] + 1) + 20 for d in datasets}
    work = sum(n * (places[d] + 1) for d, n in rows_of.items())
    files = max(-(-sum(n * row_bytes[d] for d, n in rows_of.items()) // FILE_BYTES), min(-(-work // FILE_WORK), int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    state = materialize_at(_binned(given.repartition(files), datasets, features, cuts, row_bytes), at, compression="none", group_bytes=GROUP_BYTES)
    for tree in range(max((j.options.trees for j in jobs), default=0)):
        for g, job in zip(grown, jobs):
            g.tree, g.open, g.at = None, [], tree
            if tree < job.options.trees:
                g.tree = Tree()
                g.tree.add(0.0, 0.0)
                g.open = [0]
        for level in range(max(j.options.depth for j in jobs)):
            active = [g for g, job in zip(grown, jobs) if g.open and level < job.options.depth]
            if not active:
                break
            columns = {g.number: used[g.number][_columns(len(used[g.number]), g.o, tree)] for g in active}
            _grow(state, active, columns, grown)
        for g, job in zip(grown, jobs):
            if g.tree is not None:
                models[job.name].trees.append(g.tree)
                g.since.append(g.tree)
        growing = [g for g, job in zip(grown, jobs) if tree + 1 < job.options.trees]
        every = 1 if work >= SMALL and max(Counter(g.data for g in growing).values(), default=0) <= WIDE else REFRESH
        if growing and (tree + 1) % every == 0:
            before, at = at, scratch_path(spark, "boosted")
            # Only models that still grow have scores; rows whose models are all done are dropped.
            state = materialize_at(_rescored(state, growing), at, compression="none", group_bytes=GROUP_BYTES)
            drop_written(spark, before)
            for d in {g.data for g in growing}:
                for place, g in enumerate(g for g in growing if g.data == d):
                    g.place, g.since = place, []
    drop_written(spark, at)
    return models


#: A block of rows of one dataset: arrays of their folds, numbers and labels, bins by feature and scores without the base by model (empty at first).
_STATE = "data int, folds binary, rows binary, labels binary, bins binary, scores binary"
_KINDS = [pa.int32(), *[pa.binary()] * 5]


def _block(d: int, *arrays: np.ndarray) -> pa.RecordBatch:
    values = [d, *[np.ascontiguousarray(a).tobytes() for a in arrays]]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _KINDS)], ["data", "folds", "rows", "labels", "bins", "scores"])


def _binned(given: DataFrame, datasets: list[str], features: Mapping[str, list[str]], cuts: Mapping[str, Mapping[str, np.ndarray]], row_bytes: Mapping[str, int]) -> DataFrame:
    sizes = [max(256, min(BLOCK_ROWS, BLOCK_BYTES // row_bytes[d])) for d in datasets]

    def full(held: dict[int, list[tuple]], d: int, rest: bool) -> Iterator[pa.RecordBatch]:
        """Blocks of the rows held of a dataset; fewer rows than a block stay, unless ``rest``."""
        folds, rows, labels, bins = (np.concatenate(x, axis=-1) for x in zip(*held[d]))
        end = len(rows) if rest else len(rows) - len(rows) % sizes[d]
        for i in range(0, end, sizes[d]):
            part = slice(i, min(i + sizes[d], end))
            yield _block(d, folds[part], rows[part], labels[part], bins[:, part], np.empty(0))
        held[d] = [(folds[end:], rows[end:], labels[end:], bins[:, end:])] if end < len(rows) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            names = batch.column("_number").to_numpy()
            for d in np.unique(names).tolist():
                part = batch.filter(pa.array(names == d))
                own = features[datasets[d]]
                x = np.stack([part.column(f).to_numpy(zero_copy_only=False) for f in own], 1) if own else np.empty((part.num_rows, 0))
                bins = to_bins(x.astype(float), [cuts.get(datasets[d], {}).get(f, np.empty(0)) for f in own])
                # Rows of no fold are never held out.
                folds = part.column("_fold").fill_null(-1).to_numpy().astype(np.int32)
                held.setdefault(d, []).append((folds, part.column("_row").to_numpy(), part.column("_label").to_numpy(), bins.T))
                if sum(len(h[1]) for h in held[d]) >= sizes[d]:
                    yield from full(held, d, False)
        for d in held:
            if held[d]:
                yield from full(held, d, True)

    numbered = given.withColumn("_number", (F.array_position(F.array(*[F.lit(d) for d in datasets]), F.col("_data")) - 1).cast("int")).drop("_data")
    return numbered.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(run, _STATE)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(dataset, folds, row numbers, labels, bins by feature, scores by model without the base, None before they are first written) of each block."""
    for i, d in enumerate(batch.column("data").to_pylist()):
        folds, rows, labels, bins, scores = (
            np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in (("folds", "<i4"), ("rows", "<i8"), ("labels", "<f8"), ("bins", np.uint8), ("scores", "<f8")))
        n = len(rows)
        yield d, folds, rows, labels, bins.reshape(-1, n), scores.reshape(-1, n) if len(scores) else None


def _rescored(state: DataFrame, growing: list[_Grown]) -> DataFrame:
    """Blocks with the scores of the models ``growing``, in their order, in place of those that were written."""
    by_data: dict[int, list[_Grown]] = {}
    for g in growing:
        by_data.setdefault(g.data, []).append(g)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, folds, rows, labels, bins, stored in _parts(batch):
                if d in by_data:
                    new = [g.sums(None if stored is None else stored[g.place], bins.T) for g in by_data[d]]
                    yield _block(d, folds, rows, labels, bins, np.stack(new))

    return state.where(F.col("data").isin(list(by_data))).mapInArrow(run, _STATE)


def _grow(state: DataFrame, active: list[_Grown], columns: dict[int, np.ndarray], grown: list[_Grown]) -> None:
    """One level: split the open nodes of every active model where that gains."""
    options = {g.number: g.o for g in active}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {g.number: np.zeros((len(g.open), len(columns[g.number]), SLOTS, 3)) for g in active}
        slots = {g.number: np.full(len(g.tree.feature), -1) for g in active}
        for g in active:
            slots[g.number][g.open] = np.arange(len(g.open))
        seen = set()
        for batch in batches:
            for d, folds, rows, labels, bins, stored in _parts(batch):
                kept: dict[int | None, tuple[np.ndarray, np.ndarray, np.ndarray]] = {None: (np.arange(len(rows)), labels, bins)}
                for g in active:
                    if g.data != d:
                        continue
                    if g.held not in kept:
                        outside = np.flatnonzero(folds != g.held)
                        kept[g.held] = outside, labels[outside], bins.take(outside, 1)
                    at, label, b = kept[g.held]
                    node = slots[g.number].take(g.tree.leaves(b.T))
                    here = node >= 0
                    if g.o.subsample < 1:
                        here &= _chosen(rows[at], g.o, g.at)
                    if not here.all():
                        here = np.flatnonzero(here)
                        at, label, b, node = at[here], label[here], b.take(here, 1), node[here]
                    if not len(at):
                        continue
                    seen.add(g.number)
                    grad, hess = _gradients(g.base + g.sums(None if stored is None else stored[g.place].take(at), b.T), label, g.o.loss)
                    own, size, first = held[g.number], len(g.open) * SLOTS, node * SLOTS
                    for k, f in enumerate(columns[g.number].tolist()):
                        key = first + b[f]
                        n = np.bincount(key, minlength=size).reshape(-1, SLOTS)
                        own[:, k, :, 0] += np.bincount(key, grad, size).reshape(-1, SLOTS)
                        own[:, k, :, 1] += n if g.o.loss == "squared" else np.bincount(key, hess, size).reshape(-1, SLOTS)
                        own[:, k, :, 2] += n
        for m in sorted(seen):
            own = held[m]
            out = [(m, node, s, own[i, s : s + SLICE].tobytes()) for i, node in enumerate(next(g.open for g in active if g.number == m)) for s in range(0, own.shape[1], SLICE) if own[i, s, :, 2].any()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["model", "node", "slice", "hist"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            hists = batch.column("hist")
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("model", "node", "slice")))):
                hist = np.frombuffer(hists[i].as_buffer()).reshape(-1, SLOTS, 3)
                if key in held:
                    held[key] += hist
                else:
                    held[key] = hist.copy()  # the batch itself is not kept
        found: dict[tuple[int, int], tuple] = {}
        together: dict[tuple[int, int], list[int]] = {}
        for m, node, s in sorted(held):
            together.setdefault((m, s), []).append(node)
        for (m, s), nodes in together.items():
            # Some nodes at a time, so that the sums beside the histograms stay small.
            for i in range(0, len(nodes), 16):
                some = nodes[i : i + 16]
                hists = np.concatenate([held[m, node, s] for node in some])
                for j, split in enumerate(best_splits(hists, options[m])):
                    node, k = some[j * len(some) // len(hists)], j % (len(hists) // len(some))
                    if split and ((m, node) not in found or split[0] > found[m, node][1]):
                        found[m, node] = (int(columns[m][s + k]), *split)
        out = [(m, node, f, b, side, gain, *sums) for (m, node), (f, gain, b, side, *sums) in found.items()]
        if out:
            kinds = [pa.int32()] * 4 + [pa.bool_()] + [pa.float64()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], _NAMES)

    met = state.mapInArrow(partial, "model int, node int, slice int, hist binary").repartition("model", "node", "slice")
    schema = ", ".join(f"{c} {t}" for c, t in zip(_NAMES, ["int"] * 4 + ["boolean"] + ["double"] * 7))
    chosen: dict[tuple[int, int], tuple] = {}
    for r in met.mapInArrow(best, schema).collect():  # open nodes x shuffle partitions
        key, rank = (r["model"], r["node"]), (-r["gain"], r["feature"])
        if key not in chosen or rank < chosen[key][0]:
            chosen[key] = (rank, r)
    for g in active:
        nodes, g.open = g.open, []
        for node in nodes:
            if (g.number, node) not in chosen:
                continue
            r, tree = chosen[g.number, node][1], g.tree
            if node == 0:
                tree.cover[0] = r["nl"] + r["nr"]
            tree.feature[node], tree.bin[node], tree.null_left[node], tree.gain[node] = r["feature"], r["bin"], r["null_left"], r["gain"]
            tree.left[node] = tree.add(leaf_value(r["gl"], r["hl"], g.o), r["nl"])
            tree.right[node] = tree.add(leaf_value(r["gr"], r["hr"], g.o), r["nr"])
            g.open += [tree.left[node], tree.right[node]]


def _matrix(model: Model, part: pd.DataFrame) -> np.ndarray:
    return part[model.features].to_numpy(float) if model.features else np.empty((len(part), 0))


def score_column(models: Mapping[object, Model], df: DataFrame, key: str | None = None) -> Column:
    """Raw score of each row under the model named by its column ``key`` (or the only one); NULL without such a model."""
    wanted = sorted({f for m in models.values() for f in m.features})
    sent = df.sparkSession.sparkContext.broadcast({str(k): m for k, m in models.items()})

    place = {f: i for i, f in enumerate(wanted)}

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            codes, names = pd.factorize(part["_key"])
            x, out = part[wanted].to_numpy(float) if wanted else np.empty((len(part), 0)), np.full(len(part), np.nan)
            order = np.argsort(codes, kind="stable")
            ends = np.searchsorted(codes[order], np.arange(len(names) + 1))
            for name, i, j in zip(names, ends[:-1], ends[1:]):
                if name in sent.value:
                    model, at = sent.value[name], order[i:j]
                    out[at] = model.score(x[np.ix_(at, [place[f] for f in model.features])])
            yield pd.Series(out, index=part.index)

    name = F.col(key).cast("string") if key else F.lit(str(next(iter(models))))
    columns = [(F.col(f"`{f}`").cast("double") if f in df.columns else F.lit(None).cast("double")).alias(f) for f in wanted]
    return F.nanvl(score(F.struct(name.alias("_key"), *columns)), F.lit(None))


def predict(models: Mapping[object, Model] | Model, df: DataFrame, out: str = "predicted", key: str | None = None) -> DataFrame:
    """``df`` with the models' predictions: values, or probabilities for the logistic loss. Absent features count as missing."""
    models = {"": models} if isinstance(models, Model) else models
    score = score_column(models, df, key)
    losses = {m.loss for m in models.values()}
    if len(losses) > 1:
        raise ValueError("models of one call need one loss")
    return df.withColumn(out, 1 / (1 + F.exp(-score)) if losses == {"logistic"} else score)


def fold_metrics(models: Mapping[str, Model], held: Mapping[str, tuple[str, int]], rows: DataFrame, truth: str, fold: str, data: str | None = None,
                 train_scores: bool = True) -> DataFrame:
    """(model, n, r2_val, rmse, mae, and r2_train if asked for) of models that left out a fold each; ``held`` names the dataset and that fold by model.

    One pass over the rows: a task bins each row once, scores it with all models that ask for it and adds up the errors, so no row is copied by
    model. Only for the squared loss. A missing or non-finite label fails the job; rows of no fold count nowhere.
    """
    if {m.loss for m in models.values()} - {"squared"}:
        raise ValueError("only for the squared loss")
    wanted = sorted({f for m in models.values() for f in m.features})
    by_data: dict[str, list[str]] = {}
    for name in models:
        by_data.setdefault(held[name][0], []).append(name)
    sent = rows.sparkSession.sparkContext.broadcast(dict(models))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, bool], np.ndarray] = {}
        for batch in batches:
            names = batch.column("_data").to_numpy(zero_copy_only=False)
            folds = batch.column("_fold").to_numpy()
            for d in set(names) & set(by_data):
                own = np.flatnonzero(names == d)
                y, fold_of = batch.column("_truth").to_numpy(zero_copy_only=False)[own], folds[own]
                if not np.isfinite(y).all():
                    raise ValueError("non-finite label")
                made: dict[int, tuple[Model, np.ndarray]] = {}
                for name in by_data[d]:
                    m = sent.value[name]
                    # The models of one fit on a dataset share their cuts, hence their bins.
                    known = next((b for o, b in made.values() if o.features == m.features and all(np.array_equal(p, q) for p, q in zip(o.cuts, m.cuts))), None)
                    if known is None:
                        x = np.stack([batch.column(f).to_numpy(zero_copy_only=False)[own] for f in m.features], 1) if m.features else np.empty((len(own), 0))
                        known = np.ascontiguousarray(m.bins(x).T)
                        made[len(made)] = m, known
                    for val in (True, False) if train_scores else (True,):
                        at = np.flatnonzero((fold_of == held[name][1]) == val)
                        if not len(at):
                            continue
                        off = m.score_bins(known.take(at, 1).T) - y[at]
                        c = y[at] - m.base
                        new = np.array([len(at), (off * off).sum(), np.abs(off).sum(), c.sum(), (c * c).sum(), c.min(), c.max()])
                        old = sums.get((name, val))
                        sums[name, val] = new if old is None else np.concatenate([old[:5] + new[:5], [min(old[5], new[5]), max(old[6], new[6])]])
        if sums:
            keys, found = list(sums), np.array(list(sums.values()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), *(pa.array(found[:, i]) for i in range(7))], names_)

    names_ = ["model", "val", "n", "sq", "ab", "c", "cc", "lo", "hi"]
    given = rows.where(F.col(fold).isNotNull()).select(
        (F.col(data) if data else F.lit(next(iter(by_data)))).cast("string").alias("_data"), F.col(fold).cast("int").alias("_fold"), F.col(truth).cast("double").alias("_truth"),
        *[F.col(f"`{f}`").cast("double").alias(f) for f in wanted])
    parts = spread(given).mapInArrow(run, "model string, val boolean, " + ", ".join(f"{c} double" for c in names_[2:]))
    total = parts.groupBy("model", "val").agg(*[F.sum(c).alias(c) for c in names_[2:7]], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # Labels are summed without the model's base, so that their variance loses no digits.
    spread_of = F.col("cc") / F.col("n") - F.pow(F.col("c") / F.col("n"), 2)
    mse = F.col("sq") / F.col("n")
    total = total.select("model", "val", F.col("n").cast("long").alias("n"), F.when(F.col("lo") < F.col("hi"), 1 - F.try_divide(mse, spread_of)).alias("r2"), F.sqrt(mse).alias("rmse"), (F.col("ab") / F.col("n")).alias("mae"))
    total = materialize(total)
    val = total.where("val").select("model", "n", F.col("r2").alias("r2_val"), "rmse", "mae")
    return val.join(total.where("not val").select("model", F.col("r2").alias("r2_train")), "model") if train_scores else val


def swapped_errors(model: Model, paired: DataFrame, features: Sequence[str], truth: str, donor: str, log_target: bool = False) -> DataFrame:
    """(shuffled, rmse) of a model on rows in which the feature ``shuffled`` comes from the struct ``donor``; '' names the rows as they are.

    One pass over the rows, none is copied by feature: a task bins each row and its donor once, and only trees that split on the feature are asked
    again. A missing or non-finite truth fails the job.
    """
    sent = paired.sparkSession.sparkContext.broadcast(model)
    names = ["", *features]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, n, squares = sent.value, 0, np.zeros(len(names))
        values, used = [np.array(t.value) for t in m.trees], [set(t.feature) for t in m.trees]
        for batch in batches:
            y = batch.column("_truth").to_numpy(zero_copy_only=False)
            if not len(y):
                continue
            if not np.isfinite(y).all():
                raise ValueError("non-finite truth")
            bins, other = (np.ascontiguousarray(m.bins(np.stack([batch.column(f"{side}{i}").to_numpy(zero_copy_only=False) for i in range(len(m.features))], 1)).T)
                           if m.features else np.empty((0, len(y)), np.uint8) for side in "xd")
            n += len(y)
            parts = [v.take(t.leaves(bins.T)) for v, t in zip(values, m.trees)]
            for k, f in enumerate(names):
                j = m.features.index(f) if f in m.features else -2  # -1 marks leaves
                score = np.full(len(y), m.base)
                if j >= 0:
                    kept, bins[j] = bins[j].copy(), other[j]
                for part, v, t, u in zip(parts, values, m.trees, used):
                    score += v.take(t.leaves(bins.T)) if j in u else part
                if j >= 0:
                    bins[j] = kept
                off = (np.maximum(np.expm1(score), 0) if log_target else score) - y
                squares[k] += (off * off).sum()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), float(n))), pa.array(squares)], ["shuffled", "n", "sq"])

    columns = [c for i, f in enumerate(model.features) for c in (
        (F.col(f"`{f}`") if f in features else F.lit(None)).cast("double").alias(f"x{i}"), (F.col(f"{donor}.`{f}`") if f in features else F.lit(None)).cast("double").alias(f"d{i}"))]
    sums = paired.select(F.col(truth).cast("double").alias("_truth"), *columns).mapInArrow(run, "shuffled string, n double, sq double")
    return sums.groupBy("shuffled").agg(F.sqrt(F.sum("sq") / F.sum("n")).alias("rmse"))


def predict_side_by_side(models: Mapping[str, Model], df: DataFrame) -> DataFrame:
    """``df`` with a column for each of several models of the squared loss, all filled in one pass over the rows."""
    if {m.loss for m in models.values()} - {"squared"}:
        raise ValueError("only for the squared loss")
    names = list(models)
    wanted = sorted({f for m in models.values() for f in m.features})
    sent = df.sparkSession.sparkContext.broadcast(dict(models))

    @F.pandas_udf(", ".join(f"p{i} double" for i in range(len(names))))
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({f"p{i}": sent.value[v].score(_matrix(sent.value[v], part)) for i, v in enumerate(names)})

    columns = [(F.col(f"`{f}`").cast("double") if f in df.columns else F.lit(None).cast("double")).alias(f) for f in wanted]
    scored = df.withColumn("_scores", score(F.struct(*(columns or [F.lit(0.0).alias("_none")]))))
    return scored.withColumns({v: F.nanvl(F.col("_scores")[f"p{i}"], F.lit(None)) for i, v in enumerate(names)}).drop("_scores")


def predict_by_year(models: Mapping[str, Model], df: DataFrame, yearly: Sequence[str], temporal: Sequence[str], n_years: int) -> DataFrame:
    """``df`` with an array of yearly values for each of several models of the squared loss, as ``predict_side_by_side`` gives them on a row per year.

    ``yearly`` columns are arrays of ``n_years`` values, ``temporal`` features are the year itself, from 1; all others hold for every year and are
    binned once a row.
    """
    if {m.loss for m in models.values()} - {"squared"}:
        raise ValueError("only for the squared loss")
    names = list(models)
    wanted = sorted({f for m in models.values() for f in m.features if f in df.columns and f not in temporal})
    sent = df.sparkSession.sparkContext.broadcast(dict(models))
    years, some = np.arange(1.0, n_years + 1), 1024

    def binned(m: Model, part: pd.DataFrame) -> np.ndarray:
        bins = np.zeros((len(m.features), len(part) * n_years), np.uint8)
        for j, (f, cuts) in enumerate(zip(m.features, m.cuts)):
            if f in temporal:
                bins[j] = np.tile(to_bins(years[:, None], [cuts])[:, 0], len(part))
            elif f in yearly:
                bins[j] = to_bins(np.concatenate(part[f].to_numpy()).astype(float)[:, None], [cuts])[:, 0]
            elif f in wanted:
                bins[j] = np.repeat(to_bins(part[f].to_numpy(float)[:, None], [cuts])[:, 0], n_years)
        return bins

    @F.pandas_udf(", ".join(f"p{i} array<double>" for i in range(len(names))))
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found: list[list[np.ndarray]] = [[] for _ in names]
            for a in range(0, len(part), some):
                own = part.iloc[a : a + some]
                for out, v in zip(found, names):
                    out.extend(sent.value[v].score_bins(binned(sent.value[v], own).T).reshape(-1, n_years))
            yield pd.DataFrame({f"p{i}": pd.Series(out, dtype=object) for i, out in enumerate(found)})

    columns = [F.col(f"`{f}`").cast("array<double>" if f in yearly else "double").alias(f) for f in wanted]
    scored = df.withColumn("_scores", score(F.struct(*(columns or [F.lit(0.0).alias("_none")]))))
    return scored.withColumns({v: F.col("_scores")[f"p{i}"] for i, v in enumerate(names)}).drop("_scores")


def importances(models: Mapping[object, Model], spark) -> DataFrame:
    """(model, feature, importance): share of the gain of all splits; 0 for features never used."""
    rows = []
    for name, model in models.items():
        gain = np.zeros(len(model.features))
        for tree in model.trees:
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    gain[f] += g
        rows += [(str(name), f, float(x)) for f, x in zip(model.features, gain / (gain.sum() or 1.0))]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def forest(o: Boost, trees: int) -> Boost:
    """Options of a bagged forest in this frame: independent trees, each a job of its own, averaged afterwards by ``average``."""
    return replace(o, trees=1, step=1.0, ridge=0.0, subsample=0.63, columns=max(o.columns / 3, 1 / 3), seed=o.seed + 101 * trees)


def average(models: Sequence[Model]) -> Model:
    """One model that says the mean of several of one dataset."""
    out = Model(models[0].features, models[0].cuts, sum(m.base for m in models) / len(models), models[0].loss)
    for m in models:
        for tree in m.trees:
            out.trees.append(replace(tree, value=[v / len(models) for v in tree.value]))
    return out
