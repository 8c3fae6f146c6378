"""Exact attribution of boosted trees: Shapley values of every feature for every row, by the path weights of flat trees.

A leaf adds v * prod(o_j) * prod(z_k) to the expectation of a tree over a known set S of features, j in S and k not: o_j says whether the row follows
the path at all its nodes on feature j, z_k is the share of training rows that does. The Shapley values of a leaf with d features therefore
depend on the row only by the d bits o, so the recursion over subset sizes runs once per leaf and bit pattern; rows look their pattern up,
whole batches at a time. All leaves of a tree depend on the sides that a row takes at its inner nodes, so their sum is kept by these sides, and a row
costs one look at each node and one sum per tree.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.models.boosting import Model, Tree, _matrix


def path_weights(shares: list[float]) -> np.ndarray:
    """Shapley values [pattern, feature] of a leaf of value 1 with ``shares`` z; bit i of a pattern says that the row follows feature i.

    The coefficients of prod(z_j + o_j y) over the other features count the subsets by size; weights k!(d-1-k)!/d! sum them up.
    """
    d = len(shares)
    follows = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
    weight = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
    out = np.zeros((1 << d, d))
    for i in range(d):
        sizes = np.zeros((1 << d, d))
        sizes[:, 0] = 1
        for j in range(d):
            if j != i:
                grown = sizes * shares[j]
                grown[:, 1:] += sizes[:, :-1] * follows[:, j, None]
                sizes = grown
        out[:, i] = (follows[:, i] - shares[i]) * (sizes @ weight)
    return out


class _Leaf:
    """Features on the way to a leaf, the (node, side) steps of each, and its table of values."""

    def __init__(self, value: float, steps: list[tuple[int, int, bool, float]]) -> None:
        by_feature: dict[int, list[tuple[int, bool]]] = {}
        share: dict[int, float] = {}
        for feature, node, left, part in steps:
            by_feature.setdefault(feature, []).append((node, left))
            share[feature] = share.get(feature, 1.0) * part
        self.features = list(by_feature)
        self.steps = list(by_feature.values())
        self.expected = value * float(np.prod(list(share.values()))) if share else value
        self.table = value * path_weights(list(share.values()))


def leaves_of(tree: Tree) -> list[_Leaf]:
    out, open_ = [], [(0, [])]
    while open_:
        node, steps = open_.pop()
        if tree.feature[node] < 0:
            out.append(_Leaf(tree.value[node], steps))
            continue
        for child, left in ((tree.left[node], True), (tree.right[node], False)):
            part = tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.5
            open_.append((child, [*steps, (tree.feature[node], node, left, part)]))
    return out


#: Inner nodes up to which the values of a tree are kept by the sides taken at them (depth 4 has 15).
SIDES = 16


class _Sums:
    """Values of one tree by the sides taken at its inner nodes, worked out when a combination is first seen."""

    def __init__(self, tree: Tree) -> None:
        self.tree, self.leaves = tree, leaves_of(tree)
        self.inner = [k for k, f in enumerate(tree.feature) if f >= 0]
        self.features = sorted({tree.feature[k] for k in self.inner})
        self.expected = sum(leaf.expected for leaf in self.leaves)
        self.place = np.full(1 << len(self.inner), -1, np.int32) if len(self.inner) <= SIDES else None
        self.known = np.empty((0, len(self.features)))

    def sides(self, bins: np.ndarray) -> list[np.ndarray]:
        """Whether each row of ``bins`` [feature, row] goes left, by inner node."""
        out = []
        for k in self.inner:
            b = bins[self.tree.feature[k]]
            # Bin 0 (missing) is below every bin; one less makes it the highest.
            out.append(b <= self.tree.bin[k] if self.tree.null_left[k] else b - np.uint8(1) < self.tree.bin[k])
        return out

    def worked_out(self, sides: list[np.ndarray], n: int) -> np.ndarray:
        goes, out = dict(zip(self.inner, sides)), np.zeros((n, len(self.features)))
        for leaf in self.leaves:
            if not leaf.features:
                continue
            pattern = np.zeros(n, np.int64)
            for i, steps in enumerate(leaf.steps):
                follows = np.ones(n, bool)
                for node, left in steps:
                    follows &= goes[node] == left
                pattern |= follows.astype(np.int64) << i
            out[:, np.searchsorted(self.features, leaf.features)] += leaf.table[pattern]
        return out

    def values(self, bins: np.ndarray) -> np.ndarray:
        """Attributions [row, feature of the tree]."""
        sides = self.sides(bins)
        if self.place is None:
            return self.worked_out(sides, bins.shape[1])
        code = np.zeros(bins.shape[1], np.int32)
        for i, side in enumerate(sides):
            code |= side.astype(np.int32) << np.int32(i)
        at = self.place.take(code)
        if (at < 0).any():
            new = np.unique(code[at < 0])
            self.place[new] = len(self.known) + np.arange(len(new))
            self.known = np.concatenate([self.known, self.worked_out([(new >> i & 1).astype(bool) for i in range(len(sides))], len(new))])
            at = self.place.take(code)
        return self.known.take(at, 0)


class Explainer:
    """Tables of all leaves of a model; ``base`` is its expectation over the training rows as the trees saw them."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.trees = [_Sums(t) for t in model.trees]
        self.base = model.base + sum(t.expected for t in self.trees)

    def values(self, x: np.ndarray) -> np.ndarray:
        """Attributions [row, feature]; with ``base`` they add up to the model's score."""
        bins, out = np.ascontiguousarray(self.model.bins(x).T), np.zeros((len(self.model.features), len(x)))
        for tree in self.trees:
            if tree.features:
                out[tree.features] += tree.values(bins).T
        return out.T


def attribute(models: Mapping[object, Model] | Model, df: DataFrame, key: str | None = None, prefix: str = "attr_") -> DataFrame:
    """``df`` with one column ``attr_<feature>`` per feature of any model, and ``attr_base``.

    Values are those of the raw score: of the prediction for the squared loss, of the log odds for the logistic one. A row whose model does not
    exist has NULLs; a feature its model does not use has 0.
    """
    models = {"": models} if isinstance(models, Model) else models
    wanted = sorted({f for m in models.values() for f in m.features})
    place = {f: i for i, f in enumerate(wanted)}
    sent = df.sparkSession.sparkContext.broadcast({str(k): m for k, m in models.items()})
    made: dict[str, Explainer] = {}  # filled once by a worker

    @F.pandas_udf(", ".join(f"a{i} double" for i in range(len(wanted) + 1)))
    def explain(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = np.full((len(part), len(wanted) + 1), np.nan, order="F")
            position = pd.Series(range(len(part)), part.index)
            for name, at in part.groupby("_key").groups.items():
                if name not in sent.value:
                    continue
                own = made.setdefault(name, None) or Explainer(sent.value[name])
                made[name] = own
                rows = position[at].to_numpy()
                out[rows] = 0.0
                out[np.ix_(rows, [place[f] for f in own.model.features])] = own.values(_matrix(own.model, part.loc[at]))
                out[rows, -1] = own.base
            yield pd.DataFrame(out, index=part.index, columns=[f"a{i}" for i in range(len(wanted) + 1)], copy=False)

    name = F.col(key).cast("string") if key else F.lit(str(next(iter(models))))
    columns = [(F.col(f"`{f}`").cast("double") if f in df.columns else F.lit(None).cast("double")).alias(f) for f in wanted]
    found = df.withColumn("_attributed", explain(F.struct(name.alias("_key"), *columns)))
    value = [F.nanvl(F.col("_attributed")[f"a{i}"], F.lit(None)) for i in range(len(wanted) + 1)]
    return found.withColumns({f"{prefix}{f}": value[i] for f, i in place.items()} | {f"{prefix}base": value[-1]}).drop("_attributed")
