"""Embedding near-duplicates by lattice hashing.

Every vector is scaled to unit length and projected, per table, onto random orthonormal directions, 8 for each of one or more codes; each scaled
projection is decoded to its nearest point of the lattice E8, and the points of a table together name a cell. The more vectors one label has, the more
codes a cell's name takes, so that the number of cells grows with the vectors and a cell holds a bounded number of unrelated ones. A
vector is stored in its own cell and probes the cells next in distance, lattice neighbours of its points. Vectors that meet in a cell of their label are verified by cosine in double precision. Cells are cut into blocks, so that a crowded cell
becomes many tasks; a block pair returns link counts and spanning links only, never the pairs themselves. A pair is counted in the
first table in which it meets, which both sides' cell lists decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.components import connected_components
from panelloom.llm.hashing import U, mix
from panelloom.session import materialize

TABLES = 4
#: Neighbours of each lattice point that are probed, and cells probed per table at most.
PROBES, MOST_CELLS = 3, 16
#: Width of a lattice cell relative to the distance of two unit vectors at the threshold, after projection.
WIDTH = 3.0
#: Share of unrelated vectors that a probed lattice point is reckoned to hold, and vectors of one label for which one code is enough.
SHARE, ENOUGH = 0.004, 4096
#: Vectors per block of a cell.
BLOCK = 512
#: Rows per bucket of block pairs, on average.
BUCKET_ROWS = 20_000


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 for each row, doubled so that it is whole: the better of D8 and D8 shifted by one half."""

    def d8(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        odd = np.flatnonzero(near.sum(1).astype(np.int64) % 2)
        if len(odd):
            gap = y[odd] - near[odd]
            worst = np.abs(gap).argmax(1)
            near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
        return near

    whole, half = d8(x), d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.rint(2 * np.where(closer[:, None], whole, half)).astype(np.int64)


def _minimal() -> np.ndarray:
    """The 240 shortest vectors of E8, by their rule: (+-1, +-1, 0, ...) in all places, and halves with an even number of minus signs."""
    pairs = [s * np.eye(8)[i] + t * np.eye(8)[j] for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)]
    signs = np.array([[1 if k >> b & 1 == 0 else -1 for b in range(8)] for k in range(256)])
    return np.concatenate([pairs, signs[(signs < 0).sum(1) % 2 == 0] / 2])


def codes_for(vectors: int) -> int:
    """Codes in a cell's name for so many vectors of one label: one more whenever a cell would hold ``ENOUGH`` times ``SHARE`` unrelated ones."""
    return 1 + max(0, int(np.ceil(np.log(max(1, vectors / ENOUGH)) / -np.log(SHARE))))


def cells(vectors: np.ndarray, tables: int, probes: int, threshold: float, codes: int = 1, seed: int = 7) -> np.ndarray:
    """Cell keys [vector, table, cell]: the own cell, then the cells probed, by distance."""
    n, width = vectors.shape
    rng, around = np.random.default_rng(seed), _minimal()
    # Dimensions below 8 keep all of them and leave the rest of the lattice point at 0.
    scale = WIDTH * np.sqrt(2 - 2 * threshold) * np.sqrt(min(8, width) / width)
    weights = mix(np.arange(1, 9).astype(U)) | U(1)
    most = min(MOST_CELLS, (1 + probes) ** codes)
    out = np.empty((n, tables, most), np.int64)
    for t in range(tables):
        keys, apart = np.full((n, 1), t, U), np.zeros((n, 1))
        for _ in range(codes):
            basis = np.linalg.qr(rng.standard_normal((width, min(8, width))))[0]
            x = np.zeros((n, 8))
            x[:, : basis.shape[1]] = vectors @ basis / scale
            x += rng.random(8)
            own = decode_e8(x)
            rest = x - own / 2
            # |rest - m|^2 = |rest|^2 + 2 - 2 rest.m for every minimal vector m
            close = rest @ around.T
            order = np.argsort(-close, axis=1, kind="stable")[:, :probes]
            points = np.concatenate([own[:, None], own[:, None] + np.rint(2 * around[order]).astype(np.int64)], 1)
            code = mix((points.astype(U) * weights).sum(2, dtype=U))
            more = np.concatenate([np.zeros((n, 1)), 2 - 2 * np.take_along_axis(close, order, 1)], 1)
            keys = mix(keys[:, :, None] * U(0x9E3779B97F4A7C15) + code[:, None, :]).reshape(n, -1)
            apart = (apart[:, :, None] + more[:, None, :]).reshape(n, -1)
            # The own cell costs nothing, so it stays first.
            best = np.argsort(apart, axis=1, kind="stable")[:, :MOST_CELLS]
            keys, apart = np.take_along_axis(keys, best, 1), np.take_along_axis(apart, best, 1)
        out[:, t] = keys.view(np.int64)
    return out


def prepare(vectors: DataFrame, tables: int, probes: int, threshold: float, codes: int = 1) -> DataFrame:
    """Usable vectors as node, label, unit vector (doubles as bytes), cells. Null, zero, empty or non-finite ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_width: dict[int, list[int]] = {}
            values = batch.column("embedding").to_pylist()
            for i, v in enumerate(values):
                if v and None not in v:
                    by_width.setdefault(len(v), []).append(i)
            for at in by_width.values():
                x = np.array([values[i] for i in at], float)
                big = np.abs(x).max(1, keepdims=True)
                good = np.isfinite(x).all(1) & (big[:, 0] > 0)
                at, x = np.array(at)[good], x[good] / big[good]
                x = x / np.sqrt((x * x).sum(1, keepdims=True))
                keys = cells(x, tables, probes, threshold, codes).reshape(len(x), -1)
                yield pa.RecordBatch.from_arrays([
                    batch.column("node").take(pa.array(at)), batch.column("label").take(pa.array(at)),
                    pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in keys], pa.binary()),
                ], ["node", "label", "unit", "cells"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("node", "label", "embedding").mapInArrow(run, f"node long, label {kind}, unit binary, cells binary")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, tables: int = TABLES, probes: int = PROBES
) -> DataFrame:
    """Per row vec_id, n_links, component_id, kept (vec_id = component_id), for links of cosine ``threshold`` within a label.

    Equal vectors of a label are compared once and count as links of each other. Rows that cannot be compared link with nothing;
    rows of one vec_id are rows of their own, and component_id is the smallest vec_id of the component.
    """
    rows = materialize(vectors.select("vec_id", "label", "embedding").withColumn("row", F.monotonically_increasing_id()))
    equal = rows.where("label is not null and embedding is not null").groupBy("label", "embedding").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(equal)
    largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    codes = codes_for(largest)
    each = min(MOST_CELLS, (1 + probes) ** codes)
    units = materialize(prepare(classes, tables, probes, threshold, codes).join(classes.select("node", "copies"), "node"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.int64).reshape(batch.num_rows, -1)
            many = keys.shape[1]
            at = pa.array(np.repeat(np.arange(batch.num_rows), many))
            place = np.tile(np.arange(many), batch.num_rows)
            yield pa.RecordBatch.from_arrays([
                batch.column("node").take(at), batch.column("label").take(at), pa.array(keys.ravel()),
                pa.array((place // each).astype(np.int32)), pa.array(place % each == 0),
            ], ["node", "label", "cell", "tab", "own"])

    kind = units.schema["label"].dataType.simpleString()
    entries = units.select("node", "label", "cells").mapInArrow(spread, f"node long, label {kind}, cell long, tab int, own boolean")
    place = ["label", "tab", "cell"]
    met = entries.groupBy(*place).agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("own").cast("long")).alias("stored"))
    met = materialize(met.where("all > 1 and stored > 0"))
    held = materialize(entries.join(met, place))
    # Blocks: stored vectors and visitors each cut by a hash; every visitor block meets every stored block of its cell.
    blocks = F.ceil(F.col("stored") / BLOCK).cast("int")
    stored = held.where("own").select(*place, "node", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), "all", "stored", F.lit(True).alias("own"))
    visits = held.select(*place, "node", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "all", "stored", F.lit(False).alias("own"))
    visits = visits.withColumn("part", F.pmod(F.xxhash64("node", "tab"), F.ceil(F.col("all") / (4 * BLOCK)).cast("int")).cast("int"))
    parts = F.ceil(F.col("all") / (4 * BLOCK)).cast("int")
    stored = stored.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    group = ["lab", "tab", "cell", "block", "part"]
    columns = [F.xxhash64("label").alias("lab"), "tab", "cell", "block", "part", "node", "own"]
    both = stored.select(*columns).unionByName(visits.select(*columns))
    # Whole groups share a bucket, so that small ones are verified many at a time.
    buckets = max(12, held.count() // BUCKET_ROWS)
    joined = both.join(units.select("node", "unit", "cells", "copies"), "node").withColumn("bucket", F.pmod(F.xxhash64(*group), F.lit(buckets)))

    def verify(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(group, ignore_index=True)
        keys = part[group].to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1), [True]]))
        found = [f for a, b in zip(cuts, cuts[1:]) if b - a > 1 for f in _links(part.iloc[a:b], threshold, tables, each)]
        if not found:
            return pd.DataFrame({"node": [], "n": [], "to": []}).astype("int64")
        node, n, to = (np.concatenate(x) for x in zip(*found))
        counts = pd.DataFrame({"node": node, "n": n}).groupby("node", as_index=False)["n"].sum()
        counts["to"] = counts["node"]
        tree = _spanning(node, to)
        return pd.concat([counts, pd.DataFrame({"node": tree[0], "n": 0, "to": tree[1]})]).astype("int64")

    links = materialize(joined.groupBy("bucket").applyInPandas(verify, "node long, n long, to long"))
    labels = connected_components(links, "node", "to")
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    per_class = classes.join(labels, "node", "left").join(counts, "node", "left").select("node", "label", "embedding", "copies", F.coalesce("component", "node").alias("component"), F.coalesce("n", F.lit(0)).alias("n"))
    good = units.select("node").withColumn("usable", F.lit(True))
    per_class = per_class.join(good, "node", "left").drop("node")
    joined = rows.join(per_class, ["label", "embedding"], "left")
    usable = F.coalesce("usable", F.lit(False))
    joined = joined.select("vec_id", F.when(usable, F.col("n") + F.col("copies") - 1).otherwise(0).alias("n_links"), F.when(usable, F.col("component")).otherwise(F.col("row")).alias("component"))
    least = joined.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return joined.join(least, "component").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _links(part: pd.DataFrame, threshold: float, tables: int, each: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(node, copies of the other end, other end) for both ends of every link between a visiting and a stored vector of one block pair."""
    own, tab, sizes = part["own"].to_numpy(), int(part["tab"].iloc[0]), part["unit"].map(len).to_numpy()
    for size in np.unique(sizes):  # vectors of other widths never link
        a, b = part[own & (sizes == size)], part[~own & (sizes == size)]
        if not len(a) or not len(b):
            continue
        ka, kb = (np.frombuffer(b"".join(x["cells"]), np.int64).reshape(len(x), tables, each) for x in (a, b))
        ua, ub = (np.frombuffer(b"".join(x["unit"])).reshape(len(x), -1) for x in (a, b))
        na, nb, ca, cb = a["node"].to_numpy(), b["node"].to_numpy(), a["copies"].to_numpy(), b["copies"].to_numpy()
        j, i = np.nonzero((ub @ ua.T >= threshold) & (nb[:, None] != na[None, :]))
        # Of a pair that meets twice in this table the visit of the larger node counts; a pair met in an earlier table counted there.
        first = (kb[j, tab] == ka[i, tab, :1]).any(1) & (~(ka[i, tab] == kb[j, tab, :1]).any(1) | (nb[j] > na[i]))
        for t in range(tab):
            first &= ~((kb[j, t] == ka[i, t, :1]).any(1) | (ka[i, t] == kb[j, t, :1]).any(1))
        j, i = j[first], i[first]
        if len(j):
            yield np.concatenate([nb[j], na[i]]), np.concatenate([ca[i], cb[j]]), np.concatenate([na[i], nb[j]])


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links node -> smallest node of its component, within these links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        before = label.copy()
        np.minimum.at(label, x, before[y])
        np.minimum.at(label, y, before[x])
        label = label[label]
        if (label == before).all():
            break
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]
