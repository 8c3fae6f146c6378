"""Exact centroid clustering (Lloyd's rounds in integers) with ns-bounds.

A vector keeps, for every centroid, its distance at the round in which that distance was last computed. The driver keeps the history of
all centroids, so the distance now lies within the norm of that centroid's TOTAL displacement since that round: one norm of one sum, not the
sum of the rounds' drifts, which is never smaller. A centroid whose lower bound exceeds the upper bound of the vector's own
centroid cannot be nearer; only the others are computed again, in exact integers, and their bounds start anew.

A round is one pass over a written table (vector, own centroid, distances, rounds) that writes the next one; its tasks also give the
componentwise sums of their clusters, which Spark adds up. What comes to the driver is k x dimensions sums. The table of the round before is
dropped once the next is written, so two copies exist at most and a lost executor costs its tasks of one round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.session import drop_written, materialize_at, scratch_path

SCALE = 1024
#: Integer components beyond this are held at it, so that squared distances and sums stay in 64 bits.
BOUND = 1 << 26
#: Relative allowance for the rounding of bounds.
SLACK = 1e-9


def kept_vectors(vectors: DataFrame, width: int) -> DataFrame:
    """vec_id and the integer components (little-endian 32-bit) of vectors with exactly ``width`` finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            at = [i for i, n in enumerate(pa.compute.list_value_length(column).to_pylist()) if n == width]
            if not at:
                continue
            values = column.take(pa.array(at)).flatten()
            x = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, width)
            good = np.isfinite(x).all(1)
            with np.errstate(over="ignore"):
                q = np.floor(SCALE * x[good]).clip(-BOUND, BOUND).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(np.array(at)[good], pa.int64())), pa.array([r.tobytes() for r in q], pa.binary())], ["vec_id", "q"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, q binary")


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of the rows of ``q`` to the rows of ``c``, pair by pair."""
    d = q - c
    return np.einsum("ij,ij->i", d, d)


def assign(q: np.ndarray, own: np.ndarray, far: np.ndarray, when: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, int]:
    """New own centroid of each vector under the last entry of ``history``; ``far`` and ``when`` are brought up to date in place.

    ``far[i, j]`` is the exact squared distance of vector i to ``history[when[i, j], j]``; ``own`` is -1 before the first round.
    Also returns how many distances were computed. Ties go to the smaller centroid.
    """
    now, k = len(history) - 1, history.shape[1]
    rows = np.arange(len(q))
    # moved[t, j]: norm of the displacement of centroid j from round t to now
    gap = (history[-1][None] - history).astype(float)
    moved = np.sqrt((gap * gap).sum(2))
    computed = 0

    def compute(mask: np.ndarray) -> None:
        nonlocal computed
        i, j = np.nonzero(mask)
        far[i, j], when[i, j] = squared(q[i], history[-1, j]), now
        computed += len(i)

    if (own < 0).any():
        compute(np.broadcast_to((own < 0)[:, None], far.shape))
        own = np.where(own < 0, 0, own)
    away = moved[when, np.arange(k)[None]]
    held = np.sqrt(far.astype(float))
    low = held - away - SLACK * (held + away)
    high = (held + away + SLACK * (held + away))[rows, own]
    others = np.arange(k)[None] != own[:, None]
    fails = (others & (low <= high[:, None])).any(1)
    # Failures: first the own centroid exactly, then every other centroid that may still be as near.
    mask = np.zeros(far.shape, bool)
    mask[rows[fails], own[fails]] = when[rows[fails], own[fails]] < now
    compute(mask)
    exact = np.sqrt(far[rows, own].astype(float)) * (1 + SLACK)
    mask = fails[:, None] & others & (low <= exact[:, None]) & (when < now)
    compute(mask)
    candidates = np.where((when == now) & fails[:, None], far, np.iinfo(np.int64).max)
    return np.where(fails, candidates.argmin(1), own), computed


_STATE = "vec_id {kind}, q binary, own int, far binary, seen binary, part binary"


def _advance(batches: Iterator[pa.RecordBatch], history: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
    k, width = history.shape[1:]
    sums, counts, computed = np.zeros((k, width), np.int64), np.zeros(k, np.int64), 0
    names = ["vec_id", "q", "own", "far", "seen", "part"]
    kind = None
    for batch in batches:
        kind = batch.schema.field("vec_id").type
        n = batch.num_rows
        if not n:
            continue
        q = np.frombuffer(b"".join(batch.column("q").to_pylist()), "<i4").reshape(n, width).astype(np.int64)
        if len(history) == 1:
            own, far, when = np.full(n, -1), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
        else:
            own = batch.column("own").to_numpy().astype(np.int64)
            far = np.frombuffer(b"".join(batch.column("far").to_pylist()), "<i8").reshape(n, k).copy()
            when = np.frombuffer(b"".join(batch.column("seen").to_pylist()), "<u2").reshape(n, k).astype(np.int64)
        own, work = assign(q, own, far, when, history)
        computed += work
        if last:
            far[np.arange(n), own] = squared(q, history[-1, own])
        else:
            for j in range(k):
                mine = q[own == j]
                sums[j] += mine.sum(0)
                counts[j] += len(mine)
        yield pa.RecordBatch.from_arrays([
            batch.column("vec_id"), batch.column("q"), pa.array(own.astype(np.int32)), pa.array([r.tobytes() for r in far.astype("<i8")], pa.binary()),
            pa.array([r.tobytes() for r in when.astype("<u2")], pa.binary()), pa.nulls(n, pa.binary()),
        ], names)
    if kind is not None:  # the task's sums, counts and number of distances, in a row of its own
        part = np.concatenate([sums.ravel(), counts, [computed]]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([-1], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([part], pa.binary())], names)


def _totals(written: DataFrame, entries: int) -> np.ndarray:
    """Sum of the tasks' parts: ``entries`` whole numbers, added up place by place on Spark."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(entries, np.int64)
        for batch in batches:
            for part in batch.column("part").to_pylist():
                total += np.frombuffer(part, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(entries)), pa.array(total)], ["place", "value"])

    rows = written.where("part is not null").select("part").mapInArrow(unpack, "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(entries, np.int64)
    for r in rows:
        out[r["place"]] = r["value"]
    return out


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k kept vectors with the smallest sha256 of ``seed:vec_id``, in that order; equal ids by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()
    return np.array([np.frombuffer(r["q"], "<i4") for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, seed: int = 3, work: list | None = None) -> DataFrame:
    """One row per kept row of ``vectors``: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors of another width, null vectors and vectors with null or non-finite components are left out; rows that repeat an id are rows of
    their own. Components are floor(1024 * x), held within +-2^26. With fewer than k vectors there are fewer centroids, with none no
    rows. Empty clusters keep their centroid. ``work`` gets the number of distances computed in each round.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    at = scratch_path(spark, "vectors")
    kept = materialize_at(kept_vectors(vectors, width), at)
    history = first_centroids(kept, k, seed)
    k = len(history)
    if not k:
        drop_written(spark, at)
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    history, table = history[None], kept
    for step in range(rounds + 1):
        last = step == rounds
        sent = history

        def advance(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            return _advance(batches, sent, last)

        before, at = at, scratch_path(spark, "clusters")
        rows = table if step == 0 else table.where("part is null")
        table = materialize_at(rows.mapInArrow(advance, _STATE.format(kind=kind)), at)
        totals = _totals(table, k * width + k + 1)
        drop_written(spark, before)
        if work is not None:
            work.append(int(totals[-1]))
        if not last:
            sums, counts = totals[: k * width].reshape(k, width), totals[k * width : -1]
            new = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], history[-1])  # // rounds down
            history = np.concatenate([history, new[None]])

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = np.frombuffer(b"".join(batch.column("far").to_pylist()), "<i8").reshape(batch.num_rows, k)
                own = batch.column("own").to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("own"), pa.array(far[np.arange(len(own)), own])], ["vec_id", "cluster", "distance"])

    out = table.where("part is null").select("vec_id", "own", "far").mapInArrow(distances, f"vec_id {kind}, cluster int, distance long")
    inertia = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in history[-1]]
    facts = spark.createDataFrame([(j, inertia.get(j, 0), sum(inertia.values()), digests[j]) for j in range(k)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clustering_sql(k: int = 8, rounds: int = 10, width: int = 64, seed: int = 3) -> str:
    """The same rows in DuckDB SQL, one chain of expressions per round."""
    parts = [f"""q as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as q from embeddings
        where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {width})""",
             f"c0 as materialized (select cast(row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as int) as j, q as c from q order by sha256('{seed}:' || vec_id) limit {k})"]
    for t in range(rounds + 1):
        parts.append(f"""a{t} as materialized (select r, arg_min(j, d * {k} + j) as j, min(d) as d from
            (select r, j, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from q, c{t}) group by r)""")
        if t < rounds:
            parts.append(f"""s{t} as (select a.j, i, sum(q.q[i]) as s, count(*) as n from a{t} a join q using (r), range(1, {width + 1}) g(i) group by a.j, i)""")
            parts.append(f"""c{t + 1} as materialized (select c.j, coalesce(m.c, c.c) as c from c{t} c left join
                (select j, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as c from s{t} group by j) m using (j))""")
    return f"""with {", ".join(parts)}
        select vec_id, a.j as cluster, d as distance, cast(sum(d) over (partition by a.j) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
        sha256(array_to_string(c.c, ',')) as centroid_sha256 from a{rounds} a join q using (r) join c{rounds} c on c.j = a.j"""
