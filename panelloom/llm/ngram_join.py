"""N-gram Jaccard join: several global orders filter the candidates, exact sets verify them.

A document's set holds its distinct n-word shingles (the whole sequence when it has fewer words). If two sets of sizes a and b reach
the threshold t they share at least ceil(t * a) shingles, so under ANY global order of shingles they share one among the first
a - ceil(t * a) + 1 of each. Orders put shingles with rare words first; each order takes word rarity from its own counting sketch
and breaks ties by its own hash. A pair is a candidate if it shares a posting under the first order, and it stays one only if its prefixes
overlap as much as the threshold demands under every order.

Equal sets are one class before the join. Postings held by one class only are dropped. Then two star rounds compare the members of
each posting with its hub (first the member with the least of its own, then another) and contract what they link, so that large groups
of near copies become one component without their pairs being formed. The pairs of one posting that still lie in different components
are then found by what sets them apart from the first hub c: x and y of sizes a and b reach t only if x ^ y, which is
(x ^ c) ^ (y ^ c), holds at most (1 - t) / (1 + t) * (a + b) shingles. As c was compared with both, the differences x ^ c and y ^ c must then
overlap, and a crowd of texts that are alike but below the threshold shares few of them: no pairs are formed on what the whole crowd has in
common. Members unlike their hub are paired by the posting itself. Links inside a component are therefore not all listed, but no two
components that a link joins stay apart.

Whole sets are made again from the texts where two of them are compared: a set of hashes takes several times the room of its text, on disk and
in a shuffle. Texts are moved once, for classes that share a posting, and again only for pairs that the prefixes leave. Prefixes are dealt by
ranges of tokens one after another, and tables are dropped when the next is written, so that the disk holds a part of the postings at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.llm.common import byte_slices, in_blocks, list_array, utf8
from panelloom.llm.components import connected_components
from panelloom.llm.hashing import U, mix, runs_of, word_hashes
from panelloom.session import broadcast_if_small, drop_written, materialize, materialize_at, materialize_counted, scratch_path, settle

#: Counters in each word sketch: the most that is broadcast, whatever the corpus.
SKETCH = 1 << 20
ORDERS = 2
#: Ranges of tokens that are dealt one after another; each moves that share of the prefixes.
PASSES = 4
#: Parts in which the texts of the asked classes are fetched, one after another.
FETCHES = 2
#: Bits of the filter of asked ids: 16 an id up to this many (16 MB); beyond, it lets more texts through that a join then drops.
FILTER_BITS = 1 << 27


def _seed(k: int) -> np.uint64:
    return U((0xA0761D6478BD642F * (2 * k + 1)) % (1 << 64))


def word_sketches(docs: DataFrame, orders: int = ORDERS, size: int = SKETCH) -> list[np.ndarray]:
    """Per order, log2 of the corpus count of the words in each of ``size`` hashed cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((orders, size), np.int64)
        for batch in byte_slices(batches):
            texts = utf8(batch.column("text"))
            for i, j in in_blocks(texts):
                words, _ = word_hashes(texts[i:j])
                for k in range(orders):
                    cells[k] += np.bincount((mix(words ^ _seed(k)) % U(size)).astype(np.int64), minlength=size)
        for k in range(orders):
            for at in range(0, size, 1 << 14):  # dense slices: 64 rows an order and task
                yield pa.RecordBatch.from_pydict({"part": pa.array([k * size + at], pa.int64()), "cells": pa.array([cells[k, at : at + (1 << 14)].astype("<i8").tobytes()])})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
                held[part] = held.get(part, 0) + np.frombuffer(cells, "<i8")
        for part, cells in held.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "cells": pa.array([np.log2(cells + 1).astype(np.uint8).tobytes()])})

    partial = docs.select("text").mapInArrow(run, "part long, cells binary")
    parts = partial.repartition("part").mapInArrow(total, "part long, cells binary").collect()  # orders * size bytes
    out = np.zeros(orders * size, np.uint8)
    for r in parts:
        out[r["part"] : r["part"] + (1 << 14)] = np.frombuffer(r["cells"], np.uint8)
    return list(out.reshape(orders, size))


def _sets(texts: list[bytes], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text its distinct shingle hashes (sorted), where each occurs first, and its word hashes."""
    for i, j in in_blocks(texts):
        words, begins = word_hashes(texts[i:j])
        for a, b in zip(begins[:-1], begins[1:]):
            own = words[a:b]
            runs = runs_of(own, n if len(own) >= n else max(len(own), 1))
            yield *np.unique(runs, return_index=True), own


def _prefix(found: np.ndarray, first: np.ndarray, words: np.ndarray, n: int, threshold: int, sketch: np.ndarray, k: int) -> np.ndarray:
    """The shingles of one set that come first under order ``k``."""
    count = len(found)
    if not count:
        return np.empty(0, np.int64)
    keep = count - -(-threshold * count // 100) + 1
    rare = sketch[(mix(words ^ _seed(k)) % U(len(sketch))).astype(np.int64)]
    width = min(n, len(words))
    least = rare[: len(words) - width + 1]
    for s in range(1, width):
        least = np.minimum(least, rare[s : len(words) - width + 1 + s])
    key = (least[first].astype(U) << U(56)) | (mix(found ^ _seed(k + 17)) >> U(8))
    return found[np.argpartition(key, keep - 1)[:keep]].view(np.int64)


def signatures(docs: DataFrame, n: int, threshold: int, sketch: np.ndarray) -> DataFrame:
    """Per row: doc_id, text_md5, size of its set, digest of the set, and its prefix under the first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            texts = utf8(batch.column("text"))
            size, digest, prefix = [], [], []
            for found, first, words in _sets(texts, n):
                size.append(len(found))
                digest.append(hashlib.md5(found.tobytes()).digest() if len(found) else None)
                prefix.append(_prefix(found, first, words, n, threshold, sketch, 0))
            md5 = [hashlib.md5(t).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(md5, pa.binary()), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), list_array(prefix, pa.int64())],
                ["doc_id", "text_md5", "n_shingles", "digest", "p0"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text_md5 binary, n_shingles long, digest binary, p0 array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, n: int, threshold: int, orders: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold: prefix overlap under every order first, whole sets after it.

    Each table of prefixes or texts is cut down to the classes that are still in a pair before it is joined.
    """
    # Sets that reach t share at least t / (1 + t) of their sizes' sum, and outside the prefixes lie at most ceil(t * size) - 1 of the larger set.
    need = F.ceil((F.col("na") + F.col("nb")) * threshold / (100.0 + threshold) - 1e-6)
    beyond = F.ceil(F.greatest("na", "nb") * threshold / 100.0 - 1e-9) - 1
    least = F.greatest(F.lit(1), need - beyond)
    near = pairs
    for k in range(orders):
        sides = [_only(sets.select(F.col("node").alias(x), F.col(f"p{k}").alias(f"{x}{k}")), near, x) for x in "ab"]
        met = near.join(sides[0], "a").join(sides[1], "b").where(F.size(F.array_intersect(f"a{k}", f"b{k}")) >= least)
        near = materialize(met.select("a", "b", "na", "nb"))

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= threshold * (len(x) + len(y) - both)

    def judge(batch: pa.RecordBatch, own: Callable[[str], list[np.ndarray]]) -> pa.RecordBatch:
        hit = [linked(x, y) for x, y in zip(own("text_a"), own("text_b"))]
        return batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    out = materialize(_compared(near.select("a", "b"), sets, "a", "b", n, judge, "a long, b long"))
    settle(pairs.sparkSession)
    return out


def _compared(pairs: DataFrame, sets: DataFrame, a: str, b: str, n: int, judge: Callable, schema: str) -> DataFrame:
    """``judge(batch, sets by text column)`` on the pairs, which gain the texts of both sides as text_a and text_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text_b", 1 << 20):
            sides = {c: utf8(batch.column(c)) for c in ("text_a", "text_b")}
            texts = list(dict.fromkeys(sides["text_a"] + sides["text_b"]))  # a hub stands in many rows
            made = {t: found for t, (found, _, _) in zip(texts, _sets(texts, n))}
            yield judge(batch, lambda c: [made[t] for t in sides[c]])

    sides = [_only(sets.select(F.col("node").alias(x), F.col("text").alias(t)), pairs, x) for x, t in ((b, "text_b"), (a, "text_a"))]
    return pairs.join(sides[0], b).join(sides[1], a).mapInArrow(run, schema)


def _only(table: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Rows of ``table`` whose ``side`` stands in a pair; the ids are broadcast if they are few."""
    ids = materialize(pairs.select(side).distinct())
    return table.join(broadcast_if_small(ids, 1_000_000), side, "left_semi")


def jaccard_components(docs: DataFrame, n: int = 5, threshold: int = 80, orders: int = ORDERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id linked), kept, text_md5.

    ``threshold`` is in percent. Texts without words have an empty set and a component of their own; rows that repeat an id and a
    text share one. ``kept`` marks the rows that carry the smallest (doc_id, text_md5) of their component; equal rows are all marked.
    """
    spark = docs.sparkSession
    sketches = word_sketches(docs, orders)
    settle(spark)
    paths = {name: scratch_path(spark, name) for name in ("parsed", "rows", "classes", "shared", "postings", "sets", "near")}
    parsed = materialize_at(signatures(docs, n, threshold, sketches[0]).withColumn("row", F.monotonically_increasing_id()), paths["parsed"])
    with_set = parsed.where("digest is not null")
    first = with_set.groupBy("digest").agg(F.min("row").alias("row"))
    # Prefixes move by row number, once and for one row of a class only.
    classes = materialize_at(with_set.join(first.select("row"), "row").select(F.col("row").alias("node"), "doc_id", "text_md5", "n_shingles", "p0"), paths["classes"])
    rows = materialize_at(parsed.drop("p0"), paths["rows"])
    _drop(spark, paths["parsed"])

    each = classes.select("node", F.explode("p0").alias("token"))
    held = F.count(F.lit(1)).over(Window.partitionBy("token"))
    for k in range(PASSES):
        part = each.where(F.pmod("token", F.lit(PASSES)) == k).withColumn("held", held).where("held > 1").select("token", "node")
        part.write.mode("append").parquet(paths["shared"])
        settle(spark)
    shared = spark.read.schema("token long, node long").parquet(paths["shared"])
    # "away": share of the prefix that no other class holds; hubs are the members nearest to the rest of their posting.
    away = 1 - F.count(F.lit(1)).over(Window.partitionBy("node")) / F.col("width")
    sized = classes.select("node", "n_shingles", F.size("p0").alias("width"))
    postings = materialize_at(shared.join(sized, "node").select("node", "n_shingles", "token", away.alias("away")), paths["postings"])
    _drop(spark, paths["shared"])

    # Texts and prefixes under all orders, only for classes that share a posting.
    asked = materialize(classes.select("node", "doc_id", "text_md5").join(postings.select("node").distinct(), "node"))
    _drop(spark, paths["classes"])
    for k in range(FETCHES):
        part = _fetch(docs, asked.where(F.pmod("node", F.lit(FETCHES)) == k), n, threshold, sketches)
        part.write.mode("append").parquet(paths["sets"], compression="zstd")
        settle(spark)
    sets = spark.read.schema(part.schema).parquet(paths["sets"])

    labels, links = None, []
    for pick in (F.min(F.struct("away", "node", "n_shingles", "component")), F.max(F.struct("component", "node", "n_shingles"))):
        held = _labelled(postings, labels)
        hub = held.groupBy("token").agg(pick.alias("hub"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").drop("lo", "hi")
        pairs = held.join(hub, "token").where("component <> hub.component").select(F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("hub.n_shingles").alias("na"), F.col("n_shingles").alias("nb"))
        links.append(_verified(_sized(pairs, threshold), sets, n, threshold, orders))
        labels = connected_components(reduce(DataFrame.unionByName, links), "a", "b")
    links.append(_verified(_open_pairs(_labelled(postings, labels), sets, n, threshold, paths["near"]), sets, n, threshold, orders))
    labels = connected_components(reduce(DataFrame.unionByName, links), "a", "b")

    named = rows.where("digest is not null").groupBy("digest").agg(F.min("row").alias("node")).join(labels, "node", "left")
    named = materialize(named.select("digest", F.coalesce("component", "node").alias("component")))
    for name in ("postings", "sets", "near"):
        drop_written(spark, paths[name])
    settle(spark)
    rows = rows.join(named, "digest", "left").withColumn("component", F.coalesce("component", "row"))
    first = rows.groupBy("component").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_md5"))).alias("least"), F.min("text_md5").alias("any"))
    joined = rows.join(first, "component")
    kept = F.coalesce((F.col("doc_id") == F.col("least.doc_id")) & (F.col("text_md5") == F.col("least.text_md5")), F.col("least").isNull() & (F.col("text_md5") == F.col("any")), F.lit(False))
    return joined.select("doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), kept.alias("kept"), "text_md5")


def _drop(spark: SparkSession, path: str) -> None:
    drop_written(spark, path)
    settle(spark)


def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return postings.withColumn("component", F.col("node"))
    return postings.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _open_pairs(held: DataFrame, sets: DataFrame, n: int, threshold: int, path: str) -> DataFrame:
    """Candidate pairs (a, b, na, nb) of one posting that lie in different components; its first hub was compared with all others before.

    Differences to the hubs are written to ``path``, by ranges of hubs one after another.
    """
    hub = held.groupBy("token").agg(F.min(F.struct("away", "node", "n_shingles")).alias("hub"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    hub = hub.select("token", F.col("hub.node").alias("c"), F.col("hub.n_shingles").alias("nc"))
    held = held.join(hub, "token").where("node <> c").select("token", "node", "component", "n_shingles", "c", "nc")
    # A posting is open only if its members besides the hub lie in different components.
    still = held.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    held = materialize(held.join(still, "token", "left_semi"))

    # Differences to the hub, for members of which at least a third is shared with it.
    around = held.where("2 * least(n_shingles, nc) >= greatest(n_shingles, nc)").select("c", "node", "component", "n_shingles").distinct()
    around = materialize(around)

    def judge(batch: pa.RecordBatch, own: Callable[[str], list[np.ndarray]]) -> pa.RecordBatch:
        apart = [(np.setxor1d(x, y, assume_unique=True), len(x) + len(y)) for x, y in zip(own("text_a"), own("text_b"))]
        near = [2 * len(d) <= both for d, both in apart]
        kept = batch.select(["c", "node", "component", "n_shingles"]).filter(pa.array(near, pa.bool_()))
        return pa.RecordBatch.from_arrays([*kept.columns, list_array([d.view(np.int64) for (d, _), x in zip(apart, near) if x], pa.int64())], [*kept.schema.names, "apart"])

    schema = "c long, node long, component long, n_shingles long, apart array<long>"
    for k in range(PASSES):
        part = materialize(around.where(F.pmod(F.xxhash64("c"), F.lit(PASSES)) == k))
        _compared(part, sets, "c", "node", n, judge, schema).write.mode("append").parquet(path)
        settle(sets.sparkSession)
    near = sets.sparkSession.read.schema(schema).parquet(path)

    words = near.select("c", F.explode("apart").alias("token"), "node", "component", "n_shingles", F.size("apart").alias("d"))
    df = words.groupBy("c", "token").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").drop("lo", "hi")
    own = Window.partitionBy("c", "node")
    # "left": shared tokens of the difference from this one on, rarest first; a pair's first common token leaves room for its whole overlap.
    placed = words.join(df, ["c", "token"]).withColumn("left", F.count(F.lit(1)).over(own) - F.row_number().over(own.orderBy("df", "token")) + 1)
    t = threshold
    placed = materialize(placed.where(t * F.col("left") >= t * F.col("d") - F.col("n_shingles") * (100 - t)).select("c", "token", "node", "component", "n_shingles", "d", "left"))
    x, y = _renamed(placed, ["node", "component", "n_shingles", "d", "left"], "c", "token")
    room = 2 * (100 + t) * F.least("left_a", "left_b") >= (100 + t) * (F.col("d_a") + F.col("d_b")) - (100 - t) * (F.col("n_shingles_a") + F.col("n_shingles_b"))
    alike = (F.col("component_a") != F.col("component_b")) & (F.col("node_a") < F.col("node_b")) & (100 * F.least("n_shingles_a", "n_shingles_b") >= t * F.greatest("n_shingles_a", "n_shingles_b"))
    met = x.join(y, (F.col("c_a") == F.col("c_b")) & (F.col("token_a") == F.col("token_b")) & alike & room)
    crowd = met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("n_shingles_a").alias("na"), F.col("n_shingles_b").alias("nb"))

    marked = held.join(near.select("c", "node", F.lit(True).alias("near")), ["c", "node"], "left").select("token", "node", "component", "n_shingles", F.coalesce("near", F.lit(False)).alias("near"))
    x, y = _renamed(materialize(marked), ["node", "component", "n_shingles", "near"], "token")
    rest = x.join(y, (F.col("token_a") == F.col("token_b")) & alike & ~(F.col("near_a") & F.col("near_b"))).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("n_shingles_a").alias("na"), F.col("n_shingles_b").alias("nb"))
    return materialize(crowd.distinct().unionByName(rest.distinct()).distinct())


def _renamed(df: DataFrame, columns: list[str], *keys: str) -> list[DataFrame]:
    return [df.select(*[F.col(c).alias(f"{c}_{side}") for c in (*keys, *columns)]) for side in "ab"]


def _sized(pairs: DataFrame, threshold: int) -> DataFrame:
    return materialize(pairs.where(100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb")).select("a", "b", "na", "nb").distinct())


def _fetch(docs: DataFrame, asked: DataFrame, n: int, threshold: int, sketches: list[np.ndarray]) -> DataFrame:
    """(node, text, p0, p1, ...) of the asked classes, the prefixes recomputed from the texts."""
    names = ["node", "text", *(f"p{k}" for k in range(len(sketches)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            lists: list[list[np.ndarray]] = [[] for _ in sketches]
            for found, first, words in _sets(utf8(batch.column("text")), n):
                for k, sketch in enumerate(sketches):
                    lists[k].append(_prefix(found, first, words, n, threshold, sketch, k))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("text"), *(list_array(x, pa.int64()) for x in lists)], names)

    # A class is asked for by one (doc_id, text), so rows that repeat it are dropped where the join has brought them together.
    own = _maybe_asked(docs, asked).select(_row_key(F.col("doc_id"), F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))).alias("key"), "text")
    met = own.join(asked.select("node", _row_key(F.col("doc_id"), F.col("text_md5")).alias("key")), "key").dropDuplicates(["key"]).select("node", "text")
    schema = "node long, text string, " + ", ".join(f"{c} array<long>" for c in names[2:])
    return met.mapInArrow(run, schema)


def _maybe_asked(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """All rows of ``docs`` whose doc_id is asked for, and few others: a Bloom filter spares most other texts the shuffle."""
    size = 1 << 10
    wanted = min(16 * asked.count(), FILTER_BITS)
    while size < wanted:
        size *= 2
    places = lambda doc_id: [F.pmod(F.xxhash64(doc_id, F.lit(k)), F.lit(size)) for k in range(4)]
    at = asked.select(F.explode(F.array(*places(F.col("doc_id")))).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 8).alias("byte")).agg(F.expr("bit_or(1 << cast(at % 8 as int))").alias("bits")).toArrow()
    bits = np.zeros(size // 8, np.uint8)
    bits[words.column("byte").to_numpy()] = words.column("bits").to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    @F.arrow_udf("boolean")
    def maybe(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        filled, hit = np.frombuffer(held.value, np.uint8), True
        for x in (a, b, c, d):
            place = x.to_numpy(zero_copy_only=False)
            hit = hit & ((filled[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
        return pa.array(hit.astype(bool))

    return docs.select("doc_id", "text").where(maybe(*places(F.col("doc_id"))))


def _row_key(doc_id: Column, text_md5: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")).cast("binary"), F.lit(":").cast("binary"), text_md5))


def keep_one(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """One document of each group, with its own columns: the smallest doc_id, and of equal rows a single one."""
    found = jaccard_components(docs, n, threshold).where("kept").groupBy("doc_id", "text_md5").agg(F.count(F.lit(1)).alias("copies"))
    kept, _ = materialize_counted(found.select(F.col("doc_id").alias("_pl_id"), F.col("text_md5").alias("_pl_md5"), (F.col("copies") > 1).alias("_pl_many")))
    given = docs.withColumn("_pl_own", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    met = given.join(kept, given["doc_id"].eqNullSafe(kept["_pl_id"]) & (given["_pl_own"] == kept["_pl_md5"]))
    single = met.where("not _pl_many").select(*docs.columns)
    return single.unionByName(met.where("_pl_many").dropDuplicates(["_pl_id", "_pl_md5"]).select(*docs.columns))
