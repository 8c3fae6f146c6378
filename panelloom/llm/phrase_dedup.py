"""Removal of repeated byte strings by prefix-free parsing.

Hashes of a small rolling window pick triggers: the smallest hash among ``WINDOW`` consecutive starts, so a trigger depends on nearby bytes
only and one lies in the first ``WINDOW`` starts of every ``length``-byte string. Triggers cut a text into phrases; the dictionary
holds distinct phrases with their context, the parse is the sequence of triggers per text. Equal strings have their trigger at the same
place, hence the same dictionary entry, which narrows the work in three steps, each a count and a join over the whole corpus:

1. strings whose entry (``length - WINDOW`` bytes from the trigger) occurs once are unique;
2. strings of one trigger lie in one extended phrase; if that occurs again, all of them are repeated;
3. the strings of the remaining triggers, at the ends of repeats, are compared one by one within their entry, together with one
   representative of every repeated extended phrase of that entry.

Strings are judged to the depth of ``length`` bytes only, so dictionary and parse are grouped by 64-bit fingerprints where full suffix
arrays would sort them: the order beyond that depth decides nothing. Texts shorter than ``length`` have no strings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import list_array, map_batches, utf8
from panelloom.llm.hashing import U, mix, prefix_hash, span_hash
from panelloom.session import materialize

LENGTH = 200
#: Starts among which the trigger is chosen, and bytes of its rolling window.
WINDOW, GRAM = 80, 8
#: Bytes of one text parsed at a time; memory follows this, not the text.
PART = 1 << 20


def triggers(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first start, last start): every start of a ``length``-byte string belongs to one trigger, in order."""
    window = min(WINDOW, length // 2)
    starts = len(data) - length + 1
    if starts <= 0:
        return (np.empty(0, np.int64),) * 3
    need = starts + window - 1
    gram = min(GRAM, length - window)
    grams = np.zeros(need, U)
    for k in range(gram):
        grams = (grams << U(8)) | data[k : k + need].astype(U)
    hashes = grams * U(0x9E3779B97F4A7C15)
    hashes ^= hashes >> U(29)
    hashes *= U(0xBF58476D1CE4E5B9)
    low = U(0xFFFFFFFF)
    least = (hashes & ~low) | (low - np.arange(need, dtype=U))  # of equal hashes the last one wins
    wide = 1
    while 2 * wide <= window:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < window:
        least = np.minimum(least[:starts], least[window - wide : window - wide + starts])
    at = (low - (least[:starts] & low)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.concatenate([first[1:] - 1, [starts - 1]])


def parse(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entry hash, extended phrase hash, first start, last start) of every trigger; parts overlap so that none is lost or doubled."""
    out = []
    for begin in range(0, max(len(text) - length + 1, 0), PART):
        data = np.frombuffer(text, np.uint8, min(len(text) - begin, PART + length - 1), begin)
        at, first, last = triggers(data, length)
        prefix = prefix_hash(data)
        entry = span_hash(prefix, at, at + length - min(WINDOW, length // 2))
        out.append((entry, span_hash(prefix, first, last + length), first + begin, last + begin))
    if not out:
        return np.empty(0, U), np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def strings(text: bytes, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all strings of the given triggers."""
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)]) if len(first) else np.empty(0, np.int64)
    hashes = np.empty(len(starts), U)
    for begin in range(0, len(text), PART):
        here = (starts >= begin) & (starts < begin + PART)
        if here.any():
            data = np.frombuffer(text, np.uint8, min(len(text) - begin, PART + length - 1), begin)
            hashes[here] = span_hash(prefix_hash(data), starts[here] - begin, starts[here] - begin + length)
    return starts, hashes


def _md5(column: str = "text"):
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))


def _with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, md5, ...) with the text of its document."""
    right = wanted.withColumnRenamed("doc_id", "_id").withColumnRenamed("md5", "_md5")
    given = docs.select("doc_id", "text").withColumn("md5", _md5())
    return given.join(right, given["doc_id"].eqNullSafe(right["_id"]) & (given["md5"] == right["_md5"])).drop("_id", "_md5")


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Per row doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept bytes if asked for).

    A byte goes when a ``length``-byte string that covers it starts anywhere else, in any row or in the same one. Null is empty; a repeated
    row repeats all its strings.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column("text"))
        parsed = [parse(t, length) for t in texts]
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()), pa.array(list(map(len, texts)), pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            list_array([p[0].view(np.int64) for p in parsed], pa.int64()), list_array([p[1].view(np.int64) for p in parsed], pa.int64()),
        ], ["doc_id", "md5", "n_bytes", "sha256", "entry", "phrase"])

    fields = f"doc_id {kind}, md5 binary, n_bytes long, sha256 string, entry array<long>, phrase array<long>"
    rows = materialize(map_batches(docs.select("doc_id", "text"), read, fields).withColumn("row", F.monotonically_increasing_id()))
    keys = rows.select("row", "doc_id", "md5")

    entries = rows.select("row", F.posexplode("entry").alias("j", "entry"), "phrase").withColumn("phrase", F.get("phrase", "j"))
    shared = rows.select(F.explode("entry").alias("entry")).groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("entry")
    held = materialize(entries.join(shared, "entry"))
    phrases = materialize(held.groupBy("entry", "phrase").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "j")).alias("one")))
    again = phrases.where("n > 1").select("entry", "phrase")
    whole = held.join(again, ["entry", "phrase"]).groupBy("row").agg(F.collect_list("j").alias("whole"))
    open_entries = phrases.where("n = 1").select("entry").distinct()
    single = phrases.join(open_entries, "entry").select("one.row", "one.j").groupBy("row").agg(F.collect_list("j").alias("single"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text, js in zip(utf8(batch.column("text")), batch.column("single").to_pylist()):
            _, _, first, last = parse(text, length)
            js = np.array(sorted(js), np.int64)
            found.append(strings(text, first[js], last[js], length))
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), list_array([f[0].astype(np.int32) for f in found], pa.int32()), list_array([f[1].view(np.int64) for f in found], pa.int64())],
            ["row", "at", "hash"],
        )

    asked = _with_text(docs, keys.join(single, "row")).select("row", "text", "single").dropDuplicates(["row"])
    cut_rows = materialize(map_batches(asked, cut, "row long, at array<int>, hash array<long>"))
    each = cut_rows.select("row", F.posexplode("hash").alias("k", "hash"), "at").select("row", "hash", F.get("at", "k").alias("at"))
    twice = cut_rows.select(F.explode("hash").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    ends = each.join(twice, "hash").groupBy("row").agg(F.collect_list("at").alias("ends"))

    hit = whole.join(ends, "row", "full")
    touched = materialize(keys.join(hit, "row").drop("row").dropDuplicates(["doc_id", "md5"]))

    def remove(batch: pa.RecordBatch) -> pa.RecordBatch:
        gone, runs, kept = [], [], []
        for text, whole_js, at in zip(utf8(batch.column("text")), batch.column("whole").to_pylist(), batch.column("ends").to_pylist()):
            change = np.zeros(len(text) + 1, np.int64)
            _, _, first, last = parse(text, length)
            js, at = np.array(whole_js or [], np.int64), np.array(at or [], np.int64)
            np.add.at(change, np.concatenate([first[js], at]), 1)
            np.add.at(change, np.concatenate([last[js], at]) + length, -1)
            drop = change.cumsum()[:-1] > 0
            gone.append(int(drop.sum()))
            runs.append(int((drop & ~np.concatenate([[False], drop[:-1]])).sum()))
            kept.append(np.frombuffer(text, np.uint8)[~drop].tobytes())
        columns = [batch.column("doc_id"), batch.column("md5"), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        names = ["own_id", "own_md5", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
        return pa.RecordBatch.from_arrays(columns, names)

    out = f"own_id {kind}, own_md5 binary, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    removed = map_batches(_with_text(docs, touched), remove, out).dropDuplicates(["own_id", "own_md5"])
    plain = rows.select("doc_id", "md5", "n_bytes", "sha256")
    joined = plain.join(removed, plain["doc_id"].eqNullSafe(removed["own_id"]) & (plain["md5"] == removed["own_md5"]), "left")
    result = joined.select(
        plain["doc_id"], "md5", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), *(["kept"] if with_text else []),
    )
    if not with_text:
        return result.drop("md5")
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("binary").alias("_text"), _md5().alias("_md5")).dropDuplicates(["_id", "_md5"])
    full = result.join(texts, result["doc_id"].eqNullSafe(texts["_id"]) & (result["md5"] == texts["_md5"]), "left")
    return full.withColumn("kept", F.coalesce("kept", "_text", F.lit(b""))).drop("md5", "_id", "_md5", "_text")
