"""LM scoring with a log-frequency Bloom filter.

Word pairs of the training rows are counted on Spark: tasks count their own pairs and send them, packed by hash segment, to the task that
adds them up and writes the segment's filter. A pair of count c is inserted under the levels 1 ... 1 + log2(c); a reader probes
level after level until one is missing and takes the count of the last level found. A filter has 8 to 16 bits per inserted level
whatever the input, so a probe of a missing level succeeds in at most 3.1 % of cases.

The probability of a word after another is (c(h, w) + A * p(w)) / (c(h) + A), with exact single-word counts and add-one p(w) behind the pair
counts. Single words are looked up in a broadcast table as long as it has at most ``VOCABULARY`` words, pairs in broadcast filters as long as
all together have at most ``FILTER_BYTES``. What is larger stays where it is stored: blocks of rows send their distinct keys, packed by
hash segment, to the segment's table or filter, and the counts come back per block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import byte_slices, in_blocks, utf8
from panelloom.llm.hashing import U, mix, word_hashes
from panelloom.session import materialize

#: Most bytes of all filters together that are broadcast, and most words in the broadcast table (12 bytes each).
FILTER_BYTES = 64 << 20
VOCABULARY = 8_000_000
#: Weight of the single-word model behind the pair counts.
PRIOR = 50.0
#: Probes per level, bits per inserted level at least, tokens counted by a task before it sends them.
PROBES, BITS, HELD = 3, 8, 2_000_000
END = np.array([0x5851F42D4C957F2D], U)
_FIXED = np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per block of texts: token hashes with one end after every text, and where each text's tokens begin."""
    for i, j in in_blocks(texts):
        words, begins = word_hashes(texts[i:j])
        out = np.insert(words, begins[1:], END[0])
        yield out, begins + np.arange(len(begins))


def pairs(run: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Hash of (previous token, token) for every token; the first token of a text follows an end."""
    before = np.concatenate([END, run[:-1]])
    before[begins[:-1]] = END[0]
    return mix(before * _FIXED + run)


def _segment(keys: np.ndarray, segments: int) -> np.ndarray:
    return (keys >> U(64 - segments.bit_length() + 1)).astype(np.int64) if segments > 1 else np.zeros(len(keys), np.int64)


def _training(doc_id, fold: int = 7, held: int = 2):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % fold != held, F.lit(True))


def counts(docs: DataFrame, segments: int) -> DataFrame:
    """Segments of word counts (kind w) and of pair filters (kind p): entries, total, keys or bits, counts."""

    def packed(kind: str, keys: np.ndarray) -> Iterator[dict]:
        keys, n = np.unique(keys, return_counts=True)
        cuts = np.searchsorted(_segment(keys, segments), np.arange(segments + 1))
        for s in range(segments):
            a, b = cuts[s], cuts[s + 1]
            if b > a:
                yield {"kind": kind, "segment": s, "keys": keys[a:b].tobytes(), "n": n[a:b].astype("<i8").tobytes()}

    schema = pa.schema([("kind", pa.string()), ("segment", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[np.ndarray] = []
        couples: list[np.ndarray] = []
        held = 0

        def send() -> Iterator[pa.RecordBatch]:
            for kind, own in (("w", words), ("p", couples)):
                if own:
                    yield pa.RecordBatch.from_pylist(list(packed(kind, np.concatenate(own))), schema)
                    own.clear()

        for batch in byte_slices(batches):
            for run, begins in tokens(utf8(batch.column("text"))):
                words.append(run), couples.append(pairs(run, begins))
                held += len(run)
                if held >= HELD:
                    yield from send()
                    held = 0
        yield from send()

    def total(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        keys, at = np.unique(np.frombuffer(b"".join(part["keys"]), U), return_inverse=True)
        n = np.bincount(at, np.frombuffer(b"".join(part["n"]), "<i8"), len(keys)).astype(np.int64)
        kept = (keys.tobytes(), n.tobytes()) if key[0] == "w" else (filter_bits(keys, n), b"")
        return pd.DataFrame({"kind": [key[0]], "segment": [key[1]], "entries": [len(keys)], "total": [int(n.sum())], "keys": [kept[0]], "n": [kept[1]]})

    partial = docs.select("text").mapInArrow(count, "kind string, segment int, keys binary, n binary")
    return partial.groupBy("kind", "segment").applyInPandas(total, "kind string, segment int, entries long, total long, keys binary, n binary")


def _bit(keys: np.ndarray, level: int, probe: int) -> np.ndarray:
    return mix(keys + U((level * PROBES + probe + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def filter_bits(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Bloom filter of one segment; its number of bits is a power of two."""
    levels = np.log2(n).astype(np.int64) + 1
    size = 1 << max(6, int(np.ceil(np.log2(max(1, BITS * levels.sum())))))
    bits = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        own = keys[levels >= level]
        for probe in range(PROBES):
            bits[(_bit(own, level, probe) & U(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """All segments side by side; ``count`` estimates the count of each key from its level."""

    def __init__(self, start: np.ndarray, mask: np.ndarray, bits: np.ndarray) -> None:
        self.segments, self.start, self.mask, self.bits = len(start), start, mask, bits

    @classmethod
    def of(cls, segments: int, parts: Iterable[tuple[int, bytes]], size: int) -> Filter:
        """Copies the segments into one array of ``size`` bytes, and 8 empty ones for the segments that are absent."""
        bits = np.zeros(size + 8, np.uint8)
        start, mask, at = np.full(segments, 8 * size, np.int64), np.full(segments, 63, U), 0
        for s, own in parts:
            bits[at : at + len(own)] = np.frombuffer(own, np.uint8)
            start[s], mask[s] = 8 * at, U(8 * len(own) - 1)
            at += len(own)
        return cls(start, mask, bits)

    def count(self, keys: np.ndarray) -> np.ndarray:
        return estimate(self.level(keys))

    def level(self, keys: np.ndarray) -> np.ndarray:
        segment = _segment(keys, self.segments)
        start, mask = self.start[segment], self.mask[segment]
        level, alive = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for step in range(1, 64):
            for probe in range(PROBES):
                at = start[alive] + (_bit(keys[alive], step, probe) & mask[alive]).astype(np.int64)
                alive = alive[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            if not len(alive):
                break
            level[alive] = step
        return level


def estimate(level: np.ndarray) -> np.ndarray:
    return np.where(level > 1, 1.5 * 2.0 ** (level - 1), level)  # middle of the level's range


def score(docs: DataFrame, vocabulary: int = VOCABULARY, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Per row doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Null text is empty and has the end token alone; a row without id counts as training. Without training rows every count is 0.
    """
    rows = docs.select("doc_id", "text")
    segments = 1 << max(6, int(np.ceil(np.log2(max(1, rows.count() // 1024)))))
    stored = materialize(counts(rows.where(_training(F.col("doc_id"))), segments))
    words = stored.where("kind = 'w'")
    facts = words.agg(F.sum("total"), F.sum("entries")).first()
    n_train, distinct = facts[0] or 0, facts[1] or 0
    size = stored.where("kind = 'p'").agg(F.sum(F.length("keys"))).first()[0] or 0
    context = docs.sparkSession.sparkContext
    sent = None
    if size <= filter_bytes:
        parts = ((r["segment"], r["keys"]) for r in stored.where("kind = 'p'").select("segment", "keys").toLocalIterator())
        sent = context.broadcast(Filter.of(segments, parts, size))  # three arrays, one copy in each worker
    table = None
    if distinct <= vocabulary:
        listed = sorted((r["segment"], bytes(r["keys"]), bytes(r["n"])) for r in words.select("segment", "keys", "n").toLocalIterator())
        table = context.broadcast((np.frombuffer(b"".join(x[1] for x in listed), U), np.minimum(np.frombuffer(b"".join(x[2] for x in listed), "<i8"), 2**32 - 1).astype(np.uint32) if n_train < 2**32 else np.frombuffer(b"".join(x[2] for x in listed), "<i8")))
    held_out = ~_training(F.col("doc_id"))
    total = float(n_train + distinct + 1)
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = "n_tokens long, n_known long, base_score double, score double"

    def sums(begins: np.ndarray, c: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, ...]:
        """From the counts of every token and, as the filter has it, of the pair that ends there."""
        before = np.concatenate([[0], c[:-1]])
        before[begins[:-1]] = c[begins[1:] - 1]  # the end token's count
        base = (c + 1) / total
        pair = np.minimum(seen, np.minimum(before, c))
        full = (pair + PRIOR * base) / (before + PRIOR)
        at = begins[:-1]
        return np.diff(begins), np.add.reduceat((c > 0).astype(np.int64), at), np.add.reduceat(np.log10(base), at), np.add.reduceat(np.log10(full), at)

    def listed_counts(near: np.ndarray) -> np.ndarray:
        return _exact(near, *table.value).astype(float)

    given = rows.withColumn("held_out", held_out)
    if table is None or sent is None:
        scored = _asked(given, stored, segments, None if table is None else listed_counts, sent, sums, kind, columns)
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = sent.value
            for batch in byte_slices(batches):
                out = []
                for own, begins in tokens(utf8(batch.column("text"))):
                    near, back = np.unique(own, return_inverse=True)
                    couples, place = np.unique(pairs(own, begins), return_inverse=True)
                    out.append(sums(begins, listed_counts(near)[back], model.count(couples)[place]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *(pa.array(np.concatenate(x)) for x in zip(*out))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        scored = given.mapInArrow(run, f"doc_id {kind}, held_out boolean, {columns}")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def _exact(near: np.ndarray, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n of every key, 0 where it is not among the sorted ``keys``."""
    at = np.searchsorted(keys, near)
    found = at < len(keys)
    found[found] = keys[at[found]] == near[found]
    return np.where(found, n[np.minimum(at, len(n) - 1)] if len(n) else 0, 0)


def _asked(rows: DataFrame, stored: DataFrame, segments: int, listed_counts, sent, sums, kind: str, columns: str) -> DataFrame:
    """The same scores where words, pairs or both are not broadcast: blocks of rows ask the stored segments for their distinct keys."""
    asks = [k for k, held in (("w", listed_counts), ("p", sent)) if held is None]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i, j in in_blocks(utf8(batch.column("text"))):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(j - i, block))], [*part.schema.names, "block"])
                block += 1

    def distinct(parts: list[tuple[np.ndarray, np.ndarray]], what: str) -> np.ndarray:
        return np.unique(np.concatenate([run if what == "w" else pairs(run, begins) for run, begins in parts]))

    def ask(part: pa.Table) -> pa.Table:
        block, runs, out = part.column("block")[0].as_py(), list(tokens(utf8(part.column("text")))), []
        for what in asks:
            keys = distinct(runs, what)
            cuts = np.searchsorted(_segment(keys, segments), np.arange(segments + 1))
            out += [{"kind": what, "segment": s, "block": block, "keys": keys[a:b].tobytes()} for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        return pa.Table.from_pylist(out, pa.schema([("kind", pa.string()), ("segment", pa.int32()), ("block", pa.int64()), ("keys", pa.binary())]))

    def answer(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        """Counts of words (8 bytes each) or levels of pairs (one byte each) for every message to a segment, in the order of its keys."""
        what, sent_keys = key[0].as_py(), asked.column("keys").to_pylist()
        keys = np.frombuffer(b"".join(sent_keys), U)
        own, n = (held.column(c)[0].as_py() if held.num_rows else b"" for c in ("keys", "n"))
        if what == "w":
            found = _exact(keys, np.frombuffer(own, U), np.frombuffer(n, "<i8")).astype("<i8")
        else:
            found = Filter.of(1, [(0, own)] if own else [], len(own)).level(keys).astype(np.uint8)
        cuts = np.cumsum([0, *(len(k) // 8 for k in sent_keys)])
        return pa.table({"kind": pa.array([what] * asked.num_rows, pa.string()), "segment": asked.column("segment"), "block": asked.column("block"), "found": pa.array([found[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})

    def run(part: pa.Table, answers: pa.Table) -> pa.Table:
        runs = list(tokens(utf8(part.column("text"))))
        back = sorted(zip(answers.column("kind").to_pylist(), answers.column("segment").to_pylist(), answers.column("found").to_pylist()))
        known = {}
        for what in asks:
            keys, found = distinct(runs, what), np.frombuffer(b"".join(f for k, _, f in back if k == what), "<i8" if what == "w" else np.uint8)
            if len(keys) != len(found):
                raise ValueError(f"{len(found)} answers for {len(keys)} keys")
            known[what] = keys, found.astype(float) if what == "w" else estimate(found.astype(np.int64))
        out = []
        for own, begins in runs:
            values = {}
            for what, asked in (("w", own), ("p", pairs(own, begins))):
                if what in known:
                    values[what] = known[what][1][np.searchsorted(known[what][0], asked)]
                else:
                    near, place = np.unique(asked, return_inverse=True)
                    values[what] = (listed_counts if what == "w" else sent.value.count)(near)[place]
            out.append(sums(begins, values["w"], values["p"]))
        return pa.table([part.column("doc_id"), part.column("held_out"), *(pa.array(np.concatenate(x)) for x in zip(*out))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    dealt = rows.mapInArrow(deal, f"doc_id {kind}, text string, held_out boolean, block long")
    given = materialize(dealt)
    asked = given.groupBy("block").applyInArrow(ask, "kind string, segment int, block long, keys binary")
    answers = asked.groupBy("kind", "segment").cogroup(stored.where(F.col("kind").isin(asks)).groupBy("kind", "segment")).applyInArrow(answer, "kind string, segment int, block long, found binary")
    return given.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"doc_id {kind}, held_out boolean, {columns}")
