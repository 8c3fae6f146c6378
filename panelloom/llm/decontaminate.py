"""Benchmark decontamination with one Aho-Corasick automaton over normalised questions and answers.

Texts and items are lowered (A-Z) and cut into words of digits, letters and non-ASCII characters. Every run of ``window``
item words is a pattern; an item of fewer words is one pattern. A document is normalised once and scanned once; matches carry word
positions, which are mapped back to character offsets of the original text. Null or wordless texts match nothing, repeated items count
once, items without id are named "null".
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.llm.common import utf8
from panelloom.session import materialize

#: Benchmark bytes whose patterns share one automaton. A larger benchmark is scanned shard by shard.
SHARD_BYTES = 400_000
_KEPT = set(range(48, 58)) | set(range(97, 123)) | set(range(128, 256))
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEPT else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_HITS = "array<struct<item:string,first:int,last:int>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def automaton(items: list[tuple[str, bytes]], window: int) -> ahocorasick.Automaton:
    """Patterns are " word word ... word " over bytes read as Latin-1, so a match always covers whole words."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(len(words) - window + 1, min(len(words), 1))):
            run = words[i : i + window]
            found.setdefault(f" {b' '.join(run).decode('latin-1')} ", (len(run), set()))[1].add(item)
    out = ahocorasick.Automaton()
    for key, (n, ids) in found.items():
        out.add_word(key, (n, sorted(ids)))
    out.make_automaton()
    return out


def _scan(text: bytes, machine: ahocorasick.Automaton) -> tuple[int, list[tuple[str, int, int]]]:
    """Number of words, and per item the merged word ranges [first, last) of its matches."""
    words = words_of(text)
    plain = f" {b' '.join(words).decode('latin-1')} "
    found = list(machine.iter(plain)) if len(machine) and words else []
    if not found:
        return len(words), []
    gaps = np.flatnonzero(np.frombuffer(plain.encode("latin-1"), np.uint8) == 32)
    ends = np.searchsorted(gaps, [e for e, _ in found])
    ranges: dict[str, list[list[int]]] = {}
    for last, (_, (n, ids)) in zip(ends.tolist(), found):
        for item in ids:
            own = ranges.setdefault(item, [])
            if own and last - n <= own[-1][1]:
                own[-1][0], own[-1][1] = min(own[-1][0], last - n), last
            else:
                own.append([last - n, last])
    return len(words), [(item, a, b) for item, own in ranges.items() for a, b in own]


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` plus n_words, n_hit (words inside any match), items (sorted) and spans (character ranges of hit runs).

    Added columns replace ones of the same name.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "spans", "_pl_hits")]
    listed = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary").alias("text")).where("text is not null")
    size = listed.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = -(-size // SHARD_BYTES) or 1
    current = docs.select(*names, F.lit(None).cast(_HITS).alias("_pl_hits"))
    for shard in range(shards):
        if shard:
            current = materialize(current)
        # About SHARD_BYTES of text; an item is never split.
        part = [(r[0], bytes(r[1])) for r in listed.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard).distinct().collect()]
        current = _pass(current, part, window, names, last=shard == shards - 1)
    return current


def _pass(docs: DataFrame, items: list[tuple[str, bytes]], window: int, names: list[str], last: bool) -> DataFrame:
    kept = docs.select(*names).schema
    hits = pa.list_(pa.struct([("item", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(items, window)
        for batch in batches:
            own = [batch.column(c) for c in names]
            before = batch.column("_pl_hits").to_pylist()
            rows = []
            for text, old in zip(utf8(batch.column("text")), before):
                n, new = _scan(text, machine)
                rows.append((n, [(h["item"], h["first"], h["last"]) for h in old or []] + new, text))
            if not last:
                yield pa.RecordBatch.from_arrays([*own, pa.array([[dict(zip(("item", "first", "last"), h)) for h in r[1]] for r in rows], hits)], [*names, "_pl_hits"])
                continue
            merged = [_merge(r[1]) for r in rows]
            yield pa.RecordBatch.from_arrays([
                *own, pa.array([r[0] for r in rows], pa.int64()), pa.array([sum(b - a for a, b in m) for m in merged], pa.int64()),
                pa.array([sorted({h[0] for h in r[1]}) for r in rows], pa.list_(pa.string())),
                pa.array([_offsets(r[2], m) for r, m in zip(rows, merged)], spans),
            ], [*names, "n_words", "n_hit", "items", "spans"])

    if not last:
        return docs.mapInArrow(run, T.StructType([*kept.fields, docs.schema["_pl_hits"]]))
    added = T._parse_datatype_string("n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>")
    return docs.mapInArrow(run, T.StructType([*kept.fields, *added.fields]))


def _merge(found: list[tuple[str, int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for _, a, b in sorted(found, key=lambda h: h[1:]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _offsets(text: bytes, ranges: list[list[int]]) -> list[dict[str, int]]:
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(text.decode())]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents that hold no benchmark passage, with their own columns."""
    given = docs.select(*docs.columns, F.struct(*docs.columns).alias("_pl_row"))
    return find_passages(given, benchmark, window).where("n_hit = 0").select("_pl_row.*")
