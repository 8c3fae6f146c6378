"""Best-fit packing of documents into sequences of at most ``capacity`` tokens, in bulk-synchronous rounds.

Documents are tokenised once; what is longer than a sequence is cut. Pieces of one length are interchangeable until the end, so range-
sorted documents and gaps are kept as runs: (size, first rank, count). A round is one job over those runs. Size ranges are swept side by
side: going up in size, each gap takes the longest documents below it that still wait, so every document meets the successor of its
length, and conflicts for a gap are resolved by rank. A second sweep matches what the ranges have left over, gaps are updated, and
the next round starts. When a round places nothing, the longest documents open as many sequences as the waiting tokens need at least. The
number of runs is bound by capacity and rounds, never by documents. Ranks inside a length are computed by distributed, salted
windows, so one common length cannot land in one task; a final join maps rank ranges to sequences.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.session import materialize, materialize_counted

CAPACITY = 2048
#: Distinct words whose ids a Python worker keeps.
CACHE_WORDS = 400_000
#: Rows per salted group of one length, on average.
GROUP_ROWS = 20_000

# Characters for which the pattern below cuts exactly as the vocabulary's own splitter does.
_SAFE = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧]*")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class _Ids(dict):
    """Word to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = np.array(self.encode(word), "<u4").tobytes()
        if len(word) < 64:
            self[word] = out
        return out


@lru_cache(2)
def _vocabulary(name: str):
    """Encoders for one word and for any text; both give the ids of the vocabulary file without special tokens."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    whole.encode_special_tokens = True
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pieces = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _Ids(pieces.encode_ordinary), lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def token_bytes(text: str | None, vocabulary: str = "byte_bpe_50k") -> bytes:
    """Ids of a text and the closing id 0, four bytes each; null is empty."""
    words, whole = _vocabulary(vocabulary)
    text = text or ""
    ids = b"".join(map(words.__getitem__, _SPLIT.findall(text))) if _SAFE.fullmatch(text) else whole(text)
    return ids + b"\0\0\0\0"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids.

    Only the first piece of a cut document may be shorter than ``capacity``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc, parts = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = token_bytes(text, vocabulary)
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    size = n % capacity if k == 0 and n % capacity else capacity
                    part = ids[4 * at : 4 * (at + size)]
                    row.append(i), piece.append(k), start.append(at), length.append(size), crc.append(zlib.crc32(part))
                    if with_ids:
                        parts.append(np.frombuffer(part, "<i4"))
                    at, k = at + size, k + 1
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(parts, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


_RUNS = "kind string, size long, first long, n long, rank long, offset long"
#: Size ranges swept side by side in a round.
RANGES = 8


def sweep(runs: list[tuple], capacity: int) -> list[tuple]:
    """Match waiting documents (d) with gaps (g) in the order of size; every gap takes the longest document not longer than it.

    Runs are (kind, size, first, n, rank, offset). A document that finds no gap in these runs stays d, so ranges can be swept apart
    and their leftovers together. Placed runs get kind p, what is left of a used gap kind u (used in this round).
    """
    out, stack = [r for r in runs if r[0] not in "dg"], []
    for kind, size, first, n, _, _ in sorted((r for r in runs if r[0] in "dg"), key=lambda r: (r[1], r[0], r[2])):
        if kind == "d":
            stack.append([size, first, n])
            continue
        while n and stack:
            length, rank, waiting = stack[-1]
            each = max(1, min(size // length, waiting // n))  # many equal documents fill a gap at once
            bins = min(n, waiting // each)
            out += [("p", length, first, bins, rank + j * bins, capacity - size + j * length) for j in range(each)]
            if size > each * length:
                out.append(("u", size - each * length, first, bins, 0, 0))
            first, n = first + bins, n - bins
            stack[-1][1], stack[-1][2] = rank + bins * each, waiting - bins * each
            if not stack[-1][2]:
                stack.pop()
        if n:
            out.append(("g", size, first, n, 0, 0))
    return out + [("d", size, first, n, 0, 0) for size, first, n in stack]


def open_sequences(runs: list[tuple], capacity: int, opened: int, all_docs: bool) -> list[tuple]:
    """The longest waiting documents start as many sequences as their tokens need at least (or one each)."""
    waiting = sorted((r for r in runs if r[0] == "d"), key=lambda r: -r[1])
    count = -(-sum(r[1] * r[3] for r in waiting) // capacity)
    out = [r for r in runs if r[0] != "d"]
    for _, size, first, n, _, _ in waiting:
        took = n if all_docs else min(n, count)
        count -= took
        if took:
            out.append(("p", size, opened, took, first, 0))
            opened += took
            if size < capacity:
                out.append(("u", capacity - size, opened - took, took, 0, 0))
        if n > took:
            out.append(("d", size, first + took, n - took, 0, 0))
    return out


def _round(runs: DataFrame, floor: int, capacity: int, opened: int) -> DataFrame:
    """Sweep every size range, then the leftovers of all; open sequences if nothing was placed. Documents up to ``floor`` wait (w)."""
    names = ["kind", "size", "first", "n", "rank", "offset"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names)

    def local(part: pd.DataFrame) -> pd.DataFrame:
        return frame(sweep(list(part[names].itertuples(index=False, name=None)), capacity))

    def together(part: pd.DataFrame) -> pd.DataFrame:  # at most a few runs per size
        rows = sweep(list(part[names].itertuples(index=False, name=None)), capacity)
        if not any(r[0] == "p" for r in rows):
            rows = open_sequences(rows, capacity, opened, floor == capacity // 2)
        return frame([("g" if r[0] == "u" else r[0], *r[1:]) for r in rows])

    active = runs.withColumn("kind", F.when((F.col("kind") == "w") & (F.col("size") > floor), "d").otherwise(F.col("kind")))
    swept = active.withColumn("range", F.floor(F.col("size") * RANGES / (capacity + 1))).groupBy("range").applyInPandas(local, _RUNS)
    return swept.withColumn("range", F.lit(0)).groupBy("range").applyInPandas(together, _RUNS)


def plan(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Placed runs (size, rank, n, first sequence, offset) for ``counts`` (length, n)."""
    zero = F.lit(0).cast("long")
    runs = counts.select(F.lit("w").alias("kind"), F.col("length").alias("size"), zero.alias("first"), "n", zero.alias("rank"), zero.alias("offset"))
    tables, opened = [], 0
    # Documents over half a sequence come first (no two of them share one), then the middle ones, then the short ones.
    for floor in (capacity // 2, capacity // 8, 0):
        left = counts.where(F.col("length") > floor).limit(1).count()
        while left:
            stored, facts = materialize_counted(
                _round(runs, floor, capacity, opened), left=F.sum(F.when(F.col("kind") == "d", F.col("n"))),
                opened=F.sum(F.when((F.col("kind") == "p") & (F.col("offset") == 0), F.col("n"))),
            )
            tables.append(stored.where("kind = 'p'"))
            runs, left, opened = stored.where("kind <> 'p'"), facts["left"], opened + (facts["opened"] or 0)
    out = runs.where("kind = 'p'")
    for t in tables:
        out = out.unionByName(t)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset; a sequence's pieces lie gapless from 0.

    Null text is an empty document (one closing id); repeated rows are packed as often as they occur.
    """
    pieces, facts = materialize_counted(token_pieces(docs, capacity, vocabulary, with_ids))
    salts = max(64, facts["n"] // GROUP_ROWS)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = materialize(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start"))
    ranked = salted.withColumn("_row", within).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_row") - 1 + F.col("before"))
    runs = plan(counts.groupBy("length").agg(F.sum("n").alias("n")), capacity)
    # At most 2 * capacity runs per round, whatever the number of documents.
    placed = F.broadcast(runs.select(F.col("size").alias("length"), F.col("first").alias("_bin"), F.col("n").alias("_n"), F.col("rank").alias("_from"), F.col("offset").alias("_at")))
    met = ranked.join(placed, "length").where("_rank >= _from and _rank < _from + _n")
    return met.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), (F.col("_bin") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("_at").alias("offset"))
