"""Token counts of whole texts by a map-side two-tier lookup.

A tokenizer with a splitter encodes every pre-token on its own, so a text's count is the sum over its pre-tokens. Tier one is a compact
open-addressing table (64-bit hash of the pre-token, its number of tokens) of the corpus' frequent pre-tokens, broadcast and probed
for whole blocks of text at once. What it misses goes to tier two, a cache in each Python worker, and what that misses is encoded by the
library. Pre-tokens are never shuffled: to choose the frequent ones every task reduces all its texts to a summary of at most
``SUMMARY`` (hash, count, length) entries, and only those summaries are merged, in ``SLICES`` hash slices with bounded state. The table decides
about speed alone; counts are the library's whatever it holds.

Pre-tokens of texts made of the characters for which the rules below are known to cut as the splitter does are found by numpy over code
points; other texts are cut by the library's own splitter. Texts that hold an added token's string, and files without a splitter, are
encoded whole by the library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.hashing import U, mix, prefix_hash, span_hash

#: Entries of the broadcast table, and of the summary of a task.
FREQUENT, SUMMARY = 1 << 16, 1 << 13
#: Hash slices in which summaries are merged, and entries a merging task holds per slice before it prunes.
SLICES, HELD = 64, 1 << 17
#: Pre-tokens whose lengths a Python worker keeps.
CACHE = 1 << 20
#: Characters handled at once; longer texts are cut where a single blank starts a pre-token.
BLOCK = 1 << 19
#: Distinct pre-tokens a task collects before it prunes its summary.
WINDOW = 1 << 21

# Characters on which the numpy rules cut as the splitter does: Basic Latin to Latin Extended-B, without odd separators, digits and letters.
_SAFE = re.compile("[\x00-\x1b\x20-\x84\x86-\x9f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027]*")
_CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")
_GAP = "\ue000"
SPACE, LETTER, NUMBER, OTHER, END = range(5)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point below the gap character."""
    out = np.full(0xE001, OTHER, np.uint8)
    for c in range(0x2100):
        ch = chr(c)
        out[c] = SPACE if ch.isspace() and not 0x1C <= c <= 0x1F else LETTER if ch.isalpha() else NUMBER if ch.isnumeric() else OTHER
    out[0xE000] = END
    return out


def starts_of(points: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of a run of safe code points start; the gap character ends a text.

    Letters, digits and the rest form runs that take one blank before them; white space before a run leaves its last character apart; an
    apostrophe that stands alone takes s, t, m, d, re, ve or ll with it.
    """
    if not len(points):
        return np.empty(0, np.int64)
    kind = _classes()[points]
    flag = np.ones(len(points), bool)
    flag[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == END)
    begin = np.flatnonzero(flag)
    what, end = kind[begin], np.append(begin[1:], len(points))
    after = np.append(what[1:], END)
    gap = np.flatnonzero((what == SPACE) & (after != END))
    last = end[gap] - 1
    flag[last] = True
    blank = points[last] == 0x20
    flag[end[gap[blank]]] = False
    taken = np.zeros(len(begin) + 1, bool)
    taken[gap[blank] + 1] = True
    mark = np.flatnonzero((what == OTHER) & (end - begin == 1) & (points[begin] == 0x27) & (after == LETTER) & ~taken[:-1])
    if len(mark):
        at, size = begin[mark], end[mark + 1] - end[mark]
        one, two = points[at + 1], points[np.minimum(at + 2, len(points) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b)) & (size >= 2)
        for width, hit in ((1, short), (2, pair)):
            flag[at[hit] + 1] = False
            stop = at[hit] + 1 + width
            flag[stop[stop < len(points)]] = True
    return np.flatnonzero(flag)


class Counter:
    """A vocabulary file with its caches; made once by a Python worker."""

    def __init__(self, name: str) -> None:
        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.cache: dict[int, int] = {}
        self.piece = None
        path = public_tokenizers.path(name)
        if name.endswith(".model"):
            import sentencepiece

            whole = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(x) for x in whole.encode(texts, num_threads=1)]
            return
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation(), self.library.no_padding()
        self.whole = lambda texts: [len(x.ids) for x in self.library.encode_batch(texts, add_special_tokens=False)]
        self.added = [t["content"] for t in spec["added_tokens"]]
        cut = spec["pre_tokenizer"] or {}
        if not cut or any(t["normalized"] for t in spec["added_tokens"]):
            return
        self.bytes = cut == cut | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} and not spec["normalizer"]
        self.normal = self.library.normalizer
        model = self.library.model
        if self.bytes:  # bytes outside the visible ones of Latin-1 are written from U+0100 on
            seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
            signs = {b: b for b in seen} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(seen))}
            self.piece = lambda s: len(model.tokenize(s.encode().decode("latin-1").translate(signs)))
        else:
            self.piece = lambda s: len(model.tokenize(s))

    def parts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """Blocks (row of each pre-token, characters, starts, ends); rows with an added token are left to ``whole``."""
        held, rows, size = [], [], 0
        for i, text in enumerate(texts):
            if any(a in text for a in self.added):
                continue
            if not self.bytes:
                normal = self.normal.normalize_str(text) if self.normal else text
                pieces = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
                ends = np.cumsum([0, *map(len, pieces)])
                yield np.full(len(pieces), i), "".join(pieces), ends[:-1], ends[1:]
                continue
            for part in in_parts(text):
                if not _SAFE.fullmatch(part):
                    spans = np.array([at for _, at in self.library.pre_tokenizer.pre_tokenize_str(part)], np.int64).reshape(-1, 2)
                    yield np.full(len(spans), i), part, spans[:, 0], spans[:, 1]
                    continue
                held.append(part), rows.append(i)
                size += len(part) + 1
                if size >= BLOCK:
                    yield self._safe(held, rows)
                    held, rows, size = [], [], 0
        if held:
            yield self._safe(held, rows)

    @staticmethod
    def _safe(held: list[str], rows: list[int]) -> tuple[np.ndarray, str, np.ndarray, np.ndarray]:
        joined = _GAP.join([*held, ""])
        points = _points(joined)
        start = starts_of(points)
        end = np.append(start[1:], len(points))
        real = points[start] != ord(_GAP)
        bounds = np.cumsum([len(h) + 1 for h in held])
        row = np.array(rows)[np.searchsorted(bounds, start, side="right").clip(max=len(rows) - 1)]
        return row[real], joined, start[real], end[real]

    def lengths(self, keys: np.ndarray, joined: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tier two: tokens of each pre-token, from the cache or the library."""
        near, first, back = np.unique(keys, return_index=True, return_inverse=True)
        out = np.empty(len(near), np.int64)
        if len(self.cache) + len(near) > CACHE:
            self.cache.clear()
        for k, (key, a, b) in enumerate(zip(near.tolist(), start[first].tolist(), end[first].tolist())):
            n = self.cache.get(key)
            if n is None:
                n = self.cache[key] = self.piece(joined[a:b])
            out[k] = n
        return out[back]


@lru_cache(4)
def counter(name: str) -> Counter:
    return Counter(name)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def in_parts(text: str) -> Iterator[str]:
    """A text in parts of about ``BLOCK`` characters, cut only before a single blank between two other characters."""
    start = 0
    while len(text) - start > BLOCK and (cut := _CUT.search(text, start + BLOCK)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _keys(joined: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each pre-token; never 0, which marks an empty slot."""
    return np.maximum(span_hash(prefix_hash(_points(joined)), start, end), U(1))


def compact_table(keys: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing with linear probing, at most half full: slots with the keys, and the lengths beside them."""
    size = 1 << max(1, int(2 * len(keys))).bit_length()
    slots, values = np.zeros(size, U), np.zeros(size, np.uint16)
    left = np.arange(len(keys))
    at = (mix(keys) & U(size - 1)).astype(np.int64)
    while len(left):
        free = slots[at[left]] == 0
        own, first = np.unique(at[left[free]], return_index=True)
        placed = left[free][first]
        slots[own], values[own] = keys[placed], lengths[placed]
        left = np.setdiff1d(left, placed)
        at[left] = (at[left] + (slots[at[left]] != 0)) & (size - 1)
    return slots, values


def probe(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the keys and where they were found."""
    slots, values = table
    at = (mix(keys) & U(len(slots) - 1)).astype(np.int64)
    out, found = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    open_ = np.arange(len(keys))
    while len(open_):
        here = slots[at[open_]]
        hit = here == keys[open_]
        out[open_[hit]], found[open_[hit]] = values[at[open_[hit]]], True
        open_ = open_[~hit & (here != 0)]
        at[open_] = (at[open_] + 1) & (len(slots) - 1)
    return out, found


def _top(keys: np.ndarray, n: np.ndarray, *others: np.ndarray, keep: int) -> list[np.ndarray]:
    """The ``keep`` most frequent entries, ties by key."""
    order = np.lexsort((keys, -n))[:keep]
    return [x[order] for x in (keys, n, *others)]


def frequent_lengths(docs: DataFrame, vocabulary: str, entries: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and lengths of frequent pre-tokens over all texts: task summaries, merged by hash slice."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(vocabulary)
        keys, n, size = np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
        if model.piece is None:
            return
        for batch in batches:
            for _, joined, start, end in model.parts([t or "" for t in batch.column("text").to_pylist()]):
                near, first, many = np.unique(_keys(joined, start, end), return_index=True, return_counts=True)
                kept = np.flatnonzero(many > 1)  # what a block holds once is not frequent
                if len(kept) > SUMMARY:
                    kept = kept[np.argpartition(-many[kept], SUMMARY)[:SUMMARY]]
                near, first, many = near[kept], first[kept], many[kept]
                long = model.lengths(near, joined, start[first], end[first])
                keys, n, size = _merged(np.concatenate([keys, near]), np.concatenate([n, many]), np.concatenate([size, long]))
                if len(keys) > WINDOW // 64:
                    keys, n, size = _top(keys, n, size, keep=SUMMARY)
        keys, n, size = _top(keys, n, size, keep=SUMMARY)
        part = (keys >> U(64 - SLICES.bit_length() + 1)).astype(np.int64)
        for s in np.unique(part):
            own = part == s
            yield pa.RecordBatch.from_pydict({"slice": pa.array([int(s)], pa.int32()), "keys": [keys[own].tobytes()], "n": [n[own].tobytes()], "size": [size[own].tobytes()]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                new = [np.frombuffer(row["keys"], U), np.frombuffer(row["n"], np.int64), np.frombuffer(row["size"], np.int64)]
                old = held.get(row["slice"])
                both = _merged(*(new if old is None else map(np.concatenate, zip(old, new))))
                held[row["slice"]] = _top(*both, keep=HELD // 2) if len(both[0]) > HELD else list(both)
        for s, (keys, n, size) in held.items():
            keys, n, size = _top(keys, n, size, keep=entries // SLICES)
            yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "keys": [keys.tobytes()], "n": [n.tobytes()], "size": [size.tobytes()]})

    schema = "slice int, keys binary, n binary, size binary"
    merged = docs.select("text").mapInArrow(summary, schema).repartition(SLICES, "slice").mapInArrow(merge, schema)
    rows = merged.collect()  # at most ``entries`` entries of 24 bytes
    keys, size = (np.concatenate([np.frombuffer(r[c], t) for r in rows] or [np.empty(0, t)]) for c, t in (("keys", U), ("size", np.int64)))
    return keys[size < 1 << 16], size[size < 1 << 16]


def _merged(keys: np.ndarray, n: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    near, first, back = np.unique(keys, return_index=True, return_inverse=True)
    return near, np.bincount(back, n, len(near)).astype(np.int64), size[first]


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512, entries: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``vocabulary`` is a file of ``public_tokenizers``: .json for tokenizers, .model for sentencepiece. Null and empty texts have 0 of both;
    repeated rows and null ids stay rows of their own; an empty table gives an empty result. Other columns are ignored.
    """
    keys, lengths = frequent_lengths(docs, vocabulary, entries)
    sent = docs.sparkSession.sparkContext.broadcast(compact_table(keys, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            total = np.zeros(len(texts), np.int64)
            if model.piece is None:
                apart = range(len(texts))
            else:
                apart = [i for i, t in enumerate(texts) if any(a in t for a in model.added)]
                for row, joined, start, end in model.parts(texts):
                    own = _keys(joined, start, end)
                    n, found = probe(sent.value, own)
                    miss = np.flatnonzero(~found)
                    n[miss] = model.lengths(own[miss], joined, start[miss], end[miss])
                    total += np.bincount(row, n, len(texts)).astype(np.int64)
            if len(apart):
                total[list(apart)] = model.whole([texts[i] for i in apart])
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
