"""Substring dedup by sliding sentence spans.

A text is cut into sentences at line ends and after . ! ? before white space. A span is a run of at least ``MIN_SENTENCES`` sentences with
``MIN_WORDS`` words: the shortest one from every sentence on and, with ``both_ways``, also the shortest one up to every sentence. The two
together cover every longer repeated run (where its occurrences are cut into the same sentences); the first alone leaves the end of
a passage whose last sentences are short. Spans are compared by a hash of their words with A-Z lowered. All spans
are joined by hash over the whole table; of each repeated span the first occurrence (smallest doc_id, then text digest, then position) stays, and
every sentence covered by any other occurrence is removed. Texts too short for a span are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import in_blocks, list_array, map_batches, utf8
from panelloom.llm.hashing import mix, prefix_hash, span_hash, word_hashes
from panelloom.session import materialize

MIN_SENTENCES = 2
MIN_WORDS = 12
_END = re.compile(rb"[.!?]+(?=[\x20\x09-\x0D])|\n")
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def sentences(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges that cover the whole text: every sentence with the white space after it."""
    ends = [m.end() for m in _END.finditer(text)]
    cuts = []
    for e in ends:
        while e < len(text) and text[e] in b" \t\n\r\x0b\x0c":
            e += 1
        if not cuts or e > cuts[-1]:
            cuts.append(e)
    if not cuts or cuts[-1] < len(text):
        cuts.append(len(text))
    return [(a, b) for a, b in zip([0, *cuts], cuts) if b > a]


def spans(texts: list[bytes], both_ways: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per text: number of sentences, then first sentence, end sentence and hash of every span."""
    for i, j in in_blocks(texts):
        words, begins = word_hashes(texts[i:j])
        for k in range(i, j):
            own, cut = words[begins[k - i] : begins[k - i + 1]], sentences(texts[k])
            counts = np.array([len(_WORDS.findall(texts[k], a, b)) for a, b in cut], np.int64)
            at = np.concatenate([[0], np.cumsum(counts)])
            first = np.arange(len(cut))
            end = np.maximum(np.searchsorted(at, at[:-1] + MIN_WORDS), first + MIN_SENTENCES)
            good = (end <= len(cut)) & (counts > 0)
            code = first[good] * (len(cut) + 1) + end[good]
            if both_ways:
                start = np.minimum(np.searchsorted(at, at[1:] - MIN_WORDS, "right") - 1, first + 1 - MIN_SENTENCES)
                good = (start >= 0) & (counts[start] > 0)
                code = np.unique(np.concatenate([code, start[good] * (len(cut) + 1) + first[good] + 1]))
            first, end = np.divmod(code, len(cut) + 1)
            yield len(cut), first, end, span_hash(prefix_hash(mix(own)), at[first], at[end]).view(np.int64)


def repeated_sentences(docs: DataFrame, both_ways: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_sentences, n_removed, removed (sentence numbers), kept_text.

    Null counts as empty. Rows that repeat an id and a text are occurrences of the same document: of such rows all stay as the first one does.
    """

    def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column("text"))
        found = list(spans(texts, both_ways))
        kinds = ((1, pa.int32()), (2, pa.int32()), (3, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()), *(list_array([f[k].astype(t.to_pandas_dtype()) for f in found], t) for k, t in kinds)],
            ["doc_id", "md5", "first", "last", "hash"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    parsed = map_batches(docs.select("doc_id", "text"), parse, f"doc_id {kind}, md5 binary, first array<int>, last array<int>, hash array<long>")
    rows = materialize(parsed.select("doc_id", "md5", F.explode(F.arrays_zip("first", "last", "hash")).alias("s")).select("doc_id", "md5", F.col("s.first").alias("first"), F.col("s.last").alias("last"), F.col("s.hash").alias("hash")))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "md5", "first")
    repeated = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("stays")).where("n > 1").select("hash", "stays")
    later = rows.join(repeated, "hash").where(place != F.col("stays"))
    covered = later.groupBy("doc_id", "md5").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    covered = materialize(covered)
    given = docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("md5"))
    met = given.join(covered.withColumnRenamed("doc_id", "own_id"), given["doc_id"].eqNullSafe(F.col("own_id")) & (given["md5"] == covered["md5"]), "left")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, gone, kept = [], [], []
        for text, found in zip(utf8(batch.column("text")), batch.column("spans").to_pylist()):
            own = sentences(text)
            drop = sorted({k for s in found or [] for k in range(s["first"], s["last"])})
            total.append(len(own)), gone.append(drop)
            out = set(drop)
            kept.append(b"".join(text[a:b] for k, (a, b) in enumerate(own) if k not in out).decode() if drop else text.decode())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(list(map(len, gone)), pa.int64()), pa.array(gone, pa.list_(pa.int32())), pa.array(kept)],
            ["doc_id", "n_sentences", "n_removed", "removed", "kept_text"],
        )

    out = f"doc_id {kind}, n_sentences long, n_removed long, removed array<int>, kept_text string"
    return map_batches(met.select(given["doc_id"], "text", "spans"), cut, out)
