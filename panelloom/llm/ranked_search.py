"""Ranked lexical search with pair-bound MaxScore over a document-partitioned index.

``build_index`` turns every document into postings, one row per block of at most ``BLOCK_DOCS`` documents; no posting is ever shuffled. For
a set of queries, ``weigh`` counts the document frequencies of their terms, then writes per block the impacts (what a posting adds to a
score), the greatest impact of every term in each chunk of ``CHUNK`` documents, and intersection lists of term pairs: per chunk in which both
terms share a document, the greatest joint impact of one document.

A query's bound for a chunk is the sum of its terms' maxima, less what disjoint pairs save: a pair adds at most the greatest of its joint
maximum and its two single maxima, as a document holds both terms or one of them. Terms are taken from the greatest bound to the
smallest; after each, documents whose score so far and the combined bound of the remaining terms cannot reach the threshold are
skipped, so the long lists of common terms are only read for documents that are left. The threshold is the tenth best score found by a probe
of every block's most promising chunk, and rises within a task. Bounds below the threshold are skipped and equal ones are not, so
ranks are exact, ties included.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import in_blocks, utf8
from panelloom.llm.hashing import _LOWER, U, prefix_hash, span_hash
from panelloom.session import drop_written, materialize_at, scratch_path

BLOCK_DOCS, BLOCK_TEXT = 4096, 16 << 20
CHUNK = 64
#: Terms of a query of which all pairs get intersection lists. More or fewer change the bounds' tightness, never the result.
PAIR_TERMS = 10
#: Query terms that are searched for in one go; a larger set of queries is dealt into several.
QUERY_TERMS = 1 << 18
TOP = 10

_TERM = np.ones(256, bool)
_TERM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_TERM[65:91] = True
_BREAK = re.compile(rb"[\x00-\x2f:-@\[-`{-\x7f]")
_PART = 1 << 20


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term (A-Z lowered) and where each text's terms begin."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    inside = np.concatenate([[False], _TERM[data], [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = change[::2], change[1::2]
    if not len(start):
        return np.empty(0, U), np.zeros(len(texts) + 1, np.int64)
    return span_hash(prefix_hash(_LOWER[data]), start, end), np.searchsorted(start, begins)


def _text_terms(text: bytes) -> Iterator[np.ndarray]:
    """Terms of one text, part by part; a long text is cut at a byte that belongs to no term."""
    start = 0
    while len(text) - start > _PART and (cut := _BREAK.search(text, start + _PART)):
        yield term_hashes([text[start : cut.start()]])[0]
        start = cut.start()
    yield term_hashes([text[start:]])[0]


def _postings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of all texts, sorted by row and term."""
    rows, terms, counts = [], [], []
    for i, j in in_blocks(texts, _PART):
        if len(texts[i]) > _PART:
            own, n = np.unique(np.concatenate(list(_text_terms(texts[i]))), return_counts=True)
            rows.append(np.full(len(own), i)), terms.append(own), counts.append(n)
            continue
        found, begins = term_hashes(texts[i:j])
        row = np.repeat(np.arange(i, j), np.diff(begins))
        order = np.lexsort((found, row))
        row, found = row[order], found[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (found[1:] != found[:-1])])) if len(row) else np.empty(0, np.int64)
        rows.append(row[new]), terms.append(found[new]), counts.append(np.diff(np.append(new, len(row))))
    return tuple(np.concatenate(x) if x else np.empty(0, t) for x, t in ((rows, np.int64), (terms, U), (counts, np.int64)))


_INDEX = "docs array<{kind}>, n_docs long, n_terms long, sizes binary, terms binary, starts binary, ords binary, tfs binary"


def build_index(docs: DataFrame) -> DataFrame:
    """One row per block: its documents with at least one term, their lengths, and postings by term (sorted by hash).

    Null and empty texts are in no block. Rows that repeat an id are documents of their own.
    """
    kind = docs.schema["doc_id"].dataType

    def block(ids: list, texts: list[bytes]) -> pa.RecordBatch | None:
        row, term, tf = _postings(texts)
        if not len(row):
            return None
        used, place = np.unique(row, return_inverse=True)
        order = np.lexsort((place, term))
        place, term, tf = place[order], term[order], tf[order]
        start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        sizes = np.bincount(place, tf, len(used)).astype("<i8")
        values = {
            "docs": [[ids[i] for i in used]], "n_docs": [len(used)], "n_terms": [int(sizes.sum())], "sizes": [sizes.tobytes()], "terms": [term[start].tobytes()],
            "starts": [np.append(start, len(term)).astype("<i4").tobytes()], "ords": [place.astype("<u2").tobytes()], "tfs": [tf.astype("<i4").tobytes()],
        }
        return pa.RecordBatch.from_pydict(values, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("docs", pa.list_(to_arrow_type(kind))), ("n_docs", pa.int64()), ("n_terms", pa.int64()), *((c, pa.binary()) for c in ("sizes", "terms", "starts", "ords", "tfs"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
                if texts and (len(texts) >= BLOCK_DOCS or size + len(text) > BLOCK_TEXT):
                    if (out := block(ids, texts)) is not None:
                        yield out
                    ids, texts, size = [], [], 0
                ids.append(i), texts.append(text)
                size += len(text)
        if texts and (out := block(ids, texts)) is not None:
            yield out

    return docs.select("doc_id", "text").mapInArrow(run, _INDEX.format(kind=kind.simpleString()))


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """(query number, item_id, distinct term hashes) of every query that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(np.concatenate(list(_text_terms(t)))) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("item_id"), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["query", "item_id", "n", "terms"])

    kind = queries.schema["item_id"].dataType.simpleString()
    numbered = queries.select(F.monotonically_increasing_id().alias("query"), "item_id", F.col(text).alias("text"))
    return numbered.mapInArrow(run, f"query long, item_id {kind}, n long, terms binary").where("n > 0")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each posting adds to a score of a term of weight 1."""
    longest = int(sizes.max(initial=0))
    if 90 * longest * n_docs < 1 << 63:
        m = 10 + 90 * sizes * n_docs // n_terms
    else:
        m = np.array([10 + 90 * int(s) * n_docs // n_terms for s in sizes], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Plan:
    """Queries of one go: their terms by number, weights, and the pairs that get intersection lists."""

    def __init__(self, queries: list[np.ndarray], terms: np.ndarray, df: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.terms, self.n_docs, self.n_terms = terms, n_docs, n_terms
        self.weights = np.array([weight(n_docs, int(d)) if d else 0 for d in df], np.int64)
        self.queries = [np.searchsorted(terms, q) for q in queries]
        # A term's bound matters by its weight and by the share of chunks that hold it.
        value = self.weights * (1 - (1 - df / max(1, n_docs)) ** CHUNK)
        chosen: set[tuple[int, int]] = set()
        for q in self.queries:
            best = sorted(q[np.argsort(-value[q], kind="stable")[:PAIR_TERMS]].tolist())
            chosen.update((a, b) for k, a in enumerate(best) for b in best[k + 1 :] if self.weights[a] and self.weights[b])
        self.pairs = np.array(sorted(chosen), np.int64).reshape(-1, 2)
        number = {tuple(p): k for k, p in enumerate(self.pairs.tolist())}
        self.query_pairs = []
        for q in self.queries:
            own = q.tolist()
            place = {t: k for k, t in enumerate(own)}
            found = [(number[a, b], place[a], place[b]) for k, a in enumerate(own) for b in own[k + 1 :] if (a, b) in number] if len(own) <= 4 * PAIR_TERMS else [
                (number[a, b], place[a], place[b]) for best in [sorted(q[np.argsort(-value[q], kind="stable")[:PAIR_TERMS]].tolist())] for k, a in enumerate(best) for b in best[k + 1 :] if (a, b) in number
            ]
            self.query_pairs.append(np.array(found, np.int64).reshape(-1, 3))


def _chunk_maxima(ords: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of the sorted ``ords``, and the greatest value in each."""
    chunk = ords // CHUNK
    start = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
    return chunk[start], np.maximum.reduceat(values, start)


class Block:
    """Impacts of one block for the terms of a plan, with maxima by chunk for terms and pairs."""

    def __init__(self, n: int, own: np.ndarray, starts: np.ndarray, ords: np.ndarray, values: np.ndarray) -> None:
        self.n, self.chunks = n, -(-n // CHUNK)
        self.own, self.starts, self.ords, self.values = own, starts, ords, values
        self.row = {t: k for k, t in enumerate(own.tolist())}

    @classmethod
    def weighed(cls, plan: Plan, sizes: np.ndarray, terms: np.ndarray, starts: np.ndarray, ords: np.ndarray, tfs: np.ndarray) -> Block:
        at = np.searchsorted(terms, plan.terms)
        here = at < len(terms)
        here[here] = terms[at[here]] == plan.terms[here]
        here &= plan.weights > 0
        own, at = np.flatnonzero(here), at[here]
        width = starts[at + 1] - starts[at]
        begin = np.concatenate([[0], np.cumsum(width)])
        pick = np.repeat(starts[at] - begin[:-1], width) + np.arange(begin[-1])
        place = ords[pick].astype(np.int64)
        value = impacts(tfs[pick].astype(np.int64), sizes[place], plan.n_docs, plan.n_terms) * np.repeat(plan.weights[own], width)
        return cls(len(sizes), own, begin, place, value)

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[self.row[term]], self.starts[self.row[term] + 1]
        return self.ords[a:b], self.values[a:b]

    def term_maxima(self) -> np.ndarray:
        out = np.zeros((len(self.own), self.chunks), np.int64)
        if len(self.ords):
            cell = np.repeat(np.arange(len(self.own)), np.diff(self.starts)) * self.chunks + self.ords // CHUNK
            start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            out.ravel()[cell[start]] = np.maximum.reduceat(self.values, start)
        return out

    def pair_maxima(self, pairs: np.ndarray) -> np.ndarray:
        """Joint maxima by pair and chunk; 0 where no document holds both."""
        out = np.zeros((len(pairs), self.chunks), np.int64)
        marks = np.zeros(self.n, np.int64)
        for k in np.argsort(pairs[:, 0], kind="stable").tolist():
            a, b = pairs[k].tolist()
            if a not in self.row or b not in self.row:
                continue
            (x, vx), (y, vy) = self.postings(a), self.postings(b)
            marks[x] = vx
            both = marks[y] > 0
            if both.any():
                chunk, best = _chunk_maxima(y[both], (marks[y] + vy)[both])
                out[k, chunk] = best
            marks[x] = 0
        return out


def best_of(block: Block, query: np.ndarray, pairs: np.ndarray, term_max: np.ndarray, pair_max: np.ndarray, threshold: int, probe: bool, use_pairs: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents (ordinals, scores) of a block that may be among the best: score at least ``threshold``, and the postings read.

    ``probe`` looks at the chunk with the greatest bound only.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64), 0
    here = [t in block.row for t in query.tolist()]
    if not any(here):
        return none
    place = np.full(len(query), -1)
    place[here] = np.arange(sum(here))
    own = query[here]
    top = term_max[[block.row[t] for t in own.tolist()]]
    bound = top.sum(0)
    # Disjoint pairs, those that save most first.
    picked: list[tuple[int, int, np.ndarray]] = []
    if use_pairs and len(pairs):
        mine = pairs[(place[pairs[:, 1]] >= 0) & (place[pairs[:, 2]] >= 0)]
        if len(mine):
            a, b = place[mine[:, 1]], place[mine[:, 2]]
            saved = np.minimum(top[a] + top[b] - pair_max[mine[:, 0]], np.minimum(top[a], top[b]))
            total, used = saved.sum(1), set()
            for k in np.argsort(-total, kind="stable").tolist():
                if not total[k]:
                    break
                if a[k] not in used and b[k] not in used:
                    used |= {a[k], b[k]}
                    picked.append((int(a[k]), int(b[k]), saved[k]))
                    bound = bound - saved[k]
    if probe:
        alive = np.zeros(block.chunks, bool)
        alive[bound.argmax()] = True
    else:
        alive = bound >= threshold
    if not alive.any():
        return none
    order = np.argsort(-top.max(1), kind="stable")
    turn = np.empty(len(own), np.int64)
    turn[order] = np.arange(len(own))
    # rest[i]: combined bound of the terms from turn i on, by chunk
    rest = np.concatenate([np.cumsum(top[order][::-1], 0)[::-1], np.zeros((1, block.chunks), np.int64)])
    for a, b, saved in picked:
        rest[: min(turn[a], turn[b]) + 1] -= saved
    chunk_of = np.arange(block.n) // CHUNK
    live = np.flatnonzero(alive[chunk_of])
    score, read = np.zeros(block.n, np.int64), 0
    is_live = np.zeros(block.n, bool)
    is_live[live] = True
    for i, k in enumerate(order.tolist()):
        ords, values = block.postings(int(own[k]))
        if 8 * len(live) < len(ords):  # few are left: look them up
            at = np.searchsorted(ords, live)
            at[at == len(ords)] = 0
            hit = ords[at] == live
            score[live[hit]] += values[at[hit]]
            read += len(live)
        else:
            hit = is_live[ords]
            score[ords[hit]] += values[hit]
            read += len(ords)
        keep = score[live] + rest[i + 1][chunk_of[live]] >= threshold
        if not keep.all():
            is_live[live[~keep]] = False
            live = live[keep]
            if not len(live):
                return np.empty(0, np.int64), np.empty(0, np.int64), read
    live = live[score[live] >= threshold]
    return live, score[live], read


def weigh(index: DataFrame, plan: Plan) -> DataFrame:
    """Per block the impacts of the plan's terms, their maxima by chunk and the pairs' intersection lists."""
    kind = index.schema["docs"].dataType.simpleString()
    sent = index.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("sizes", "terms", "starts", "ords", "tfs")}
                block = Block.weighed(plan, np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["terms"], U), np.frombuffer(row["starts"], "<i4").astype(np.int64), np.frombuffer(row["ords"], "<u2"), np.frombuffer(row["tfs"], "<i4"))
                if not len(block.own):
                    continue
                joint = block.pair_maxima(plan.pairs)
                pair, chunk = np.nonzero(joint)
                columns = [block.own.astype("<i4"), block.starts.astype("<i4"), block.ords.astype("<u2"), block.values.astype("<i8"), pair.astype("<i4"), chunk.astype("<u2"), joint[pair, chunk].astype("<i8")]
                yield pa.RecordBatch.from_arrays([batch.column("docs").slice(i, 1), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], ["docs", "own", "starts", "ords", "impacts", "pair", "chunk", "joint"])

    return index.select("docs", "sizes", "terms", "starts", "ords", "tfs").mapInArrow(run, f"docs {kind}, own binary, starts binary, ords binary, impacts binary, pair binary, chunk binary, joint binary")


def _scan(weighed: DataFrame, plan: Plan, thresholds: np.ndarray | None, top: int, use_pairs: bool = True) -> DataFrame:
    """(query, doc_id, score) of the best documents of every task; a probe where no thresholds are given."""
    sent = weighed.sparkSession.sparkContext.broadcast((plan, thresholds))
    kind = weighed.schema["docs"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, known = sent.value
        least = np.ones(len(plan.queries), np.int64) if known is None else known.copy()
        best: dict[int, list[tuple[np.ndarray, pa.Array]]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("own", "<i4"), ("starts", "<i4"), ("ords", "<u2"), ("impacts", "<i8"), ("pair", "<i4"), ("chunk", "<u2"), ("joint", "<i8"))}
                docs = batch.column("docs").slice(i, 1).flatten()
                block = Block(len(docs), row["own"].astype(np.int64), row["starts"].astype(np.int64), row["ords"].astype(np.int64), row["impacts"])
                term_max, pair_max = block.term_maxima(), np.zeros((len(plan.pairs), block.chunks), np.int64)
                pair_max[row["pair"], row["chunk"]] = row["joint"]
                for q, (query, pairs) in enumerate(zip(plan.queries, plan.query_pairs)):
                    ords, score, _ = best_of(block, query, pairs, term_max, pair_max, int(least[q]), known is None, use_pairs)
                    if len(ords) > top:  # ties at the last place stay
                        keep = score >= np.partition(score, len(score) - top)[len(score) - top]
                        ords, score = ords[keep], score[keep]
                    if len(ords):
                        held = best.setdefault(q, [])
                        held.append((score, docs.take(pa.array(ords))))
                        if len(held) > 1:
                            best[q] = held = [_best(held, top)]
                        if len(held[0][0]) >= top:
                            least[q] = max(least[q], int(held[0][0].min()))
        for q, held in best.items():
            score, docs = _best(held, top)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), q)), docs, pa.array(score)], ["query", "doc_id", "score"])

    return weighed.mapInArrow(run, f"query long, doc_id {kind}, score long")


def _best(held: list[tuple[np.ndarray, pa.Array]], top: int) -> tuple[np.ndarray, pa.Array]:
    """The ``top`` best of several lists by score, then id; a null id comes last."""
    score, docs = np.concatenate([s for s, _ in held]), pa.concat_arrays([d for _, d in held])
    order = pa.compute.sort_indices(pa.table({"s": score, "d": docs}), [("s", "descending"), ("d", "ascending")], null_placement="at_end")[:top]
    return score[order.to_numpy()], docs.take(order)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.select("query", "doc_id", "score").withColumn("rank", place).where(F.col("rank") <= top)


def search(index: DataFrame, queries: DataFrame, top: int = TOP, use_pairs: bool = True, at_once: int = QUERY_TERMS) -> DataFrame:
    """The ``top`` best documents of ``index`` for every query: item_id, rank, doc_id, score (above 0).

    Queries without terms, or without a document that holds one, have no rows; queries that repeat an item_id are ranked each.
    Queries are dealt into goes of about ``at_once`` terms, so what is broadcast is bound by it.
    """
    spark = index.sparkSession
    kinds = queries.schema["item_id"].dataType.simpleString(), index.schema["docs"].dataType.elementType.simpleString()
    asked_at = scratch_path(spark, "queries")
    asked = materialize_at(query_terms(queries), asked_at)
    facts = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    goes = max(1, math.ceil((asked.agg(F.sum("n")).first()[0] or 0) / at_once))
    parts = []
    for go in range(goes):
        rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(goes)) == go).orderBy("query").collect()
        if not rows or not facts[0]:
            continue
        own = [np.frombuffer(r["terms"], U) for r in rows]
        terms = np.unique(np.concatenate(own))
        plan = Plan(own, terms, _frequencies(index, terms), *facts)
        at = scratch_path(spark, "impacts")
        weighed = materialize_at(weigh(index, plan), at)
        last = _ranked(_scan(weighed, plan, None, top, use_pairs), top).where(F.col("rank") == top).select("query", "score").collect()
        least = np.ones(len(own), np.int64)
        for r in last:
            least[r["query"]] = max(1, r["score"])
        found_at = scratch_path(spark, "found")
        found = materialize_at(_scan(weighed, plan, least, top, use_pairs), found_at)
        drop_written(spark, at)
        named = spark.createDataFrame(pd.DataFrame({"query": range(len(rows)), "item_id": pd.Series([r["item_id"] for r in rows], dtype=object)}), f"query long, item_id {kinds[0]}")
        parts.append(_ranked(found, top).join(F.broadcast(named), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    drop_written(spark, asked_at)
    if not parts:
        return spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Documents of the whole index that hold each term."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for held, starts in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist()):
                held, width = np.frombuffer(held, U), np.diff(np.frombuffer(starts, "<i4"))
                at = np.searchsorted(held, sent.value)
                at[at == len(held)] = 0
                df += np.where(held[at] == sent.value, width[at], 0)
        place = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(df[place])], ["place", "df"])

    out = np.zeros(len(terms), np.int64)
    for r in index.select("terms", "starts").mapInArrow(run, "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).collect():
        out[r["place"]] = r["df"]
    return out


def rank_documents(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """Index all documents and search them for every query; see ``search``."""
    spark = docs.sparkSession
    at = scratch_path(spark, "index")
    index = materialize_at(build_index(docs), at)
    out = search(index, queries, top)
    drop_written(spark, at)
    return out


def search_sql(top: int = TOP) -> str:
    """The same rows in DuckDB SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = f"unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
    return f"""with d as (select row_number() over () as r, doc_id, text from documents),
        p as (select r, term, count(*) as tf from (select r, {terms} as term from d) group by all),
        n as (select r, cast(sum(tf) as bigint) as n from p group by r),
        s as (select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from n),
        f as (select term, cast(floor(1000 * ln(cast(2 * n_docs + 2 as double) / (2 * count(*) + 1))) as bigint) as w from p, s group by term, n_docs),
        i as (select distinct q, item_id, term from (select row_number() over () as q, item_id, {terms} as term from benchmark)),
        hit as (select q, item_id, r, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + 90 * n * n_docs // n_terms)))) as bigint) as score
            from i join f using (term) join p using (term) join n using (r), s group by q, item_id, r)
        select item_id, cast(rank as int) as rank, doc_id, score from
            (select item_id, doc_id, score, row_number() over (partition by q order by score desc, doc_id) as rank from hit join d using (r) where score > 0)
        where rank <= {top}"""
