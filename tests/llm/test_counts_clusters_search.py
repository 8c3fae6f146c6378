"""Token counts, centroid clustering and ranked search against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import compare

from panelloom.llm import centroid_clustering as cc
from panelloom.llm import ranked_search as rs
from panelloom.llm import token_counts as tc
from panelloom.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, rank string, score string, n_tokens string, cluster string, query string"


def texts() -> list[tuple]:
    rng = random.Random(11)
    signs = " '  \n\t\r\x1cabsStTrevldmLé1²¼½_-.,x\xa0‘中ªºµʰ"
    out = [None, "", " ", "it's we'll 'style 'S don''t I've'", "a<|endoftext|>b <|endoftext|>", "x" * 5000, "中文 текст ١", "no\r\n\r\n  end  "]
    out += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    out += [" ".join(rng.choice(["the", "of", "alpha", "Beta", "gamma7", "dé"]) for _ in range(n)) for n in (5, 80, 700, 700)]
    return out


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, None, "x", "y", "z", "q") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[8], rows[8], (None, "the null id", *[None] * 5), (None, None, *[None] * 5)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- token counts


def library_counts(rows, name):
    import public_tokenizers

    if name.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        encode = own.encode
    else:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(public_tokenizers.path(name))
        encode = lambda t: own.encode(t, add_special_tokens=False).ids
    return Counter((r["doc_id"], len((r["text"] or "").encode()), n := len(encode(r["text"] or "")), n > 512) for r in rows)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(awkward, name):
    got = tc.count_tokens(awkward, name).collect()
    assert Counter(map(tuple, got)) == library_counts(awkward.collect(), name)


def test_counts_of_the_registered_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert Counter(map(tuple, QUERIES["op11_two_tier_counts"](spark, sf_dir).collect())) == library_counts(docs.collect(), "byte_bpe_50k.json")


def test_counts_of_an_empty_table(empty):
    assert tc.count_tokens(empty).collect() == []


def test_pre_tokens_are_the_splitters():
    model, rng = tc.counter("byte_bpe_50k.json"), random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(" '  \n\tstmdrevlLTxé1²_.") for _ in range(rng.randint(1, 25)))
        if not tc._SAFE.fullmatch(text):
            continue
        _, joined, start, end = model._safe([text], [0])
        assert list(zip(start.tolist(), end.tolist())) == [at for _, at in model.library.pre_tokenizer.pre_tokenize_str(text)], text


def test_long_texts_are_cut_without_changing_counts(monkeypatch):
    monkeypatch.setattr(tc, "BLOCK", 40)
    model = tc.counter("byte_bpe_50k.json")
    for text in texts():
        if text and "<|" not in text:
            assert "".join(tc.in_parts(text)) == text
            total = sum(int(model.lengths(tc._keys(j, s, e), j, s, e).sum()) for _, j, s, e in model.parts([text]))
            assert total == model.whole([text])[0]


def test_table_finds_its_entries_and_no_others():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 3000):
        keys = np.unique(rng.integers(1, 1 << 63, n).astype(np.uint64))
        table = tc.compact_table(keys, np.arange(len(keys)))
        n_of, found = tc.probe(table, keys)
        assert found.all() and (n_of == np.arange(len(keys))).all()
        assert not tc.probe(table, keys ^ np.uint64(1 << 63))[1].any()
        assert len(table[0]) >= 2 * len(keys)


def test_table_decides_about_speed_alone(awkward):
    plain = Counter(map(tuple, tc.count_tokens(awkward, entries=64).collect()))
    assert plain == Counter(map(tuple, tc.count_tokens(awkward).collect()))
    keys, lengths = tc.frequent_lengths(awkward, "byte_bpe_50k.json")
    model = tc.counter("byte_bpe_50k.json")
    near = tc._keys(" the", np.array([0]), np.array([4]))
    assert near[0] in keys and lengths[list(keys).index(near[0])] == 1 and model.piece(" the") == 1


# -- centroid clustering


def lloyd(rows, k, rounds, width, seed):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [nearest(v) for _, v in kept]
    inertia = Counter()
    for d, j in last:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(kept, last))


VECTORS = "vec_id long, embedding array<float>, label int, cluster int, distance string, own string, q string"


@pytest.mark.parametrize("case", ["mixed", "ties", "few", "none", "far"])
def test_clusters_equal_plain_rounds(spark, case):
    rng = random.Random(7)
    width = 6
    if case == "mixed":
        rows = [(i, [rng.gauss(3 * (i % 5), 1) for _ in range(width)]) for i in range(400)]
        rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [None] + [1.0] * 5), (904, [float("nan")] * width), (905, [float("inf")] * width), (None, [0.5] * width), rows[0], rows[0]]
    elif case == "ties":
        rows = [(i, [float(rng.randint(-1, 1)) for _ in range(width)]) for i in range(300)]
    elif case == "few":
        rows = [(i, [float(i), -1.5, 0.0, 0.25, 1e-4, -1e-4]) for i in range(3)]
    elif case == "none":
        rows = [(1, None), (2, [1.0])]
    else:  # one cluster takes nearly all, some stay empty
        rows = [(i, [1.0] * width) for i in range(200)] + [(1000 + i, [rng.uniform(-9000, 9000) for _ in range(width)]) for i in range(12)]
    df = spark.createDataFrame([(i, v, 1, 2, "d", "o", "q") for i, v in rows], VECTORS).repartition(5)
    exact = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    work = []
    got = Counter(map(tuple, cc.cluster(df, 8, 10, width, 3, work).collect()))
    assert got == lloyd(exact, 8, 10, width, 3)
    if case == "mixed":
        assert sum(work) < 0.6 * 11 * 8 * sum(got.values())


def test_bounds_use_the_displacement_not_the_path():
    """A centroid that went away and came back leaves its bound tight, so nothing is computed again."""
    q = np.array([[0, 0], [100, 0]])
    history = np.array([[[0, 0], [100, 0]], [[0, 40], [100, 0]], [[0, 0], [100, 0]]])
    own, far, when = np.array([-1, -1]), np.zeros((2, 2), np.int64), np.zeros((2, 2), np.int64)
    own, n = cc.assign(q, own, far, when, history[:1])
    assert n == 4 and own.tolist() == [0, 1]
    own, n = cc.assign(q, own, far, when, history)
    assert n == 0 and own.tolist() == [0, 1]


def test_clustering_query_matches_sql(spark, duck, sf_dir):
    name = "op12_ns_bounds_clustering"
    assert compare(spark, duck, QUERIES[name], ORACLES[name], sf_dir) == ""


# -- ranked search


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranking(rows, items, top=10):
    docs = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    n_docs, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = Counter()
    for item, text in items:
        found = []
        for doc, c in docs:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        for place, (score, none, doc) in enumerate(sorted(found)[:top], 1):
            out[item, place, None if none else doc, -score] += 1
    return out


ITEMS = "item_id long, text string, rank string, doc_id string, terms string"


def test_search_equals_brute_force(spark, awkward, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    prose = [(1000 + i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.choice([3, 20, 60])))) for i in range(700)]
    prose += [(3000 + i, "W1 w2 w3") for i in range(40)]  # equal scores
    docs = awkward.unionByName(spark.createDataFrame([(i, t, *[None] * 5) for i, t in prose], DOCS))
    items = [(1, "w1 w2 W3"), (2, "w50 w51 w52 w2 w3 w4 w5 w6"), (3, None), (4, ""), (5, "nowhere"), (6, "w7"), (None, "w8 w9"), (1, "w1 w2 W3"), (7, " ".join(words)), (8, "the of dé 中文")]
    asked = spark.createDataFrame([(i, t, "r", "d", "t") for i, t in items], ITEMS)
    want = ranking([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    for size, at_once in ((4096, 1 << 18), (90, 12)):
        monkeypatch.setattr(rs, "BLOCK_DOCS", size)
        index = rs.materialize_at(rs.build_index(docs), rs.scratch_path(spark, "index"))
        assert Counter(map(tuple, rs.search(index, asked, at_once=at_once).collect())) == want
        assert Counter(map(tuple, rs.search(index, asked, use_pairs=False).collect())) == want


def test_search_of_empty_tables(spark, awkward, empty):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "the of", "r", "d", "t")], ITEMS)
    assert rs.rank_documents(empty, some).collect() == rs.rank_documents(awkward, none).collect() == []
    assert rs.rank_documents(awkward, some).columns == ["item_id", "rank", "doc_id", "score"]


def test_pairs_tighten_bounds_and_keep_results():
    """Two frequent terms that never meet: single maxima promise their sum everywhere, the pair's list denies it."""
    docs = [b"alpha filler"] * 2000 + [b"beta filler"] * 2000 + [b"alpha beta"] * 12
    order = np.random.default_rng(1).permutation(4000).tolist() + list(range(4000, 4012))
    row, term, tf = rs._postings([docs[i] for i in order])
    place, start = np.lexsort((row, term)), None
    row, term, tf = row[place], term[place], tf[place]
    start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    query = np.unique(rs.term_hashes([b"alpha beta"])[0])
    plan = rs.Plan([query], query, np.array([2012, 2012]), 4012, 8024)
    block = rs.Block.weighed(plan, np.full(4012, 2), term[start], np.append(start, len(term)), row.astype(np.uint16), tf)
    top, joint = block.term_maxima(), block.pair_maxima(plan.pairs)
    least = int(top.max(1).sum())
    found = [rs.best_of(block, plan.queries[0], plan.query_pairs[0], top, joint, least, False, use) for use in (True, False)]
    assert found[0][0].tolist() == found[1][0].tolist() == list(range(4000, 4012))
    assert found[0][2] * 10 < found[1][2]


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = b" ".join(b"Word%d-x" % (i % 700) for i in range(5000))
    whole = rs.term_hashes([text])[0]
    monkeypatch.setattr(rs, "_PART", 1000)
    assert (np.concatenate(list(rs._text_terms(text))) == whole).all()
    row, term, tf = rs._postings([b"a b a", text, b""])
    assert Counter(dict(zip(term[row == 1].tolist(), tf[row == 1].tolist()))) == Counter(whole.tolist()) and tf[row == 0].tolist().count(2) == 1


def test_search_query_matches_sql(spark, duck, sf_dir):
    name = "op13_pair_bound_search"
    assert compare(spark, duck, QUERIES[name], ORACLES[name], sf_dir) == ""
