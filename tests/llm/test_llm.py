"""The dealt operators against plain versions, on the smallest tables and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.llm import (
    bloom_lm, decontaminate, lattice_dedup, ngram_join, packing, phrase_dedup, pii, quality, sentence_dedup, warc,
)
from panelloom.llm.components import connected_components
from panelloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, row string, md5 string, n_words string"


def awkward() -> list[tuple]:
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = [" ".join(rng.choice(words) for _ in range(n)) + "." for n in (3, 40, 40, 300, 9000)]
    near = prose[3].split()
    near[150] = "changed"
    passage = ". ".join(" ".join(rng.choice(words) for _ in range(14)) for _ in range(6)) + ". "
    texts = [None, "", " \t\n", "One", "one ONE", *prose, prose[1], " ".join(near), passage + prose[1], "Start. " + passage + prose[2], "ab" * 700, "一² ١ <|endoftext|>\x1c it's"]
    rows = [(i, t, None, "x", "y", "z") for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[1], (None, prose[2], None, None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def counted(rows):
    return Counter(map(tuple, rows))


class Union(dict):
    def top(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self[max(a, b)] = min(a, b)


# -- 1: packing


def check_packing(df, capacity, vocabulary="byte_bpe_50k"):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    tokenizer.encode_special_tokens = True
    wanted = Counter()
    for doc, text in texts(df):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        cut = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            wanted[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = packing.pack(df, capacity).collect()
    assert counted(r[:5] for r in got) == wanted
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at <= capacity
    return len(by), sum(n * c for (*_, n, _), c in wanted.items())


def test_packing(docs, odd, empty):
    sequences, tokens = check_packing(docs, 2048)
    assert sequences <= 1.05 * tokens / 2048 + 1
    check_packing(odd, 64)
    assert packing.pack(empty).count() == 0
    assert sum(len(r["ids"]) for r in packing.pack(odd, 64, with_ids=True).collect()) == sum(r["length"] for r in packing.pack(odd, 64).collect())


def test_sweep_prefers_the_tightest_gap():
    out = packing.sweep([("d", 5, 0, 1, 0, 0), ("g", 9, 0, 1, 0, 0), ("g", 6, 1, 1, 0, 0)], 10)
    assert ("p", 5, 1, 1, 0, 4) in out and ("g", 9, 0, 1, 0, 0) in out and ("u", 1, 1, 1, 0, 0) in out


# -- 2: Jaccard join


def shingles(text, n):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, min(len(words), 1)))}


def crowd() -> list[tuple]:
    """Variants of two texts around the threshold, and variants of variants."""
    rng = random.Random(9)
    bases = [[f"w{rng.randrange(4000)}" for _ in range(n)] for n in (150, 150)]
    bases[1][:40] = bases[0][:40]
    rows = []
    for k in range(260):
        words = list(bases[k % 2] if k < 220 else rows[rng.randrange(200)][1].split())
        for _ in range(rng.randint(1, 7)):
            words[rng.randrange(len(words))] = rng.choice([f"e{rng.randrange(9)}", f"u{rng.random()}"])
        rows.append((k, " ".join(words[: rng.choice([150, 150, 130])]), None, None, None, None))
    return rows


@pytest.mark.parametrize("n,threshold", [(4, 85), (5, 80), (2, 50)])
def test_jaccard(spark, docs, odd, empty, n, threshold):
    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"]), empty, spark.createDataFrame(crowd(), SCHEMA)):
        sets = {d: shingles(t, n) for d, t in texts(df)}
        union, by = Union(), defaultdict(list)
        for d, s in sets.items():
            for x in s:
                by[x].append(d)
        for a, b in {(min(a, b), max(a, b)) for own in by.values() for a in own for b in own if a != b}:
            both = len(sets[a] & sets[b])
            if 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                union.join(a, b)
        got = ngram_join.jaccard_components(df, n, threshold).collect()
        assert counted(r[:3] for r in got) == Counter((d, len(s), union.top(d)) for d, s in sets.items())


def test_keep_one(odd):
    kept = ngram_join.keep_one(odd, 5, 80)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    # Row 10 repeats 6, row 11 is near 8; the repeated rows of 6 and 1 leave one; without an id row 7's text stays as 7.
    assert [i[1] for i in ids if not i[0]] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13, 14, 15]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (103, 101), (None, 4)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


# -- 3: LM scoring


@pytest.mark.parametrize("vocabulary", [10**6, 0])
def test_lm(docs, odd, empty, vocabulary):
    for df in (docs, odd):
        rows = [(d, [*(w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w), None]) for d, t in texts(df)]
        held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
        c = Counter(w for d, ws in rows if not held(d) for w in ws)
        total = sum(c.values())
        got = bloom_lm.score(df, vocabulary).collect()
        exact = lambda r: (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
        wanted = Counter((d, held(d), len(ws), sum(c[w] > 0 for w in ws), total, round(sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in ws), 6)) for d, ws in rows)
        assert Counter(map(exact, got)) == wanted
        assert all(r["score"] < 0 for r in got)
    assert bloom_lm.score(empty, vocabulary).count() == 0


def test_lm_prefers_seen_text(docs):
    got = bloom_lm.score(docs).collect()
    assert sum(r["score"] for r in got if not r["held_out"]) > sum(r["base_score"] for r in got if not r["held_out"])


@pytest.mark.parametrize("vocabulary", [10**6, 0])
def test_lm_asks_stored_filters_beyond_the_bound(docs, odd, empty, vocabulary):
    """The same scores whether the filters are broadcast or too large for that."""
    plain = lambda r: (r["doc_id"], r["held_out"], *r[2:5], round(r["base_score"], 7), round(r["score"], 7))
    for df in (docs, odd):
        asked, sent = (Counter(map(plain, bloom_lm.score(df, vocabulary, bound).collect())) for bound in (0, 1 << 30))
        assert not asked - sent and not sent - asked
    assert bloom_lm.score(empty, vocabulary, 0).count() == 0


def test_filter_counts():
    rng = np.random.default_rng(3)
    keys, n = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64)), None
    n = rng.integers(1, 300, len(keys))
    bits = bloom_lm.filter_bits(keys, n)
    model = bloom_lm.Filter.of(1, [(0, bits)], len(bits))
    found = model.count(keys)
    assert (found >= np.where(n > 1, 1.5 * 2.0 ** np.floor(np.log2(n)), 1)).all()
    assert (model.count(rng.integers(0, 2**63, 5000).astype(np.uint64)) > 0).mean() < 0.1
    apart = [(s, bloom_lm.filter_bits(k, c)) for s in (0, 3) for at in [bloom_lm._segment(keys, 4) == s] for k, c in [(keys[at], n[at])]]
    several, here = bloom_lm.Filter.of(4, apart, sum(len(b) for _, b in apart)), bloom_lm._segment(keys, 4)
    assert (several.count(keys)[np.isin(here, (0, 3))] > 0).all() and not several.count(keys)[np.isin(here, (1, 2))].any()


# -- 4: WARC


def test_warc(spark):
    page = "<html lang=EN><head><title>A &amp; B</title><script>x<b></script></head><body><p>One<p>two &lt;three <a href='/x?a=1&amp;b=2'>link</a><!-- no --></body>"
    pages = spark.createDataFrame([(1, "http://a/", page), (2, None, None), (2, None, None), (None, "u", "")], "page_id long, url string, html string")
    rows = warc.derive(warc.responses(pages)).collect()
    assert len(rows) == 12 and Counter(r["record_type"] for r in rows) == {"response": 4, "metadata": 4, "conversion": 4}
    own = {r["record_type"]: r for r in rows if r["page_id"] == 1}
    assert own["conversion"]["block"] == "A & B\nOne\ntwo <three link"
    assert own["metadata"]["refers_to"] == own["conversion"]["refers_to"] == own["response"]["record_id"]
    assert own["conversion"]["source_digest"] == own["response"]["payload_digest"] == warc.digest(page.encode())
    assert '"links": ["/x?a=1&b=2"]' in own["metadata"]["block"] and '"lang": "en"' in own["metadata"]["block"]
    assert all(r["content_length"] == len(r["block"].encode()) and r["block_digest"] == warc.digest(r["block"].encode()) for r in rows)
    record = warc.serialize(warc.derive(warc.responses(pages))).where("page_id = 1").orderBy("record_id").first()["record"]
    assert record.startswith("WARC/1.1\r\nWARC-Type: ") and record.endswith("\r\n\r\n")
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


# -- 5: decontamination


def contaminated(text, items, window):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    words, hit, found = cut(text), set(), set()
    for item, own in items:
        own = cut(own)
        for run in {tuple(own[i : i + window]) for i in range(max(len(own) - window + 1, min(len(own), 1)))}:
            for i in range(len(words) - len(run) + 1):
                if tuple(words[i : i + len(run)]) == run:
                    hit.update(range(i, i + len(run)))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, docs, sf_dir):
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op5_benchmark_decontamination"](spark, sf_dir).collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    own = texts(docs)
    for d, t in own[:60] + [x for x in own if got[x[0]][1]][:15]:
        assert got[d] == contaminated(t, items, 10), d


def test_decontamination_of_awkward_rows(spark, odd, empty, monkeypatch):
    long = awkward()[7][1]
    items = [(1, "One"), (2, None), (3, "..."), (10, long.split(".")[0][:80]), (10, long), (None, "changed")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    wanted = Counter((d, *contaminated(t, [(i if i is not None else "null", x) for i, x in items if x], 10)) for d, t in texts(odd))
    for shard in (400_000, 60):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
        found = decontaminate.find_passages(odd, benchmark)
        assert found.count() == odd.count()
        rows = found.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), F.col("n_hit") > 0).collect()
        assert counted(rows) == wanted
    spot = found.where("doc_id = 3").first()
    assert [spot["text"][s["start"] : s["end"]] for s in spot["spans"]] == ["One"]
    kept = decontaminate.decontaminate(odd, benchmark)
    assert kept.columns == odd.columns and kept.where("doc_id = 3").count() == 0
    assert decontaminate.find_passages(odd, benchmark.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.find_passages(empty, benchmark).count() == 0


# -- 6: repeated strings


def repeats(rows, length):
    seen = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = Counter()
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out[d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("length,part", [(200, 1 << 20), (60, 500)])
def test_repeated_strings(docs, odd, empty, length, part, monkeypatch):
    monkeypatch.setattr(phrase_dedup, "PART", part)
    rng = random.Random(2)
    for df in (docs, odd):
        rows = [(d, t.encode()) for d, t in texts(df)]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        got = phrase_dedup.remove_repeats(df, length).select(names).collect()
        assert counted(got) == repeats(rows, length)
    shared = "".join(rng.choice("abcdefgh") for _ in range(400))
    cuts = [(i, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 90))) + shared[a : a + n] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 90)))) for i in range(60) for a, n in [(rng.randint(0, 250), rng.randint(50, 260))]]
    df = docs.sparkSession.createDataFrame(cuts, "doc_id long, text string")
    assert counted(phrase_dedup.remove_repeats(df, length).select(names).collect()) == repeats([(d, t.encode()) for d, t in cuts], length)
    full = phrase_dedup.remove_repeats(odd, length, with_text=True).collect()
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in full) and len(full) == odd.count()
    assert phrase_dedup.remove_repeats(empty, length).count() == 0


# -- 7: embeddings


def test_lattice_decoding():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 2
    near = lattice_dedup.decode_e8(x) / 2
    for row, point in zip(x, near):
        assert (np.allclose(point, np.rint(point)) or np.allclose(point - 0.5, np.rint(point - 0.5))) and point.sum() % 2 < 1e-9
        assert all(((row - point - m) ** 2).sum() >= ((row - point) ** 2).sum() - 1e-9 for m in lattice_dedup._minimal())
    assert len(lattice_dedup._minimal()) == 240


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(80, 24))
    vectors = [base[i % 80] + rng.normal(size=24) * rng.choice([0.02, 0.1, 0.15]) for i in range(500)]
    rows = [(i, [float(np.float32(x)) for x in v], i % 80 % 3) for i, v in enumerate(vectors)]
    rows += [(500 + i, rows[0][1], 0) for i in range(4)] + [(600, None, 1), (601, [0.0] * 24, 1), (602, [None] + [1.0] * 23, 1), (603, [float("nan")] + [1.0] * 23, 1), (604, rows[1][1], None), (605, [1.0, 2.0], 0), (606, [2.0, 4.0], 0), (607, [], 0), (610, rows[9][1], 0), (610, rows[9][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("x"))
    lattice_dedup_block, lattice_dedup.BLOCK = lattice_dedup.BLOCK, 3
    try:
        got = lattice_dedup.near_duplicates(df).collect()
    finally:
        lattice_dedup.BLOCK = lattice_dedup_block
    good = [(k, i, np.array(v, float), lab) for k, (i, v, lab) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v) and lab is not None]
    union, links = Union(), Counter()
    for x, (k, i, v, lab) in enumerate(good):
        for m, j, w, other in good[:x]:
            if lab == other and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[k] += 1
                links[m] += 1
                union.join(("c", k), ("c", m))
    assert sum(links.values()) > 500
    found = sum(r["n_links"] for r in got)
    assert found <= sum(links.values()) and found >= 0.97 * sum(links.values())
    by_id = {r["vec_id"]: r for r in got}
    assert len(got) == len(rows) and all(by_id[i]["n_links"] == 0 for i in (600, 601, 602, 603, 604, 607)) and by_id[606]["component_id"] == 605
    assert by_id[500]["n_links"] >= 4 and by_id[500]["component_id"] == 0 and not by_id[500]["kept"]
    assert lattice_dedup.near_duplicates(df.limit(0)).count() == 0


# -- 8: sentences


def sentence_oracle(rows):
    occurrences = defaultdict(set)
    cuts = {}
    for key in set(rows):
        text = key[1].encode()
        cuts[key] = own = [text[a:b] for a, b in sentence_dedup.sentences(text)]
        assert b"".join(own) == text
        words = [s.lower().split() for s in own]
        for i in range(len(own)):
            for j in range(i + sentence_dedup.MIN_SENTENCES, len(own) + 1):
                run = [w for s in words[i:j] for w in s]
                if len(run) >= sentence_dedup.MIN_WORDS and words[i]:
                    occurrences[tuple(run)].add((key, i, j))
                    break
    gone = defaultdict(set)
    order = lambda o: (o[0][0] is None, o[0][0] or 0, hashlib.md5(o[0][1].encode()).digest(), o[1])
    for own in occurrences.values():
        for key, i, j in sorted(own, key=order)[1:]:
            gone[key].update(range(i, j))
    return Counter((d, len(cuts[d, t]), len(gone[d, t]), b"".join(s for k, s in enumerate(cuts[d, t]) if k not in gone[d, t]).decode()) for d, t in rows)


def test_sentences(docs, odd, empty):
    for df in (docs, odd):
        got = sentence_dedup.repeated_sentences(df).select("doc_id", "n_sentences", "n_removed", "kept_text").collect()
        assert counted(got) == sentence_oracle(texts(df))
    assert sentence_dedup.repeated_sentences(empty).count() == 0


def every_run_oracle(rows):
    """As ``sentence_oracle``, but over all runs, however long."""
    occurrences, cuts, gone = defaultdict(set), {}, defaultdict(set)
    for key in set(rows):
        text = key[1].encode()
        cuts[key] = own = [text[a:b] for a, b in sentence_dedup.sentences(text)]
        words = [s.lower().split() for s in own]
        for i in range(len(own)):
            run = list(words[i])
            for j in range(i + 1, len(own)):
                run += words[j]
                if len(run) >= sentence_dedup.MIN_WORDS and words[i]:
                    occurrences[hashlib.md5(b" ".join(run)).digest()].add((key, i, j + 1))
    order = lambda o: (o[0][0] is None, o[0][0] or 0, hashlib.md5(o[0][1].encode()).digest(), o[1])
    for own in occurrences.values():
        for key, i, j in sorted(own, key=order)[1:]:
            gone[key].update(range(i, j))
    return Counter((d, len(cuts[d, t]), len(gone[d, t]), b"".join(s for k, s in enumerate(cuts[d, t]) if k not in gone[d, t]).decode()) for d, t in rows)


def test_sentences_cover_every_repeated_run(spark, docs, odd, sf_dir):
    copies = [(1, "A b c. D e f g h i. J k l. M."), (2, "A b c. D e f g h i. J k l. M."), (3, "Own. A b c. D e f g h i. J k l. M. Other.")]
    small = spark.createDataFrame(copies, "doc_id long, text string")
    names = ["doc_id", "n_sentences", "n_removed", "kept_text"]
    got = {r["doc_id"]: r["kept_text"] for r in sentence_dedup.repeated_sentences(small, True).collect()}
    assert got == {1: copies[0][1], 2: "", 3: "Own. Other."}
    for df in (small, odd):
        assert counted(sentence_dedup.repeated_sentences(df, True).select(names).collect()) == every_run_oracle(texts(df))
    wanted, found = every_run_oracle(texts(docs)), counted(QUERIES["op8_sentence_spans"](spark, sf_dir).collect())
    assert not wanted - found and not found - wanted


# -- 9: personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data(spark, docs, odd, empty, sf_dir):
    rng = random.Random(9)
    made = ["".join(rng.choice("a1.@+-( )5 4") for _ in range(60)) for _ in range(3000)]
    made += ["x é 4111 1111 1111 1111 1.2.3.4.5.6.7.8 +1 (269) 555-3296@a.b.c @x.y a@b@c.d 0255.1.1.0001"]
    for text in made + [t for _, t in texts(docs)]:
        assert pii.base_spans(text) == plain_spans(text), text
    got = QUERIES["op9_pii_weak_supervision"](spark, sf_dir).collect()
    assert len(got) == docs.count()
    assert all(set(r["spans"].split(",")) >= set(pii.listed(plain_spans(t)).split(",")) for (_, t), r in zip(sorted(texts(docs)), sorted(got)) if plain_spans(t))
    assert pii.annotate(odd, pii.fit(pii.vote_counts(odd))).count() == odd.count()
    assert pii.fit(pii.vote_counts(empty)) == {} and pii.annotate(empty, {}).count() == 0


def test_weak_supervision_adds_and_redacts(spark):
    texts = [f"please call me, phone 555-{i:03d}-{i + 4000}, or mail a{i}@b.org or bob{i} (at) site (dot) com" for i in range(50)] + [f"order 123-456-{i + 1000}" for i in range(20)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.fit(pii.vote_counts(df))
    first = pii.annotate(df, model).orderBy("doc_id").first()
    assert first["n_email"] == 1 and first["n_phone"] == 0 and first["spans"].count("email:") == 2
    out = {r["doc_id"]: r["text"] for r in pii.redact(df, model).collect()}
    assert "<EMAIL>" in out[0] and "@" not in out[0] and out[70] is None and out[60] == texts[60]


def test_loose_addresses_need_no_dot_word(spark):
    forms = ["bob{} (at) site.com", "bob{}[at]site.org", "bob{} at site.com"]
    for form in forms:
        own = "write to " + form.format(1)
        found = [(a, k, b) for a, k, b in pii.loose_spans(own, [])]
        assert [own[a:b] for a, _, b in found] == [form.format(1)]
    prose = "we met at home. It rained"
    assert [pii.votes(prose, s, False)[:2] for s in pii.loose_spans(prose, [])] == ["0-"]
    # Beside an unrelated "dot" or not, the same address is found and masked.
    texts = [f"please mail {forms[i % 2].format(i)}" + (" with an anecdote" if i % 4 > 1 else "") for i in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = pii.vote_counts(df)
    assert sum(counts.values()) == 80
    out = [r["text"] for r in pii.redact(df, {k: 1.0 for k in counts}).orderBy("doc_id").collect()]
    assert all(t.startswith("please mail <EMAIL>") for t in out)


# -- 10: quality


def test_quality(spark, docs, odd, empty, sf_dir):
    larger = sf_dir.replace("0.001", "0.01")  # the smallest tables hold out 19 labels only
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op10_quality_trees"](spark, larger).collect()}
    truth = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if r["doc_id"] in got]
    held = [(r["predicted"], q) for r, q in truth if r["held_out"]]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) > 0.9
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    forest = quality.fit(docs, quality.training_rows(labels))
    x = np.array([quality.statistics(t.encode()) for _, t in texts(docs)])
    for row, score in zip(x[:50], forest.score(x)[:50]):
        total = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + (row[f[k]] > t[k])
            total += v[k - len(f)]
        assert math.isclose(score, 1 / (1 + math.exp(-total)))
    scored = quality.score(odd, forest)
    assert scored.count() == odd.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    nothing = quality.fit(docs, labels.limit(0))
    assert quality.score(odd, nothing).agg(F.max("score")).first()[0] == 0.5
    assert quality.quality_filter(empty, labels).count() == 0 and quality.quality_filter(odd, labels).columns == odd.columns
