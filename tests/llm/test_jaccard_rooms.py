"""The n-gram join moves no text that shares no posting and compares nothing that a hub has settled."""

from pyspark.sql import functions as F

from panelloom.llm import ngram_join
from panelloom.session import drop_written, scratch_path


def test_texts_not_asked_for_stay(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    asked = docs.where("doc_id % 40 = 0").select("doc_id")
    got = {r["doc_id"] for r in ngram_join._maybe_asked(docs, asked).collect()}
    assert got >= set(range(0, 4000, 40)) and len(got) < 400
    nobody = docs.select(F.lit(None).cast("long").alias("doc_id"), "text").limit(1)
    assert ngram_join._maybe_asked(nobody, nobody).count() == 1


def test_settled_postings_are_not_open(spark):
    """One member besides the hub, or members of one component: no pair is left, and no text is read."""
    rows = [(1, 10, 20, 0.1, 10), (1, 11, 20, 0.2, 11), (2, 20, 20, 0.1, 20), (2, 21, 20, 0.2, 21), (2, 22, 20, 0.3, 21)]
    held = spark.createDataFrame(rows, "token long, node long, n_shingles long, away double, component long")
    sets = spark.createDataFrame([(n, "no text is asked for") for _, n, *_ in rows], "node long, text string")
    path = scratch_path(spark, "near")
    assert ngram_join._open_pairs(held, sets, 4, 85, path).count() == 0
    assert spark.read.parquet(path).count() == 0
    drop_written(spark, path)


def test_no_whole_set_is_kept(spark):
    """What is fetched of a class is its text and its prefixes, which hold a fifth of its shingles here."""
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(404)))], "doc_id long, text string")
    asked = docs.select(F.lit(7).cast("long").alias("node"), "doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_md5"))
    row = ngram_join._fetch(docs, asked, 5, 80, ngram_join.word_sketches(docs)).first().asDict()
    assert row.pop("node") == 7 and row.pop("text").startswith("w0 w1 ")
    assert set(row) == {"p0", "p1"} and all(len(p) == 81 for p in row.values())
