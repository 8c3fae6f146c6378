"""The page scanner and the records: odd pages, linear time, whole tables."""

import hashlib
import json
import time

import pytest

from panelloom.llm import warc


def test_pages_become_text_title_language_and_links():
    page = """<!DOCTYPE html><HTML class=x lang="de-AT"><head><title a=b> A &amp; B </title><style>p{}</style><script>if (a<b) "</p>"</script ></head>
    <body><!-- <a href="no"> --><p>One <b>two</b>three</p>4 < 5 and 6 <7 <a class=q href='/x?a=1&amp;b=2'>go</a><a href=bare>b</a><a name=n>n</a>
    <a href="v>w">gt</a><noscript><a href=hidden></noscript><div>end"""
    text, facts = warc.scan(page)
    assert facts == {"title": "A & B", "lang": "de-at", "links": ["/x?a=1&b=2", "bare", "v>w"]}
    assert text.split("\n") == ["A & B", "One two three", "4 < 5 and 6 <7 go b n", "gt", "end"]


@pytest.mark.parametrize("page, text, links", [
    ("", "", []), ("no tags at all", "no tags at all", []), ("a<b", "a<b", []), ("x <!-- never closed <p>", "x", []), ("<script>never", "", []),
    ("<a href=\"never closed>t</a>", "t", ["\"never closed"[:6]]), ("1 < 2 > 0", "1 < 2 > 0", []), ("<title>open", "open", []), ("<p>a<p>b</p", "a\nb</p", []),
])
def test_broken_pages(page, text, links):
    got, facts = warc.scan(page)
    assert got == text and facts["title"] is None and facts["links"] == links


@pytest.mark.parametrize("piece", ["<a ", "<title>", "<html ", "<p ", "<script ", "<script>", "<!--", "<a href=\"", "<a href='x ", "<style></style ", "<", "<x <", "< a href= ", "</", "&#", "<a href"])
def test_time_is_linear(piece):
    began = time.perf_counter()
    warc.scan(piece * (10_000_000 // len(piece)))
    warc.scan(piece * (2_000_000 // len(piece)) + ">" + piece * 10_000 + ">")
    assert time.perf_counter() - began < 30


def test_records_of_awkward_rows(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, "", ""), (3, "ué", "<title>é</title>" + "x" * 200_000)]
    pages = spark.createDataFrame([(*r, "block", "kind", "date") for r in rows], "page_id long, url string, html string, block string, record_type string, date string")
    made = warc.derive(warc.responses(pages)).collect()
    assert len(made) == 3 * len(rows) and sorted(made[0].asDict()) == sorted(warc.COLUMNS)
    for r in made:
        assert r["content_length"] == len(r["block"].encode()) and r["block_digest"] == warc.digest(r["block"].encode())
        assert (r["refers_to"] is None) == (r["record_type"] == "response")
        assert [n for n, _ in json.loads(r["source_headers"])] == ["Content-Type", "Content-Length"]
    by_page = {}
    for r in made:
        by_page.setdefault(r["page_id"], []).append(r)
    assert all({d["refers_to"] for d in rs if d["refers_to"]} == {d["record_id"] for d in rs if not d["refers_to"]} for rs in by_page.values())


def test_serialised_records_are_complete(spark):
    pages = spark.createDataFrame([(7, "http://e/x", "<p>t</p>")], "page_id long, url string, html string")
    for r in warc.serialize(warc.derive(warc.responses(pages))).collect():
        head, block = r["record"].split("\r\n\r\n", 1)
        lines = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
        assert head.startswith("WARC/1.1\r\n") and len(block.encode()) == int(lines["Content-Length"]) + 4
        if lines["WARC-Type"] != "response":
            assert lines["WARC-Refers-To-Target-URI"] == "http://e/x" and json.loads(lines["WARC-Source-Headers"]) and lines["WARC-Source-Digest"].startswith("sha1:")


def test_whole_pages_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {(r["page_id"], hashlib.sha1(warc.plain_text(r["html"] or "").encode()).hexdigest()) for r in pages.collect()}
    got = {(r["page_id"], hashlib.sha1(r["block"].encode()).hexdigest()) for r in warc.derive(warc.responses(pages)).where("record_type = 'conversion'").collect()}
    assert got == want
