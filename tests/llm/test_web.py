"""WARC derivatives and URL filters against SQL, brute force and round trips."""

import gzip
import random

import duckdb
import pytest
from helpers import DATA, rows_of, same_as_sql

from textweir.llm import registry
from textweir.llm import url_filter as U
from textweir.llm import warc as W


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, name):
    same_as_sql(registry.QUERIES[name](spark, DATA), registry.SQL[name])


HTML = "<html lang=\"en\"><head><title>A &amp; B\n c</title><script>var x='<p>'</script><style>p{}</style></head><body>\n<h1>Big</h1><p>One&nbsp; two<br>three &#233;&#38;lt;&#9999999; <b>bo</b>ld <a href=\"/x\">l</a><!-- no --></p>a < b</body></html>"


def test_text_of_a_page(spark):
    df = spark.createDataFrame([(HTML,)], "html string").select(W.html_text(W.F.col("html")))
    assert df.first()[0] == "Big\nOne two\nthree é&lt;&#9999999; bold l\na < b"


def test_odd_pages_same_as_sql(spark, tmp_path):
    parts = ["<p>", "</b>", "<title>", "</title", "<script>", "</script >", "<!--", "-->", "<", ">", " ", "   ", "\n", " \n", "\t", "\r\n", "\x0b", "\u00a0", "&nbsp;", "&lt;", "&#39;", "&amp;", "&#38;", "&#65;", "&#160;", "&#10;", "&#35;", "&#55296;", "&", "#39;", "lt;", "é", "a", "$1"]
    r = random.Random(3)
    pages = [(i, "u", "".join(r.choices(r.sample(parts, r.randint(1, len(parts))), k=r.randint(0, 20)))) for i in range(2000)]
    spark.createDataFrame([*pages, (-1, "u", None)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages"))
    (file,) = (tmp_path / "pages").glob("*.parquet")
    want = duckdb.sql(registry.SQL["op5_warc"].replace("FROM pages", f"FROM '{file}'")).to_arrow_table()
    got = W.derive(W.page_responses(spark.read.parquet(str(file)))).toArrow()
    assert rows_of(got) == rows_of(want) and got.num_rows == 2 * len(pages)


def test_each_text_is_made_once(spark):
    plan = registry.QUERIES["op5_warc"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("</title|") == 1


def test_records(spark, tmp_path):
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html"
    rows = [("<r1>", "response", "http://a/\r\nX: y", "2020-01-01T00:00:00Z", head, HTML, "e1", "c1"), ("<r2>", "response", None, None, None, "", "e2", "c2"), ("<r3>", "response", "u", "d", "h", None, "e3", "c3"), (None, "response", "u", "d", "h", "x", "e4", "c4"), ("<r5>", "request", "u", "d", "h", "x", "e5", "c5"), ("<r6>", "response", "http://long", "d", head, "<p>word</p>" * 20_000, "e6", "c6")]
    df = spark.createDataFrame([*rows, rows[1]], "record_id string, warc_type string, target_uri string, warc_date string, http_headers string, payload string, page_id string, content string")
    out = W.derive(df, "2024-02-02T00:00:00Z")
    assert out.columns == ["page_id", "content_1", *W.DERIVED] and out.count() == 8
    got = {(r.refers_to, r.warc_type): r for r in out.collect()}
    meta, text = got["<r1>", "metadata"], got["<r1>", "conversion"]
    assert text.target_uri == "http://a/ X: y" and text.content_1 == "c1" and text.source_headers == head and text.content_length == len(text.content.encode())
    lines = meta.content.split("\r\n")
    assert lines[:3] == ["title: A & B c", "language: en", f"text-characters: {len(text.content)}"] and "http-header: Content-Type: text/html" in lines and "outlink: /x" in lines
    assert f"source-payload-digest: {text.source_payload_digest}" in lines and f"source-record-id: {meta.refers_to}" in lines and len({meta.record_id, text.record_id}) == 2
    assert got["<r2>", "conversion"].content == "" and got["<r6>", "conversion"].content.count("word") == 20_000
    assert W.derive(df.limit(0)).count() == 0
    raw = [bytes(r.record) for r in W.record_bytes(out).orderBy("refers_to", "warc_type").collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(raw))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)))
    again = W.read_warc(spark, str(tmp_path)).collect()
    assert len(again) == 16 and sorted(bytes(r.payload).decode() for r in again) == sorted(2 * [r.content for r in out.collect()])
    assert {r.record_id for r in again} == {r.record_id for r in out.collect()}


def test_a_response_is_read(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Target-URI: http://a\r\n b\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(block)
    (tmp_path / "a.warc").write_bytes(record + block + b"\r\n\r\n")
    row = W.read_warc(spark, str(tmp_path)).first()
    assert row.target_uri == "http://a b" and bytes(row.payload) == b"<p>hi</p>" and row.http_headers.startswith("HTTP/1.1")
    assert W.derive(W.read_warc(spark, str(tmp_path))).filter("warc_type = 'conversion'").first().content == "hi"
    for bad in (b"junk\r\n", record + block[:5]):
        with pytest.raises(ValueError):
            list(W.parse_warc(bad))


def brute_match(rules, url):
    parts = U.split_url(url)
    hits = []
    for action, pattern in rules:
        host, _, path = pattern.partition("/")
        labels, segments = host.lower().split(".")[::-1], [s for s in path.split("/") if s]
        if parts and parts[0][: len(labels)] == labels and (not segments or len(parts[0]) == len(labels) and parts[1][: len(segments)] == segments):
            hits.append((len(labels) + len(segments), action, pattern))
    return max(hits, key=lambda h: (h[0], h[1] == "block"), default=None)


def test_urls(spark):
    rules = [("block", "example.com"), ("allow", "a.example.com"), ("block", "a.example.com/x"), ("allow", "a.example.com/x/y"), ("allow", "b.org/p"), ("block", "b.org/p"), ("block", "com")]
    hosts, paths = ["example.com", "A.example.com.", "c.a.example.com", "notexample.com", "b.org", "[::1]", ""], ["", "/", "/x", "/x/y/z", "//x//y", "/xy", "/p?q#f"]
    urls = [f"http://u@{h}:80{p}" for h in hosts for p in paths] + [None, "", "no url", "//b.org/p", " https://b.org/p", "http://" + "x" * 100_000]
    df = spark.createDataFrame([(u, "v") for u in [*urls, urls[0]]], "url string, verdict string")
    out = U.url_verdicts(df, rules)
    assert out.columns == ["url", "verdict", "verdict_1", "rule", "depth"] and out.count() == len(urls) + 1
    for r in out.collect():
        want = brute_match(rules, r.url)
        assert (r.verdict_1, r.depth) == ((want[1], want[0]) if want else ("allow", 0)) and (r.rule is None) == (want is None)
    assert U.url_verdicts(df.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        U.build_trie([("deny", "x")])
    with pytest.raises(ValueError):
        U.url_verdicts(df, rules, most_rules=3)
