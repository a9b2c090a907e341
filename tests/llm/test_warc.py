import gzip
import hashlib
import html
import json
import re

from tracewell.llm import warc

SCHEMA = "page_id long, url string, html string, block string, record_id string, refers_to string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def derived(spark, rows):
    return {(r["page_id"], r["warc_type"]): r for r in warc.derive(warc.responses(pages(spark, rows))).collect()}


PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head>
<body><!-- <p>no</p> --><nav><a href="/x?a=1&amp;b=2">x</a> <A class="c" HREF='y'>y</A></nav>
<p>One <b>two</b>
three&nbsp;&lt;four&gt; &#233;&#x1F600;&#xE9; &amp;lt; &copy;</p><p></p><div>five<br>six</div></body></html>"""


def test_text_links_and_title(spark):
    rows = derived(spark, [(1, "http://a/", PAGE)])
    assert rows[1, "conversion"]["block"] == "A & B\nx y\nOne two three <four> é\U0001f600é &lt; ©\nfive\nsix"
    meta = json.loads(rows[1, "metadata"]["block"])
    assert meta["title"] == "A & B" and meta["links"] == ["/x?a=1&b=2", "y"]
    assert meta["status"] == "HTTP/1.1 200 OK" and meta["headers"][0] == "Content-Type: text/html; charset=utf-8"
    assert meta["warc"]["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(PAGE.encode()).hexdigest()


def test_records_are_linked_and_digested(spark):
    rows = derived(spark, [(1, "http://a/", PAGE), (2, None, None), (3, "", ""), (None, "http://b/", "<p>x"), (4, "http://c/", "w " * 200_000)])
    source = {r["page_id"]: r for r in warc.responses(pages(spark, [(1, "http://a/", PAGE), (2, None, None)])).collect()}
    assert len(rows) == 10 and len({r["record_id"] for r in rows.values()}) == 10
    for r in rows.values():
        body = r["block"].encode()
        assert r["content_length"] == len(body) and r["block_digest"] == "sha256:" + hashlib.sha256(body).hexdigest()
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}>", r["record_id"])
    for k in (1, 2):
        assert {rows[k, t]["refers_to"] for t in ("metadata", "conversion")} == {source[k]["record_id"]}
    assert rows[2, "conversion"]["block"] == "" and rows[3, "conversion"]["block"] == "" and rows[2, "metadata"]["target_uri"] is None
    assert rows[4, "conversion"]["block"] == ("w " * 200_000).strip()


def test_files_are_read_and_written(spark, tmp_path):
    made = warc.derive(warc.responses(pages(spark, [(1, "http://a/", PAGE), (2, "http://b/é", "<p>ü")])))
    data = [bytes(r["data"]) for r in warc.serialised(made).orderBy("record_id").collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(data))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    want = sorted((r["warc_type"], r["record_id"], r["refers_to"], r["target_uri"], r["block"]) for r in made.collect())
    for name in ("a.warc", "b.warc.gz"):
        back = warc.read(spark, str(tmp_path / name), None).collect()
        assert sorted((r["warc_type"], r["record_id"], r["refers_to"], r["target_uri"], r["block"]) for r in back) == want


def test_responses_of_files_without_http_header(spark):
    frame = spark.createDataFrame([("<r>", "http://a", "d", "plain <b>text</b>", 7), ("<s>", None, None, None, 8)], "record_id string, target_uri string, warc_date string, block string, size long")
    rows = {(r["size"], r["warc_type"]): r for r in warc.derive(frame).collect()}
    assert rows[7, "conversion"]["block"] == "plain text" and rows[8, "conversion"]["block"] == ""
    assert json.loads(rows[7, "metadata"]["block"])["headers"] == []


def test_entities_match_the_standard_table():
    for name, char in warc.ENTITIES:
        assert html.unescape(name) == ("\xa0" if name == "&nbsp;" else char)


def test_empty_table(spark):
    assert derived(spark, []) == {}
