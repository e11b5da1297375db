import base64
import gzip
import hashlib
import html
import re

from pyspark.sql import functions as F

from locatext.llm import queries as Q
from locatext.llm import warc


def sha1(b):
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_links_and_digests(spark):
    rows = [(1, "http://a/x", "<title>T &amp; U</title><p>one<p>two <b>three</b><script>no</script>"), (2, None, None), (3, "http://a/\r\ny", ""), (3, "http://a/\r\ny", "")]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, block int")
    source = warc.responses(pages)
    by = {r["record_id"]: r for r in source.collect()}
    made = warc.derive(source).collect()
    assert len(made) == 8 and len(by) == 3
    for r in made:
        s = by[r["refers_to"]]
        assert r["target_uri"] == s["target_uri"] and r["source_headers"] == s["source_headers"]
        assert r["block_digest"] == sha1(bytes(r["block"])) and r["payload_digest"] == s["payload_digest"] == sha1(bytes(s["block"]).partition(b"\r\n\r\n")[2])
    text = next(r for r in made if r["record_type"] == "conversion" and r["target_uri"] == "http://a/x")
    assert bytes(text["block"]) == b"T & U\none\ntwo three"
    about = next(r for r in made if r["record_type"] == "metadata" and r["target_uri"] == "http://a/x")
    assert b"title: T & U\r\n" in bytes(about["block"]) and b"source-header-0: HTTP/1.1 200 OK" in bytes(about["block"])
    assert warc.derive(source.limit(0)).count() == 0 and warc.derive(warc.derive(source)).count() == 0


def test_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>é</p>"), (2, "http://b/", "WARC/1.1 in a text\r\n\r\n")], "page_id long, url string, html string")
    every = warc.responses(pages).unionByName(warc.derive(warc.responses(pages)))
    rows = warc.with_bytes(every).collect()
    (tmp_path / "a.warc").write_bytes(b"".join(bytes(r["warc"]) for r in rows))
    back = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert len(back) == len(rows) == 6
    for r in rows:
        b = back[r["record_id"]]
        assert bytes(b["block"]) == bytes(r["block"]) and b["refers_to"] == r["refers_to"] and b["payload_digest"] == r["payload_digest"]
    again = warc.derive(warc.read_warc(spark, str(tmp_path)))
    assert {r["record_id"] for r in again.collect()} == {r["record_id"] for r in rows if r["record_type"] != "response"}


def test_gzipped_and_long_records(spark, tmp_path):
    long = "<p>" + "word &amp; " * 400_000 + "</p>"
    pages = spark.createDataFrame([(i, f"http://a/{i}", long if i == 1 else "") for i in range(4)] + [(0, "http://a/0", "")], "page_id long, url string, html string")
    rows = warc.with_bytes(warc.responses(pages)).collect()
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(bytes(r["warc"]) for r in rows)))
    (tmp_path / "each.warc.gz").write_bytes(b"".join(gzip.compress(bytes(r["warc"])) for r in rows))
    back = warc.read_warc(spark, str(tmp_path))
    assert back.count() == 2 * len(rows) == 10
    text = {bytes(r["block"]) for r in warc.derive(back).where("record_type = 'conversion' AND target_uri = 'http://a/1'").collect()}
    assert text == {("word & " * 400_000).strip().encode()}


def test_whole_table_against_plain_records(spark):
    """op4_warc on every page of sf0.001: both records of each, byte for byte."""
    d = "/root/testdata/sf0.001"
    got = {(r["refers_to"], r["record_type"]): r for r in Q.op4_warc(spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    assert len(got) == 2 * len(pages)
    for r in pages:
        source = warc.record_id("response", str(r["page_id"]), r["url"])
        payload = (r["html"] or "").encode()
        text, about = got[source, "conversion"], got[source, "metadata"]
        lines = [" ".join(x.split()) for x in html.unescape(re.sub(r"<[/!?A-Za-z][^>]*>", "", re.sub(r"<(?:br|/?(?:p|div|li|ul|h1|article|nav|footer))\b[^>]*>", "\n", re.sub(r"(?s)<!--.*?-->|<(script|style|head)\b.*?</\1>", "\n", r["html"])))).split("\n")]
        assert text["block"] == "\n".join(x for x in lines if x)
        assert text["payload_digest"] == about["payload_digest"] == sha1(payload) and text["target_uri"] == r["url"]
        fields = dict(x.split(": ", 1) for x in about["block"].split("\r\n") if x)
        assert fields["payload-bytes"] == str(len(payload)) and fields["text-digest"] == text["block_digest"] == sha1(text["block"].encode())
        assert fields["source-header-0"] == "HTTP/1.1 200 OK" and f"Content-Length: {len(payload)}" in text["source_headers"]


def test_query_covers_every_page(spark):
    d = "/root/testdata/sf0.001"
    out = Q.op4_warc(spark, d)
    n = spark.read.parquet(f"{d}/pages.parquet").count()
    assert out.count() == 2 * n and out.select("record_id").distinct().count() == 2 * n
    assert out.where(F.col("refers_to").isNull()).count() == 0
