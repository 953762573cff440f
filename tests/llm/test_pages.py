"""WARC and URL operators on small archives and link graphs."""

import hashlib

import pytest

from lectern.llm import common, url_filter, warc
from lectern.llm.queries import URL_RULES

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:lectern:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def sha1(t):
    return hashlib.sha1((t or "").encode()).hexdigest()


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "é" * 700, "x" * 999
    rows = [(1, "http://a.example.net/en/1", big), (2, "http://b\r\nX: y", big), (3, None, big), (4, "u", other), (5, "u", other), (6, "u", None), (7, "u", ""), (8, "u", f"<p>{FAKE}</p>" * 40 + "WARC/1."), (9, "u", "\r\n\r\nWARC/1.0\r\n\r\n" + FAKE), (10, "u", FAKE), (11, "u", "z" * 400_000), (12, "u", big), (12, "u", big), (None, "u", "n" * 1200), (13, "u", f"<p>{FAKE}</p>" * 40 + "WARC/1.")]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("split", [None, "4k", "1500"])
def test_archives(spark, pages, tmp_path, split):
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = warc.archive_pages(pages, path=str(tmp_path / "w")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    source = [(r.page_id, r.html or "") for r in pages.collect()]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in rows), key=str) == sorted(((p, len(h.encode()), sha1(h)) for p, h in source), key=str)
    kinds = {}
    for r in rows:
        kinds.setdefault(r.page_id, []).append((r.record_type, r.refers_to))
    assert kinds[1] == kinds[2] == kinds[3] == [("revisit", 12)] and kinds[12] == [("response", None)] * 2
    assert kinds[8] == [("revisit", 13)] and kinds[13] == [("response", None)] and all(kinds[i] == [("response", None)] for i in (4, 5, 6, 7, 9, 10, 11, None))
    assert all(r.verified for r in rows) and 666 not in kinds


def test_damaged_archives(spark, tmp_path):
    """Records behind a damaged one, and files that do not start with one, are left out."""
    good = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:lectern:page:{}>\r\nContent-Length: 4\r\n\r\n\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((good.format(1) + good.format(2).replace("4", "90000") + good.format(3)).encode())
    (tmp_path / "b.warc").write_bytes(b"junk" + good.format(4).encode())
    (tmp_path / "c.warc").write_bytes(good.format(5).encode() + good.format(6).encode())
    got = sorted(r.page_id for r in warc.read_warc(spark, str(tmp_path), common.Tables(spark, "t")).collect())
    assert got == [1, 5, 6]


@pytest.mark.parametrize("split", [None, "300"])
def test_magic_in_url(spark, tmp_path, split):
    """A magic in a URL, alone or beside others in the payload, loses neither its record nor those behind it."""
    urls = ["https://x.org/1", "https://x.org/WARC/1.1/", "WARC/1.0", "https://x.org/WARC/1.1/WARC/1.0?Content-Length:3", "https://x.org/5", "https://x.org/WARC/1."]
    rows = [(i, u, [f"<p>{i}", FAKE * 3 + "WARC/1.", "WARC/1.", "", "y" * 1500, "y" * 1500][i]) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        warc.write_warc(pages, str(tmp_path / "w"), common.Tables(spark, "t"))
        got = {r.page_id: r for r in warc.read_warc(spark, str(tmp_path / "w"), common.Tables(spark, "t")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == list(range(6)) and [got[i].url for i in range(6)] == urls
    assert [got[i].payload_digest for i in (0, 1, 2, 3, 5)] == [sha1(rows[i][2]) for i in (0, 1, 2, 3, 5)] and got[4].type == "revisit"


def test_no_pages(spark, pages):
    assert warc.archive_pages(pages.limit(0)).collect() == []
    assert url_filter.url_filter(pages.limit(0), URL_RULES).collect() == []


def test_rules(spark):
    urls = ["http://A.example.NET/en/5", "https://x.example.net/de/", "http://example.com/de/1?q=/x#y", "http://examplexcom/de/", "http://w.org/fr/z", "http://net", "http://net/", "http://q.net?x=/en/", "nothing", None, "", "s://a.b/c://d.net/", "http://xexample.net/en/"]
    df = spark.createDataFrame([(i, u, "<html>", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    got = {r.page_id: tuple(r)[1:5] for r in url_filter.url_filter(df, URL_RULES).collect()}
    assert got[0] == ("a.example.net", "/en/5", "example.net/en/", "allow")
    assert got[1] == ("x.example.net", "/de/", "net/", "block")
    assert got[2] == ("example.com", "/de/1", "example.com/de/", "block")
    assert got[3] == ("examplexcom", "/de/", None, "allow")
    assert got[4] == ("w.org", "/fr/z", "org/fr/", "allow")
    assert got[5] == ("net", "", None, "allow") and got[6] == ("net", "/", "net/", "block") and got[7] == ("q.net", "", None, "allow")
    assert got[8] == got[9] == got[10] == ("", "", None, "allow")
    assert got[11] == ("a.b", "/c://d.net/", None, "allow") and got[12][2] == "net/"


def test_aliases(spark):
    link = '<head><link href="{}" rel="canonical"></head>'.format
    rows = [
        (1, "http://good.example.org/en/1#top", link("http://bad.example.net/x")), (2, "http://good.example.org/en/2", link("/en/1")), (3, "http://good.example.org/en/3", "<p>"),
        (4, "http://good.example.org/fr/4", link("http://bad.example.net/x")), (5, "http://other.org/5", '<meta http-equiv="refresh" content="0; url=http://good.example.org/en/2">'),
        (6, "http://lone.org/6", link("http://lone.org/7")), (7, "http://lone.org/7", None), (8, "http://moved.org/8", None), (9, "http://BAD.example.net/x", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    moved = spark.createDataFrame([("http://moved.org/8", "http://good.example.org/en/2"), (None, "http://a.org/"), ("x", "y")], "src string, dst string")
    got = {r.page_id: (r.verdict, r.alias_block) for r in url_filter.url_filter(df, URL_RULES, moved).collect()}
    assert {k for k, v in got.items() if v == ("block", True)} == {1, 2, 5, 8}
    assert got[3] == got[4] == got[6] == got[7] == ("allow", False) and got[9] == ("block", False)
