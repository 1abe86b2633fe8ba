import base64
import gzip
import hashlib
import random

import duckdb
import pytest

from graingrid.llm import op01_warc as W

FILES = "path string, content binary, warc_type string"


def test_query_equals_its_sql(spark, sf):
    got = W.query(spark.read.parquet(f"{sf}/pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    want = con.sql(W.ORACLE_SQL)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(tuple(r[k] for k in at) for r in want.fetchall())


PAGES = [(1, "http://a.example/x y", "<p>one</p>"), (2, "http://b.example/", ""), (3, "https://c.example/ü", "<p>ü\n\nhttp://fake 1.2.3.4 20010101000000 text/html 5\n</p>" * 3)]


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [False, True])
def test_round_trip(version, packed):
    raw = W.arc_file("f.arc", version, PAGES)
    out = list(W.convert_file("p", gzip.compress(raw) if packed else raw))
    assert [r[4] for r in out] == ["warcinfo", "response", "response", "response"]
    assert all(r[3] == "ok" and r[2] == version for r in out)
    for (page, url, html), r in zip(PAGES, out[1:]):
        body = r[-1].split(b"\r\n\r\n", 1)[1]
        assert (r[7], body.decode()) == (url, html)
        assert r[13] == "sha1:" + base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert r[11] == len(r[-1]) and r[6].startswith("2008-01-01T00:00:0")
        whole = W.warc_bytes(r[15], r[16])
        head, rest = whole.split(b"\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert rest[: int(fields["Content-Length"])] == r[16] and rest[int(fields["Content-Length"]) :] == b"\r\n\r\n"
        assert fields["WARC-Record-ID"] == r[5] and fields["WARC-Target-URI"] == url


def test_wrong_and_cut_lengths():
    raw = W.arc_file("f.arc", 1, [(1, "http://a/", "x" * 50), (2, "http://b/", "y" * 60)])
    for wrong in (b" 7\n", b" 90\n"):
        bad = raw.replace(b"text/html 114\n", b"text/html" + wrong, 1)
        assert bad != raw
        out = list(W.convert_file("p", bad))
        assert [(r[7], r[3]) for r in out[1:]] == [("http://a/", "resynced"), ("http://b/", "ok")]
        assert out[1][-1].endswith(b"x" * 50)
    out = list(W.convert_file("p", raw[:-20]))
    assert out[-1][3] == "truncated" and out[-1][-1].endswith(b"y")


def test_kinds_and_dates():
    raw = b"filedesc://f 0.0.0.0 20040506070809 text/plain 40\n1 0 me\nURL IP-address Archive-date x yyyyyy\n\ndns:a.example 1.2.3.4 2004 text/dns 3\nabc\nhttp://a/ 1.2.3.4 20041399000000 image/png 4\n\x89PNG\nhttp://b/ 1.2.3.4 200405060708 text/html 14\nHTTP/1.0 404 X\n"
    out = list(W.convert_file("p", raw))
    assert [(r[4], r[6], r[9], r[10]) for r in out] == [
        ("warcinfo", "2004-05-06T07:08:09Z", "text/plain", None), ("resource", "2004-01-01T00:00:00Z", "text/dns", None),
        ("resource", "2004-05-06T07:08:09Z", "image/png", None), ("response", "2004-05-06T07:08:00Z", "application/http; msgtype=response", 404),
    ]


def test_edges(spark):
    one = W.arc_file("f.arc", 1, PAGES)
    rows = [("a", one, "z"), ("a", one, "z"), ("b", None, "z"), ("c", b"", None), ("d", b"no archive at all\n\nreally", "z"), (None, W.arc_file("g", 2, [(9, "http://l/", "long " * 400000)]), "z")]
    got = W.convert(spark.createDataFrame(rows, FILES)).collect()
    assert sorted((r.path or "", r.warc_type) for r in got) == sorted([("a", "response")] * 6 + [("a", "warcinfo")] * 2 + [("", "response"), ("", "warcinfo")])
    assert len({r.record_id for r in got if r.path == "a"}) == 4
    assert W.convert(spark.createDataFrame([], FILES)).count() == 0
    pages = spark.createDataFrame([(1, None, None), (None, "u", "h"), (2, "http://x/\n1", "")], "page_id long, url string, html string")
    assert sorted(r.target_uri for r in W.query(pages).collect()) == ["about:blank", "http://x/ 1"]


def test_damaged_members():
    raw = W.arc_file("f.arc", 1, [(k, f"http://a/{k}", "".join(random.Random(k).choices("abcdefghijklmnop ", k=6000))) for k in range(1, 5)])
    at = [0] + [raw.index(f"http://a/{k} ".encode()) for k in range(1, 5)] + [len(raw)]
    members = [gzip.compress(raw[a:b]) for a, b in zip(at, at[1:])]
    for hurt in (10, len(members[2]) // 2, len(members[2]) - 20):
        bad = members[2][:hurt] + bytes(255 - c for c in members[2][hurt : hurt + 12]) + members[2][hurt + 12 :]
        out = list(W.convert_file("p", b"".join(members[:2] + [bad] + members[3:])))
        assert [r[7] for r in out if r[3] == "ok"] == ["filedesc://f.arc", "http://a/1", "http://a/3", "http://a/4"]
        rest = [r for r in out if r[3] != "ok"]
        assert [(r[7], r[3]) for r in rest] in ([], [("http://a/2", "damaged")]) and (rest or hurt == 10)
        assert all(r[-1] == w[-1] or r[3] == "damaged" and w[-1].startswith(r[-1][:1000]) for r in out for w in [next(w for w in W.convert_file("p", raw) if w[7] == r[7])])
    cut = list(W.convert_file("p", b"".join(members)[:-30]))
    assert [r[3] for r in cut] == ["ok"] * 4 + ["truncated"]
    assert list(W.convert_file("p", b"\x1f\x8b\x08nothing")) == []
