import base64
import gzip
import hashlib
from collections import Counter

import pytest

from mailsieve.llm import queries, warc

PAGES = [
    (1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "http://c/\r\nX: y", ""), (5, "u%0Av", "ünï\r\n\r\ncode"),
    (5, "u", "ünï\r\n\r\ncode"), (None, "n", "same"), (None, "n", "only without an id"), (6, "l", "long " * 50_000),
]


def expected(pages):
    last = {}
    for i, _, h in pages:
        last[h or ""] = max((x for x in (last.get(h or ""), i) if x is not None), default=None)
    out = []
    for i, _, h in pages:
        b, top = (h or "").encode(), last[h or ""]
        revisit = top is not None and i != top
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return Counter(out)


@pytest.fixture
def folder(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' AS payload", "'y' AS sha1", "'z' AS last_id")
    warc.write_warc(pages.repartition(3), str(tmp_path / "w"))
    return str(tmp_path / "w")


def test_round_trip(spark, folder):
    rows = warc.read_warc(spark, folder).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == expected(PAGES)
    uris = {r.page_id: r.target_uri for r in rows if r.page_id in (3, 4)}
    assert uris == {3: None, 4: "http://c/\r\nX: y"}
    full = {r.page_id: bytes(r.payload).decode() for r in rows if r.record_type == "response" and r.page_id}
    assert full == {2: "same", 4: "", 5: "ünï\r\n\r\ncode", 6: "long " * 50_000}


def test_filters_reach_the_reader_and_payloads_are_skipped(spark, folder, monkeypatch, capsys):
    df = warc.read_warc(spark, folder, ["page_id", "record_type"]).where("record_type = 'revisit' AND page_id IN (1, 2)")
    assert [r.page_id for r in df.collect()] == [1]
    df.explain()
    assert "PushedFilters: []" not in capsys.readouterr().out
    reader = warc.WarcReader(folder, ["page_id", "payload_bytes"], 1 << 20)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload",), b"x")]))
    assert len(left) == 1
    monkeypatch.setattr(warc.Member, "payload", lambda self: pytest.fail("a payload was decoded"))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["payload_bytes"] for r in rows if r["page_id"]) == [0, 4, 13, 13, 250_000]


def test_partitions_follow_a_size(folder):
    files = sum(len(p.paths) for p in warc.WarcReader(folder, ["page_id"], 1).partitions())
    assert len(warc.WarcReader(folder, ["page_id"], 1).partitions()) == files
    assert len(warc.WarcReader(folder, ["page_id"], 1 << 40).partitions()) == 1


def test_files_are_plain_gzip(folder):
    path = warc.WarcReader(folder, ["page_id"], 1).partitions()[0].paths[0]
    assert gzip.open(path).read().startswith(b"WARC/1.1\r\n")


def test_damage_is_noticed(spark, folder):
    path = next(p.paths[0] for p in warc.WarcReader(folder, ["page_id"], 1).partitions())
    with open(path, "r+b") as f:
        f.seek(0)
        f.write(b"no")
    with pytest.raises(Exception, match="gzip member"):
        warc.read_warc(spark, folder).collect()


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_a_second_write_keeps_the_first_and_other_archives(spark, folder):
    other = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    with gzip.open(f"{folder}/other.warc.gz", "wb") as f:
        f.write(other)
    more = spark.createDataFrame([(70, "m", "more")], "page_id long, url string, html string")
    warc.write_warc(more, folder)
    rows = warc.read_warc(spark, folder).collect()
    assert len(rows) == len(PAGES) + 2
    assert {r.page_id for r in rows} == {p[0] for p in PAGES} | {70}
    assert [bytes(r.payload) for r in rows if r.record_type == "warcinfo"] == [b"hi"]


def test_cut_archives_are_noticed(spark, tmp_path):
    whole = gzip.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n")
    (tmp_path / "x.warc.gz").write_bytes(whole[:-12])
    with pytest.raises(Exception, match="before its time"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_blanks_of_an_address_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, " http://a/ x\t ", "h")], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).first().target_uri == " http://a/ x\t "


@pytest.mark.parametrize("form", ["member a record", "one member", "plain"])
def test_archives_of_other_writers(spark, tmp_path, form):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + b"body\r\n\r\n" * 40_000
    parts = [
        (b"WARC-Type: warcinfo", b"", b"software: x\r\n"),
        (b"warc-type:request", b"WARC-Target-URI: http://a/?q=%25\r\nContent-Type: application/http; msgtype=request\r\n", b"GET / HTTP/1.1\r\n\r\n"),
        (b"WARC-Type: response", b"WARC-Payload-Digest: sha1:AAAA\r\nContent-Type: application/http;\r\n msgtype=response\r\n", http),
        (b"WARC-Type: metadata", b"", b""),
    ]
    packed = [b"WARC/1.0\r\n" + t + b"\r\n" + h + b"Content-Length: %d\r\n\r\n" % len(x) + x + b"\r\n\r\n" for t, h, x in parts]
    data = b"".join(packed)
    if form != "plain":
        data = b"".join(map(gzip.compress, packed)) if form == "member a record" else gzip.compress(data)
    (tmp_path / ("x.warc" if form == "plain" else "x.warc.gz")).write_bytes(data)
    rows = {r.record_type: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert list(rows) == ["warcinfo", "request", "response", "metadata"]
    assert all((r.page_id, r.payload_bytes, r.refers_to) == (None, None, None) for r in rows.values())
    assert rows["request"].target_uri == "http://a/?q=%25" and rows["response"].target_uri is None
    assert [rows[k].payload_digest for k in rows] == [None, None, "AAAA", None]
    assert bytes(rows["warcinfo"].payload) == b"software: x\r\n" and bytes(rows["metadata"].payload) == b""
    assert bytes(rows["response"].payload) == b"body\r\n\r\n" * 40_000
    assert warc.read_warc(spark, str(tmp_path), ["record_type"]).where("record_type = 'metadata'").count() == 1


def test_query_on_the_given_pages(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert Counter(tuple(r) for r in queries.op3_warc(spark, sf).collect()) == expected(pages)
