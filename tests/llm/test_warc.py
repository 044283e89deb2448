import hashlib

import pytest

from foliant.llm import warc as W
from foliant.llm.common import read_table, work_path

LONG = "é" * 600


def test_round_trip_cases(spark):
    rows = [(1, "http://a/", LONG, "x"), (2, "http://b b/\t", LONG, "x"), (3, None, LONG, "x"), (4, "http://c/", "short", "x"), (5, "u", "short", "x"), (6, "u", None, "x"), (7, "u", "", "x"),
            (None, "n", LONG, "x"), (8, "crlf", "a\r\n\r\nWARC/1.1\r\n\r\n" * 100, "x"), (8, "crlf", "a\r\n\r\nWARC/1.1\r\n\r\n" * 100, "x"), (-5, "neg", "y" * 1000, "x"), (2**62, "big", "y" * 1000, "x")]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string")
    got = sorted((tuple(r) for r in W.round_trip(d).collect()), key=str)
    want = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        same = [p for p, _, h, _ in rows if (h or "").encode() == data and p is not None]
        top = max(same, default=None)
        again = len(data) >= 1000 and i != top
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    assert got == sorted(want, key=str)


def test_empty(spark):
    d = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert W.round_trip(d).count() == 0


def test_versions_and_lengths():
    one = W.version_block(1, "f") + b"\n" + W.arc_record(1, "f", "u", b"body\nwith\nlines", 0) + b"\n"
    two = W.version_block(2, "f") + b"\n" + W.arc_record(2, "f", "v", b"", 9) + b"\n"
    got = list(W.parse_arc(one + two))
    assert [(h["version"], h["url"], b) for h, b in got] == [(1, "u", b"body\nwith\nlines"), (2, "v", b"")]
    assert got[1][0]["status"] == "200" and got[1][0]["file"] == "f"
    for bad in (one[:-5], one.replace(b"1 0 foliant", b"3 0 foliant"), b"http://x 1 2 3\n", W.arc_record(1, "f", "u", b"x", 0)):
        with pytest.raises(ValueError):
            list(W.parse_arc(bad))


def test_identifiers_dates_digests():
    for p in (0, 1, -1, 2**63 - 1, -(2**62), None, 123456789012345):
        u = W.record_id(p, b"salt")
        assert W.record_page(f"<{u}>") == p and u[9 + 14] == "8"
    assert W.iso("20200102030405") == "2020-01-02T03:04:05Z" and W.iso("199701020304") == "1997-01-02T03:04:00Z"
    rec = W.convert({"url": "u", "date": W.DATE, "ip": "1.2.3.4", "at": 0}, W.http_block(5, b"payload"), "f", None)
    (fields, block), = W.parse_warc(rec + b"\r\n\r\n")
    assert fields["warc-type"] == "response" and block.endswith(b"payload")
    assert fields["warc-payload-digest"] == W.base32(hashlib.sha1(b"payload").digest())
    again = W.convert({"url": "u", "date": W.DATE, "ip": "1.2.3.4", "at": 0}, W.http_block(5, b"payload"), "f", W.record_at(9, "f", 77))
    (fields, block), = W.parse_warc(again)
    assert fields["warc-type"] == "revisit" and W.record_page(fields["warc-refers-to"]) == 9 and b"payload" not in block


def test_hot_payload_and_files(spark):
    d = spark.createDataFrame([(i, f"u{i}", "z" * 1500 if i % 3 else str(i) * 1000) for i in range(900)], "page_id bigint, url string, html string").repartition(3)
    arc, warc = work_path(spark, "a"), work_path(spark, "w")
    W.write_arc(d, arc)
    assert W.read_arc(spark, arc).count() == 900
    W.to_warc(spark, arc, warc)
    got = W.read_warc(spark, warc)
    assert got.where("record_type = 'revisit'").count() == 599
    assert {r.refers_to for r in got.where("record_type = 'revisit'").collect()} == {899}
    # every reference names a record of the archive, the response with that payload
    ids = {r.record_id: r for r in got.collect()}
    assert len(ids) == 900
    for r in ids.values():
        if r.record_type == "revisit":
            to = ids[r.refers_to_id]
            assert to.record_type == "response" and to.payload_digest == r.payload_digest and to.page_id == 899


def archive(spark, name, *records):
    path = work_path(spark, name)
    body = W.version_block(1, "f") + b"\n" + b"".join(r + b"\n" for r in records)
    spark.createDataFrame([(bytearray(body),)], "value binary").selectExpr("cast(value as string) AS value").write.option("lineSep", "\n").text(path)
    return path


def test_archive_of_others(spark):
    """No page ids, no Content-Length, a record that is no HTTP message, a malformed tail."""
    http = b"HTTP/1.0 200 OK\r\nX-Page-Id: none\r\n\r\n" + b"q" * 1200
    dns = b"2020 example.org 1.2.3.4"
    path = archive(spark, "others", *(W.arc_record(1, "f", f"http://h/{i}", http, 0) for i in range(3)), W.arc_record(1, "f", "dns:h", dns, 0), b"http://x not a record")
    rows = W.read_arc(spark, path).collect()
    assert [r.error is None for r in rows] == [True] * 4 + [False]
    out = work_path(spark, "others-warc")
    W.to_warc(spark, path, out)
    got = W.read_warc(spark, out).collect()
    assert sorted(r.record_type for r in got) == ["resource", "response", "revisit", "revisit"]
    response, = (r.record_id for r in got if r.record_type == "response")
    assert {r.refers_to_id.strip("<>") for r in got if r.record_type == "revisit"} == {response.strip("<>")}
    assert {r.payload_bytes for r in got if r.record_type == "revisit"} == {None}


def test_sql(spark, sf, same):
    same(W.round_trip(read_table(spark, sf, "pages")), W.SQL)
