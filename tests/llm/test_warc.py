"""WARC writing and reading: exact round trip, hand-made archives, damaged and incomplete ones."""

import base64
import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from evigraph.common import scratch_path
from evigraph.llm import warc

PAGES = "page_id long, url string, html string, digest int, id string, body int, n int, last int, `a.b` int"


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def pages_of(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5) for r in rows], PAGES).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    long = "".join(rng.choice("abc é漢\r\n") for _ in range(90_000))
    tricky = "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n0\r\n\r\n"
    out = [(i, f"http://h{i}/", f"<p>{rng.random()}</p>" * rng.randint(0, 40)) for i in range(40)]
    out += [(100 + i, "http://copy/", "<b>same</b>") for i in range(50)]
    out += [(200, None, None), (201, "u", ""), (202, "a b\r\nc\x01", "x"), (None, "n", "only here"), (None, "n", "<b>same</b>"), (None, "n", "twice"), (None, "n", "twice")]
    out += [(300, "l", long), (301, "l", long), (302, "t", tricky), (303, "t", tricky * 3000), (304, "r", "again"), (304, "r", "again"), (305, "m", long + "z"), (305, "m", long + "z")]
    return out


def expected(rows, least=0):
    last = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if len(body) >= least:
            last[body] = max([x for x in (last.get(body), i) if x is not None], default=None)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        again = body in last and i != last[body]
        out.append((str(i), len(body), b32(body), "revisit" if again else "response", str(last[body]) if again else "None"))
    return sorted(out)


def as_rows(df):
    return sorted((str(r["page_key"]), r["payload_bytes"], r["payload_digest"], r["type"], str(r["full_key"]) if r["type"] == "revisit" else "None") for r in df.collect())


@pytest.mark.parametrize("least", [0, 8])
def test_round_trip(spark, rows, least):
    got = warc.round_trip(pages_of(spark, rows), least=least)
    assert as_rows(got) == expected(rows, least)
    assert {r["status"] for r in got.collect()} == {"ok"}


def test_many_small_files_segments_and_frequent_bodies(spark, rows, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 3)  # the copies are joined by broadcast, the others by a shuffle
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.planned(pages_of(spark, rows)), path, segment=700, chunk=333, file_bytes=3000)
    files = spark.read.format("binaryFile").load(path)
    assert files.count() > 50
    pages = warc.read_pages(spark, path)
    assert as_rows(warc.resolved(pages.persist())) == expected(rows)
    full = {r["page_key"]: bytes(r["payload"]) for r in pages.filter("type = 'response'").collect()}
    assert all(full[str(i)] == (html or "").encode() for i, _, html in rows if str(i) in full and i is not None)
    numbers = warc.read_records(spark, path, segmented=True)
    assert numbers.agg(F.max("segment")).first()[0] > 200 and numbers.filter("octet_length(block) > 700").count() == 0


def test_empty_table_and_text_ids(spark):
    assert warc.round_trip(pages_of(spark, [(1, "u", "x")]).limit(0)).count() == 0
    df = spark.createDataFrame([("b", "u", "x"), ("a:é", "u", "x")], "page_id string, url string, html string")
    assert as_rows(warc.round_trip(df)) == [("a:é", 1, b32(b"x"), "revisit", "b"), ("b", 1, b32(b"x"), "response", "None")]


def test_files_are_plain_warc(spark, rows):
    """Each file holds whole records, closed by blank lines, in one gzip member."""
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.planned(pages_of(spark, rows[:5])), path)
    for r in spark.read.format("binaryFile").load(path).collect():
        data = gzip.decompress(bytes(r["content"]))
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
            size = int(head.rsplit(b"Content-Length: ", 1)[1])
            assert rest[size : size + 4] == b"\r\n\r\n"
            data = rest[size + 4 :]


def record(kind, name, block, **fields):
    head = [b"WARC/1.0", b"warc-type: " + kind, b"WARC-Record-ID: " + name]
    head += [k.replace("_", "-").encode() + b":" + v for k, v in fields.items()]
    return b"\r\n".join(head) + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def http(body, chunked=False):
    return b"HTTP/1.1 200 OK\r\n" + (b"transfer-encoding: gzip, Chunked\r\n" if chunked else b"") + b"\r\n" + body


def read(spark, *files):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(f,) for f in files], T.StructType([T.StructField("content", T.BinaryType())])).repartition(len(files))
    old, warc._files = warc._files, lambda s, p: df
    try:
        return {r["record_id"]: r for r in warc.read_pages(spark, "").collect()}
    finally:
        warc._files = old


def seg(name, origin, number, block, total=None, kind=b"continuation"):
    fields = {"WARC_Segment_Number": b"%d" % number}
    if origin:
        fields["WARC_Segment_Origin_ID"] = origin
    if total is not None:
        fields["WARC_Segment_Total_Length"] = b"%d" % total
    return record(kind, name, block, **fields)


def test_segments_in_any_order_and_incomplete_ones(spark):
    whole = http(b"3;x=y\r\nabc\r\n2\r\nde\r\n0\r\nTrailer: 1\r\n\r\n", True)
    a, b, c = whole[:11], whole[11:50], whole[50:]
    got = read(
        spark,
        seg(b"o3", b"o", 3, c, len(whole)) + seg(b"p3", b"p", 3, c, len(whole)) + seg(b"q2", b"q", 2, whole[11:], 5),
        gzip.compress(seg(b"o2", b"o", 2, b)) + gzip.compress(seg(b"o", None, 1, a, kind=b"response")) + gzip.compress(seg(b"p", None, 1, a, kind=b"response")),
        seg(b"q", None, 1, a, kind=b"response") + seg(b"r", None, 1, whole, kind=b"response") + seg(b"s2", b"s", 2, b, 9),
    )
    assert bytes(got["o"]["payload"]) == b"abcde" and got["o"]["status"] == "ok" and got["o"]["payload_digest"] == b32(b"abcde")
    assert got["p"]["status"] == "segment missing" and got["p"]["payload"] is None
    assert got["q"]["status"] == "total length differs"
    assert got["r"]["status"] == "total length missing"
    assert got["s"]["status"] == "segment missing" and got["s"]["type"] == "continuation"


def test_framing_digests_and_damage(spark):
    files = [
        record(b"response", b"1", http(b"plain")) + record(b"resource", b"2", b"raw\r\n\r\nbytes", WARC_Payload_Digest=b"sha1:" + b32(b"raw\r\n\r\nbytes").encode()),
        record(b"response", b"3", http(b"zz\r\nab\r\n0\r\n\r\n", True)) + record(b"response", b"4", http(b"4\r\nab", True)),
        record(b"response", b"5", http(b"x"), WARC_Payload_Digest=b"sha1:" + b32(b"y").encode()) + b"noise\r\nmore\r\n" + record(b"response", b"6", http(b"")),
        record(b"revisit", b"7", http(b""), WARC_Payload_Digest=b"sha1:ABC", WARC_Refers_To=b"1") + record(b"response", b"8", http(b"cut off"))[:-9],
        gzip.compress(record(b"response", b"9", http(b"x" * 5000)))[:-40], b"", b"\r\n",
        zlib.compress(b"not an archive"), b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\n" + record(b"response", b"10", http(b"z")),
    ]
    got = read(spark, *files)
    assert {k: r["status"] for k, r in got.items() if k} == {
        "1": "ok", "2": "ok", "3": "chunk framing", "4": "chunk framing", "5": "digest differs", "6": "ok", "7": "ok", "10": "ok"
    }
    assert got[None]["status"] == "damaged"
    assert bytes(got["1"]["payload"]) == b"plain" and bytes(got["2"]["payload"]) == b"raw\r\n\r\nbytes" and got["6"]["payload_bytes"] == 0
    assert got["7"]["payload_bytes"] is None and got["7"]["refers_to"] == "1"


def test_unchunk_inverts_framing():
    rng = random.Random(1)
    for n in (0, 1, 7, 8, 9, 1000):
        body = rng.randbytes(n)
        framed = warc._chunked(body, 8)
        assert warc.unchunk(framed) == body
        if n:
            assert all(warc.unchunk(framed[:i]) is None for i in range(len(framed) - 4))
