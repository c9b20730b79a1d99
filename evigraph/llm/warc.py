"""Web archives: pages written as WARC records, and archives read back with segments put together.

Writing. Each page is one HTTP response whose body (the html in UTF-8; null counts as empty) is framed in
chunks. Of pages with equal bodies of at least ``least`` bytes, the one of largest id is a ``response`` and
the others are ``revisit`` records that name it; smaller bodies are all responses. A block longer than
``segment`` bytes is cut: the first record has segment number 1, ``continuation`` records name it as their
origin, the last one states the total length. Files hold whole records up to ``file_bytes`` before
compression, so segments of one page may lie in several files.

Reading. Files (plain, gzip in one or many members) are parsed record by record with Content-Length; a
damaged place yields a row of status ``damaged`` and reading goes on at the next record. Segments are
shuffled by origin, sorted by number and put together in a stream: a task holds one page at a time. Numbers
must run from 1 without gap and the lengths must sum to the stated total. Then chunked framing is undone and
the body is hashed and held against the stated digest.

Defined cases: a row repeated with id and body is written under one record id as often as it occurs and read
as often; ids may be of any type, null included (smaller than all others; pages without id and with equal
bodies are all responses if none of them has an id). Urls keep their text but for control characters and
spaces, which are percent-encoded; a null url is left out. An empty table gives empty archives and no rows.
Other columns of the table take no part.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evigraph.common import cut_lineage, scratch_path

SEGMENT = 1 << 15
CHUNK = 1 << 13
FILE_BYTES = 64 << 20
HOT = 1000  # a digest with more than 1/HOT of all rows is joined by broadcast: fewer than HOT of them exist

END = b"\r\n\r\n"
OK, NO_SEGMENT, NO_TOTAL, BAD_TOTAL, BAD_FRAME, BAD_DIGEST, BAD_RECORD = (
    "ok", "segment missing", "total length missing", "total length differs", "chunk framing", "digest differs", "damaged",
)

RECORD = "type string, record_id string, origin string, segment int, total long, refers_to string, target_uri string, page_key string, digest string, block binary, status string"
PAGE = "type string, record_id string, refers_to string, target_uri string, page_key string, payload_digest string, payload_bytes long, payload binary, status string"


def sha1_base32(data: Column) -> Column:
    """Base32 of a SHA-1: four groups of ten hex digits become eight digits of base 32 each."""
    code = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(code, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def attach(rows: DataFrame, side: DataFrame, key: str, total: int) -> DataFrame:
    """Left join with ``side``, unique on ``key``; its column ``n`` says how many rows hold the key.

    Keys of many rows are bounded in number and joined by broadcast; their rows then carry keys of their own
    into the shuffle join with the rest, so no key gathers rows in one task.
    """
    extra = [c for c in side.columns if c not in (key, "n")]
    hot = side.filter(F.col("n") * HOT > total).select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in extra])
    cold = side.filter(F.col("n") * HOT <= total).select(F.col(key).alias("_cold"), *[F.col(c).alias(f"_cold_{c}") for c in extra])
    rows = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    own = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumn("_at", F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), own).otherwise(F.col(key)))
    rows = rows.join(cold, F.col("_at") == F.col("_cold"), "left")
    for c in extra:
        rows = rows.withColumn(c, F.coalesce(f"_hot_{c}", f"_cold_{c}"))
    return rows.drop("_hot", "_cold", "_at", *[f"_{k}_{c}" for k in ("hot", "cold") for c in extra])


# -- writing -------------------------------------------------------------------------------
def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Rows page_key, url, body, digest, shared, last: ``last`` is the id (as text) of the response among equal bodies.

    Ids keep their own order. Only digests, counts and ids are shuffled to find equal bodies, and only digests
    that occur twice are joined back.
    """
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", sha1_base32(F.col("body")))
    alike = rows.filter(F.octet_length("body") >= least).groupBy("digest").agg(F.max("id").cast("string").alias("last"), F.count(F.lit(1)).alias("n"))
    alike = cut_lineage(alike.filter("n > 1").withColumn("shared", F.lit(True)))
    return attach(rows, alike, "digest", pages.count()).select(F.col("id").cast("string").alias("page_key"), "url", "body", "digest", F.coalesce("shared", F.lit(False)).alias("shared"), "last")


def record_id(key: str | None, digest: str) -> str:
    """A record of the same page with the same body has the same id."""
    code = hashlib.md5(f"{'' if key is None else '=' + key}|{digest}".encode()).hexdigest()
    return f"<urn:uuid:{code[:8]}-{code[8:12]}-{code[12:16]}-{code[16:20]}-{code[20:]}>"


def _head(fields: list[tuple[str, str | None]], length: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + END


def _plain(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def _chunked(body: bytes, chunk: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + chunk]), body[i : i + chunk]) for i in range(0, len(body), chunk)]
    return b"".join(parts) + b"0\r\n\r\n"


def records_of(key: str | None, url: str | None, body: bytes, digest: str, shared: bool, last: str | None, date: str, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of one page, in order, without the blank lines after them."""
    own = record_id(key, digest)
    revisit = shared and key != last
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = head + b"\r\n" if revisit else head + b"Transfer-Encoding: chunked\r\n\r\n" + _chunked(body, chunk)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", _plain(url)),
        ("Page-Key", None if key is None else base64.urlsafe_b64encode(key.encode()).decode()), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Refers-To", record_id(last, digest) if revisit else None),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if len(block) <= segment:
        yield _head(fields, len(block)) + block
        return
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield _head([*fields, ("WARC-Segment-Number", "1")], segment) + pieces[0]
    for n, piece in enumerate(pieces[1:], 2):
        fields = [
            ("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(f"{own}#{n}", digest)), ("WARC-Date", date), ("WARC-Segment-Origin-ID", own),
            ("WARC-Segment-Number", str(n)), ("WARC-Segment-Total-Length", str(len(block)) if n == len(pieces) else None),
        ]
        yield _head(fields, len(piece)) + piece


def write_archives(plan: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", segment: int = SEGMENT, chunk: int = CHUNK, file_bytes: int = FILE_BYTES) -> None:
    """Write the rows of ``planned`` as gzip files of whole records.

    Tasks pack records into pieces of at most ``file_bytes`` (or one record); Spark writes each piece as a file
    whose line end is the blank lines that close a record.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_key", "url", "body", "digest", "shared", "last"))):
                for record in records_of(*row, date, segment, chunk):
                    if held and size + len(record) > file_bytes:
                        yield pa.record_batch([pa.array([END.join(held)], pa.binary())], ["value"])
                        held, size = [], 0
                    held.append(record)
                    size += len(record) + len(END)
        if held:
            yield pa.record_batch([pa.array([END.join(held)], pa.binary())], ["value"])

    files = plan.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


# -- reading -------------------------------------------------------------------------------
def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(fields by lower-cased name, block) of each record; a damaged place gives ({}, None) once."""
    file = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    try:
        line, lost = file.readline(), False
        while line:
            if not line.startswith(b"WARC/"):
                if line.strip(b"\r\n") and not lost:
                    yield {}, None
                    lost = True
                line = file.readline()
                continue
            fields: dict[str, str] = {}
            name = ""
            while (line := file.readline()).strip(b"\r\n"):
                text = line.decode("utf-8", "replace").rstrip("\r\n")
                if text[0] in " \t" and name:  # a folded line
                    fields[name] += " " + text.strip()
                elif ":" in text:
                    name, value = text.split(":", 1)
                    name = name.strip().lower()
                    fields[name] = value.strip()
            size = fields.get("content-length", "")
            block = file.read(int(size)) if re.fullmatch("[0-9]{1,18}", size) else None
            lost = block is None or len(block) != int(size)
            yield ({}, None) if lost else (fields, block)
            line = file.readline()
    except (EOFError, OSError, zlib.error):
        yield {}, None


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch("[0-9]{1,9}", text) else None


def unchunk(body: bytes) -> bytes | None:
    """Undo chunked transfer framing (extensions and trailers allowed); None where it is malformed or cut off."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";", 1)[0].strip() if end >= 0 else b""
        if not re.fullmatch(b"[0-9A-Fa-f]{1,15}", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes, http: bool) -> tuple[bytes, str]:
    """Body of a whole block and its status. A body whose framing cannot be undone is returned as it stands."""
    if not http:
        return block, OK
    head, _, body = block.partition(END)
    coding = re.search(rb"(?im)^transfer-encoding:[ \t]*([^\r\n]*)", head)
    if coding is None or coding.group(1).split(b",")[-1].strip().lower() != b"chunked":
        return body, OK
    plain = unchunk(body)
    return (body, BAD_FRAME) if plain is None else (plain, OK)


def _page(row: dict, block: bytes | None, status: str, keep: bool) -> dict:
    """One read page. A revisit has no body; its digest is the stated one."""
    out = {k: row[k] for k in ("type", "record_id", "refers_to", "target_uri", "page_key")}
    stated, body = row["digest"], None
    if status == OK and row["type"] == "revisit":
        return out | {"payload_digest": stated, "payload_bytes": None, "payload": None, "status": status}
    if block is not None:
        body, frame = payload_of(block, row["type"] in ("response", "request"))
        status = frame if status == OK else status
    found = None if body is None else base64.b32encode(hashlib.sha1(body).digest()).decode()
    if status == OK and stated is not None and stated != found:
        status = BAD_DIGEST
    return out | {"payload_digest": found, "payload_bytes": None if body is None else len(body), "payload": body if keep else None, "status": status}


def _row(fields: dict[str, str], block: bytes | None) -> dict:
    digest = fields.get("warc-payload-digest", "")
    try:
        key = base64.urlsafe_b64decode(fields["page-key"]).decode() if "page-key" in fields else None
    except ValueError:
        key = None
    return {
        "type": fields.get("warc-type", "").lower() or None, "record_id": fields.get("warc-record-id"), "origin": fields.get("warc-segment-origin-id"),
        "segment": _number(fields.get("warc-segment-number")), "total": _number(fields.get("warc-segment-total-length")), "refers_to": fields.get("warc-refers-to"),
        "target_uri": fields.get("warc-target-uri"), "page_key": key, "digest": digest[5:].upper() if digest[:5].lower() == "sha1:" else None,
        "block": block, "status": BAD_RECORD if block is None else OK,
    }


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batches(rows: Iterator[dict], schema: str, size: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded bytes."""
    fields = pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in schema.split(", "))])
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += 200 + len(row[size] or b"")
        if total >= limit:
            yield pa.RecordBatch.from_pylist(held, fields)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, fields)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_records(spark: SparkSession, path: str, segmented: bool | None = None) -> DataFrame:
    """Raw records of all archives under ``path``; only segmented ones or only whole ones, if asked."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (_row(*r) for b in batches for content in b.column(0) for r in parse(content.as_py()))
        return _batches((r for r in found if segmented is None or segmented == (r["segment"] is not None)), RECORD, "block")

    return _files(spark, path).mapInArrow(scan, RECORD)


def assembled(segments: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Pages put together from segments: by origin, in order of number, with the total length verified."""
    rows = segments.withColumn("origin", F.coalesce("origin", "record_id"))
    rows = rows.repartition("origin").sortWithinPartitions("origin", "segment")

    def finish(firsts: list[dict], pieces: dict[int, bytes], totals: set[int], origin: str | None) -> Iterator[dict]:
        status = OK if sorted(pieces) == list(range(1, len(pieces) + 1)) and firsts else NO_SEGMENT
        whole = b"".join(pieces[n] for n in sorted(pieces))
        if status == OK and len(totals) != 1:
            status = BAD_TOTAL if totals else NO_TOTAL
        if status == OK and totals != {len(whole)}:
            status = BAD_TOTAL
        lone = {"type": "continuation", "record_id": origin, "refers_to": None, "target_uri": None, "page_key": None, "digest": None}
        for first in firsts or [lone]:
            yield _page(first, whole if status == OK else None, status, keep_payload)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, firsts, pieces, totals = None, [], {}, set()
        for batch in batches:
            for row in batch.to_pylist():
                if now is not None and row["origin"] != now[0]:
                    yield from finish(firsts, pieces, totals, now[0])
                    firsts, pieces, totals = [], {}, set()
                now = (row["origin"],)
                block = row.pop("block")
                pieces.setdefault(row["segment"], block)  # a repeated record repeats its bytes
                if row["total"] is not None:
                    totals.add(row["total"])
                if row["type"] != "continuation" and row["segment"] == 1:
                    firsts.append(row)
        if now is not None:
            yield from finish(firsts, pieces, totals, now[0])

    return rows.mapInArrow(lambda b: _batches(joined(b), PAGE, "payload"), PAGE)


def read_pages(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per page of the archives: whole records as they are parsed, segmented ones put together."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pages() -> Iterator[dict]:
            for batch in batches:
                for content in batch.column(0):
                    for row in (_row(*r) for r in parse(content.as_py())):
                        if row["segment"] is None:
                            yield _page(row, row["block"], row["status"], keep_payload)

        return _batches(pages(), PAGE, "payload")

    return _files(spark, path).mapInArrow(scan, PAGE).unionByName(assembled(read_records(spark, path, segmented=True), keep_payload))


def resolved(pages: DataFrame) -> DataFrame:
    """Read pages with, for each revisit, the size and the page of the response it names.

    ``pages`` is read more than once: hand in a written table. A response named by a third of all rows is
    joined by broadcast.
    """
    asked = pages.filter("type = 'revisit'").groupBy(F.col("refers_to").alias("record_id")).agg(F.count(F.lit(1)).alias("n"))
    answers = pages.filter("type = 'response'").groupBy("record_id").agg(F.first("payload_bytes").alias("full_bytes"), F.first("page_key").alias("full_key"))
    side = answers.join(asked, "record_id").withColumnRenamed("record_id", "refers_to")
    return attach(pages, side, "refers_to", pages.count()).withColumn("payload_bytes", F.coalesce("payload_bytes", "full_bytes")).drop("full_bytes")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, path: str | None = None) -> DataFrame:
    """Write all pages, read the archives back: page_key, type, payload_bytes, payload_digest, full_key, status."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write_archives(planned(pages, id_col, url_col, html_col, least), path)
    return resolved(cut_lineage(read_pages(pages.sparkSession, path, keep_payload=False).drop("payload")))
