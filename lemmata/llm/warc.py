"""WARC: segmented records, revisits and chunked transfer framing.

Writing: of pages with equal payloads the one with the largest id is stored, the others are ``revisit`` records without a
body. A stored page is an HTTP response in chunked framing; its block is cut into a first record and ``continuation``
records (WARC 1.1, segmentation). Reading: the archives are parsed record by record, continuations are grouped by origin
identifier, ordered by segment number and checked against the total length, and the chunked body is decoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmata.llm.common import keep
from lemmata.shipping import map_arrow

#: Bytes to a segment's block, to a chunk of the body, and to an archive.
SEGMENT, CHUNK, ARCHIVE = 32768, 8192, 4 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


_HEX = re.compile(rb"[0-9A-Fa-f]+")


class WarcError(ValueError):
    pass


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Decode chunked transfer framing: hexadecimal sizes, extensions after a semicolon, trailers after the last chunk."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise WarcError("a chunk has no size line")
        digits = body[at:end].split(b";")[0].rstrip(b" \t")
        if not _HEX.fullmatch(digits):
            raise WarcError("a chunk's size is not hexadecimal")
        size = int(digits, 16)
        at = end + 2
        if not size:
            if body.find(b"\r\n\r\n", end) < 0:
                raise WarcError("no end after the last chunk")
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise WarcError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return b"".join([b"WARC/1.1\r\n", lines.encode(), b"Content-Length: %d\r\n\r\n" % len(block), block, b"\r\n\r\n"])


def page_records(identity: str, page_id, url: str | None, payload: bytes, refers_to=None, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page; ``identity`` is unlike that of any other page of the archives."""
    urn = lambda n: f"<urn:lemmata:{identity}:{n}>"
    uri = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    common = [("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", page_id)]
    if refers_to is not None:
        head = [("WARC-Type", "revisit"), ("WARC-Record-ID", urn(1)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return [record([*head, *common, ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Refers-To-Page", refers_to)], _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload))]
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    head = [("WARC-Type", "response"), ("WARC-Record-ID", urn(1)), *common, ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if len(block) <= segment:
        return [record(head, block)]
    out = [record([*head, ("WARC-Segment-Number", 1)], block[:segment])]
    cuts = range(segment, len(block), segment)
    for n, at in enumerate(cuts, 2):
        last = [("WARC-Segment-Total-Length", len(block))] if n == len(cuts) + 1 else []
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", urn(n)), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", urn(1)), ("WARC-Segment-Number", n), *last], block[at : at + segment]))
    return out


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an archive."""
    at = 0
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        if archive[at : at + 5] != b"WARC/" or end < 0:
            raise WarcError(f"no record at byte {at}")
        lines = archive[at:end].decode().split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        try:
            size = int(headers["content-length"])
        except (KeyError, ValueError):
            raise WarcError(f"the record at byte {at} has no length") from None
        block = archive[end + 4 : end + 4 + size]
        at = end + 4 + size
        if len(block) != size or archive[at : at + 4] != b"\r\n\r\n":
            raise WarcError("a record does not end where its length says")
        at += 4
        yield headers, block


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise WarcError("the HTTP headers have no end")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    return headers, unchunked(body) if headers.get("transfer-encoding", "").lower() == "chunked" else body


_PAYLOAD = "page_id long, url string, html string, refers_to long"
_ARCHIVE = "archive string, data binary"


def _write(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    part, n, k = TaskContext.get().partitionId(), 0, 0
    held: list[bytes] = []
    size = 0

    def full() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"{part}-{k}"]), pa.array([b"".join(held)], pa.binary())], names=["archive", "data"])

    for batch in batches:
        for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
            for r in page_records(f"{part}-{n}", page_id, url, (html or "").encode(), refers_to, segment):
                held.append(r)
                size += len(r)
            n += 1
            if size >= ARCHIVE:
                yield full()
                held, size, k = [], 0, k + 1
    if held:
        yield full()


def with_refers(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) and refers_to: of equal payloads of ``least`` bytes the largest id, null for itself.

    Rows that repeat the largest id are all stored. The sums for each payload are made before the shuffle, and its join
    may be dealt anew by Spark where one payload is that of many pages.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    same = pages.filter(F.octet_length("html") >= least).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").select("sha1", "first")
    joined = pages.join(same, "sha1", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def archives(pages: DataFrame, *, least: int = 0, segment: int = SEGMENT) -> DataFrame:
    """The pages as archives of about 4 MB: (archive, data), each ``data`` a WARC file's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _write(batches, segment)

    return with_refers(pages, least).transform(map_arrow, run, _ARCHIVE)


_READ = "origin string, page_id long, record_type string, digest string, refers_to long, segment int, total long, block binary, payload_bytes long, payload_digest string"


def _number(x: str | None) -> int | None:
    return None if x is None else int(x)


def _finish(kind: str, digest_said: str | None, block: bytes) -> tuple[int, str]:
    """Length and digest of the payload in a whole block; the digest is computed, and must be the one that is stated."""
    headers, payload = http_payload(block)
    if kind == "revisit":
        return int(headers["content-length"]), digest_said or ""
    if (found := digest(payload)) != digest_said:
        raise WarcError("the payload's digest is another than stated")
    return len(payload), found


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("origin", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("data"):
            rows = []
            for h, block in records(data.as_py()):
                kind, said = h["warc-type"], (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                whole = kind != "continuation" and "warc-segment-number" not in h
                size, found = _finish(kind, said, block) if whole else (None, None)
                rows.append((h.get("warc-segment-origin-id", h["warc-record-id"]), _number(h.get("x-page-id")), kind, said, _number(h.get("x-refers-to-page")), int(h.get("warc-segment-number", 1)), _number(h.get("warc-segment-total-length")), None if whole else block, size, found))
            yield _table(rows)


_PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            parts = r["parts"]
            first = parts[0]
            size, found = first["payload_bytes"], first["payload_digest"]
            if size is None or len(parts) > 1:
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                    raise WarcError(f"{r['origin']}: segments are missing or repeated")
                block = b"".join(p["block"] for p in parts)
                if len(block) != parts[-1]["total"]:
                    raise WarcError(f"{r['origin']}: {len(block)} bytes, not {parts[-1]['total']}")
                size, found = _finish(first["record_type"], first["digest"], block)
            out.append((first["page_id"], size, found, first["record_type"], first["refers_to"]))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read(stored: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page of the archives.

    A group is one page's segments, so it is as large as one page. A missing or repeated segment, a wrong total length,
    a broken chunk or a wrong digest is an error that names the record.
    """
    parsed = stored.select("data").transform(map_arrow, _parse, _READ)
    parts = F.sort_array(F.collect_list(F.struct("segment", "page_id", "record_type", "digest", "refers_to", "total", "block", "payload_bytes", "payload_digest")))
    return parsed.groupBy("origin").agg(parts.alias("parts")).transform(map_arrow, _assemble, _PAGES)


def round_trip(pages: DataFrame, *, least: int = 0, segment: int = SEGMENT) -> DataFrame:
    """Write the pages as archives in the shared folder, then read the archives back.

    A null html counts as empty; a null url leaves the target out; a null page_id stays null and, where other pages have
    its payload, revisits the largest of them. Extra columns are ignored.
    An empty table gives an empty table.
    """
    return checked(read(keep(archives(pages, least=least, segment=segment), "warc")))


def checked(found: DataFrame) -> DataFrame:
    """What was read, written down; an error unless every revisit has a response of its payload's length and digest."""
    found = keep(found, "pages")
    told = found.filter("record_type = 'revisit'").select("refers_to", "payload_bytes", "payload_digest").distinct()
    held = found.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").distinct()
    lost = told.join(held, ["refers_to", "payload_bytes", "payload_digest"], "left_anti").limit(1).collect()
    if lost:
        raise WarcError(f"no response of page {lost[0]['refers_to']} has {lost[0]['payload_bytes']} bytes with digest {lost[0]['payload_digest']}")
    return found
