"""Media columns: Ogg.

A payload of 8-bit samples is cut into packets, dealt to two logical streams on one clock and paged as Ogg (RFC 3533):
lacing values, continued packets, granule positions, page checksums. The reader verifies every page's checksum, puts
packets together from the lacing values, separates the streams by serial number and derives each packet's time from the
granule positions; the payload is the packets in order of time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmata.llm.common import keep, slices
from lemmata.shipping import map_arrow

#: Samples to a block; payloads are whole blocks.
BLOCK = 192
#: Samples to a packet, logical streams, samples a second.
PACKET, STREAMS, RATE = 4 * BLOCK, 2, 8000
#: Bytes of a column that are worked on at once.
SLICE = 8 << 20
MAGIC = b"PCM8S\x00\x00\x01"
_HEAD = struct.Struct("<4sBBqIIIB")
_ID = struct.Struct("<8sBBHIQ")
CONTINUED, FIRST, LAST = 1, 2, 4
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """Ogg's checksum: polynomial 0x04c11db7, most significant bit first, register 0, nothing inverted.

    It is the mirror image of zlib's CRC, so zlib computes it on mirrored bytes.
    """
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


class OggError(ValueError):
    pass


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def _stream_pages(serial: int, header: bytes, packets: list[bytes], granules: list[int]) -> list[tuple[int, bytes]]:
    """(time at which the page's data begin, page); pages hold 255 lacing values, so packets may span pages."""
    out = [(-1, _page(FIRST if packets else FIRST | LAST, 0, serial, 0, bytes([len(header)]), header))]
    lacing, whose = bytearray(), []
    for i, p in enumerate(packets):
        n = len(p) // 255
        lacing += b"\xff" * n + bytes([len(p) - 255 * n])
        whose += [i] * (n + 1)
    body, at, number = b"".join(packets), 0, 1
    for a in range(0, len(lacing), 255):
        part = bytes(lacing[a : a + 255])
        size = sum(part)
        ended = [whose[a + k] for k, v in enumerate(part) if v < 255]
        flags = (CONTINUED if a and lacing[a - 1] == 255 else 0) | (LAST if a + 255 >= len(lacing) else 0)
        out.append((granules[whose[a]], _page(flags, granules[ended[-1]] if ended else -1, serial, number, part, body[at : at + size])))
        at, number = at + size, number + 1
    return out


def encode(payload: bytes, *, packet: int = PACKET, streams: int = STREAMS, rate: int = RATE) -> bytes:
    """The payload as a physical Ogg stream of ``streams`` multiplexed logical streams."""
    cuts = range(0, len(payload), packet)
    pages = []
    for s in range(streams):
        mine = cuts[s::streams]
        header = _ID.pack(MAGIC, s, streams, packet, rate, len(payload))
        serial = zlib.crc32(header)
        pages.append(_stream_pages(serial, header, [payload[a : a + packet] for a in mine], [min(a + packet, len(payload)) for a in mine]))
    first = b"".join(p[0][1] for p in pages)
    rest = sorted(((t, s, k, page) for s, ps in enumerate(pages) for k, (t, page) in enumerate(ps[1:])), key=lambda x: x[:3])
    return first + b"".join(x[3] for x in rest)


@dataclass
class _Stream:
    index: int
    streams: int
    packet: int
    rate: int
    total: int
    number: int = 0
    partial: list[bytes] = field(default_factory=list)
    waiting: list[bytes] = field(default_factory=list)
    last: bool = False


@dataclass
class Decoded:
    payload: bytes
    rate: int
    pages: int
    packets: int
    streams: int
    continued: int


def decode(media: bytes) -> Decoded:
    """Read a physical stream back; OggError if a page, a packet or a time does not fit."""
    at, n, pages, continued = 0, len(media), 0, 0
    logical: dict[int, _Stream] = {}
    timed: list[tuple[int, bytes]] = []
    while at < n:
        if n - at < _HEAD.size:
            raise OggError("page header cut short")
        magic, version, flags, granule, serial, number, crc, count = _HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = media[at + 27 : at + 27 + count]
        body_at = at + 27 + count
        end = body_at + sum(lacing)
        if end > n:
            raise OggError("page body cut short")
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        at, pages = end, pages + 1
        if flags & FIRST:
            magic, index, streams, packet, rate, total = _ID.unpack(media[body_at:end])
            if magic != MAGIC or serial in logical:
                raise OggError("unknown or repeated logical stream")
            logical[serial] = _Stream(index, streams, packet, rate, total, last=bool(flags & LAST))
            continue
        s = logical.get(serial)
        if s is None or s.last:
            raise OggError("page of no open logical stream")
        s.number += 1
        if number != s.number:
            raise OggError(f"page {s.number} of a stream is missing")
        if bool(flags & CONTINUED) != bool(s.partial):
            raise OggError("continued packet without its start, or the reverse")
        continued += bool(flags & CONTINUED)
        for v in lacing:
            s.partial.append(media[body_at : body_at + v])
            body_at += v
            if v < 255:
                s.waiting.append(b"".join(s.partial))
                s.partial = []
        if granule >= 0 and s.waiting:
            # the page's granule is the time at which its last ended packet ends; earlier ones lie a stride apart
            start = granule - len(s.waiting[-1])
            stride, k = s.packet * s.streams, len(s.waiting) - 1
            timed += [(start - stride * (k - i), p) for i, p in enumerate(s.waiting)]
            s.waiting = []
        s.last = bool(flags & LAST)
    if not logical or any(s.partial or s.waiting or not s.last for s in logical.values()) or {s.index for s in logical.values()} != set(range(len(logical))):
        raise OggError("a logical stream is missing or has no end")
    timed.sort(key=lambda x: x[0])
    clock = 0
    for t, p in timed:
        if t != clock:
            raise OggError(f"no samples at time {clock}")
        clock += len(p)
    one = next(iter(logical.values()))
    if clock != one.total or len(logical) != one.streams:
        raise OggError("samples or streams are missing")
    return Decoded(b"".join(p for _, p in timed), one.rate, pages, len(timed), len(logical), continued)


def feature(got: Decoded) -> str:
    """What a training set keeps of a clip: shape of the container, duration, level, and the loudest block."""
    x = np.frombuffer(got.payload, np.uint8)
    total = np.add.reduceat(x, np.arange(0, len(x), BLOCK), dtype=np.int64)
    square = int(np.dot(f := x.astype(np.float64), f))
    return f"streams={got.streams};pages={got.pages};packets={got.packets};continued={got.continued};seconds={len(x) / got.rate:.6f};mean={int(total.sum()) / len(x):.6f};rms={(square / len(x)) ** 0.5:.6f};peak={int(x.max())};loudest={int(total.argmax())}"


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % BLOCK if text else BLOCK)


_STORED = "doc_id long, n_bytes long, media binary"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            media = [encode(payload_of(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and a binary column ``media`` with the text's payload as Ogg, for every row of ``docs``.

    A null text counts as empty: one block of spaces. Null ids and repeated rows stay; extra columns are ignored. An empty
    table gives an empty table.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_arrow, _store, _STORED)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "media", SLICE):
            payload, errors = [], []
            for m in batch.column("media").to_pylist():
                try:
                    payload.append(None if m is None else decode(m).payload)
                    errors.append(None)
                except (OggError, struct.error) as e:
                    payload.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(payload, pa.binary()), pa.array(errors, pa.string())], names=["doc_id", "payload", "error"])


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, payload, error of a table (doc_id, media); a damaged stream has a null payload and says why.

    A null medium has a null payload and no error; null ids and repeated rows stay; extra columns are ignored.
    """
    return media.select(F.col("doc_id").cast("long"), "media").transform(map_arrow, _read, "doc_id long, payload binary, error string")


_MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "media", SLICE):
            cols: list[list] = [[] for _ in range(6)]
            for media in batch.column("media").to_pylist():
                got = decode(media)
                for c, v in zip(cols, (len(got.payload), hashlib.sha256(got.payload).hexdigest(), zlib.crc32(got.payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(got)), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def digests(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the stored form's and the read payload's digests and the feature.

    The media column is written as a table in the shared folder, and what is digested is read from there. A null text
    counts as empty: one block of spaces. A null id stays null; repeated rows give repeated results. Extra columns are
    ignored. An empty table gives an empty table.
    """
    return keep(media_column(docs), "media", compression="zstd").transform(map_arrow, _digest, _MEDIA)
