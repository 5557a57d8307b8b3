"""Ogg and WARC round trips and damage."""

import hashlib
import random
import zlib

import pytest

from lemmata.llm import ogg, warc


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000, 48_960, 200_000])
def test_ogg_round_trip(n):
    payload = ogg.payload_of(random.Random(n).randbytes(n))
    assert len(payload) % 192 == 0 and payload
    for how in ({}, {"streams": 1}, {"streams": 3, "packet": 510}, {"packet": 255}):
        got = ogg.decode(ogg.encode(payload, **how))
        assert got.payload == payload


def test_ogg_crc_bit_by_bit():
    data, crc = b"OggS and more \x00\xff", 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    assert ogg.page_crc(data) == crc


def test_ogg_damage_is_found():
    media = ogg.encode(ogg.payload_of(random.Random(1).randbytes(100_000)))
    rng = random.Random(2)
    for _ in range(30):
        at = rng.randrange(len(media))
        bad = bytearray(media)
        bad[at] ^= 1 << rng.randrange(8)
        with pytest.raises(ogg.OggError):
            ogg.decode(bytes(bad))
    pages = [media.index(b"OggS", 1)]
    with pytest.raises(ogg.OggError):
        ogg.decode(media[pages[0] :])
    with pytest.raises(ogg.OggError):
        ogg.decode(media[:-1])


def test_media_rows(spark):
    rows = [(1, "é" * 500), (2, None), (3, ""), (None, "x"), (4, "y" * 300_000), (4, "y" * 300_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, media string")
    got = ogg.digests(df).collect()
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        payload = ogg.payload_of(text.encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert len({tuple(r)[1:] for r in got if r["doc_id"] == 4}) == 1
    back = ogg.read_media(ogg.media_column(df)).collect()
    assert sorted(len(r["payload"]) for r in back) == sorted(r["payload_bytes"] for r in got) and not any(r["error"] for r in back)
    broken = spark.createDataFrame([(1, bytearray(b"OggSxx")), (2, None)], "doc_id long, media binary")
    assert {r["doc_id"]: (r["payload"], bool(r["error"])) for r in ogg.read_media(broken).collect()} == {1: (None, True), 2: (None, False)}
    assert ogg.digests(df.limit(0)).count() == 0


def test_chunked_framing():
    for n in (0, 1, 8191, 8192, 30_000):
        payload = random.Random(n).randbytes(n)
        assert warc.unchunked(warc.chunked(payload)) == payload
    assert warc.unchunked(b"4;x=y\r\nab\r\n\r\n0\r\nTrailer: 1\r\n\r\n") == b"ab\r\n"
    for bad in (b"4\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"0\r\n", b"", b"+4\r\nabcd\r\n0\r\n\r\n", b" 4\r\nabcd\r\n0\r\n\r\n", b"0x4\r\nabcd\r\n0\r\n\r\n", b"0_4\r\nabcd\r\n0\r\n\r\n"):
        with pytest.raises(warc.WarcError):
            warc.unchunked(bad)


def test_archives(spark):
    big = "<p>é</p>" * 20_000
    rows = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (7, "http://b\r\nX: y", big), (3, "u", None), (4, "u", ""), (5, "u", big), (5, "u", "q"), (None, "u", "<p>x</p>"), (None, "u", "alone")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, sha1 string")
    for segment in (300, 32768):
        got = sorted(map(tuple, warc.round_trip(df, segment=segment).collect()), key=str)
        want = []
        for i, _, html in rows:
            payload = (html or "").encode()
            ids = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
            first = max(ids, default=None)
            alone = sum((h or "") == (html or "") for _, _, h in rows) == 1
            refers = None if alone or i == first else first
            want.append((i, len(payload), warc.digest(payload), "response" if refers is None else "revisit", refers))
        assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_lost_segments_are_found(spark):
    parts = warc.page_records("a-0", 1, "u", b"x" * 5000, segment=1000)
    rows = lambda p: spark.createDataFrame([("a", bytearray(b"".join(p)))], "archive string, data binary")
    assert warc.read(rows(parts[::-1])).first()["payload_bytes"] == 5000
    for bad in (parts[:-1], parts[1:], parts[:2] + parts[3:], [*parts, parts[2]]):
        with pytest.raises(Exception):
            warc.read(rows(bad)).collect()


def test_revisits_need_their_response(spark):
    rows = lambda p: spark.createDataFrame([("a", bytearray(b"".join(p)))], "archive string, data binary")
    good = warc.page_records("a-0", 9, "u", b"page") + warc.page_records("a-1", 1, "u", b"page", refers_to=9)
    assert {r["page_id"] for r in warc.checked(warc.read(rows(good))).collect()} == {1, 9}
    other = warc.page_records("a-0", 9, "u", b"Page") + warc.page_records("a-1", 1, "u", b"page", refers_to=9)
    for bad in (other, good[1:]):
        with pytest.raises(warc.WarcError):
            warc.checked(warc.read(rows(bad)))
