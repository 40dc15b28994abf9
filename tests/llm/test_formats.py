"""Containers and archives: exact round trips, and malformed or empty input."""

import hashlib
import struct
import zlib

import pytest

from tidewater.llm import media, warc


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 576 * 16, 576 * 33 + 5])
def test_container_gives_its_payload_back(size):
    payload = media.padded(bytes(k % 251 for k in range(size)))
    assert len(payload) % media.FRAME == 0 and payload
    data = media.container(payload)
    (track,) = media.tracks(data)
    assert b"".join(data[a : a + n] for a, n in track["samples"]) == payload
    frames = len(payload) // media.FRAME
    assert track["codec"] == "raw " and track["width"] == track["height"] == 24
    assert track["duration"] == frames * media.FRAME_TICKS and len(track["keyframes"]) == -(-frames // media.CHUNK_FRAMES)
    assert track["keyframes"][0] == track["samples"][0]
    assert [p[-1] for p, _, _ in media.boxes(data) if len(p) == 1] == [b"ftyp", b"moov", b"mdat"]


def test_box_sizes_of_zero_and_of_64_bits():
    data = struct.pack(">I4sQ", 1, b"free", 20) + b"abcd" + struct.pack(">I4s", 0, b"mdat") + b"xyz"
    assert [(p[-1], data[a:b]) for p, a, b in media.boxes(data)] == [(b"free", b"abcd"), (b"mdat", b"xyz")]
    assert list(media.boxes(b"\0\0\0\x05abcd")) == []


def test_media_digest_of_texts(spark):
    rows = [(1, "héllo", "x"), (2, None, "y"), (3, "", None), (4, "héllo", "z"), (None, "a" * 200_000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    found = {r["doc_id"]: r for r in media.media_digest(df).collect()}
    payload = media.padded("héllo".encode())
    assert found[1]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and found[1]["n_bytes"] == 6
    assert found[1]["tail_crc32"] == zlib.crc32(payload[-32:]) and found[1]["media_sha256"] == found[4]["media_sha256"]
    assert found[2][1:] == found[3][1:] and found[2]["payload_bytes"] == 576
    assert found[None]["n_bytes"] == 200_000
    assert media.media_digest(df.limit(0)).count() == 0


def test_description_of_broken_media_is_null(spark):
    good = media.container(media.padded(b"x"))
    df = spark.createDataFrame([(0, good), (1, good[:200]), (2, None), (3, b"")], "k int, m binary")
    found = df.select("k", media.describe(df["m"]).alias("d"), media.read_samples(df["m"]).alias("s")).orderBy("k").collect()
    assert found[0]["d"]["codec"] == "raw " and bytes(found[0]["s"]) == media.padded(b"x")
    assert [r["d"]["codec"] for r in found[1:]] == [None] * 3


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records_follow_their_declared_lengths(version):
    data = warc.arc_record(7, "http://a/b c", b"one\ntwo", version) + warc.arc_record(8, None, b"", version)
    (h1, p1), (h2, p2) = warc.parse_arc(data)
    assert (p1, p2) == (b"one\ntwo", b"") and h1["url"] == "http://a/b%20c" and h2["url"] == "-" and len(h1) == len(warc.ARC_FIELDS[version])
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-40]))


@pytest.mark.parametrize("page_id", [0, 1, -5, 2**63 - 1, -(2**63), None])
def test_record_ids_give_page_ids_back(page_id):
    assert warc.page_of(warc.record_id(page_id, "http://x")) == page_id


def test_revisits(spark):
    big = "b" * 1000
    rows = [(1, "http://a", big), (2, "http://b", big), (5, None, big), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", "é" * 500), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, arc string")
    found = {r["page_id"]: r for r in warc.converted_pages(pages).collect()}
    assert len(found) == len(rows)
    assert [(k, found[k]["record_type"], found[k]["refers_to"]) for k in (1, 2, 5)] == [(1, "revisit", 5), (2, "revisit", 5), (5, "response", None)]
    assert all(found[k]["record_type"] == "response" for k in (3, 4, 6, 7, None))
    assert found[1]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() and found[1]["payload_bytes"] == 1000 and found[6]["payload_bytes"] == 0
    assert found[7]["payload_bytes"] == 1000
    assert warc.converted_pages(pages.limit(0)).count() == 0


def test_pages_of_one_id_keep_their_own_payloads(spark):
    big, other = "b" * 1500, "o" * 1500
    rows = [(1, "http://a/", big), (1, "http://a/", "small"), (1, "http://a/", other), (2, "http://b/", big), (3, "http://c/", other), (None, None, big), (None, None, None)]
    found = sorted((tuple(r)[:5] for r in warc.converted_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    expected = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        to = {big: 2, other: 3}.get(html)
        revisit = page_id is not None and to is not None and page_id != to
        expected.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    assert found == sorted(expected, key=str)


def test_media_with_false_counts_has_no_description(spark):
    good = media.container(media.padded(b"abc" * 999))
    for kind, at, value in ((b"stsz", 12, 0xFFFFFFFF), (b"stsz", 8, 0x7FFFFFFF), (b"stco", 8, 0xFFFFFFFF), (b"stco", 12, 0xFFFFFF00), (b"stsc", 8, 1 << 30), (b"stts", 8, 1 << 31), (b"stss", 8, 1 << 31)):
        bad = bytearray(good)
        place = good.index(kind) + at - 4 + 4
        bad[place : place + 4] = value.to_bytes(4, "big")
        assert media._readable(bytes(bad)) == [], kind
        assert media._sample_bytes(bytes(bad)) is None
    assert media._readable(good[:-1]) == [] or media._sample_bytes(good[:-1]) is None
    assert media._sample_bytes(good) == media.padded(b"abc" * 999)
