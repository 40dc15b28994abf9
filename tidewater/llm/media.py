"""Media columns: ISO media containers described by their boxes and sample tables.

``store_payload`` keeps bytes losslessly as uncompressed 8-bit frames in an ISO container, ``describe`` walks the
boxes of any such container and decodes its sample tables into codec, duration and keyframe byte ranges, and
``read_samples`` takes the sample bytes back by these tables. No payload is decoded.

Null texts are empty; an empty text has one frame of padding. A media value that is null or holds no readable movie
gives a null description: every declared count must fit its box, every sample the file. Equal texts give equal bytes.
Repeated rows give equal rows; other columns pass through untouched, and one of the name given for the media is replaced.
An empty table gives no rows. A very long text is one media value, with 64-bit sizes from 4 GiB on.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME_SIDE = 24
FRAME = FRAME_SIDE * FRAME_SIDE
TIMESCALE = 600
FRAME_TICKS = 25
CHUNK_FRAMES = 16
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta"))


def padded(data: bytes, unit: int = FRAME) -> bytes:
    """Append bytes 255 up to a positive multiple of unit."""
    short = -len(data) % unit if data else unit
    return data + b"\xff" * short


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def _numbers(*values: int) -> bytes:
    return struct.pack(f">{len(values)}I", *values)


_MATRIX = _numbers(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def container(payload: bytes) -> bytes:
    """An ISO file with one track of raw grey frames; a sync sample opens each chunk."""
    frames = len(payload) // FRAME
    ticks = frames * FRAME_TICKS
    chunks = -(-frames // CHUNK_FRAMES)
    last = frames - (chunks - 1) * CHUNK_FRAMES
    runs = [(1, CHUNK_FRAMES, 1)] * (chunks > 1) + [(chunks, last, 1)] * (chunks == 1 or last != CHUNK_FRAMES)
    entry = _box(
        b"raw ",
        bytes(6), struct.pack(">H", 1), bytes(16),
        struct.pack(">HHIIIH", FRAME_SIDE, FRAME_SIDE, 0x480000, 0x480000, 0, 1),
        bytes(32), struct.pack(">Hh", 40, -1),
    )
    brand = _box(b"ftyp", b"qt  ", _numbers(0), b"qt  ")

    def movie(first: int) -> bytes:
        offsets = [first + k * CHUNK_FRAMES * FRAME for k in range(chunks)]
        wide = first + len(payload) >= 1 << 32
        tables = _box(
            b"stbl",
            _full(b"stsd", _numbers(1), entry),
            _full(b"stts", _numbers(1, frames, FRAME_TICKS)),
            _full(b"stss", _numbers(chunks, *range(1, frames + 1, CHUNK_FRAMES))),
            _full(b"stsc", _numbers(len(runs), *(x for run in runs for x in run))),
            _full(b"stsz", _numbers(FRAME, frames)),
            _full(b"co64" if wide else b"stco", _numbers(chunks), struct.pack(f">{chunks}{'Q' if wide else 'I'}", *offsets)),
        )
        handler = _full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0")
        info = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", _numbers(1), _full(b"url ", flags=1))), tables)
        media = _box(b"mdia", _full(b"mdhd", _numbers(0, 0, TIMESCALE, ticks), bytes(4)), handler, info)
        track = _full(b"tkhd", _numbers(0, 0, 1, 0, ticks), bytes(16), _MATRIX, _numbers(FRAME_SIDE << 16, FRAME_SIDE << 16), flags=3)
        head = _full(b"mvhd", _numbers(0, 0, TIMESCALE, ticks, 0x10000), bytes(12), _MATRIX, bytes(24), _numbers(2))
        return _box(b"moov", head, _box(b"trak", track, media))

    large = len(payload) + 8 >= 1 << 32
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if large else struct.pack(">I4s", len(payload) + 8, b"mdat")
    start = len(brand) + len(movie(0)) + len(head)
    moov = movie(start)
    start = len(brand) + len(moov) + len(head)
    return b"".join((brand, movie(start), head, payload))


def boxes(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of each box, parents first; a size of 0 runs to the end, of 1 is 64 bits long."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                return
            size = struct.unpack_from(">Q", data, body)[0]
            body += 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            return
        here = (*path, kind)
        yield here, body, stop
        if kind in CONTAINERS:
            yield from boxes(data, body, stop, here)
        start = stop


class Unreadable(ValueError):
    """Tables that don't fit their box or the file."""


def _counted(data: bytes, at: int, end: int, head: int, bits: int) -> int:
    """The number of entries of so many bits that a box declares at the end of its head; they must fit the box."""
    if at + head > end:
        raise Unreadable("box without its head")
    count = struct.unpack_from(">I", data, at + head - 4)[0]
    if count * bits > 8 * (end - at - head):
        raise Unreadable(f"{count} entries in a box of {end - at} bytes")
    return count


def _pairs(data: bytes, at: int, end: int, columns: int) -> list[tuple[int, ...]]:
    count = _counted(data, at, end, 8, 32 * columns)
    flat = struct.unpack_from(f">{count * columns}I", data, at + 8)
    return list(zip(*(flat[k::columns] for k in range(columns)), strict=True))


def _sizes(data: bytes, kind: bytes, at: int, end: int) -> Sequence[int]:
    if at + 12 > end:
        raise Unreadable("box without its head")
    same, count = struct.unpack_from(">II", data, at + 4)
    if kind == b"stz2":
        bits = same & 255
        if bits not in (4, 8, 16):
            raise Unreadable(f"sizes of {bits} bits")
        _counted(data, at, end, 12, bits)
        if bits == 4:
            return [data[at + 12 + k // 2] >> (0 if k % 2 else 4) & 15 for k in range(count)]
        return struct.unpack_from(f">{count}{'B' if bits == 8 else 'H'}", data, at + 12)
    if same:
        # Samples of one size have no entries: the file must be able to hold them.
        if same * count > len(data):
            raise Unreadable(f"{count} samples of {same} bytes in {len(data)} bytes")
        return np.broadcast_to(np.int64(same), count)
    _counted(data, at, end, 12, 32)
    return struct.unpack_from(f">{count}I", data, at + 12)


def _placed(runs: list[tuple[int, ...]], offsets: Sequence[int], sizes: Sequence[int], length: int) -> list[tuple[int, int]]:
    """Byte range of every sample, from the runs of samples per chunk and the chunks' offsets; all must lie in the file."""
    places: list[tuple[int, int]] = []
    firsts = [run[0] for run in runs] + [len(offsets) + 1]
    for run, following in zip(runs, firsts[1:], strict=True):
        if not 1 <= run[0] <= following <= len(offsets) + 1:
            raise Unreadable("runs of chunks that aren't there")
        for chunk in range(run[0], following):
            at = offsets[chunk - 1]
            for size in sizes[len(places) : len(places) + run[1]]:
                places.append((at, int(size)))
                at += int(size)
            if at > length:
                raise Unreadable(f"samples up to byte {at} of {length}")
    return places


def tracks(data: bytes) -> list[dict]:
    """Each track's codec, duration, sample and keyframe byte ranges, from its tables alone."""
    found: list[dict] = []
    for path, at, end in boxes(data):
        kind = path[-1]
        if kind == b"trak":
            found.append({"handler": None, "codec": None, "timescale": 0, "duration": 0, "width": 0, "height": 0, "runs": [], "offsets": [], "sizes": [], "ticks": [], "sync": None})
        if not found:
            continue
        track = found[-1]
        if kind == b"mdhd":
            long = data[at] == 1
            track["timescale"], track["duration"] = struct.unpack_from(">IQ" if long else ">II", data, at + (20 if long else 12))
        elif kind == b"hdlr" and b"mdia" in path:
            track["handler"] = data[at + 8 : at + 12].decode("latin-1")
        elif kind == b"stsd" and end - at >= 16:
            track["codec"] = data[at + 12 : at + 16].decode("latin-1")
            if track["handler"] == "vide" and end - at >= 44:
                track["width"], track["height"] = struct.unpack_from(">HH", data, at + 40)
        elif kind == b"stts":
            track["ticks"] = _pairs(data, at, end, 2)
        elif kind == b"stsc":
            track["runs"] = _pairs(data, at, end, 3)
        elif kind in (b"stsz", b"stz2"):
            track["sizes"] = _sizes(data, kind, at, end)
        elif kind in (b"stco", b"co64"):
            count = _counted(data, at, end, 8, 64 if kind == b"co64" else 32)
            track["offsets"] = list(struct.unpack_from(f">{count}{'Q' if kind == b'co64' else 'I'}", data, at + 8))
        elif kind == b"stss":
            track["sync"] = [x for (x,) in _pairs(data, at, end, 1)]
    for track in found:
        track["samples"] = _placed(track.pop("runs"), track.pop("offsets"), track.pop("sizes"), len(data))
        sync = track.pop("sync")
        track["keyframes"] = track["samples"] if sync is None else [track["samples"][k - 1] for k in sync if 0 < k <= len(track["samples"])]
        track["duration"] = track["duration"] or sum(count * ticks for count, ticks in track.pop("ticks", []))
    return found


def _readable(data: bytes | None) -> list[dict]:
    try:
        return tracks(bytes(data)) if data is not None else []
    except (struct.error, IndexError, Unreadable):
        return []


DESCRIPTION = T.StructType([
    T.StructField("codec", T.StringType()),
    T.StructField("handler", T.StringType()),
    T.StructField("timescale", T.LongType()),
    T.StructField("duration", T.LongType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("n_samples", T.LongType()),
    T.StructField("keyframes", T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))),
])


@F.pandas_udf(T.BinaryType())
def _contained(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: container(padded((x or "").encode())))


@F.pandas_udf(DESCRIPTION)
def _described(media: pd.Series) -> pd.DataFrame:
    rows = []
    for data in media:
        track = next(iter(_readable(data)), None)
        rows.append((None,) * 8 if track is None else (track["codec"], track["handler"], track["timescale"], track["duration"], track["width"], track["height"], len(track["samples"]), [{"offset": a, "length": b} for a, b in track["keyframes"]]))
    return pd.DataFrame(rows, columns=DESCRIPTION.names)


def _sample_bytes(data: bytes | None) -> bytes | None:
    found = _readable(data)
    return b"".join(data[at : at + size] for at, size in found[0]["samples"]) if found else None


@F.pandas_udf(T.BinaryType())
def _read(media: pd.Series) -> pd.Series:
    return media.map(_sample_bytes)


def store_payload(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    return df.withColumn(media, _contained(F.col(text)))


def describe(media: Column) -> Column:
    return _described(media)


def read_samples(media: Column) -> Column:
    return _read(media)


_DIGEST = T.StructType([
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
])


@F.pandas_udf(_DIGEST)
def _digested(media: pd.Series) -> pd.DataFrame:
    rows = []
    for data in media:
        track = tracks(data)[0]
        payload = b"".join(data[at : at + size] for at, size in track["samples"])
        facts = {k: track[k] for k in ("codec", "handler", "timescale", "duration", "width", "height")} | {"samples": len(track["samples"]), "keyframes": track["keyframes"]}
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), json.dumps(facts, separators=(",", ":"))))
    return pd.DataFrame(rows, columns=_DIGEST.names)


def media_digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as media, read the samples back by the tables and return digests of both."""
    kept = df.select(F.col(key), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), F.col(text).alias("_text"))
    stored = store_payload(kept, "_text", "_media").withColumn("_d", _digested(F.col("_media")))
    return stored.select(key, "n_bytes", "_d.*")
