"""Legacy archives to WARC: ARC records in, equivalent WARC records out.

``arc_record`` lays out a page as an ARC record (header line of version 1 or 2, then the declared number of bytes).
``parse_arc`` reads a member by its version's header line and declared length, ``warc_record`` synthesises the
identifier, date, type and digests of the equivalent WARC record, and ``parse_warc`` reads it back.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the largest id is the response and the
others revisit it. A record identifier is a version-8 UUID that holds the record's id and 56 bits of a hash, so reading
an archive gives the ids back. Null html is an empty payload; a null url becomes ``-`` and a null id stays null, its
records are responses. Repeated rows of one id are all written, with equal or different payloads; those that share the
largest id and the payload are all responses. Other columns, whatever their names, are ignored. An empty table gives no
rows. A very long payload is held whole by its task.
"""

from __future__ import annotations

import hashlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

REVISIT_BYTES = 1000
#: Fields of an ARC header line by version (fixed by the format).
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "name", "length"),
}
ARC_DATE = "20240301000000"
NIL = "-"


def arc_record(page_id: int | None, url: str | None, payload: bytes, version: int = 2) -> bytes:
    known = {
        "url": (url or NIL).replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D") or NIL, "ip": "0.0.0.0", "date": ARC_DATE, "type": "text/html", "status": "200",
        "checksum": NIL, "location": NIL, "offset": "0", "name": NIL if page_id is None else f"page-{page_id}.arc", "length": str(len(payload)),
    }
    return " ".join(known[f] for f in ARC_FIELDS[version]).encode() + b"\n" + payload + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and payload of each record."""
    for head, payload, _ in arc_records(data):
        yield head, payload


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Header fields, payload and end of each record; a line's number of fields tells its version, its last one the length."""
    at = 0
    while at < len(data):
        end = data.index(b"\n", at)
        parts = data[at:end].decode().split(" ")
        fields = next((f for f in ARC_FIELDS.values() if len(f) == len(parts)), None)
        if fields is None or not parts[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}")
        head = dict(zip(fields, parts, strict=True))
        start = end + 1
        stop = start + int(head["length"])
        if stop > len(data):
            raise ValueError(f"record at byte {at} is cut short")
        at = stop + (data[stop : stop + 1] == b"\n")
        yield head, data[start:stop], at


def warc_date(arc_date: str) -> str:
    full = arc_date.ljust(14, "0")
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(page_id: int | None, url: str) -> str:
    """A UUID of version 8: 48 bits of hash, the id's 64 bits and 8 more of hash; variant digit 9 marks a null id."""
    p, h = f"{(page_id or 0) % (1 << 64):016x}", hashlib.sha1(url.encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{p[:3]}-{'9' if page_id is None else '8'}{p[3:6]}-{p[6:]}{h[12:14]}>"


def page_of(record: str) -> int | None:
    _, _, third, fourth, last = record.removeprefix("<urn:uuid:").rstrip(">").split("-")
    if fourth[0] == "9":
        return None
    value = int(third[1:] + fourth[1:] + last[:10], 16)
    return value - (1 << 64) if value >> 63 else value


def _digest(data: bytes) -> str:
    return "sha1:" + b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(page_id: int | None, head: dict[str, str], payload: bytes, refers: tuple[int, str] | None) -> bytes:
    """A response, or a revisit of the response with this id and url; both carry the full payload's digest and length."""
    http = f"HTTP/1.1 {head.get('status', '200')} OK\r\nContent-Type: {head['type']}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {record_id(page_id, head['url'])}", f"WARC-Date: {warc_date(head['date'])}",
        f"WARC-Target-URI: {head['url']}", f"WARC-IP-Address: {head['ip']}", f"WARC-Payload-Digest: {_digest(payload)}", f"WARC-Block-Digest: {_digest(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers:
        lines += [f"WARC-Refers-To: {record_id(*refers)}", f"WARC-Refers-To-Target-URI: {refers[1]}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = end + 4
        stop = start + int(head["content-length"])
        yield head, data[start:stop]
        at = stop + 4


def _arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True)
        ids, records = [], []
        for page_id, url, html in rows:
            ids.append(page_id)
            records.append(arc_record(page_id, url, (html or "").encode()))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(records, pa.binary())], ["page_id", "arc"])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each ARC record by itself, with what settles its type: payload length and digest."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for page_id, data in zip(batch["page_id"].to_pylist(), batch["arc"].to_pylist(), strict=True):
            at = 0
            for head, payload, end in arc_records(data):
                for column, value in zip(out, (page_id, head["url"], len(payload), hashlib.sha1(payload).digest(), data[at:end]), strict=True):
                    column.append(value)
                at = end
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["page_id", "url", "n", "sha1", "arc"])


def _warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        records = []
        for page_id, data, to, url in zip(*(batch[c].to_pylist() for c in ("page_id", "arc", "to_id", "to_url")), strict=True):
            for head, payload in parse_arc(data):
                records.append(warc_record(page_id, head, payload, None if to is None else (to, url)))
        yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["warc"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts of each WARC record; a response's are taken from its payload, a revisit's from its header and HTTP head."""
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for data in batch["warc"].to_pylist():
            for head, block in parse_warc(data):
                http, _, payload = block.partition(b"\r\n\r\n")
                revisit = head["warc-type"] == "revisit"
                told = head["warc-payload-digest"].removeprefix("sha1:")
                if not revisit and b32encode(hashlib.sha1(payload).digest()).decode() != told:
                    raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
                size = int(http.rpartition(b"Content-Length: ")[2]) if revisit else len(payload)
                row = (page_of(head["warc-record-id"]), size, _hex(told), head["warc-type"], page_of(head["warc-refers-to"]) if revisit else None, head["warc-date"])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], READ_NAMES)


READ_NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "warc_date"]
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, warc_date string"


def _hex(base32: str) -> str:
    from base64 import b32decode

    return b32decode(base32).hex()


def legacy_archive(pages: DataFrame) -> DataFrame:
    """page_id and its ARC record, for pages of page_id, url and html."""
    return pages.select("page_id", "url", "html").mapInArrow(_arc, "page_id long, arc binary")


def convert(arcs: DataFrame) -> DataFrame:
    """WARC records (column ``warc``) of ARC records (page_id, arc), with repeated payloads as revisits.

    Only digests of large payloads that occur more than once are joined back, by id and digest.
    """
    records = written(arcs.mapInArrow(_parsed, "page_id long, url string, n long, sha1 binary, arc binary"), "warc-records")
    large = records.where((F.col("n") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    repeated = large.groupBy("sha1", "n").agg(F.max("page_id").alias("to_id"), F.max_by("url", F.struct("page_id", "url")).alias("to_url"), F.count(F.lit(1)).alias("records"))
    repeated = written(repeated.where("records > 1").select("sha1", "n", "to_id", "to_url"), "warc-repeated")
    # An id may stand for several payloads, so revisits are known by id, digest and length.
    revisits = large.select("page_id", "sha1", "n").distinct().join(repeated, ["sha1", "n"]).where("page_id <> to_id")
    revisits = written(revisits.select("page_id", "sha1", "n", "to_id", "to_url"), "warc-revisits")
    return records.join(revisits, ["page_id", "sha1", "n"], "left").mapInArrow(_warc, "warc binary")


def read_back(warcs: DataFrame) -> DataFrame:
    return warcs.mapInArrow(_read, READ_SCHEMA)


def converted_pages(pages: DataFrame) -> DataFrame:
    """Write the archives of all pages, then read them back."""
    archives = written(convert(legacy_archive(pages)), "warc-archives")
    return read_back(archives)
