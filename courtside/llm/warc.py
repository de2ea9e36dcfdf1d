"""WARC archives: writing pages, and a reader that salvages what is left of damaged archives.

Tasks write archives (one gzip member per record, or plain) into the shared folder under names of their own and report them; only files
reported by tasks that Spark has committed are listed in the manifest, so lost or repeated attempts leave nothing behind that is read.

The reader goes through an archive record by record. Every record is checked: the gzip checksum, the version line, the header fields, the
length, the line breaks behind the block, and the digests of block and payload. Where a check fails it searches for the next version line
(in the unpacked bytes of a gzip member, or in a plain archive) or gzip member whose record passes all checks, goes on there, and reports the
bytes in between as a quarantined gap with the reason. Members are unpacked and checked as a stream.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions.store import new_path

VERSION = b"WARC/1.1\r\n"
VERSION_LINE = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")
MEMBER = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "<urn:page:{}>"
FILE_BYTES = 256 << 20  # an archive is closed once it is larger
HEADER_BYTES = 1 << 20  # longest header
CHUNK = 1 << 16
MANDATORY = ("warc-type", "warc-record-id", "warc-date")

MANIFEST = "path string, bytes bigint, records bigint"
READ = "path string, kind string, start bigint, end bigint, reason string, type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_length bigint, payload binary"
READ_ARROW = pa.schema([
    ("path", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()), ("type", pa.string()), ("record_id", pa.string()),
    ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary()),
])


# Writing


def record(kind: str, number: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response with its payload, or a revisit that repeats the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    fields = [("WARC-Type", kind), ("WARC-Record-ID", ID.format(number)), ("WARC-Date", date)]
    if uri is not None:
        fields.append(("WARC-Target-URI", quote(uri, safe="!#$%&'()*+,/:;=?@[]~")))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", ID.format(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(records: DataFrame, folder: str, compress: bool = True, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write rows of (kind, number, uri, payload, digest, refers_to) into ``folder`` and return the manifest: path, bytes, records.

    ``folder`` is in a file system that pyarrow opens by its URI. An archive holds about FILE_BYTES at most, or one larger record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        out, name, size, count = None, "", 0, 0

        def report() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], ["path", "bytes", "records"])

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc" + ".gz" * compress, 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = record(row["kind"], row["number"], row["uri"], row["payload"], row["digest"], row["refers_to"], date)
                data = member(data) if compress else data
                out.write(data)
                size, count = size + len(data), count + 1
                if size > FILE_BYTES:
                    yield report()
                    out = None
        if out is not None:
            yield report()

    path = new_path(records.sparkSession, "warc-manifest")
    records.select("kind", "number", "uri", "payload", "digest", "refers_to").mapInArrow(run, MANIFEST).write.parquet(path)
    return records.sparkSession.read.parquet(path)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """Records for ``write_archives``: of equal payloads of ``least`` bytes or more, the one with the largest id is response, the others revisit it.

    The payload is the text in UTF-8, empty for a null. Rows that share the largest id are all responses; a row without an id revisits
    unless no equal payload has one. Only digests are grouped; the payloads meet the groups in one equi join, whose hot keys adaptive
    execution splits.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    groups = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = rows.join(groups, ["digest", "size"], "left")
    revisit = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("first")))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("kind"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("number"), "uri", "payload", "digest",
        F.when(revisit, F.col("first").cast("string")).alias("refers_to"),
    )


# Reading


@dataclass
class Record:
    fields: dict[str, str]
    payload: bytes
    length: int  # of the full payload, also where a revisit leaves it out


class Damage(Exception):
    """A failed check."""


def check(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record at ``at``, and where it ends, or Damage."""
    line = VERSION_LINE.match(data, at)
    if not line:
        raise Damage("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damage("header does not end")
    try:
        lines = data[line.end() : end].decode().split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        length = int(fields["content-length"])
    except (ValueError, KeyError) as e:
        raise Damage("header fields are broken") from e
    if any(f not in fields for f in MANDATORY):
        raise Damage("a mandatory field is missing")
    after = end + 4 + length
    block = data[end + 4 : after]
    if len(block) != length or data[after : after + 4] != b"\r\n\r\n":
        raise Damage("length does not fit")
    if not same_digest(fields.get("warc-block-digest"), block):
        raise Damage("block digest differs")
    if "application/http" in fields.get("content-type", ""):
        head, _, payload = block.partition(b"\r\n\r\n")
        told = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)", head)
        full = int(told[1]) if told else len(payload)
    else:
        payload, full = block, length
    if fields.get("warc-type") != "revisit":
        full = len(payload)
        if not same_digest(fields.get("warc-payload-digest"), payload):
            raise Damage("payload digest differs")
    return Record(fields, payload, full), after + 4


def same_digest(told: str | None, data: bytes) -> bool:
    """Whether a ``sha1:`` digest in hex fits; other kinds and none are taken as they are."""
    return told is None or not re.fullmatch(r"sha1:[0-9a-fA-F]{40}", told) or told[5:].lower() == hashlib.sha1(data).hexdigest()


def unpack(file, at: int) -> Iterator[tuple[int, bytes]]:
    """Pieces of the gzip member at ``at``, each with the place its bytes were read from, and (end, b"") behind the last.

    What comes before a broken place is given out before Damage is raised.
    """
    unpacker, place = zlib.decompressobj(31), at
    while not unpacker.eof:
        file.seek(place)
        chunk = file.read(CHUNK)
        if not chunk:
            raise Damage("file ends inside a member")
        held = unpacker.copy() if place > at else zlib.decompressobj(31)
        try:
            data = unpacker.decompress(chunk)
        except zlib.error as e:
            whole = bytearray()
            try:
                for i in range(len(chunk)):
                    whole += held.decompress(chunk[i : i + 1])
            except zlib.error:
                pass
            yield place, bytes(whole)
            raise Damage("gzip member is broken") from e
        yield place, data
        place += len(chunk)
    yield place - len(unpacker.unused_data), b""


def read_member(file, at: int) -> Iterator[tuple[int, Record | str | None]]:
    """The records of the gzip member at ``at`` and the reasons of gaps between them, each with a place that it doesn't end before; (end, None) last.

    Of a broken member the last record is left out if nothing was unpacked behind it: nothing tells that it is whole.
    """
    data, need, lost = bytearray(), 0, False
    held: list[tuple[int, Record]] = []

    def parse(place: int, last: bool) -> Iterator[tuple[int, Record | str]]:
        nonlocal need, lost
        while data and (last or len(data) >= need):
            if held:
                yield held.pop()
            try:
                if not lost or VERSION_LINE.match(data):
                    need = missing(data)
                    if need > len(data) and not last:
                        return
                    if need > len(data):
                        raise Damage("record does not end")
                    record, end = check(bytes(data[:need]))
                    held.append((place, record))
                    del data[:end]
                    need, lost = 0, False
                    continue
            except Damage as e:
                if not lost:
                    yield place, str(e)
                lost = True
            found = data.find(b"WARC/", 1)
            if found < 0:
                del data[: len(data) if last else max(1, len(data) - 4)]
                need = len(data) + len(VERSION)
                continue
            del data[:found]
            need = 0 if last else len(VERSION)

    place = at
    try:
        for place, piece in unpack(file, at):
            data += piece
            if piece:
                yield from parse(place, False)
    except Damage:
        if data:
            yield from held
        raise
    yield from parse(place, True)
    yield from held
    yield place, None


def missing(data: bytearray) -> int:
    """How many bytes the record at the beginning of ``data`` takes, as far as its header tells; more than there are while it doesn't."""
    if len(data) < len(VERSION):
        return len(VERSION)
    if not VERSION_LINE.match(data):
        raise Damage("no version line in the member")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        if len(data) > HEADER_BYTES:
            raise Damage("header does not end")
        return len(data) + 1
    told = re.search(rb"(?i)\r\ncontent-length[ \t]*:[ \t]*([0-9]+)[ \t]*\r\n", data[: end + 2])
    if not told:
        raise Damage("header has no length")
    return end + 4 + int(told[1]) + 4


def salvage_members(file) -> Iterator[tuple[int, int, Record | str]]:
    """See ``salvage``. Records and gaps inside a member begin and end at the places that its chunks were read from."""
    at, size = 0, file.size()
    mark, reason = 0, ""  # what is before ``mark`` is told; ``reason``: of the gap that begins there
    while at < size:
        held, whole = None, True
        try:
            for place, found in read_member(file, at):
                if held:
                    end = place if found is None else held[0]
                    yield mark, end, held[1]
                    held, mark = None, end
                if isinstance(found, str):
                    reason, whole = reason or found, whole and bool(reason)
                elif found:
                    if reason:
                        cut = max(mark, at if whole else place)
                        yield mark, cut, reason
                        mark, reason = cut, ""
                    held, whole = (max(place, mark), found), False
                else:
                    at = place
        except Damage as e:
            if held:
                yield mark, held[0], held[1]
                mark = held[0]
            reason = reason or str(e)
            at = search(file, max(at, mark if not whole else 0) + 1, True)
    if reason:
        yield mark, size, reason


def read_plain(file, at: int) -> tuple[list[Record], int]:
    """The record at ``at`` of a plain archive, and where it ends."""
    file.seek(at)
    head = file.read(CHUNK)
    while b"\r\n\r\n" not in head and len(head) < HEADER_BYTES and (more := file.read(CHUNK)):
        head += more
    if not VERSION_LINE.match(head):
        raise Damage("no version line")
    end = head.find(b"\r\n\r\n")
    told = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)[ \t]*\r\n", head[: end + 2]) if end >= 0 else None
    if not told:
        raise Damage("header has no length")
    size = end + 4 + int(told[1]) + 4
    if at + size > file.size():
        raise Damage("file ends inside a record")
    file.seek(at)
    return [check(file.read(size))[0]], at + size


def search(file, at: int, packed: bool) -> int:
    """The next place from ``at`` on where a member or a version line may begin; the file's size if there is none."""
    wanted, place = MEMBER if packed else b"WARC/", at
    overlap = len(wanted) - 1
    while place < file.size():
        file.seek(place)
        chunk = file.read(CHUNK)
        found = chunk.find(wanted)
        if found >= 0:
            return place + found
        if len(chunk) <= overlap:
            break
        place += len(chunk) - overlap
    return file.size()


def salvage(file, packed: bool) -> Iterator[tuple[int, int, Record | str]]:
    """(start, end, record) of every record that passes its checks, and (start, end, reason) of the gaps between them, in order."""
    if packed:
        yield from salvage_members(file)
        return
    at, size = 0, file.size()
    gap, reason = -1, ""
    while at < size:
        try:
            records, end = read_plain(file, at)
        except Damage as e:
            if gap < 0:
                gap, reason = at, str(e)
            at = search(file, at + 1, False)
            continue
        if gap >= 0:
            yield gap, at, reason
            gap = -1
        for r in records:
            yield at, end, r
        at = end
    if gap >= 0:
        yield gap, size, reason


def read_archives(paths: DataFrame, packed: bool | None = None) -> DataFrame:
    """Records and gaps (``kind``: record, gap) of the archives in column ``path``, each read by one task as a stream.

    ``packed``: whether the archives have gzip members (by default by the name, ``.gz``). An empty archive has no rows; a null path is
    ignored. ``payload_length`` is that of the full payload; a revisit has an empty ``payload``. Gaps have start, end and reason only.
    """
    rows = paths.select("path").where("path is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                held, size = [], 0
                with store.open_input_file(place) as file:
                    for start, end, found in salvage(file, path.endswith(".gz") if packed is None else packed):
                        held.append(_row(path, start, end, found))
                        size += len(held[-1].get("payload") or b"")
                        if size > CHUNK * 32 or len(held) >= 1000:
                            yield pa.RecordBatch.from_pylist(held, READ_ARROW)
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, READ_ARROW)

    return rows.repartition(max(1, rows.count())).mapInArrow(run, READ)


def _row(path: str, start: int, end: int, found: Record | str) -> dict:
    if isinstance(found, str):
        return {"path": path, "kind": "gap", "start": start, "end": end, "reason": found}
    get = found.fields.get
    digest = get("warc-payload-digest", "")
    return {
        "path": path, "kind": "record", "start": start, "end": end, "type": get("warc-type"), "record_id": get("warc-record-id"), "refers_to": get("warc-refers-to"), "target_uri": get("warc-target-uri"),
        "payload_digest": digest.removeprefix("sha1:").lower() or None, "payload_length": found.length, "payload": found.payload,
    }


def page_number(record_id: Column) -> Column:
    """The page id in a record id, null where there is none."""
    return F.regexp_extract(record_id, r"<urn:page:(-?[0-9]+)>", 1).try_cast("bigint")
