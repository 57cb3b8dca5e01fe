"""Legacy archive converter: ARC files to WARC files.

ARC versions 1 and 2 name their header fields in the version block at the top of a file; record headers are parsed by that
definition, from the right, since an address may hold spaces, and bodies by their declared length. The converter gives
each record a WARC identifier, a timestamp from its 14 digits, a type, and digests of block and payload. The archive's
version block becomes a warcinfo record.

A payload of at least `REVISIT_BYTES` bytes is stored once: among equal payloads the record with the smallest page id (then
the first in its archive) is a response, the others are revisits that keep the response's HTTP header and name it.

ARC and WARC records are gzip members. Tasks write files under names of their own and report them; the lists of
reported files are tables written by Spark, so files of lost or repeated attempts are never read. Deciding on revisits
moves index rows, never payloads.

Defined cases: a null payload is empty; a null address becomes urn:page:<id>; white space and control characters in an
address are percent-encoded; records without a page id count as the smallest; an empty table writes nothing; other
columns are ignored. An archive that is cut off yields its whole records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, written

REVISIT_BYTES = 100
FILE_BYTES = 16 << 20
LEVEL = 3
STEP = 8192
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:sigloom:archive")
_EPOCH = datetime(2001, 1, 1, tzinfo=timezone.utc)
#: The header lines that the two ARC versions define.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
INDEX = pa.schema([("arc", pa.string()), ("position", pa.int64()), ("page_id", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("url", pa.string()), ("date", pa.string())])


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def members(data: bytes, cut: bool = False) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member; a member that is cut off ends the file, with `cut` after what is there."""
    at, view = 0, memoryview(data)
    while at < len(data):
        d, parts, to = zlib.decompressobj(31), [], at
        while not d.eof and to < len(data):  # in steps: what is left over of a step is copied
            parts.append(d.decompress(view[to : to + STEP]))
            to += STEP
        if not d.eof:
            if cut:
                yield at, b"".join(parts)
            return
        yield at, b"".join(parts)
        at = min(to, len(data)) - len(d.unused_data)


def arc_address(url: str | None, page_id: int | None) -> str:
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else f"urn:page:{page_id}"


def arc_record(version: int, url: str, date: str, body: bytes, name: str, position: int) -> bytes:
    short = [url, "0.0.0.0", date, "text/html"]
    extra = ["200", hashlib.md5(body).hexdigest(), "-", str(position), name] if version == 2 else []
    return " ".join([*short, *extra, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_version_block(version: int, date: str, name: str) -> bytes:
    text = f"{version} {version - 1} sigloom\n{ARC_FIELDS[version]}\n".encode()
    fields = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"] + (["200", "-", "-", "0", name] if version == 2 else [])
    return " ".join([*fields, str(len(text))]).encode() + b"\n" + text + b"\n"


def write_arcs(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages as ARC files, versions 1 and 2 in turn; returns the list of files: arc, version, records."""
    folder = shared_path(pages.sparkSession, "arc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = _open(folder)
        out, name, version, size, records = None, "", 2, 0, 0
        for batch in batches:
            for page_id, url, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                payload = payload or b""
                date = (_EPOCH + timedelta(seconds=(page_id or 0) % 600_000_000)).strftime("%Y%m%d%H%M%S")
                if out is None:
                    store.create_dir(inner, recursive=True)
                    version, name = 3 - version, f"{uuid.uuid4().hex}.arc.gz"
                    out = store.open_output_stream(f"{inner}/{name}")
                    out.write(_member(arc_version_block(version, date, name)))
                    size = records = 0
                page = b"" if page_id is None else f"X-Page-Id: {page_id}\r\n".encode()
                body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + page + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                out.write(_member(arc_record(version, arc_address(url, page_id), date, body, name, records)))
                size, records = size + len(body), records + 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"arc": [f"{folder}/{name}"], "version": pa.array([version], pa.int32()), "records": [records]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"arc": [f"{folder}/{name}"], "version": pa.array([version], pa.int32()), "records": [records]})

    source = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(payload_col).cast("binary"))
    return written(source.mapInArrow(run, "arc string, version int, records long"), "arc-files")


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Position (0 is the version block), header fields and body of each record of an ARC file: plain, gzipped a record at a
    time, or gzipped in one member or several of any number of records. A record that is cut off ends the file."""
    parts = members(data, cut=True) if data[:2] == b"\x1f\x8b" else [(0, data)]
    plain = (record for _, part in parts for record in _plain_records(part))
    fields: list[str] = []
    for k, (_, record) in enumerate(plain):
        line, _, rest = record.partition(b"\n")
        if not k:
            length = int(line.rsplit(b" ", 1)[1])
            version_line, definition = rest[:length].decode("utf-8", "replace").split("\n")[:2]
            fields = definition.split()
            if version_line.split()[0] not in ("1", "2") or fields[-1] != "Archive-length":
                raise ValueError("not an ARC file of version 1 or 2")
            head = dict(zip(("URL", "Archive-date"), (line.split(b" ")[0].decode(), line.split(b" ")[2].decode()), strict=True)) | {"version": version_line.split()[0]}
            yield 0, head, rest[:length]
            continue
        values = line.decode("utf-8", "replace").rsplit(" ", len(fields) - 1)
        head = dict(zip(fields, values, strict=True))
        body = rest[: int(head["Archive-length"])]
        if len(body) == int(head["Archive-length"]):
            yield k, head, body


def _plain_records(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data) and (line := data.find(b"\n", at)) >= 0:
        end = line + 1 + int(data[at:line].rsplit(b" ", 1)[1])
        if end > len(data):
            return
        yield at, data[at:end]
        at = end + 1


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its empty line, and payload; a body without a header is all payload."""
    if body[:5] == b"HTTP/" and (at := body.find(b"\r\n\r\n")) >= 0:
        return body[: at + 4], body[at + 4 :]
    return b"", body


def http_field(header: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", header)
    return found[1].decode("utf-8", "replace").strip() if found else None


def _tasks(files: DataFrame) -> int:
    return max(1, min(files.count(), 100_000))


def index_arcs(files: DataFrame) -> DataFrame:
    """A row per ARC record: where it is, page id, payload digest and size, address and date."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for arc in batch.column(0).to_pylist():
                store, inner = _open(arc)
                with store.open_input_stream(inner) as f:
                    data = f.read()
                rows = []
                for k, head, body in arc_records(data):
                    if k:
                        header, payload = split_http(body)
                        page = http_field(header, b"X-Page-Id")
                        rows.append({"arc": arc, "position": k, "page_id": None if page is None else int(page), "digest": hashlib.sha256(payload).hexdigest(), "payload_bytes": len(payload), "url": head["URL"], "date": head["Archive-date"]})
                yield pa.RecordBatch.from_pylist(rows, INDEX)

    return written(files.select("arc").repartition(_tasks(files)).mapInArrow(run, "arc string, position long, page_id long, digest string, payload_bytes long, url string, date string"), "arc-index")


def revisits(index: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """The index and, for records that revisit another, that other's page id, address, date, archive and position."""
    where = F.struct("page_id", "arc", "position", "url", "date")
    groups = index.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.min(where).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = index.join(groups, "digest", "left")
    other = F.col("first").isNotNull() & ((F.col("first.arc") != F.col("arc")) | (F.col("first.position") != F.col("position")))
    return joined.withColumn("first", F.when(other, F.col("first")))


def warc_date(digits: str) -> str:
    """ISO 8601 of an ARC timestamp of up to 14 digits; missing or wrong parts count as their least value."""
    digits = re.sub(r"\D", "", digits)[:14]
    full = digits + "00010101000000"[len(digits) :]
    try:
        return datetime.strptime(full, "%Y%m%d%H%M%S").isoformat() + "Z"
    except ValueError:
        return "0001-01-01T00:00:00Z"


def record_id(arc: str, position: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{arc.rsplit("/", 1)[-1]}#{position}')}>"


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    lines = [f"{k}: {v}" for k, v in (fields | {"WARC-Block-Digest": f"sha1:{digest}", "Content-Length": str(len(block))}).items()]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def converted(arc: str, data: bytes, firsts: dict[int, dict | None]) -> Iterator[bytes]:
    """WARC records of an ARC file; firsts: by position what a record revisits."""
    for k, head, body in arc_records(data):
        date = warc_date(head["Archive-date"])
        if not k:
            info = f"software: sigloom\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC/{head['version']}\r\n".encode()
            yield warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(arc, 0), "WARC-Date": date, "WARC-Filename": arc.rsplit("/", 1)[-1].replace(".arc", ".warc"), "Content-Type": "application/warc-fields"}, info)
            continue
        header, payload = split_http(body)
        page, first = http_field(header, b"X-Page-Id"), firsts.get(k)
        fields = {"WARC-Type": "revisit" if first else "response", "WARC-Record-ID": record_id(arc, k), "WARC-Date": date, "WARC-Target-URI": head["URL"], "WARC-IP-Address": head["IP-address"], "WARC-Warcinfo-ID": record_id(arc, 0), "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}", "Content-Type": "application/http; msgtype=response"}
        if page is not None:
            fields["WARC-Page-ID"] = page
        if first:
            fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(first["arc"], first["position"]), "WARC-Refers-To-Target-URI": first["url"], "WARC-Refers-To-Date": warc_date(first["date"])}
            if first["page_id"] is not None:
                fields["WARC-Refers-To-Page-ID"] = str(first["page_id"])
        yield warc_record(fields, header if first else body)


def convert(files: DataFrame, index: DataFrame | None = None, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write a WARC file for each ARC file; returns the list of files: warc, records."""
    folder = shared_path(files.sparkSession, "warc")
    decided = revisits(index_arcs(files) if index is None else index, least_bytes)
    first = F.when(F.col("first").isNotNull(), F.to_json("first"))
    rows = decided.where(F.col("first").isNotNull()).select("arc", "position", first.alias("first"))
    # every file once, then its revisits: a task streams through one file's decisions at a time
    rows = rows.unionByName(files.select("arc", F.lit(0).cast("long").alias("position"), F.lit(None).cast("string").alias("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        arc, firsts = None, {}

        def close() -> pa.RecordBatch:
            store, inner = _open(arc)
            with store.open_input_stream(inner) as f:
                data = f.read()
            store, inner = _open(folder)
            store.create_dir(inner, recursive=True)
            name, n = f"{uuid.uuid4().hex}.warc.gz", 0
            with store.open_output_stream(f"{inner}/{name}") as out:
                for record in converted(arc, data, firsts):
                    out.write(_member(record))
                    n += 1
            return pa.RecordBatch.from_pydict({"warc": [f"{folder}/{name}"], "records": [n]})

        for batch in batches:
            for a, position, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if a != arc:
                    if arc is not None:
                        yield close()
                    arc, firsts = a, {}
                if position:
                    found = json.loads(text)
                    firsts[position] = {k: found.get(k) for k in ("page_id", "arc", "position", "url", "date")}
        if arc is not None:
            yield close()

    dealt = rows.repartition(_tasks(files), "arc").sortWithinPartitions("arc", "position")
    return written(dealt.mapInArrow(run, "warc string, records long"), "warc-files")


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    for _, record in members(data):
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        if fields["WARC-Block-Digest"] != f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}":
            raise ValueError(f"block digest of {fields['WARC-Record-ID']} does not hold")
        yield fields, block


def read_warcs(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """The response and revisit records: record_id, page_id, record_type, date, url, payload_bytes, payload_digest,
    refers_to (page id), refers_to_record and, if asked for, the payload of responses."""
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("date", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("refers_to_record", pa.string())] + [("payload", pa.binary())] * with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = _open(path)
                with store.open_input_stream(inner) as f:
                    data = f.read()
                rows = []
                for fields, block in warc_records(data):
                    if fields["WARC-Type"] not in ("response", "revisit"):
                        continue
                    header, payload = split_http(block)
                    digest = fields["WARC-Payload-Digest"].split(":", 1)[1]
                    if fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} does not hold")
                    size = len(payload) if fields["WARC-Type"] == "response" else int(http_field(header, b"Content-Length"))
                    numbers = {k: None if fields.get(f) is None else int(fields[f]) for k, f in (("page_id", "WARC-Page-ID"), ("refers_to", "WARC-Refers-To-Page-ID"))}
                    rows.append(numbers | {"record_id": fields["WARC-Record-ID"], "record_type": fields["WARC-Type"], "date": fields["WARC-Date"], "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "refers_to_record": fields.get("WARC-Refers-To"), **({"payload": payload} if with_payload else {})})
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = "record_id string, page_id long, record_type string, date string, url string, payload_bytes long, payload_digest string, refers_to long, refers_to_record string"
    return files.select("warc").repartition(_tasks(files)).mapInArrow(run, ddl + ", payload binary" * with_payload)
