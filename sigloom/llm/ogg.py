"""Ogg media columns: unsigned 8-bit mono samples in an Ogg stream, and a reader that trusts nothing.

The writer multiplexes two logical streams, the samples and a stream that states how many of them carry data. The reader
verifies each page's checksum, finds the next page after damage, sorts pages into logical streams by serial number,
joins packets from lacing values across pages, and derives each packet's time from granule positions. Serial numbers
come from the payload, so equal payloads give equal bytes.

Defined cases: null and empty payloads become 64 zero samples; payloads of any length are cut into packets, so pages
never exceed the format's 65,307 bytes; a missing or damaged page loses its packets only and is counted.
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

from .common import extended

RATE = 8000
PACKET = 8192
_PAGE = struct.Struct("<4sBBqIIIB")
_PCM = struct.Struct(">8sHHIIBBHI")
_COUNT = struct.Struct("<8sQ")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """Ogg's CRC-32: most significant bit first, no complement. zlib's is the same polynomial, reflected."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    crc = page_checksum(head + lacing + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + lacing + body


def pages_of(packets: list[tuple[bytes, int]], serial: int, first: bool, number: int = 0) -> list[bytes]:
    """Pages that hold (packet, granule position at its end); a packet may go on in the next page."""
    lacing, values, body = [], bytearray(), b"".join(p for p, _ in packets)
    for packet, granule in packets:
        full, rest = divmod(len(packet), 255)
        lacing += [(255, None)] * full + [(rest, granule)]
    out, at, continued = [], 0, False
    for k in range(0, len(lacing), 255):
        part = lacing[k : k + 255]
        values = bytes(v for v, _ in part)
        size = sum(values)
        ended = [g for _, g in part if g is not None]
        flags = continued | 2 * (first and not k) | 4 * (not first and k + 255 >= len(lacing))
        out.append(_page(flags, ended[-1] if ended else -1, serial, number + len(out), values, body[at : at + size]))
        at += size
        continued = part[-1][1] is None
    return out


def write_ogg(samples: bytes, n_data: int, rate: int = RATE, packet: int = PACKET) -> bytes:
    """Both logical streams: headers first, then the sample pages, then the last page of the count stream."""
    serial = zlib.crc32(samples) & 0x7FFFFFFE
    header = _PCM.pack(b"PCM     ", 0, 0, 1, rate, 8, 1, packet, 0)
    heads = pages_of([(header, 0)], serial, True) + pages_of([(b"COUNT\0\0\0", 0)], serial + 1, True)
    data = [(samples[a : a + packet], min(a + packet, len(samples))) for a in range(0, len(samples), packet)]
    return b"".join([*heads, *pages_of(data, serial, False, 1), *pages_of([(_COUNT.pack(b"COUNT\0\0\0", n_data), 0)], serial + 1, False, 1)])


@dataclass
class LogicalStream:
    packets: list[bytes] = field(default_factory=list)
    ends: list[int | None] = field(default_factory=list)  # granule position at the packet's end, where a page tells it
    next_number: int | None = None
    open_packet: bytes | None = None
    gaps: int = 0
    ended: bool = False


def read_ogg(data: bytes) -> tuple[dict[int, LogicalStream], int, int]:
    """Logical streams by serial number, good pages, and damaged places."""
    streams: dict[int, LogicalStream] = {}
    at, good, bad, seeking = 0, 0, 0, False
    while at < len(data):
        at_page = data.find(b"OggS", at)
        if at_page < 0 or len(data) - at_page < 27:
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, n = _PAGE.unpack_from(data, at_page)
        lacing = data[at_page + 27 : at_page + 27 + n]
        end = at_page + 27 + n + sum(lacing)
        page = data[at_page:end]
        if version or len(page) < end - at_page or page_checksum(page[:22] + bytes(4) + page[26:]) != crc:
            bad += not seeking
            at, seeking = at_page + 4, True
            continue
        bad += at_page != at and not seeking
        at, good, seeking = end, good + 1, False
        s = streams.setdefault(serial, LogicalStream())
        lost = s.next_number is not None and number != s.next_number
        if lost:
            s.gaps += 1
            s.open_packet = None
        s.next_number, s.ended = number + 1, s.ended or bool(flags & 4)
        held, skip = (s.open_packet or b"", flags & 1 and s.open_packet is None) if flags & 1 else (b"", False)
        body, done = 27 + n, 0
        s.open_packet = None
        begin = body
        finished = []
        for v in lacing:
            body += v
            if v < 255:
                if not skip:
                    finished.append(held + page[begin:body])
                held, begin, skip, done = b"", body, False, done + 1
        if n and lacing[-1] == 255 and not skip:
            s.open_packet = held + page[begin:body]
        s.packets += finished
        s.ends += [None] * len(finished)
        if finished and granule >= 0:
            s.ends[-1] = granule
    return streams, good, bad


def times_us(stream: LogicalStream, rate: int) -> list[int]:
    """The end of each sample packet in microseconds: a page dates its last packet, the others count back from it."""
    ends: list[int] = []
    known, sizes = stream.ends[1:], [len(p) for p in stream.packets[1:]]
    after: int | None = None
    for end, size in zip(reversed(known), reversed(sizes), strict=True):
        after = end if end is not None else after
        ends.append(-1 if after is None else after * 1_000_000 // rate)
        after = None if after is None else after - size
    return ends[::-1]


def read_samples(data: bytes) -> dict:
    """The samples, how many carry data, and what the container says of them."""
    streams, good, bad = read_ogg(data)
    sound = next(s for s in streams.values() if s.packets and s.packets[0][:8] == b"PCM     ")
    count = next(s for s in streams.values() if s.packets and s.packets[0][:5] == b"COUNT")
    rate = _PCM.unpack(sound.packets[0])[4]
    times = times_us(sound, rate)
    return {"samples": b"".join(sound.packets[1:]), "n_data": _COUNT.unpack(count.packets[1])[1], "pages": good, "damaged": bad + sound.gaps, "packets": len(sound.packets) - 1, "streams": len(streams), "duration_us": times[-1] if times else 0, "rate": rate}


def pad(payload: bytes | None) -> bytes:
    """With zeros up to a positive multiple of 64 bytes."""
    payload = payload or b""
    return payload + bytes(-len(payload) % 64 or (0 if payload else 64))


def features(found: dict) -> str:
    """A line on the sound: duration, container, level, mean, sign changes about the middle."""
    x = np.frombuffer(found["samples"], np.uint8).astype(np.int64) - 128
    turns = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"us={found['duration_us']};pages={found['pages']};packets={found['packets']};streams={found['streams']};damaged={found['damaged']};square={int((x * x).sum()) // len(x)};sum={int(x.sum())};turns={turns}"


def with_media(df: DataFrame, id_col: str = "doc_id", payload_col: str = "text") -> DataFrame:
    """doc_id and media: each payload, a text in UTF-8 or bytes, as an Ogg file."""
    source = df.select(F.col(id_col).alias("doc_id"), F.col(payload_col).cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [write_ogg(pad(p), len(p or b"")) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return source.mapInArrow(run, extended(source.select("doc_id").schema, "media binary"))


def media_features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """What the stored Ogg bytes of each row hold: sizes, checksums and features of the samples read back."""
    source = df.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    kinds = (("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"))
    schema = extended(source.select("doc_id").schema, ", ".join(map(" ".join, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for media in b.column(1).to_pylist():
                found = read_samples(media)
                s = found["samples"]
                rows.append((found["n_data"], len(s), hashlib.sha256(s).hexdigest(), zlib.crc32(s[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(found)))
            columns = [pa.array([r[i] for r in rows], pa.string() if kind == "string" else pa.int64()) for i, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=schema.names)

    return source.mapInArrow(run, schema)
