"""The binary formats: block streams of samples, dictionary and basis files, event files.

Block stream: per block the bytes ALW, u64 N, f64 scale, three bytes, N f64 high parts, N f64 low parts; a sample is
(high + low) / scale. The three bytes follow the scale; missing low parts at the end of input count as zero.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sigloom.functions.atoms import TYPES
from sigloom.session import written

#: Fixed values of the formats.
BLOCK_MAGIC, DICTIONARY_MAGIC, BASIS_MAGIC, EVENT_MAGIC = b"ALW", 0x4C454152, 0x414C5742, 0x45564E54
#: Bytes of a partition of the block source, and of a file that is written unless one block is longer.
SPLIT = 1 << 24
SAMPLE_SCHEMA = "path string, block_id int, n long, i long, y double"


def encode_block(hi: np.ndarray, scale: float = 1.0, lo: np.ndarray | None = None, basis: bytes = bytes(3)) -> bytes:
    hi = np.asarray(hi, "<f8")
    lo = np.zeros(len(hi)) if lo is None else np.asarray(lo, "<f8")
    return BLOCK_MAGIC + struct.pack("<Qd", len(hi), scale) + basis + hi.tobytes() + lo.astype("<f8").tobytes()


def decode_blocks(data: bytes) -> Iterator[tuple[int, float, np.ndarray]]:
    """(number, scale, samples) of each block; a wrong signature or cut-off high part raises ValueError."""
    at, number = 0, 0
    while at < len(data):
        if data[at : at + 3] != BLOCK_MAGIC or len(data) < at + 22:
            raise ValueError(f"no block at byte {at}")
        n, scale = struct.unpack_from("<Qd", data, at + 3)
        at += 22
        if len(data) < at + 8 * n:
            raise ValueError(f"block {number} is cut off")
        hi = np.frombuffer(data, "<f8", n, at)
        at += 8 * n
        have = min(n, (len(data) - at) // 8)
        lo = np.zeros(n)
        lo[:have] = np.frombuffer(data, "<f8", have, at)
        at = len(data) if have < n else at + 8 * n
        yield number, scale, (hi + lo) / scale if scale else hi + lo
        number += 1


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """path, block_id, n, i, y of all block files under a path of any store that Spark reads; a file is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for number, _, y in decode_blocks(content):
                    for a in range(0, len(y), 100_000):
                        part = y[a : a + 100_000]
                        yield pa.RecordBatch.from_pydict({"path": [name] * len(part), "block_id": pa.array([number] * len(part), pa.int32()), "n": pa.array([len(y)] * len(part), pa.int64()), "i": np.arange(a, a + len(part)), "y": part})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SAMPLE_SCHEMA)


class BlockSource(DataSource):
    """spark.read.format("signal_blocks").load(path): path is a file or folder URI or path. A partition holds about `SPLIT`
    bytes: many small blocks and files, or a piece of a long block."""

    @classmethod
    def name(cls) -> str:
        return "signal_blocks"

    def schema(self) -> str:
        return SAMPLE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BlockReader(self.options["path"])


class _Blocks(InputPartition):
    """Runs (path, number of the first block, first byte, end), and of a piece of a long block also its `_Long`."""

    def __init__(self, runs: list[tuple]):
        super().__init__(runs[0][0])
        self.runs = runs


class _Long(NamedTuple):
    """Samples from `first` to before `last` of a block of n, whose samples begin at byte `at`; `low` low parts are there."""

    at: int
    n: int
    scale: float
    low: int
    first: int
    last: int


def _headers(f, length: int) -> Iterator[tuple[int, int, int, float, int]]:
    """(number, byte of the samples, how many, scale, low parts that are there) of each block. Headers of neighbouring small
    blocks come with one read."""
    at, number, begin, window = 0, 0, 0, b""
    while at < length:
        if at + 22 > begin + len(window):
            f.seek(at)
            begin, window = at, f.read(1 << 16)
        head = window[at - begin : at - begin + 22]
        if head[:3] != BLOCK_MAGIC or len(head) < 22:
            raise ValueError(f"no block at byte {at}")
        n, scale = struct.unpack_from("<Qd", head, 3)
        at += 22
        if length < at + 8 * n:
            raise ValueError(f"block {number} is cut off")
        low = min(n, (length - at - 8 * n) // 8)
        yield number, at, n, scale, low
        at = at + 16 * n if low == n else length
        number += 1


class _BlockReader(DataSourceReader):
    """Files up to `split` bytes are read whole, their headers by the task; of longer ones the driver reads the headers, and
    cuts them between blocks and inside blocks longer than that. A task hands on Arrow batches of at most `PIECE` samples."""

    PIECE = 1 << 17

    def __init__(self, path: str, split: int = SPLIT):
        self.path, self.split = path, split

    def _runs(self, store, path: str, length: int) -> Iterator[tuple[int, tuple]]:
        """(bytes, run) of a file."""
        if length <= self.split:
            yield length, (path, 0, 0, length, None)
            return
        with store.open_input_file(path) as f:
            first, begin, end = 0, 0, 0  # blocks that wait: number of the first, its byte, where they end
            for number, at, n, scale, low in _headers(f, length):
                to = at + 16 * n if low == n else length
                if end > begin and to - begin > self.split:
                    yield end - begin, (path, first, begin, end, None)
                    first, begin = number, at - 22
                end = to
                if end - begin > self.split:
                    step = max(self.split // 16, 1)
                    for a in range(0, n, step):
                        last = min(a + step, n)
                        yield 16 * (last - a), (path, number, begin, end, _Long(at, n, scale, low, a, last))
                    first, begin = number + 1, end
            if end > begin:
                yield end - begin, (path, first, begin, end, None)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(inner)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner))
        found: list[InputPartition] = []
        held: list[tuple] = []
        weight = 0
        for file in sorted(files, key=lambda f: f.path):
            if file.type == fs.FileType.File:
                for size, run in self._runs(store, file.path, file.size):
                    if held and weight + size > self.split:
                        found.append(_Blocks(held))
                        held, weight = [], 0
                    held.append(run)
                    weight += size
        return [*found, _Blocks(held)] if held else found

    def _read(self, partition: InputPartition) -> Iterator[tuple[str, int, int, int, np.ndarray]]:
        """(path, block, its length, first index, samples), at most `PIECE` samples at once."""
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        for path, first, begin, end, long in partition.runs:
            with store.open_input_file(path) as f:
                if long is None:
                    f.seek(begin)
                    for number, _, y in decode_blocks(f.read(end - begin)):
                        for start in range(0, len(y), self.PIECE):
                            yield path, first + number, len(y), start, y[start : start + self.PIECE]
                    continue
                for start in range(long.first, long.last, self.PIECE):
                    size = min(self.PIECE, long.last - start)
                    f.seek(long.at + 8 * start)
                    y = np.frombuffer(f.read(8 * size), "<f8").copy()
                    have = min(max(long.low - start, 0), size)
                    f.seek(long.at + 8 * (long.n + start))
                    y[:have] += np.frombuffer(f.read(8 * have), "<f8")
                    yield path, first, long.n, start, y / long.scale if long.scale else y

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, int, int, np.ndarray]] = []
        waiting = 0
        for part in self._read(partition):
            if waiting + len(part[4]) > self.PIECE:
                yield self._batch(held)
                held, waiting = [], 0
            held.append(part)
            waiting += len(part[4])
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(parts: list[tuple[str, int, int, int, np.ndarray]]) -> pa.RecordBatch:
        paths, blocks, lengths, starts, ys = zip(*parts, strict=True)
        sizes = [len(y) for y in ys]
        path = pa.array(paths, pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        i = np.concatenate([np.arange(a, a + k) for a, k in zip(starts, sizes, strict=True)])
        return pa.RecordBatch.from_pydict({"path": path, "block_id": np.repeat(np.array(blocks, np.int32), sizes), "n": np.repeat(np.array(lengths, np.int64), sizes), "i": i, "y": np.concatenate(ys)})


def write_blocks(s: DataFrame, keys: list[str], path: str, size: int = 1 << 16, scale: float = 1.0, file_bytes: int = SPLIT) -> DataFrame:
    """Indexed samples (keys, i, y) as block files of at most `file_bytes` or one block, of blocks of at most `size` samples.
    Returns keys, chunk (its samples start at chunk * size), file (name under path) and block_id, a row a block; only listed
    files count."""
    chunk = s.select(*keys, F.floor(F.col("i") / size).cast("long").alias("chunk"), F.struct("i", "y").alias("v")).groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list("v")).alias("v"))
    schema = StructType([*chunk.select(*keys).schema.fields, *StructType.fromDDL("chunk long, file string, block_id int").fields])
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        name, out, number, length = "", None, 0, 0
        try:
            for b in batches:
                files, numbers = [], []
                for y in b.column(width + 1).to_pylist():
                    data = encode_block(np.array(y, dtype=float) * scale, scale)
                    if out is not None and length + len(data) > file_bytes:
                        out.close()
                        out = None
                    if out is None:
                        store.create_dir(inner, recursive=True)
                        name, number, length = f"{uuid.uuid4().hex}.alw", 0, 0
                        out = store.open_output_stream(f"{inner}/{name}")
                    out.write(data)
                    files.append(name)
                    numbers.append(number)
                    number, length = number + 1, length + len(data)
                yield pa.RecordBatch.from_arrays([*b.columns[: width + 1], pa.array(files, pa.string()), pa.array(numbers, pa.int32())], names=schema.names)
        finally:
            if out is not None:
                out.close()

    return written(chunk.select(*keys, "chunk", F.col("v.y").alias("y")).mapInArrow(run, schema), "block-list")


def write_files(df: DataFrame, path: str) -> DataFrame:
    """Rows (name, data binary) as files under a path; returns name and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        for b in batches:
            store.create_dir(inner, recursive=True)
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{inner}/{name}") as f:
                    f.write(data)
            yield pa.RecordBatch.from_pydict({"name": b.column(0), "bytes": pa.array([len(d.as_py()) for d in b.column(1)], pa.int64())})

    return written(df.select("name", "data").mapInArrow(run, "name string, bytes long"), "file-list")


def doubles(column: str):
    """An array of doubles as little-endian bytes, then as many zeros for the low parts; null is empty."""

    @pandas_udf("binary")
    def packed(x: pd.Series) -> pd.Series:
        return x.map(lambda v: b"" if v is None else np.asarray(v, "<f8").tobytes() + bytes(8 * len(v)))

    return packed(column)


def _decoded(spark: SparkSession, path: str, ddl: str, decode) -> DataFrame:
    """name and what `decode` gives for each file under a path of any store that Spark reads."""
    arrow = to_arrow_schema(StructType.fromDDL("name string, " + ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(name, *r) for r in decode(data)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.mapInArrow(run, "name string, " + ddl)


def read_dictionary_files(spark: SparkSession, path: str) -> DataFrame:
    """name, atom_index, norm, atom of dictionary files, with or without low parts; a damaged file fails the read."""

    def rows(data: bytes) -> list[tuple]:
        atoms, norms = decode_dictionary(data)
        return [(k, float(n), a.tolist()) for k, (a, n) in enumerate(zip(atoms, norms, strict=True))]

    return _decoded(spark, path, "atom_index int, norm double, atom array<double>", rows)


def read_basis_files(spark: SparkSession, path: str) -> DataFrame:
    """name, batch, basis_index, q, r of basis files of either version; a single basis is batch 0."""

    def rows(data: bytes) -> list[tuple]:
        q, r = decode_basis(data)
        q, r = (q, r) if q.ndim == 3 else (q[None], r[None])
        return [(i, j, q[i, j].tolist(), r[i, j].tolist()) for i in range(len(q)) for j in range(q.shape[1])]

    return _decoded(spark, path, "batch int, basis_index int, q array<double>, r array<double>", rows)


def encode_dictionary(atoms: np.ndarray, norms: np.ndarray | None = None, with_low: bool = True) -> bytes:
    atoms = np.asarray(atoms, "<f8")
    head = struct.pack("<IIii", DICTIONARY_MAGIC, 1, *atoms.shape)
    norms = np.zeros(len(atoms)) if norms is None else np.asarray(norms)
    return head + atoms.tobytes() + (np.zeros(atoms.size).astype("<f8").tobytes() if with_low else b"") + norms.astype("<f8").tobytes()


def decode_dictionary(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Atoms and norms; the length tells whether low parts are there. Anything wrong raises ValueError."""
    if len(data) < 16 or struct.unpack_from("<II", data) != (DICTIONARY_MAGIC, 1):
        raise ValueError("no dictionary of version 1")
    a, n = struct.unpack_from("<ii", data, 8)
    body = np.frombuffer(data, "<f8", offset=16) if (len(data) - 16) % 8 == 0 else np.zeros(0)
    if a < 1 or n < 1 or len(body) not in (a * n + a, 2 * a * n + a):
        raise ValueError("the dictionary's size and its dimensions disagree")
    atoms = body[: a * n] + (body[a * n : 2 * a * n] if len(body) > a * n + a else 0)
    norms = body[-a:]
    if not np.isfinite(body).all() or (norms < 0).any():
        raise ValueError("the dictionary holds values that are not finite, or negative norms")
    return atoms.reshape(a, n), norms


def encode_basis(q: np.ndarray, r: np.ndarray) -> bytes:
    """Version 1 for one basis, version 2 for a batch (first axis)."""
    batch = q.ndim == 3
    head = struct.pack("<II", BASIS_MAGIC, 1 + batch) + struct.pack("<" + "i" * (2 + batch), *q.shape)
    zeros = lambda x: np.zeros(x.size).astype("<f8").tobytes()
    return head + q.astype("<f8").tobytes() + zeros(q) + r.astype("<f8").tobytes() + zeros(r)


def decode_basis(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if len(data) < 16 or struct.unpack_from("<I", data)[0] != BASIS_MAGIC or (version := struct.unpack_from("<I", data, 4)[0]) not in (1, 2):
        raise ValueError("no basis of version 1 or 2")
    shape = struct.unpack_from("<" + "i" * (1 + version), data, 8)
    r_shape = (*shape[:-1], shape[-2])
    body = np.frombuffer(data, "<f8", offset=8 + 4 * len(shape))
    m, k = int(np.prod(shape)), int(np.prod(r_shape))
    if len(body) != 2 * (m + k) or not np.isfinite(body).all():
        raise ValueError("the basis is damaged")
    return (body[:m] + body[m : 2 * m]).reshape(shape), (body[2 * m : 2 * m + k] + body[2 * m + k :]).reshape(r_shape)


_EVENT = struct.Struct("<iiB6d")


def encode_events(events: list[dict], frame_size: int, coefficients: list[list[float]] | None = None) -> bytes:
    """An event file; with `coefficients`, one list a frame follows the events."""
    out = [struct.pack("<IIii", EVENT_MAGIC, 1, len(events), frame_size)]
    out += [_EVENT.pack(e["frame_start"], e["atom_index"], TYPES.index(e["atom_type"]), e["amplitude"], 0.0, e["phase"], 0.0, e["energy"], 0.0) for e in events]
    if coefficients is not None:
        out.append(struct.pack("<i", len(coefficients)))
        out += [struct.pack("<i", len(c)) + np.asarray(c, "<f8").tobytes() + bytes(8 * len(c)) for c in coefficients]
    return b"".join(out)


def _event_count(data: bytes) -> int:
    magic, version, n, _ = struct.unpack_from("<IIii", data)
    if (magic, version) != (EVENT_MAGIC, 1) or len(data) < 16 + n * _EVENT.size:
        raise ValueError("no event file of version 1")
    return n


def decode_events(data: bytes) -> list[dict]:
    rows = (_EVENT.unpack_from(data, 16 + k * _EVENT.size) for k in range(_event_count(data)))
    return [{"frame_start": f, "atom_index": a, "atom_type": TYPES[t], "amplitude": v + vl, "phase": p + pl, "energy": e + el} for f, a, t, v, vl, p, pl, e, el in rows]


def decode_coefficients(data: bytes) -> list[np.ndarray]:
    """The coefficients behind the events, a vector a frame; none if the file ends there."""
    at = 16 + _event_count(data) * _EVENT.size
    if at == len(data):
        return []
    (frames,) = struct.unpack_from("<i", data, at)
    at, out = at + 4, []
    for _ in range(frames):
        (n,) = struct.unpack_from("<i", data, at)
        out.append(np.frombuffer(data, "<f8", n, at + 4) + np.frombuffer(data, "<f8", n, at + 4 + 8 * n))
        at += 4 + 16 * n
    return out


def events_binary(events: DataFrame, keys: list[str], frame_size: int, coefficients: DataFrame | None = None) -> DataFrame:
    """keys and data, an event file a series, with the coefficients (keys, frame_start, coeff) of its frames if given."""
    fields = ["frame_start", "pick", "atom_index", "atom_type", "amplitude", "phase", "energy"]
    g = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("e"))
    if coefficients is None:
        g = g.withColumn("c", F.lit(None).cast("array<array<double>>"))
    else:
        c = coefficients.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame_start", "coeff"))).alias("c")).select(*keys, F.col("c.coeff").alias("c"))
        g = g.join(c, keys, "full")
    schema = StructType([*g.select(*keys).schema.fields, *StructType.fromDDL("data binary").fields])
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [encode_events(e or [], frame_size, c) for e, c in zip(b.column(width).to_pylist(), b.column(width + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(data, pa.binary())], names=schema.names)

    return g.select(*keys, "e", "c").mapInArrow(run, schema)


def read_event_files(spark: SparkSession, path: str) -> DataFrame:
    """name, pick (order in the file), frame_start, atom_index, atom_type, amplitude, phase, energy of event files."""

    def rows(data: bytes) -> list[tuple]:
        return [(k, *e.values()) for k, e in enumerate(decode_events(data))]

    return _decoded(spark, path, "pick long, frame_start long, atom_index int, atom_type string, amplitude double, phase double, energy double", rows)


def read_coefficient_files(spark: SparkSession, path: str) -> DataFrame:
    """name, frame (its number) and coeff of the tails of event files."""
    return _decoded(spark, path, "frame long, coeff array<double>", lambda data: [(k, c.tolist()) for k, c in enumerate(decode_coefficients(data))])


def events_document(events: list[dict], **about) -> str:
    """The JSON document of a run."""
    return json.dumps({**about, "num_events": len(events), "events": events})


def write_dictionary(spark: SparkSession, frame: DataFrame, path: str) -> None:
    """A dictionary as a table, the native form."""
    frame.write.mode("overwrite").parquet(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.parquet(path)
    bad = d.where(F.exists("atom", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))) | ~(F.col("norm") > 0))
    if not bad.isEmpty():
        raise ValueError("the dictionary holds values that are not finite, or norms that are not positive")
    return d
