"""Token files compressed by a Re-Pair grammar.

Documents go in ascending id order through range partitions; each partition's token ids are cut into blocks of about
`BLOCK_IDS` ids. In a block, frequent pairs of neighbouring symbols are replaced by new symbols (nonterminals), again
and again, as long as a pair occurs `MIN_COUNT` times. A round replaces many pairs at once: all that occur at least a
`SPREAD`-th as often as the most frequent one, the more frequent of two overlapping pairs first. A pair that was rare stays
rare, so a round looks only at places whose pair was frequent before or holds a symbol of the last round. A block stores
the rules, their expansion lengths and the remaining symbols, so that any range of ids can be decoded from the symbols
that cover it.

File layout, little-endian. A file is a run of blocks. A block: magic RPB1, seven u64 (documents, ids, symbols, rules,
first nonterminal, bytes a symbol, rounds), then u64 rules before each round, i64 document ids, u8 document id present,
u64 ids per document, u32 left and u32 right of each rule, u32 expansion length of each rule, the symbols, and the u32
crc32 of all that.

Tasks write files under names of their own and report them; a list of reported files, written by Spark, is the table.
Files of lost or repeated attempts are on no list and are never read.

Defined cases: a null or empty text is its end id alone; documents without an id come first; repeated ids stay
neighbours, ordered by text checksum; an empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import shared_path, written

BLOCK_IDS = 1 << 20
MIN_COUNT = 8
SPREAD = 64
_MAGIC = b"RPB1"
_HEAD = struct.Struct("<4s7Q")
SLOT_BITS = 20


def _slots(left: np.ndarray, right: np.ndarray, turn: int) -> np.ndarray:
    """A hash of 32 bits for each pair of symbols; its first bits are a slot. Others each turn."""
    h = left * np.uint32((0x9E3779B1 + 2 * turn) & 0xFFFFFFFF)
    h += right
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return h


def _bits(n: int) -> int:
    """Bits of a table for n pairs, several slots for each."""
    return min(SLOT_BITS, max(8, int(n).bit_length() + 2))


def _apart(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray | None:
    """False for every second of overlapping occurrences of a pair of equal symbols; None if there are none."""
    same = np.flatnonzero(left == right)
    follows = same[1:][(np.diff(same) == 1) & (np.diff(at[same]) == 1)]
    if not follows.size:
        return None
    run = np.zeros(len(at), bool)
    run[follows] = True
    k = np.arange(len(at))
    return (k - np.maximum.accumulate(np.where(run, 0, k))) % 2 == 0


def _frequent(pairs: np.ndarray, min_count: int) -> np.ndarray:
    """The pairs that a round replaces, the most frequent first."""
    ordered = np.sort(pairs)
    edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(np.append(edge, len(ordered)))
    often = np.flatnonzero(counts >= max(min_count, int(counts.max()) // SPREAD))
    return ordered[edge[often[np.argsort(-counts[often], kind="stable")]]]


def repair(ids: np.ndarray, first: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Symbols, rules (rows left, right; rule k is symbol first + k), and the number of rules before each round."""
    seq, rules, starts, n_rules = ids.astype(np.uint32), [np.zeros((0, 2), np.uint32)], [], 0
    at = np.arange(max(0, len(seq) - 1))  # places whose pair may be frequent
    while at.size:
        left, right = (seq[:-1], seq[1:]) if len(at) == len(seq) - 1 else (seq[at], seq[at + 1])
        h = _slots(left, right, n_rules)
        slot = h >> np.uint32(32 - _bits(at.size))
        often = np.flatnonzero((np.bincount(slot) >= min_count)[slot])
        at, left, right, h = at[often], left[often], right[often], h[often]
        if not at.size:
            break
        apart = _apart(at, left, right)
        pairs = (left.astype(np.uint64) << np.uint64(32)) | right
        wanted = _frequent(pairs if apart is None else pairs[apart], min_count)
        if not wanted.size:
            break
        bits = _bits(len(wanted))
        own = _slots((wanted >> np.uint64(32)).astype(np.uint32), wanted.astype(np.uint32), n_rules) >> np.uint32(32 - bits)
        keep = np.sort(np.unique(own, return_index=True)[1])  # one pair a slot: the most frequent
        wanted, own = wanted[keep], own[keep]
        key, rank = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        key[own], rank[own] = wanted, np.arange(len(wanted), 0, -1)
        slot = h >> np.uint32(32 - bits)
        prior = rank[slot]
        prior[key[slot] != pairs] = 0
        chosen = prior > 0 if apart is None else (prior > 0) & apart
        beside = at[1:] == at[:-1] + 1
        chosen[1:] &= ~beside | (prior[1:] >= prior[:-1])
        chosen[:-1] &= ~beside | (prior[:-1] >= prior[1:])
        which = len(wanted) - prior[chosen]
        used = np.bincount(which, minlength=len(wanted)) >= min_count
        kept = used[which]
        where = at[chosen][kept]
        seq[where] = (first + n_rules - 1 + np.cumsum(used)).astype(np.uint32)[which[kept]]
        stays, alive = np.ones(len(seq), bool), np.zeros(len(seq), bool)
        stays[where + 1] = False
        alive[at] = alive[where] = True
        before = where[where > 0] - 1
        alive[np.where(stays[before], before, before - 1)] = True  # the symbol before may itself be new
        seq, alive = seq[stays], alive[stays]
        at = np.flatnonzero(alive[:-1])
        starts.append(n_rules)
        rules.append(np.stack((wanted[used] >> np.uint64(32), wanted[used] & np.uint64(0xFFFFFFFF)), 1).astype(np.uint32))
        n_rules += int(used.sum())
    return seq, np.concatenate(rules), starts


class Expansions:
    """What each symbol stands for: a table of ids, and where in it and how long."""

    def __init__(self, rules: np.ndarray, starts: list[int], first: int):
        self.at, self.size = np.arange(first + len(rules)), np.ones(first + len(rules), np.int64)
        self.table = np.arange(first, dtype=np.uint32)
        for start, stop in zip(starts, [*starts[1:], len(rules)][: len(starts)], strict=True):
            both = rules[start:stop].reshape(-1)  # a round's rules use symbols of earlier rounds only
            size, ids = self.size[both].reshape(-1, 2).sum(1), self.ids(both)
            self.size[first + start : first + stop] = size
            self.at[first + start : first + stop] = len(self.table) + np.cumsum(size) - size
            self.table = np.concatenate((self.table, ids))

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        size = self.size[symbols]
        ends = np.cumsum(size)
        place = np.repeat(self.at[symbols] - (ends - size), size)
        place += np.arange(len(place))
        return self.table[place]


def expand(symbols: np.ndarray, rules: np.ndarray, starts: list[int], first: int) -> np.ndarray:
    """The ids that symbols stand for."""
    return Expansions(rules, starts, first).ids(symbols)


def expansion_lengths(rules: np.ndarray, starts: list[int], first: int) -> np.ndarray:
    lengths = np.ones(len(rules), np.uint32)
    for start, stop in zip(starts, [*starts[1:], len(rules)][: len(starts)], strict=True):
        both = rules[start:stop].astype(np.int64) - first
        lengths[start:stop] = np.where(both >= 0, lengths[np.maximum(both, 0)], 1).sum(1)
    return lengths


def write_block(doc_ids: list[int | None], texts_ids: list[bytes]) -> bytes:
    ids = np.frombuffer(b"".join(texts_ids), "<u4")
    first = int(ids.max(initial=0)) + 1
    symbols, rules, starts = repair(ids, first)
    width = 2 if first + len(rules) <= 1 << 16 else 4
    body = b"".join((
        _HEAD.pack(_MAGIC, len(doc_ids), len(ids), len(symbols), len(rules), first, width, len(starts)),
        np.array(starts, "<u8").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is not None for d in doc_ids),
        np.array([len(x) // 4 for x in texts_ids], "<u8").tobytes(), rules[:, 0].astype("<u4").tobytes(), rules[:, 1].astype("<u4").tobytes(),
        expansion_lengths(rules, starts, first).astype("<u4").tobytes(), symbols.astype(f"<u{width}").tobytes(),
    ))
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """A block of a file, decoded where asked."""

    def __init__(self, data: bytes, at: int = 0):
        magic, docs, self.n_ids, n_symbols, n_rules, self.first, width, rounds = _HEAD.unpack_from(data, at)
        if magic != _MAGIC:
            raise ValueError("not a block of a token file")
        self.end = at + _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            found = np.frombuffer(data, kind, n, self.end)
            self.end += found.nbytes
            return found

        self.starts = take("<u8", rounds).tolist()
        ids, present = take("<i8", docs), take("u1", docs)
        self.doc_ids = [i if p else None for i, p in zip(ids.tolist(), present.tolist(), strict=True)]
        self.n_tokens = take("<u8", docs).astype(np.int64)
        left, right = take("<u4", n_rules), take("<u4", n_rules)
        self.rules, self.lengths, self.symbols = np.stack((left, right), 1), take("<u4", n_rules), take(f"<u{width}", n_symbols)
        if zlib.crc32(memoryview(data)[at : self.end]) != int(take("<u4", 1)[0]):
            raise ValueError("a block of a token file is damaged")
        self._ends: np.ndarray | None = None
        self._expansions: Expansions | None = None

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        if self._expansions is None:
            self._expansions = Expansions(self.rules, self.starts, self.first)
        return self._expansions.ids(symbols)

    def all_ids(self) -> np.ndarray:
        return self._expand(self.symbols)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The block's ids from start up to stop; only the symbols that cover them are expanded."""
        if self._ends is None:
            rule = self.symbols.astype(np.int64) - self.first
            padded = np.append(self.lengths, 1).astype(np.int64)
            self._ends = np.cumsum(padded[np.where(rule >= 0, rule, len(self.lengths))])
        a, b = np.searchsorted(self._ends, start, "right"), np.searchsorted(self._ends, stop, "left") + 1
        before = int(self._ends[a - 1]) if a else 0
        return self._expand(self.symbols[a:b])[start - before : stop - before]


def blocks_of(f) -> Iterator[Block]:
    """The blocks of an open file, one in memory at a time."""
    while head := f.read(_HEAD.size):
        _, docs, _, n_symbols, n_rules, _, width, rounds = _HEAD.unpack(head)
        yield Block(head + f.read(8 * rounds + 17 * docs + 12 * n_rules + width * n_symbols + 4))


def write_files(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the documents' ids; returns the list of files: path, first_doc, n_docs, n_ids, n_bytes, base (ids before it)."""
    spark, path = docs.sparkSession, tokenizer_path or tokens.default_path()
    folder = shared_path(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(folder)
        name, out, held, size, total = f"{uuid.uuid4().hex}.tok", None, ([], []), 0, [0, 0, 0]
        first_doc = None

        def flush() -> None:
            nonlocal held, size
            if held[0]:
                out.write(data := write_block(*held))
                total[2] += len(data)
            held, size = ([], []), 0

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1).to_pylist(), path), strict=True):
                if out is None:
                    store.create_dir(inner, recursive=True)
                    out, first_doc = store.open_output_stream(f"{inner}/{name}"), doc
                held[0].append(doc)
                held[1].append(ids)
                size += len(ids) // 4
                total[0] += 1
                total[1] += len(ids) // 4
                if size >= block_ids:
                    flush()
        if out is not None:
            flush()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "first_doc": pa.array([first_doc], pa.int64()), "n_docs": [total[0]], "n_ids": [total[1]], "n_bytes": [total[2]]})

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    )
    files = written(ordered.mapInArrow(run, "path string, first_doc long, n_docs long, n_ids long, n_bytes long"), "token-files")
    before = Window.orderBy(F.col("first_doc").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_files(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), ids (bytes, unsigned 32-bit)."""
    listed = written(files.select("path", "base"), "token-file-bases")
    tasks = max(1, min(listed.count(), 100_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_stream(inner) as f:
                    for block in blocks_of(f):
                        raw, ends = block.all_ids().astype("<u4").tobytes(), np.cumsum(block.n_tokens)
                        begins = ends - block.n_tokens
                        parts = [raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                        for at in range(0, len(parts), 2000):
                            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(block.doc_ids[at : at + 2000], pa.int64()), "start": pa.array(start + begins[at : at + 2000]), "ids": pa.array(parts[at : at + 2000], pa.binary())})
                        start += block.n_ids

    return listed.repartition(tasks).mapInArrow(run, "doc_id long, start long, ids binary")
