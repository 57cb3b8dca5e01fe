"""Benchmark decontamination with suffix arrays over the training text.

Each task turns the documents it reads into shards of words and builds a suffix array over all words of a shard, the benchmark's
numbered, all others alike. Every suffix of the benchmark is binary-searched in it, those that begin with the same window
together: the array interval whose suffixes agree on a whole window gives all verbatim occurrences, and running on from each of
them, along all benchmark suffixes that still agree, gives the longest match and where it lies.

A window is `window` consecutive words of an item; an item with fewer words, but not none, is one window. Words are
maximal runs of a-z (A-Z lowered), digits and characters beyond ASCII.

The benchmark is cut into blocks of `block_items` items, stored in the shared folder. A worker keeps the blocks it has read, up
to about `HELD_WORDS` words and one more; a task holds one shard of at most `shard_words` words (or one longer document) at a
time, whatever the sizes of the tables.

Defined cases: a null or wordless text has no words and is clean; a null or wordless item has no windows; equal items
are found each under its own id; items without an id count as hits but are not listed; repeated documents are judged one
by one; an empty benchmark leaves every document clean; other columns of either table are ignored here and kept by
`remove_contaminated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, fresh_name, shared_path

WINDOW = 10
SHARD_WORDS = 1_000_000
BLOCK_ITEMS = 20_000
#: Words of the benchmark that a worker may keep at hand before it drops the blocks it holds.
HELD_WORDS = 2_000_000
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_RESULT = {"n_words": "long", "n_hit": "long", "items": "array<string>", "longest_match": "long", "spans": "array<struct<start:long,stop:long>>"}
_blocks: dict[tuple[str, int], "Block"] = {}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class Block:
    """Items of the benchmark: their words as numbers, the distinct windows by length, and the suffix array of all items
    with the interval of each whole window."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        sequences, self.item_ids = [], []
        for item, text in items:
            if words := words_of(text):
                sequences.append(np.array([number(w, len(self.vocabulary)) for w in words], np.int64))
                self.item_ids.append(item)
        starts: dict[bytes, list[tuple[int, int]]] = {}
        for k, s in enumerate(sequences):
            n = min(window, len(s))
            for at in range(len(s) - n + 1):
                starts.setdefault(s[at : at + n].tobytes(), []).append((k, at))
        self.places = list(starts.values())
        self.holders = [sorted({self.item_ids[k] for k, _ in p if self.item_ids[k] is not None}) for p in self.places]
        by_length: dict[int, list[int]] = {}
        keys = list(starts)
        for k, key in enumerate(keys):
            by_length.setdefault(len(key) // 8, []).append(k)
        self.windows = {n: (np.array(ks), np.array([np.frombuffer(keys[k], np.int64) for k in ks])) for n, ks in sorted(by_length.items())}
        self.shortest, self.window = min(by_length, default=0), window
        self.words = np.concatenate([*(np.append(s, -2) for s in sequences), np.full(window + 1, -2)])
        self.order = suffix_array(self.words, np.flatnonzero(self.words >= 0), max(map(len, sequences), default=0) + 1)
        self.low, self.high = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        if window in self.windows:
            numbers, wanted = self.windows[window]
            self.low[numbers], self.high[numbers] = _bounds(self.words, self.order, wanted)


def suffix_array(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """`starts` in lexicographic order of the suffixes' first `depth` words at least: as many words as fit a number are ordered
    at once, then prefixes are doubled."""
    value = words - words.min(initial=0) + 1  # 0 stands behind the end
    bits = int(value.max(initial=1)).bit_length()
    have = max(1, min(depth, 62 // bits))
    key = np.zeros(len(words), np.int64)
    for k in range(have):
        key <<= bits
        key[: max(0, len(words) - k)] |= value[k:]
    while True:
        order = np.argsort(key)
        ordered = key[order]
        if have >= depth:
            break
        rank = np.empty(len(words), np.int64)
        rank[order] = np.cumsum(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        key = rank << 31
        key[: max(0, len(words) - have)] |= rank[have:]
        have *= 2
    wanted = np.zeros(len(words), bool)
    wanted[starts] = True
    return order[wanted[order]]


def _bounds(words: np.ndarray, order: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of `wanted`, the interval of the array whose suffixes begin with it. `words` ends with padding."""
    span = np.arange(wanted.shape[1])
    found = []
    for above in (False, True):
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            here, want = words[order[mid][:, None] + span], wanted[open_]
            differs = here != want
            first = differs.argmax(1)
            rows = np.arange(len(open_))
            goes_up = np.where(differs.any(1), here[rows, first] < want[rows, first], above)
            low[open_] = np.where(goes_up, mid + 1, low[open_])
            high[open_] = np.where(goes_up, high[open_], mid)
        found.append(low)
    return found[0], found[1]


def match_shard(documents: list[list[bytes]], block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word bounds of the documents in the shard, hit words, and per (document, window) its two numbers and longest match."""
    lengths = np.fromiter(map(len, documents), np.int64, len(documents))
    bounds = np.concatenate(([0], np.cumsum(lengths + 1)))  # a separator follows each document
    none = np.zeros(0, np.int64)
    hit = np.zeros(bounds[-1] + 1, np.int64)
    if not block.windows:
        return bounds, hit, none, none, none
    known = block.vocabulary.get
    ids = np.full(bounds[-1], -1, np.int64)
    ids[np.delete(np.arange(bounds[-1]), bounds[1:] - 1)] = np.fromiter((known(w, -1) for d in documents for w in d), np.int64, int(lengths.sum()))
    longest = max(block.windows)
    starts = np.delete(np.arange(bounds[-1]), bounds[1:] - 1)
    ids[bounds[1:] - 1] = -2
    order = suffix_array(ids, starts, longest)
    padded = np.concatenate((ids, np.full(longest + 1, -2)))
    got_doc, got_window, got_length = [], [], []
    for n, (numbers, wanted) in block.windows.items():
        low, high = _bounds(padded, order, wanted)
        some = np.flatnonzero(high > low)
        count = (high - low)[some]
        which = np.repeat(numbers[some], count)
        at = order[np.repeat(low[some], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + n, -1)
        got_doc.append(np.searchsorted(bounds, at, "right") - 1)
        got_window.append(which)
        got_length.append(_extended(padded, at, which, n, block))
    return bounds, np.cumsum(hit), np.concatenate(got_doc), np.concatenate(got_window), np.concatenate(got_length)


def _extended(words: np.ndarray, at: np.ndarray, which: np.ndarray, n: int, block: Block) -> np.ndarray:
    """How far the text and any benchmark suffix with that window go on alike. A window that is a whole short item ends there."""
    length = np.full(len(at), n, np.int64)
    if n < block.window:
        return length
    low, high = block.low[which], block.high[which]
    open_ = np.arange(len(at))
    while open_.size:
        depth = length[open_]
        want, ends = words[at[open_] + depth], []
        for above in (False, True):
            a, b = low[open_], high[open_]
            while (left := np.flatnonzero(a < b)).size:
                mid = (a[left] + b[left]) // 2
                here = block.words[block.order[mid] + depth[left]]
                up = here <= want[left] if above else here < want[left]
                a[left] = np.where(up, mid + 1, a[left])
                b[left] = np.where(up, b[left], mid)
            ends.append(a)
        same = (ends[0] < ends[1]) & (want >= 0)
        open_ = open_[same]
        low[open_], high[open_] = ends[0][same], ends[1][same]
        length[open_] += 1
    return length


def _load(path: str, window: int) -> Block:
    if (path, window) not in _blocks:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        t = pq.read_table(inner, filesystem=store, columns=["item", "text"])
        if sum(len(b.words) for b in _blocks.values()) > HELD_WORDS:
            _blocks.clear()
        _blocks[path, window] = Block(list(zip(t["item"].to_pylist(), t["text"].to_pylist(), strict=True)), window)
    return _blocks[path, window]


def _judged(texts: list[str | None], paths: list[str], window: int) -> Iterator[dict]:
    documents = [words_of(t) for t in texts]
    hits = items = best = None
    for path in paths:
        block = _load(path, window)
        bounds, hit, doc, which, length = match_shard(documents, block)
        if hits is None:
            hits, items, best = np.zeros(bounds[-1] + 1, bool), [set() for _ in documents], np.zeros(len(documents), np.int64)
        hits |= hit > 0
        np.maximum.at(best, doc, length)
        for pair in np.unique(doc * (len(block.places) + 1) + which).tolist():
            d, w = divmod(pair, len(block.places) + 1)
            items[d].update(block.holders[w])
    at = 0
    for k, words in enumerate(documents):
        row = {"n_words": len(words), "n_hit": 0, "items": [], "longest_match": 0, "spans": []}
        if hits is not None:
            marks = hits[at : at + len(words)]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
            row |= {"n_hit": int(marks.sum()), "items": sorted(items[k]), "longest_match": int(best[k]), "spans": [{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]}
        at += len(words) + 1
        yield row


def find_matches(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_items: int = BLOCK_ITEMS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The columns `keep` of every document, and what of it occurs in the benchmark.

    Added: n_words, n_hit (words inside matched windows), items (ids, sorted), longest_match (words) and spans (word
    ranges). Names taken by `keep` are written with underscores in front.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "benchmark")
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    items.repartition(max(1, -(-items.count() // block_items))).write.option("maxRecordsPerFile", block_items).parquet(path)
    paths = sorted(spark.read.schema("item string, text string").parquet(path).inputFiles())
    kept = docs.select(*keep)
    hidden = fresh_name(kept, "text_")
    names = {c: fresh_name(kept, c) for c in _RESULT}
    schema = extended(kept.schema, ", ".join(f"`{names[n]}` {kind}" for n, kind in _RESULT.items()))
    budget = 6 * shard_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < budget):
                    size += len(texts[to].as_py() or "")
                    to += 1
                rows = pa.RecordBatch.from_pylist(list(_judged(texts[at:to].to_pylist(), paths, window)), _ARROW)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, to - at) for i in range(batch.num_columns - 1)), *rows.columns], names=[f.name for f in schema])
                at = to

    return docs.select(*keep, F.col(text_col).cast("string").alias(hidden)).mapInArrow(run, schema)


_ARROW = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("longest_match", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents none of whose words lie in a benchmark window, with all their columns."""
    found = find_matches(docs, benchmark, docs.columns, **options)
    n_hit = fresh_name(docs, "n_hit")
    return found.where(F.col(n_hit) == 0).select(*docs.columns)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
