"""Best-fit packing of pieces into sequences, improved by swap-based local search.

How many pieces have each length, at most `capacity` numbers, is all a packing needs. The plan is made on those counts:
bins with the same lengths in them form one class with a multiplicity. Best fit, longest first, fills the classes; then
underfull classes exchange one piece for one, two for one or one for two, or move a piece, whenever that increases the
sum of squared fills, so that fuller bins fill and the emptiest bins empty. It ends when no exchange helps, or when the
bins are as few as the total length allows at all.

Each length's pieces are numbered, and intervals of those numbers belong to classes; a piece finds its sequence and
offset from its number alone. Pieces are numbered inside groups of about `GROUP_ROWS`, whose offsets come from their
counts, so that a very common length is spread over many tasks. What the driver and the tasks hold, counts and intervals,
depends on the capacity and not on the rows.

Defined cases: a null text packs like an empty one, as its end id alone; repeated rows are pieces of their own; an empty
table packs into nothing; other columns are ignored unless kept. Pieces longer than the capacity are an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import extended, fresh_name, written

CAPACITY = 4096
GROUP_ROWS = 1_000
Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def token_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pieces of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32 and, if kept, ids."""
    path = tokenizer_path or tokens.default_path()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * keep_ids
    schema = extended(source.select("doc_id").schema, "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, ids in enumerate(tokens.encode(batch.column(1).to_pylist(), path)):
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    at.append(k)
                    rows.append((piece, start, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32)))
            columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["doc_id", *(f[0] for f in fields)])

    return source.mapInArrow(run, schema)


class Plan:
    """Classes of bins: how often each pattern of lengths occurs."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.classes: dict[Pattern, int] = {}

    def add(self, pattern: Pattern, bins: int) -> None:
        if bins and pattern:
            self.classes[pattern] = self.classes.get(pattern, 0) + bins

    def take(self, pattern: Pattern, bins: int) -> None:
        self.classes[pattern] -= bins
        if not self.classes[pattern]:
            del self.classes[pattern]

    @property
    def bins(self) -> int:
        return sum(self.classes.values())


def fill_of(pattern: Pattern) -> int:
    return sum(length * n for length, n in pattern)


def changed(pattern: Pattern, out: tuple[int, ...], into: tuple[int, ...]) -> Pattern:
    counts = dict(pattern)
    for length in out:
        counts[length] -= 1
    for length in into:
        counts[length] = counts.get(length, 0) + 1
    return tuple(sorted(((length, n) for length, n in counts.items() if n), reverse=True))


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Longest first, each piece into the bin that it fills best, many equal pieces and bins at a time."""
    if any(not 0 < length <= capacity for length, n in counts.items() if n):
        raise ValueError(f"piece lengths must lie in 1..{capacity}")
    room: dict[int, dict[Pattern, int]] = {}  # by what is left
    left = np.zeros(capacity + 1, bool)

    def put(space: int, pattern: Pattern, bins: int) -> None:
        if bins:
            at = room.setdefault(space, {})
            at[pattern] = at.get(pattern, 0) + bins
            left[space] = True

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            spaces = np.flatnonzero(left[length:])
            space = length + int(spaces[0]) if spaces.size else 0
            if not space:
                each = min(capacity // length, n)
                put(capacity - each * length, ((length, each),), n // each)
                n %= each
                continue
            pattern, bins = next(iter(room[space].items()))
            each = min(space // length, n)
            used = min(bins, n // each)
            if used == bins:
                del room[space][pattern]
                left[space] = bool(room[space])
            else:
                room[space][pattern] = bins - used
            put(space - each * length, (*pattern, (length, each)), used)
            n -= used * each
    plan = Plan(capacity)
    for at in room.values():
        for pattern, bins in at.items():
            plan.add(pattern, bins)
    return plan


@lru_cache(maxsize=8192)
def _choices(pattern: Pattern, most: int) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """Sums, ascending, and lengths of up to `most` pieces of a bin; none at all if `most` is 0."""
    found: list[tuple[int, ...]] = [(length,) for length, _ in pattern] if most else [()]
    if most > 1:
        found += [(a, b) for i, (a, n) in enumerate(pattern) for b, _ in pattern[i + (n < 2) :]]
    found.sort(key=lambda x: (sum(x), x))
    return np.array([sum(x) for x in found], np.int64), found


def _exchanges(classes: dict[Pattern, int], capacity: int) -> list[tuple[Pattern, Pattern, tuple[int, ...], tuple[int, ...]]]:
    """For each class that has an exchange with one at least as full: it, that one, what that one gives, and what it gives;
    the emptiest first.

    Classes are met from the fullest on. Of those met, `one` and `two` hold, at each length (sum of two lengths) that a class
    could give back, how far its gap reaches from there, and which class that is. What a class could give has an exchange if
    something shorter reaches it; of all that it has, the one that shifts most is taken."""
    under = sorted(((fill_of(p), p) for p in classes if fill_of(p) < capacity), reverse=True)
    one, two, widest, found = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64), (0, -1), []
    for k, (fill, pattern) in enumerate(under):
        (singles, single), (pairs, pair) = _choices(pattern, 1), _choices(pattern, 2)
        gap, best = capacity - fill, None
        marks = ((one, singles, (singles + gap) << 40 | singles << 24 | k), (two, pairs, (pairs + gap) << 40 | pairs << 24 | k))
        twins = classes[pattern] > 1  # then one of the bins can give to another
        if twins:
            for table, sums, mark in marks:
                np.maximum.at(table, sums, mark)
            widest = max(widest, (gap, k))
        if at := int(np.searchsorted(singles, widest[0], "right")):
            best = (int(singles[at - 1]), widest[1], (), single[at - 1])
        # one or two pieces for one shorter, one for two that are shorter together
        for table, back, sums, lists in ((one, 1, singles, single), (one, 1, pairs, pair), (two, 2, singles, single)):
            reach = np.maximum.accumulate(table)[sums - 1]
            ok = np.flatnonzero(reach >> 40 >= sums)
            if ok.size:
                shift = sums[ok] - (reach[ok] >> 24 & 0xFFFF)
                j = int(shift.argmax())
                if best is None or shift[j] > best[0]:
                    partner = int(reach[ok[j]] & 0xFFFFFF)
                    given, names = _choices(under[partner][1], back)
                    best = (int(shift[j]), partner, names[int(np.searchsorted(given, reach[ok[j]] >> 24 & 0xFFFF))], lists[ok[j]])
        if best is not None:
            found.append((pattern, under[best[1]][1], best[2], best[3]))
        if not twins:
            for table, sums, mark in marks:
                np.maximum.at(table, sums, mark)
            widest = max(widest, (gap, k))
    return found[::-1]


def local_search(plan: Plan, moves: int | None = None) -> int:
    """Improve a plan in place; returns how many exchanges were made, an exchange of equal bins counting once.

    A sweep finds an exchange for each class that has one; they are made, the emptiest class first, as long as neither class
    has changed since. It ends when a sweep finds none, or the bins are as few as the total length allows. Each exchange
    raises the sum of squared fills, so it ends. `moves` stops it earlier."""
    total = sum(fill_of(p) * n for p, n in plan.classes.items())
    least, made = -(-total // plan.capacity), 0
    while plan.bins > least and (found := _exchanges(plan.classes, plan.capacity)):
        before = dict(plan.classes)
        for low, full, out, into in found:
            if made == moves or plan.bins <= least:
                return made
            if any(plan.classes.get(p) != before[p] for p in (low, full)):
                continue
            bins = plan.classes[low] // 2 if full == low else min(plan.classes[low], plan.classes[full])
            plan.take(low, bins)
            plan.take(full, bins)
            plan.add(changed(low, into, out), bins)
            plan.add(changed(full, out, into), bins)
            made += 1
    return made


def intervals(plan: Plan) -> np.ndarray:
    """Rows (length, first number, pieces of that length a bin, first sequence, first offset), by length and number."""
    rows, number, sequence = [], {}, 0
    for pattern, bins in sorted(plan.classes.items(), key=lambda x: (-fill_of(x[0]), x[0])):
        offset = 0
        for length, each in pattern:
            rows.append((length, number.get(length, 0), each, sequence, offset))
            number[length] = number.get(length, 0) + bins * each
            offset += length * each
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length", order_cols: tuple[str, ...] = ("doc_id", "piece"), search_moves: int | None = None) -> DataFrame:
    """All columns of `pieces`, which should be a written table, and sequence_id and offset of each; names that `pieces`
    takes get underscores in front."""
    spark = pieces.sparkSession
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy(length_col).count().collect()}  # at most `capacity` rows
    plan = best_fit(counts, capacity)
    local_search(plan, search_moves)
    table = intervals(plan)
    length, part, parts, rows, base, place, number, sequence, offset = (fresh_name(pieces, n) for n in ("length_", "part_", "parts_", "rows_", "base_", "place_", "number_", "sequence_id", "offset"))
    split = spark.createDataFrame([(x, 1 + n // GROUP_ROWS) for x, n in counts.items()], f"`{length}` long, `{parts}` long")
    keys = [length, part]
    parted = (
        pieces.withColumn(length, F.col(length_col).cast("long"))
        .join(F.broadcast(split), length)  # at most `capacity` rows
        .withColumn(part, F.pmod(F.xxhash64(*order_cols), F.col(parts)).cast("int"))
        .drop(parts)
    )
    before = Window.partitionBy(length).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parted.groupBy(*keys).agg(F.count("*").alias(rows)).select(*keys, F.coalesce(F.sum(rows).over(before), F.lit(0)).alias(base))
    others = [c for c in pieces.columns if c not in order_cols and dict(pieces.dtypes)[c] in ("bigint", "int", "string")]
    numbered = parted.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order_cols, *others))).join(offsets, keys)
    placed = numbered.select(*pieces.columns, length, (F.col(base) + F.col(place) - 1).alias(number))
    schema = extended(pieces.schema, f"`{sequence}` long, `{offset}` long")
    firsts = table[:, 0] * (1 << 44) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at = (batch.column(batch.num_columns - 2 + i).to_numpy() for i in (0, 1))
            row = table[np.searchsorted(firsts, size * (1 << 44) + at, "right") - 1]
            bins, places = np.divmod(at - row[:, 1], row[:, 2])
            columns = [pa.array(row[:, 3] + bins), pa.array(row[:, 4] + places * size)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], names=schema.names)

    return placed.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False, **columns: str) -> DataFrame:
    """Tokenise, cut and pack: the columns of token_pieces and sequence_id, offset."""
    return pack(written(token_pieces(docs, tokenizer_path, capacity, keep_ids=keep_ids, **columns), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces that kept their ids: sequence_id, ids, doc_ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))  # a sequence holds `capacity` tokens at most
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
