"""Sampled series: cleaned, indexed samples and their frames.

A series is all rows of equal key columns; its order is a total order given by the caller. Samples are (keys, i, n, y): index
from 0, length of the series, value with null, NaN and infinities as 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sigloom.functions.scalar import clean
from sigloom.session import written


def numbered(df: DataFrame, keys: list[str], order: list[str], spread: bool = False) -> DataFrame:
    """df with i, the row's number in its series from 0, and n, the series' length.

    By a window, which sorts a series in one task; or, with `spread`, over range partitions of (keys, order): a task numbers the
    rows it holds, and adds how many of the series lie in the tasks before, so that one long series takes all tasks. The sorted
    rows are written in between, because both steps must see the same partitions."""
    if not spread:
        w = Window.partitionBy(*keys)
        return df.withColumn("i", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(w))
    place, task, first, base = "place_", "task_", "first_", "base_"
    sorted_ = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    table = written(sorted_.withColumn(place, F.monotonically_increasing_id()), "sorted-samples").withColumn(task, F.shiftright(place, 33))
    counts = table.groupBy(*keys, task).agg(F.min(place).alias(first), F.count(F.lit(1)).alias("count_"))
    w = Window.partitionBy(*keys)  # a row for each task that holds some of the series
    before = w.orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*(F.col(k).alias(f"{k}_key_") for k in keys), F.col(task).alias("at_"), first, F.coalesce(F.sum("count_").over(before), F.lit(0)).alias(base), F.sum("count_").over(w).alias("n"))
    same = F.col(task) == F.col("at_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_key_"))
    return table.join(offsets, same).select(*df.columns, (F.col(base) + F.col(place) - F.col(first)).alias("i"), "n")


def samples(df: DataFrame, keys: list[str], order: list[str], value: str | Column, spread: bool = False) -> DataFrame:
    """keys, i, n, y. One shuffle, by series; `spread` numbers series too long for one task, see `numbered`."""
    column = F.col(value) if isinstance(value, str) else value
    rows = df.select(*dict.fromkeys([*keys, *order]), clean(column).alias("y_"))
    return numbered(rows, keys, order, spread).select(*keys, "i", "n", F.col("y_").alias("y"))


def with_blocks(s: DataFrame, size: Column | int, hop: Column | int, partial: bool, name: str = "block") -> DataFrame:
    """Each sample once for every block that holds it; blocks start at 0, hop, 2 hop, ...

    With `partial` a series has at least one block, cut at its end; otherwise only whole blocks count. No join: the block
    numbers of a sample follow from its index.
    """
    size, hop = (F.lit(x) if isinstance(x, int) else x for x in (size, hop))
    blocks = F.floor((F.col("n") - size + hop) / hop)
    last = (F.greatest(blocks, F.lit(1)) if partial else blocks) - 1
    low = F.greatest(F.lit(0).cast("long"), F.floor((F.col("i") - size) / hop) + 1)
    high = F.least(last, F.floor(F.col("i") / hop)).cast("long")
    return s.where(high >= low).withColumn(name, F.explode(F.sequence(low, high)))


def frames(s: DataFrame, keys: list[str], frame_size: int, hop: int) -> DataFrame:
    """keys, frame_start, y (array in order). The size is cut to the series' length and the hop to the size; tails that fill
    no frame are dropped. A frame is gathered by its own key, so a long series spreads over many tasks."""
    size = F.least(F.lit(frame_size), F.col("n"))
    step = F.least(F.lit(hop), size)
    parts = with_blocks(s, size, step, partial=False).withColumn("frame_start", (F.col("block") * step).cast("long"))
    gathered = F.array_sort(F.collect_list(F.struct("i", "y")))
    return parts.groupBy(*keys, "frame_start").agg(gathered.alias("g")).select(*keys, "frame_start", F.col("g.y").alias("y"))


def windowed(f: DataFrame, window: Callable[[Column, Column], Column], column: str = "y") -> DataFrame:
    """Frames times a window function of (position, length)."""
    n = F.size(column)
    return f.withColumn(column, F.transform(column, lambda x, i: x * window(i.cast("double"), n)))


def padded(f: DataFrame, size: int, column: str = "y") -> DataFrame:
    return f.withColumn(column, F.concat(column, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(column))))


def folded(df: DataFrame, keys: list[str], order: list[str], columns: list[str], schema: StructType | str, start: Callable[[tuple], object], step: Callable[[object, tuple], list[tuple]], end: Callable[[object], Iterable[tuple]] | None = None) -> DataFrame:
    """A sequential fold over each series in order: `step(state, row)` and `end(state)` give rows without the keys.

    Series stream through a task one after the other, sorted by Spark, so a task holds one state and one batch whatever the
    length of a series. A fold is sequential by nature; series are what is parallel.
    """
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            values = [c.to_pylist() for c in batch.columns]
            for row in zip(*values, strict=True):
                if state is None or row[:width] != key:
                    if state is not None and end:
                        for r in end(state):
                            out.append((*key, *r))
                            if len(out) > 5000:
                                yield _batch(out, arrow)
                                out = []
                    key = row[:width]
                    state = start(key)
                out += [(*key, *r) for r in step(state, row[width:])]
            if len(out) > 5000:
                yield _batch(out, arrow)
                out = []
        if state is not None and end:
            for r in end(state):
                out.append((*key, *r))
                if len(out) > 5000:
                    yield _batch(out, arrow)
                    out = []
        if out:
            yield _batch(out, arrow)

    spec = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = StructType([*df.select(*keys).schema.fields, *spec.fields])
    arrow = to_arrow_schema(whole)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *columns).mapInArrow(run, whole)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
