"""Sharding by fixed virtual slots.

Records are hashed into thousands of virtual slots that never change. Bytes and rows are aggregated per slot, and a
versioned slot-to-shard map says which shard holds a slot. Rebalancing edits that map: slots move, or change places,
between the fullest and the emptiest shard until no edit narrows the gap. Version 0 is the plain map, slot modulo
shards; a later version is the one before it, loaded and edited, and lists all slots, so a reader needs one version only.

Defined cases: a null text counts 8 bytes and has the checksum of the empty text; a null id hashes like any value;
repeated rows share a slot and get places of their own; an empty table gives an empty result and an unedited map; other
columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, written

SLOTS = 8192
RANK_GROUP_ROWS = 20_000
MAP_SCHEMA = "virtual_slot int, shard int, slot_bytes long, slot_rows long"


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """id, size, checksum and virtual slot of every record."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_loads(records: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows per virtual slot; at most as many entries as there are slots."""
    rows = records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {r["virtual_slot"]: (int(r["b"]), int(r["n"])) for r in rows}


def rebalance(slot_map: list[int], loads: dict[int, tuple[int, int]], shards: int, tolerance: float = 1e-4) -> tuple[list[int], int]:
    """Edit a slot-to-shard map; returns the new map and the number of edits.

    It ends when fullest and emptiest differ by `tolerance` of the mean load, or no edit narrows the gap. The fullest shard gives the emptiest the slot, or exchanges the pair of slots, whose difference comes nearest to
    half the gap between them. Each edit lowers the sum of squared loads, so it ends.
    """
    slot_map = list(slot_map)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    total = [0] * shards
    for slot, shard in enumerate(slot_map):
        size = loads.get(slot, (0, 0))[0]
        if size:
            bisect.insort(held[shard], (size, slot))
            total[shard] += size
    edits = 0
    while True:
        if max(total) - min(total) <= tolerance * sum(total) / shards:
            return slot_map, edits
        order = sorted(range(shards), key=lambda s: (total[s], s))
        best: tuple[int, int, tuple[int, int], tuple[int, int] | None] | None = None
        for high, low in ((order[-1], order[0]), (order[-1], order[1 % shards]), (order[-2 % shards], order[0])):
            gap = total[high] - total[low]
            if high == low or gap <= 1:
                continue
            for size, slot in held[high]:
                # without a partner, or with the partner that leaves the difference nearest to half the gap
                partners: list[tuple[int, int] | None] = [None]
                at = bisect.bisect_left(held[low], (size - gap // 2, -1))
                partners += held[low][max(0, at - 1) : at + 1]
                for partner in partners:
                    moved = size - (partner[0] if partner else 0)
                    if 0 < moved < gap and (best is None or abs(gap - 2 * moved) - gap < best[0]):
                        best = (abs(gap - 2 * moved) - gap, high * shards + low, (size, slot), partner)
            if best:
                break
        if best is None:
            return slot_map, edits
        (high, low), given, taken = divmod(best[1], shards), best[2], best[3]
        held[high].remove(given)
        bisect.insort(held[low], given)
        slot_map[given[1]] = low
        if taken:
            held[low].remove(taken)
            bisect.insort(held[high], taken)
            slot_map[taken[1]] = high
        moved = given[0] - (taken[0] if taken else 0)
        total[high] -= moved
        total[low] += moved
        edits += 1


def store_map(spark: SparkSession, path: str, version: int, slot_map: list[int], loads: dict[int, tuple[int, int]]) -> None:
    """Write a version of the map, a row per slot. Versions are folders of `path`; one that is there is not written again."""
    rows = [(s, shard, *loads.get(s, (0, 0))) for s, shard in enumerate(slot_map)]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The newest version that was written to the end; None if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = [s.getPath() for s in fs.listStatus(folder)]
    done = [int(p.getName().partition("=")[2]) for p in names if p.getName().startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(done, default=None)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    """virtual_slot, shard, slot_bytes, slot_rows of a stored version."""
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version}")


def next_map(spark: SparkSession, path: str, loads: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> tuple[int, int]:
    """Load the newest map, edit it for the loads, and store it as the next version; returns that version and the edits.

    Without a stored map the plain one becomes version 0. Slots of shards that are no more, and with more shards than before
    none at first, go to slot modulo shards; then slots move only as far as balance asks. A map that needs no edit stays."""
    version = latest_version(spark, path)
    if version is None:
        version = 0
        store_map(spark, path, 0, [s % shards for s in range(slots)], loads)
    rows = load_map(spark, path, version).collect()  # one row a slot
    held = {r["virtual_slot"]: r["shard"] for r in rows}
    if len(held) != slots:
        raise ValueError(f"the stored map has {len(held)} slots, not {slots}")
    current = [held[s] if held[s] < shards else s % shards for s in range(slots)]
    edited, edits = rebalance(current, loads, shards)
    edits += sum(current[s] != held[s] for s in range(slots))
    if edits:
        version += 1
        store_map(spark, path, version, edited, loads)
    return version, edits


def shard(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Place every record: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    The slot-to-shard map under `map_path` is loaded, edited for these records and stored as its next version; without a
    path a new one starts from the plain map.

    `slot` is the record's place in its shard, gapless from 0. Places are counted inside small groups, a virtual slot and
    a share of its ids, and group offsets come from the groups' counts, so that no task sorts a whole shard.
    """
    spark = df.sparkSession
    records = written(digests(df, id_col, text_col, slots), "digests")
    loads = slot_loads(records)
    split = 1 + sum(n for _, n in loads.values()) // (slots * RANK_GROUP_ROWS)
    map_path = map_path or shared_path(spark, "slot-map")
    version, _ = next_map(spark, map_path, loads, shards, slots)
    current = load_map(spark, map_path, version).select("virtual_slot", "shard")
    keys = ["virtual_slot", "part"]
    parted = records.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(split)).cast("int"))
    before = Window.partitionBy("shard").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parted.groupBy(*keys).agg(F.count("*").alias("n"))
        .join(F.broadcast(current), "virtual_slot")  # one row per slot: bounded by `slots`
        .select(*keys, "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "text_crc32", "size"))
    return (
        parted.withColumn("place", place)
        .join(offsets, keys)
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("base") + F.col("place") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"),
        )
    )
