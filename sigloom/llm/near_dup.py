"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles, banded, verified.

Shingles are five consecutive words (maximal runs of letters, digits and characters beyond ASCII, A-Z lowered); a text of
one to four words is one shingle. A shingle weighs tf * (1 + IDF_SHARE * idf); idf runs from 1, for shingles in at most
`RARE` of all documents, to 0, for those in all. Document frequencies are counted over all documents, in 2**20 hashed
counters, whose noise is a fixed share of the documents at every scale and lies below `RARE`.

Improved consistent weighted sampling draws `BANDS * ROWS` samples a text; two texts share a sample with a probability
that is their weighted Jaccard similarity. Texts that agree on all samples of a band meet in a bucket; texts that buckets
connect form a group, and each text travels to its group once. There, pairs that share a bucket and agree on enough samples
are verified by the exact weighted Jaccard similarity, the most alike first and only where their classes still differ, so
that a group of n texts takes n - 1 successes and the failures of those near the threshold. No pair leaves its task: a
group gives one link a member, to the least id of its class.

A group of more than `UNIT_MEMBERS` texts or `UNIT_BYTES` is dealt by hash into parts, of which each, and each two, make a
unit of work, so that all pairs still meet; their links are joined by `components`. A group that would take more parts than
there are bands is dealt bucket by bucket instead.

Exact copies are found by hash first; only one of them is compared.

Defined cases: null counts as the empty text; texts without words are compared as exact copies only; repeated rows are
copies; rows without an id take part in counts and get the class of their text; an empty table gives no rows; other columns
are ignored, and kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shared_path, text_of, written

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 7, 36
IDF_SHARE = 0.25
RARE = 2e-3
COUNTERS = 1 << 20
BLOCK = 1 << 12
#: Verified pairs have this share of equal samples: 0.8 less 3 standard deviations of the estimate.
PROMISING = 0.7245
#: A unit of work: texts, and bytes of text, that one task compares at a time.
UNIT_MEMBERS = 256
UNIT_BYTES = 1 << 24
#: Links that a task joins at a time before they are shuffled.
LOCAL_LINKS = 200_000

_U = np.uint64
_P, _Q = _U(0x100000001B3), _U(0x9E3779B97F4A7C15)
_P_INVERSE = _U(pow(0x100000001B3, -1, 1 << 64))
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_powers: list[np.ndarray] = []
_tables: list[tuple] = []
_idf: dict[str, tuple[np.ndarray, float]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and how often each occurs."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES), np.uint8)
    inside = np.concatenate(([False], raw != 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not _powers or len(_powers[0]) <= len(raw):
        n = 1 << max(16, int(len(raw)).bit_length())
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate(([_U(1)], np.cumprod(np.full(n - 1, p, np.uint64)))) for p in (_P, _P_INVERSE)]
    total = np.concatenate(([_U(0)], np.cumsum((raw.astype(np.uint64) + _U(1)) * _powers[0][: len(raw)])))
    words = _mix((total[stop] - total[start]) * _powers[1][start])
    n = min(SHINGLE, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ words[k : len(words) - n + 1 + k]) * _Q + _U(k)
        h ^= h >> _U(29)
    return np.unique(_mix(h), return_counts=True)


def weights(h: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return tf * (1.0 + IDF_SHARE * idf[(h >> _U(44)).astype(np.int64)])


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of (ascending hashes, weights): the sum of minima over the sum of maxima."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = a[0][at] == b[0]
    shared = float(np.minimum(a[1][at[both]], b[1][both]).sum())
    return shared / (float(a[1].sum() + b[1].sum()) - shared)


def _sampling_tables() -> tuple:
    """A multiplier per sample, and 65,536 draws of the sampler's three variates, found by hash: 1/r, beta, and
    ln c - r + r * beta, beside r itself (r and c are Gamma(2, 1), beta is uniform). Most shingles are rare and occur once;
    for their weight the draws are worked out beforehand."""
    if not _tables:
        g = np.random.Generator(np.random.PCG64(20240229))
        r, c, beta = g.gamma(2.0, 1.0, 1 << 16), g.gamma(2.0, 1.0, 1 << 16), g.random(1 << 16)
        table = np.stack((1 / r, beta, np.log(c) - r + r * beta, r), 1).astype(np.float32)
        multipliers = (g.integers(0, 1 << 31, ROWS * BANDS, np.uint32) << np.uint32(1)) | np.uint32(1)
        t = np.floor(np.float32(np.log(1.0 + IDF_SHARE)) * table[:, 0] + table[:, 1])
        _tables.append((multipliers, table, table[:, 2] - table[:, 3] * t, t))
    return _tables[0]


def sketch(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The consistent weighted samples of a text: a 32-bit hash each of the drawn shingle and its quantised weight."""
    multipliers, table, usual, usual_t = _sampling_tables()
    least = np.full(len(multipliers), np.inf, np.float32)
    chosen, quantum = np.zeros(len(multipliers), np.uint64), np.zeros(len(multipliers), np.int64)
    plain = w == 1.0 + IDF_SHARE
    for part, fixed in ((plain, True), (~plain, False)):
        own = h[part]
        if not len(own):
            continue
        short, log_w = (own >> _U(32)).astype(np.uint32), np.log(w[part]).astype(np.float32)
        step = max(1, (1 << 16) // len(own))
        for at in range(0, len(multipliers), step):
            to = slice(at, at + step)
            draw = (multipliers[to, None] * short >> np.uint32(16)).astype(np.intp)
            if fixed:
                value, t = usual.take(draw), None
            else:
                d = table.take(draw, 0)
                t = np.floor(log_w * d[..., 0] + d[..., 1])
                value = d[..., 2] - d[..., 3] * t
            best = value.argmin(1)
            rows = np.arange(len(best))
            won = value[rows, best]
            better = won < least[to]
            q = usual_t[draw[rows, best]] if t is None else t[rows, best]
            least[to] = np.where(better, won, least[to])
            chosen[to] = np.where(better, own[best], chosen[to])
            quantum[to] = np.where(better, q.astype(np.int64), quantum[to])
    return _mix(chosen + quantum.astype(np.uint64) * _Q) >> _U(32)


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for column in samples.reshape(BANDS, ROWS).T:
        key = _mix(key * _Q + column)
    return key.view(np.int64)


def document_frequencies(texts: DataFrame, text_col: str) -> str:
    """Count, over all rows, in how many a shingle occurs; returns the path of the written counters."""
    path = shared_path(texts.sparkSession, "shingle-df")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(COUNTERS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows += 1
                np.add.at(seen, (shingles(text)[0] >> _U(44)).astype(np.int64), 1)
        if rows:
            yield from _counter_rows({k: seen[k * BLOCK : (k + 1) * BLOCK] for k in range(COUNTERS // BLOCK)} | {-1: np.array([rows])})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(data, "<i8")
        yield from _counter_rows(held)

    counted = texts.select(F.col(text_col).cast("string")).mapInArrow(count, "block int, counts binary")
    counted.repartition("block").mapInArrow(add, "block int, counts binary").write.parquet(path)
    return path


def _counter_rows(blocks: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    kept = [(k, c.astype("<i8").tobytes()) for k, c in blocks.items() if c.any()]
    yield pa.RecordBatch.from_pydict({"block": pa.array([k for k, _ in kept], pa.int32()), "counts": pa.array([c for _, c in kept], pa.binary())})


def load_idf(path: str) -> np.ndarray:
    """idf by counter, 1 for rare shingles and 0 for those in all documents; read once a worker."""
    if path not in _idf:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        df, rows = np.zeros(COUNTERS, np.int64), 1
        for file in store.get_file_info(fs.FileSelector(inner)):
            if file.path.endswith(".parquet"):
                t = pq.read_table(file.path, filesystem=store).to_pydict()
                for k, data in zip(t["block"], t["counts"], strict=True):
                    found = np.frombuffer(data, "<i8")
                    if k < 0:
                        rows = int(found[0])
                    else:
                        df[k * BLOCK : (k + 1) * BLOCK] = found
        share = np.clip(df / rows, RARE, 1.0)
        _idf.clear()
        _idf[path] = np.log(1 / share) / np.log(1 / RARE)
    return _idf[path]


def _sketches(texts: DataFrame, counters: str) -> DataFrame:
    """node, h1, h2, bytes, samples (the low byte of each) and band keys of every row of (node, h1, h2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, known = load_idf(counters), {}
        for batch in batches:
            size, low, keys = [], [], []
            for h1, h2, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if (found := known.get((h1, h2))) is None:
                    h, tf = shingles(text)
                    samples = sketch(h, weights(h, tf, idf)) if len(h) else None
                    found = (samples.astype(np.uint8).tobytes(), band_keys(samples)) if len(h) else (b"", np.zeros(0, np.int64))
                    known = {} if len(known) > 4000 else known
                    known[h1, h2] = found
                size.append(len(text))
                low.append(found[0])
                keys.append(found[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size, pa.int64()), pa.array(low, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["node", "h1", "h2", "bytes", "samples", "bands"])

    return texts.mapInArrow(run, "node long, h1 long, h2 long, bytes long, samples binary, bands array<long>")


class Classes:
    """Union-find; the least node of a class stands for it."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def promising_pairs(samples: np.ndarray, bands: np.ndarray, sides: np.ndarray | None = None, key: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j of pairs that share a band and at least `PROMISING` of their samples, the most alike first.

    With `sides`, only pairs of different sides. With a bucket's `key`, only pairs whose first common band is that bucket.
    """
    found = []
    n, step = len(samples), max(1, (1 << 22) // max(1, samples.size))
    for at in range(0, n - 1, step):
        block = samples[at : at + step]
        alike = (block[:, None, :] == samples[None, at + 1 :, :]).sum(2, dtype=np.int32)
        i, j = np.nonzero(alike >= PROMISING * samples.shape[1])
        later = j >= i  # column j is row at + 1 + j
        i, j = i[later], j[later]
        found.append((at + i, at + 1 + j, alike[i, j]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j, alike = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = np.ones(len(i), bool) if sides is None else sides[i] != sides[j]
    for start in range(0, len(i), 1 << 16):
        part = slice(start, start + (1 << 16))
        common = bands[i[part]] == bands[j[part]]
        keep[part] &= common.any(1) if key is None else common.any(1) & (bands[i[part], common.argmax(1)] == key)
    i, j, alike = i[keep], j[keep], alike[keep]
    order = np.argsort(-alike, kind="stable")
    return i[order], j[order]


def unit_links(ids: list[int], samples: list[bytes], bands: list[list[int]], sides: list[int | None], texts: list[str], key: int | None, idf: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Of the texts of one unit: (node, least node of its class) for those with a link; exact similarities decide."""
    if len(ids) < 2:
        return []
    vectors: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def vector(k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in vectors:
            h, tf = shingles(texts[k])
            vectors[k] = h, weights(h, tf, idf)
        return vectors[k]

    classes = Classes()
    stacked = np.frombuffer(b"".join(samples), np.uint8).reshape(len(ids), -1)
    apart = np.array(sides, np.int64) if sides[0] is not None else None
    for i, j in zip(*(x.tolist() for x in promising_pairs(stacked, np.array(bands, np.int64), apart, key)), strict=True):
        if classes.root(ids[i]) != classes.root(ids[j]) and weighted_jaccard(vector(i), vector(j)) >= threshold:
            classes.join(ids[i], ids[j])
    return [(x, classes.root(x)) for x in classes.parent if classes.root(x) != x]


def _links(units: DataFrame, counters: str, threshold: float) -> DataFrame:
    """a, b and whole (whether the unit was all of its group) of rows (unit, side, key, node, samples, bands, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, unit, rows, out = load_idf(counters), None, [], []

        def close() -> None:
            if len(rows) > 1:
                ids, sides, keys, whole, samples, bands, texts = zip(*rows, strict=True)
                out.extend((a, b, whole[0]) for a, b in unit_links(ids, samples, bands, sides, texts, keys[0], idf, threshold))
            rows.clear()

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.bool_())], names=["a", "b", "whole"])
            out.clear()
            return made

        for batch in batches:
            for u, *row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if u != unit:
                    close()
                    unit = u
                if not rows or rows[-1][0] != row[0]:  # repeated rows are one text
                    rows.append(row)
            if len(out) > 1000:
                yield batch_of()
        close()
        yield batch_of()

    columns = ["unit", "node", "side", "key", "whole", "samples", "bands", "text"]
    return units.select(columns).repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(run, "a long, b long, whole boolean")


def _local_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of a task, `LOCAL_LINKS` at a time, as a link of each node to the least of its component."""
    classes, n = Classes(), 0

    def batch_of() -> pa.RecordBatch:
        found = [(x, classes.root(x)) for x in classes.parent]
        found = [(x, r) for x, r in found if x != r]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            classes.join(u, v)
        n += batch.num_rows
        if n > LOCAL_LINKS:
            yield batch_of()
            classes, n = Classes(), 0
    yield batch_of()


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node of its component), of links (a, b).

    Tasks first join the links they hold. The rest goes through large and small stars: nothing is gathered per node, each
    step is an aggregate and a join over links, cut by a written table.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").mapInArrow(_local_links, "u long, v long").distinct(), "links")
    state = (0, None)
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join below can split the many links of one node over tasks
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        before = edges
        edges = written(large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).unionByName(small.withColumnRenamed("m", "v")).where("u <> v").distinct(), "links")
        discard(before, least)
    labels = edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return labels.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _buckets(sketches: DataFrame) -> DataFrame:
    """(key, node, least) of buckets with several members, and the least of them."""
    met = sketches.select("node", F.explode("bands").alias("key"))
    shared = met.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("greatest")).where("least < greatest")
    return met.join(shared.select("key", "least"), "key").select("key", "node", "least")


def _parts(members: DataFrame) -> DataFrame:
    """(group, node, parts) of (group, node, bytes): how many parts the node's group is dealt into."""
    count, size = F.count("*"), F.sum("bytes") + 512 * F.count("*")
    parts = F.when((count > UNIT_MEMBERS) | (size > UNIT_BYTES), F.greatest(F.ceil(2 * count / UNIT_MEMBERS), F.ceil(2 * size / UNIT_BYTES))).otherwise(1)
    return members.join(members.groupBy("group").agg(parts.cast("long").alias("parts")), "group").select("group", "node", "bytes", "parts")


def _units(groups: DataFrame, buckets: DataFrame) -> DataFrame:
    """(unit, side, key, whole, node) of (group, node, bytes), the texts that buckets connect.

    A small group is a unit. A larger one is dealt into parts; each part is a unit, and each two are one, where `side` says
    of which part a text is. Where that would send a text to more units than it has bands, buckets take the group's place.
    """
    sized = written(_parts(groups), "groups")
    none = F.lit(None).cast("long")
    by_group = sized.where(F.col("parts") <= BANDS).select("group", "node", "parts", none.alias("key"))
    wide = sized.where(F.col("parts") > BANDS).select("node", "bytes")
    by_bucket = _parts(buckets.select(F.col("key").alias("group"), "node").join(wide, "node")).select("group", "node", "parts", F.col("group").alias("key"))
    dealt = by_group.unionByName(by_bucket).withColumn("part", F.pmod(F.xxhash64(F.lit(2), "node"), F.col("parts")))
    spread = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    unit = F.xxhash64("group", F.col("key").isNull(), F.least("part", "with"), F.greatest("part", "with"))
    return spread.select(unit.alias("unit"), F.when(F.col("part") != F.col("with"), F.col("part")).alias("side"), "key", (F.col("key").isNull() & (F.col("parts") == 1)).alias("whole"), "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, class_id (the least id of its class), is_kept (whether it is that document)."""
    return _classified(docs, id_col, text_col, threshold)[0]


def _classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of `near_duplicates`, and the written tables that they are read from."""
    text = text_of(F.col(text_col).cast("string"))
    source = docs.select(F.col(id_col).cast("long").alias("node"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    counters = document_frequencies(source, "text")
    every = written(_sketches(source, counters), "sketches")
    first = written(every.groupBy("h1", "h2").agg(F.min("node").alias("node")), "distinct")
    compared = every.select("node", "bytes", "samples", "bands").where(F.length("samples") > 0)
    sketches = written(compared.join(first.where("node is not null").select("node").distinct(), "node", "leftsemi").dropDuplicates(["node"]), "distinct-sketches")
    buckets = written(_buckets(sketches), "buckets")
    groups = components(buckets.select(F.col("node").alias("a"), F.col("least").alias("b")))
    units = written(_units(groups.withColumnRenamed("label", "group").join(sketches.select("node", "bytes"), "node"), buckets), "units")
    # by shuffle whatever the sizes: the plan at 100 TB is the plan of a test
    candidates = units.join(sketches.select("node", "samples", "bands"), "node").hint("shuffle_hash")
    links = written(_links(source.where("node is not null").select("node", "text").join(candidates, "node"), counters, threshold), "class-links")
    whole = links.where("whole").select(F.col("a").alias("node"), F.col("b").alias("label"))
    dealt = components(links.where("not whole").select("a", "b"))
    labels = written(whole.unionByName(dealt), "classes")
    discard(sketches, buckets, units, links)
    classes = first.join(labels, "node", "left").select("h1", "h2", F.coalesce("label", "node").alias("class_id"))
    found = every.select(F.col("node").alias("doc_id"), "h1", "h2").join(classes, ["h1", "h2"]).select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("is_kept"))
    return found, [every, first, labels]


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents of `docs`, one of each class, the one with the least id; all columns. Of rows that repeat an id one
    stays. Rows without an id cannot be told apart, and all stay."""
    classified, tables = _classified(docs, id_col, **options)
    found = written(classified, "near-duplicates")
    discard(*tables)
    kept = docs.join(found.where("is_kept").select(F.col("doc_id").alias(id_col)), id_col, "leftsemi")
    if not found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_col])
    return kept.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
