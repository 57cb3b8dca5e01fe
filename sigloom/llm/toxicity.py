"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a learned and of a fixed lexicon, the strongest learned weight, insults near second-
person words, capitals, punctuation, obfuscated words and repetition. The learned lexicon holds the words whose presence
separates toxic from other training texts. Trees of bounded depth are boosted on the logistic loss over binned features;
the raw scores of training rows, each scored by a model that did not see its fifth, are mapped to probabilities by pooling
adjacent violators.

Fitting uses a sample of labelled rows of a stated size (`SAMPLE`, the least by hash of id); everything else reads all
rows. Words are counted where the rows are; the driver receives at most `LEXICON` words and the sample's feature rows.

Defined cases: null and empty texts have all-zero features and get a score like any other; labels that are null are not
learned from; of several labels for a document the greatest counts; repeated rows score alike; without both labels in the
sample every score is the share of toxic ones, or 0; an empty table gives no rows; other columns are ignored here and kept by
`keep_harmless`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, fold, fresh_name, least_by_hash, written

SAMPLE = 12_000
LEXICON = 200
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 60, 3, 0.15, 32, 20
#: Common English insults, and second-person words in four languages.
INSULTS = frozenset("idiot moron stupid dumb fool loser pathetic worthless disgusting trash garbage scum clown ugly filthy vermin freak creep jerk imbecile hate kill".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine tu toi ton ta te vous votre usted ti tú su".split())
_DISGUISE = str.maketrans("0134578@$!", "oleastbasi")
_WORD = re.compile(r"[^\W\d_]+(?:[*@$!013457][^\W\d_]+)*")
_NEAR = 6
FEATURES = ("learned", "learned_top", "learned_distinct", "fixed", "near_you", "you", "capitals", "shouted", "marks", "exclaimed", "symbols", "disguised", "distinct", "word_length", "words")


def words_in(text: str) -> list[str]:
    return _WORD.findall(text)


def plain(word: str) -> str:
    """Lower case, and letters for the digits and signs that stand in for them inside a word."""
    word = word.lower()
    return word if word.isalpha() else word.translate(_DISGUISE).replace("*", "")


def text_features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    text = text or ""
    words = words_in(text)
    n, chars = max(1, len(words)), max(1, len(text))
    low = [plain(w) for w in words]
    kinds = Counter(low)
    found = {w: lexicon[w] for w in kinds.keys() & lexicon.keys()}
    fixed = [w for w in kinds if w in INSULTS]
    you = sum(kinds[w] for w in SECOND_PERSON if w in kinds)
    near = 0
    if you and (found or fixed):
        bad, at = {*found, *fixed}, -10 * _NEAR
        for k, w in enumerate(low):
            if w in SECOND_PERSON:
                at = k
            elif w in bad and k - at <= _NEAR:
                near += 1
    letters = max(1, sum(map(len, words)))
    capitals = sum(1 for c in text if c.isupper()) if not text.islower() else 0
    marks = chars - sum(map(len, words)) - text.count(" ") - text.count("\n")
    symbols = sum(text.count(c) for c in "*%$#&@")
    return [
        sum(found[w] * kinds[w] for w in found) / n, max(found.values(), default=0.0), float(len(found)),
        sum(kinds[w] for w in fixed) / n, near / n, you / n,
        capitals / letters, sum(1 for w in words if len(w) > 2 and w.isupper()) / n, marks / chars, text.count("!") / n, symbols / n,
        sum(1 for w in words if not w.isalpha()) / n, len(kinds) / n, letters / n, float(np.log1p(len(words))),
    ]


@dataclass
class Forest:
    """Boosted trees over binned features: per tree arrays of feature, bin, and leaf values in heap order."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1).astype(np.int16)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return self.base + sum((self.grown(b, t) for t in self.trees), np.zeros(len(x)))

    @staticmethod
    def grown(b: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        return value[node - (2**DEPTH - 1)]


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Newton boosting on the logistic loss; splits by gain over histograms."""
    forest = Forest([np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])])
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    forest.base = float(np.log(p / (1 - p)))
    b, raw = forest.binned(x), np.full(len(y), forest.base)
    inner = 2**DEPTH - 1
    for _ in range(trees):
        q = 1 / (1 + np.exp(-raw))
        g, h = y - q, q * (1 - q) + 1e-9
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, BINS + 1, np.int64), np.zeros(len(y), np.int64)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            best = 0.0
            if len(rows) >= 2 * LEAST_LEAF:
                for j in range(x.shape[1]):
                    gs, hs, ns = (np.cumsum(np.bincount(b[rows, j], w, BINS + 1)) for w in (g[rows], h[rows], None))
                    gl, hl, nl = gs[:-1], hs[:-1], ns[:-1]
                    gain = gl**2 / (hl + 1) + (gs[-1] - gl) ** 2 / (hs[-1] - hl + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                    gain[(nl < LEAST_LEAF) | (len(rows) - nl < LEAST_LEAF)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best + 1e-9:
                        best, feature[at], cut[at] = float(gain[k]), j, k
            node[rows] = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        forest.trees.append((feature, cut, value))
        raw += value[leaf]
    return forest


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points and non-decreasing probabilities, to be interpolated between."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, count, sum of scores
    for s, t in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([t, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t1, n1, s1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t1, blocks[-1][1] + n1, blocks[-1][2] + s1]
    return np.array([s / n for _, n, s in blocks]), np.array([t / n for t, n, _ in blocks])


@dataclass
class Model:
    lexicon: dict[str, float]
    forest: Forest | None
    points: np.ndarray
    values: np.ndarray
    share: float = 0.0

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.forest is None or not texts:
            return np.full(len(texts), self.share)
        raw = self.forest.raw(np.array([text_features(t, self.lexicon) for t in texts]))
        level = np.interp(raw, self.points, self.values)
        # pooled values tie; the raw score keeps order among them without crossing 0.5
        nudge = 1e-3 * (1 / (1 + np.exp(-raw)) - 0.5)
        return np.where(level >= 0.5, np.clip(level + nudge, 0.5, 1.0), np.clip(level + nudge, 0.0, 0.5 - 1e-9))


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """Words whose presence speaks for toxicity: log odds of at least 1 and enough texts, strongest evidence first."""
    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, toxic = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {plain(w) for w in words_in(text or "")}
                words += own
                toxic += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], names=["word", "toxic"])

    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad or not good:
        return {}
    counted = rows.select("text", "toxic").mapInArrow(kinds, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    evidence = counted.where(F.col("bad") >= 3).select("word", odds.alias("odds"), (odds * F.sqrt("bad")).alias("weight")).where("odds >= 1")
    found = evidence.orderBy(F.desc("weight"), "word").limit(size).collect()
    return {r["word"]: min(float(r["odds"]), 6.0) for r in found}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out: int = 0, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows outside the held-out fold."""
    marked = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    taken = least_by_hash(marked.where(fold("id", folds) != held_out), ["id"], sample)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(taken), "id")
    # of rows that repeat an id the text of the least checksum stays, so there are at most `sample` rows
    least = F.min_by(F.struct("text", "toxic"), F.struct(F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.length("text"), "text")).alias("row")
    rows = written(found.groupBy("id").agg(least).select("id", "row.text", "row.toxic"), "toxicity-sample")
    lexicon = learn_lexicon(rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [text_features(t, lexicon) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["id", "toxic", "x"])

    got = sorted(rows.mapInArrow(measure, "id string, toxic int, x array<double>").collect(), key=lambda r: (r["id"] or "", r["x"]))
    x, y = np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([float(r["toxic"]) for r in got])
    if len(y) < 4 * LEAST_LEAF or y.min() == y.max():
        return Model(lexicon, None, np.zeros(1), np.zeros(1), float(y.mean()) if len(y) else 0.0)
    part, raw = np.arange(len(y)) % 5, np.zeros(len(y))
    for k in range(5):
        raw[part == k] = boost(x[part != k], y[part != k]).raw(x[part == k])
    return Model(lexicon, boost(x, y), *isotonic(raw, y))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` and score; the name gets underscores in front if `keep` takes it."""
    kept = docs.select(*keep)
    schema = extended(kept.schema, f"`{fresh_name(kept, 'score')}` double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(model.score(batch.column(batch.num_columns - 1).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=schema.names)

    return docs.select(*keep, F.col(text_col).cast("string").alias(fresh_name(kept, "text_"))).mapInArrow(run, schema)


def keep_harmless(docs: DataFrame, model: Model, threshold: float = 0.5, **columns: str) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    return score(docs, model, docs.columns, **columns).where(F.col(fresh_name(docs, "score")) < threshold).select(*docs.columns)
