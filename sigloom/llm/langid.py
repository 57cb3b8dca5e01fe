"""Language identification by string kernels: blended-spectrum presence kernels, Nystrom landmarks, ridge regression.

Two texts' kernel is the number of n-grams of one to `LONGEST` bytes that both contain, over the geometric mean of how
many each contains. Landmarks are training texts' n-gram sets; the Nystrom map sends a text's kernels with
the landmarks through the inverse square root of the landmarks' own kernel matrix. On those features kernel ridge
regression is linear and solved in closed form, one language against the rest.

A text's n-grams are looked up among those of the landmarks; others touch no kernel but the norm. Scoring multiplies a batch
of presence rows with the landmarks' matrix. Whole texts are read, whatever their length.

The classifier is fitted on a sample of labelled rows with a letter, of a stated size (`SAMPLE`): of each language the least
by hash, as many of each as it allows, one at least; everything else reads all rows.

Defined cases: a null text, or one without a letter, is `und` with score 0; training without any labelled row makes every
text `und`; ties go to the language that sorts first; repeated rows get equal results; an empty table gives no rows; other
columns are ignored here and kept by `keep_known`.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import extended, fold, fresh_name

LONGEST = 4
SAMPLE = 2400
LANDMARKS = 160
RIDGE = 1e-2
UNKNOWN = "und"
_BITS = 22
_MULTIPLY = np.uint32(2654435761)


def grams(text: str) -> np.ndarray:
    """Hashes (22 bits) of the distinct n-grams of a text in lower case; a run of white space counts as one space."""
    raw = np.frombuffer(" ".join(text.lower().split()).encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    code, out = np.zeros(len(raw), np.uint32), []
    for n in range(1, LONGEST + 1):
        if len(raw) < n:
            break
        code = (code[: len(raw) - n + 1] << np.uint32(8)) | raw[n - 1 :]
        out.append(((code + np.uint32(n)) * _MULTIPLY) >> np.uint32(32 - _BITS))
    if not out:
        return np.zeros(0, np.int64)
    every = np.concatenate(out)
    if len(every) < 1 << 15:
        return np.unique(every).astype(np.int64)
    marks = np.zeros(1 << _BITS, bool)
    marks[every] = True
    return np.flatnonzero(marks)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    column: np.ndarray  # of a gram hash among the landmarks' grams, or -1
    presence: np.ndarray  # landmark grams x landmarks, float32
    weights: np.ndarray  # landmarks x languages: the Nystrom map and the ridge solution together
    norms: np.ndarray  # square roots of the landmarks' gram counts

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        rows = np.zeros((len(texts), len(self.presence)), np.float32)
        size, known = np.ones(len(texts)), np.zeros(len(texts), bool)
        for k, text in enumerate(texts):
            if self.languages and has_letter(text):
                g = grams(text)
                at = self.column[g]
                rows[k, at[at >= 0]] = 1
                size[k], known[k] = len(g), True
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if known.any():
            values = ((rows @ self.presence) / (np.sqrt(size)[:, None] * self.norms)) @ self.weights
            best = values.argmax(1)
            spread = np.exp(np.clip(4 * (values - values.max(1, keepdims=True)), -50, 0))
            score = np.where(known, 1 / spread.sum(1), 0.0)
            names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
        return names, score


def train(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    names = sorted(set(languages))
    empty = Model([], np.full(1 << _BITS, -1, np.int32), np.zeros((0, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    sets = [grams(t) for t in texts]
    usable = [k for k, g in enumerate(sets) if len(g)]
    if not usable or not names:
        return empty
    by_language = {n: [k for k in usable if languages[k] == n] for n in names}
    chosen = [ks[i] for i in range(landmarks) for ks in by_language.values() if i < -(-landmarks // len(names)) and i < len(ks)][:landmarks]
    column = np.full(1 << _BITS, -1, np.int32)
    union = np.unique(np.concatenate([sets[k] for k in chosen]))
    column[union] = np.arange(len(union))
    presence = np.zeros((len(union), len(chosen)), np.float32)
    for j, k in enumerate(chosen):
        presence[column[sets[k]], j] = 1
    norms = np.sqrt([len(sets[k]) for k in chosen])

    def kernel(ks: list[int]) -> np.ndarray:
        rows = np.zeros((len(ks), len(union)), np.float32)
        for i, k in enumerate(ks):
            at = column[sets[k]]
            rows[i, at[at >= 0]] = 1
        return (rows @ presence) / (np.sqrt([len(sets[k]) for k in ks])[:, None] * norms)

    values, vectors = np.linalg.eigh(kernel(chosen).astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    phi = np.concatenate([kernel(usable[a : a + 500]) for a in range(0, len(usable), 500)]).astype(np.float64) @ root
    target = np.array([[1.0 if languages[k] == n else -1.0 for n in names] for k in usable])
    # languages weigh alike, however many rows each has
    balance = np.array([len(usable) / (len(names) * len(by_language[languages[k]])) for k in usable])[:, None]
    solution = np.linalg.solve(phi.T @ (balance * phi) + ridge * np.eye(phi.shape[1]), phi.T @ (balance * target))
    return Model(names, column, presence, root @ solution, norms)


def bound_each(counts: list[int], sample: int) -> int:
    """The most rows of each language, so that all together are at most `sample`, but one each at least."""
    left = sample
    for k, n in enumerate(sorted(counts)):
        if n * (len(counts) - k) > left:
            return max(1, left // (len(counts) - k))
        left -= n
    return max(counts, default=1)


def spread(labelled: DataFrame, sample: int) -> DataFrame:
    """id, lang and text of the rows least by hash within each language. Of a large language only a share of about twice as
    many rows, those with small hashes, is sorted; equal rows count once."""
    space = 1 << 40
    keyed = labelled.select("id", "lang", "text", F.pmod(F.xxhash64("id", "lang", "text"), F.lit(space)).alias("key"))
    found = keyed.groupBy("lang").agg(F.count("*").alias("n"), F.min("key").alias("least")).collect()
    most = bound_each([r["n"] for r in found], sample)
    limits = [(r["lang"], max(r["least"], space * (2 * most + 100) // r["n"] if r["n"] > 4 * most else space)) for r in found]
    near = keyed.join(F.broadcast(labelled.sparkSession.createDataFrame(limits, "lang string, highest long")), "lang").where("key <= highest")
    ranked = near.dropDuplicates(["lang", "key"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key")))
    return ranked.where(F.col("rank") <= most).select("id", "lang", "text")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out: int = 1, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows with a letter outside the held-out fold (more only if there are more languages),
    spread over the languages; whole texts are used."""
    labelled = docs.select(
        F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
        fold(id_col, folds).alias("fold"),
    ).where((F.col("fold") != held_out) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = spread(labelled, sample).collect()
    rows.sort(key=lambda r: (r["lang"], r["id"] or "", r["text"]))
    random.Random(0).shuffle(rows)
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` and lang_pred, score; names that `keep` takes get underscores in front."""
    kept = docs.select(*keep)
    names = [fresh_name(kept, n) for n in ("lang_pred", "score")]
    schema = extended(kept.schema, f"`{names[0]}` string, `{names[1]}` double")
    step = min(250, 1 + 25_000_000 // (1 + len(model.presence)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, languages, scores = batch.column(batch.num_columns - 1).to_pylist(), [], []
            for at in range(0, len(texts), step):
                got = model.decide(texts[at : at + step])
                languages += got[0]
                scores.append(got[1])
            new = [pa.array(languages, pa.string()), pa.array(np.concatenate([*scores, []]), pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=schema.names)

    return docs.select(*keep, F.col(text_col).cast("string").alias(fresh_name(kept, "text_"))).mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: Model, languages: list[str] | None = None, least_score: float = 0.0, **columns: str) -> DataFrame:
    """The documents in a known language (or one of `languages`) told with at least `least_score`, with all their columns.
    Texts without a letter go."""
    found = identify(docs, model, docs.columns, **columns)
    name, score = (fresh_name(docs, n) for n in ("lang_pred", "score"))
    wanted = F.col(name).isin(*languages) if languages else F.col(name) != UNKNOWN
    return found.where(wanted & (F.col(score) >= least_score)).select(*docs.columns)
