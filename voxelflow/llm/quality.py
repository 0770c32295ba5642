"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

Terms are hashed byte trigrams of the text in which letters keep only their
case and digits their kind, hashed words, and length and repetition marks.
tf-idf of the labelled sample, a truncated singular value decomposition, and
unit length make the latent vectors.  The labelled vectors go to every task;
each document is compared with all of them by exact cosine products in blocks,
and its ``neighbours`` nearest vote for their label, weighted by similarity.

The sample has at most ``sample`` labelled rows, taken by the hash of their
ids.  Defined results: null text is empty; an empty text has no terms and gets
the sample's mean label; equal similarities are taken in the sample's order;
repeated rows get equal scores; null labels are ignored; without labels every
score is 0.5; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE, Roller, buffer_of, held_out, read_table, text_blocks, word_hashes, words_of
from .language_id import training_rows

TERMS = 4096
DIMENSIONS = 64
NEIGHBOURS = 15
SAMPLE = 4_000
THRESHOLD = 0.7

#: Bytes to shapes: white space 1, line feed 2, small letters 3, capitals 4, digits 5, beyond ASCII 6, other ASCII 7 and up.
SHAPE = np.arange(7, 7 + 256, dtype=np.int64)
SHAPE[0x61:0x7B], SHAPE[0x41:0x5B], SHAPE[0x30:0x3A], SHAPE[0x80:] = 3, 4, 5, 6
SHAPE[SPACE] = 1
SHAPE[0x0A] = 2
WORD_TERMS = TERMS // 2
SHAPE_TERMS = TERMS // 4
ROLLER = Roller(23)


def term_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x TERMS: hashed words, hashed shape trigrams, and repeated words by rank; float32 relative frequencies."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    row = np.repeat(np.arange(n), np.diff(offsets))
    if len(raw) >= 3:
        s = SHAPE[raw]
        code = (s[:-2] * 263 + s[1:-1]) * 263 + s[2:]
        code = (code * 0x9E3779B1 >> 12) % SHAPE_TERMS
        inside = row[:-2] == row[2:]
        flat = np.bincount(row[:-2][inside] * SHAPE_TERMS + code[inside], minlength=n * SHAPE_TERMS).reshape(n, SHAPE_TERMS)
        out[:, WORD_TERMS : WORD_TERMS + SHAPE_TERMS] = flat / np.maximum(flat.sum(1, keepdims=True), 1)
    starts, ends, first = words_of(raw, offsets, SPACE)
    if len(starts):
        h = word_hashes(ROLLER, LOWER[raw], starts, ends)
        owner = np.repeat(np.arange(n), np.diff(first))
        flat = np.bincount(owner * WORD_TERMS + (h % np.uint64(WORD_TERMS)).astype(np.int64), minlength=n * WORD_TERMS).reshape(n, WORD_TERMS)
        out[:, :WORD_TERMS] = flat / np.maximum(flat.sum(1, keepdims=True), 1)
        order = np.lexsort((h, owner))
        o, x = owner[order], h[order]
        new = np.r_[True, (o[1:] != o[:-1]) | (x[1:] != x[:-1])]
        distinct = np.bincount(o[new], minlength=n)
        words = np.diff(first)
        share = distinct / np.maximum(words, 1)
        mark = WORD_TERMS + SHAPE_TERMS
        rows = np.flatnonzero(words)
        out[rows, mark + np.minimum((share[rows] * 20).astype(int), 20)] = 0.2
        out[rows, mark + 32 + np.minimum(np.log2(words[rows] + 1).astype(int), 24)] = 0.1
        capital = np.bincount(row[(raw >= 0x41) & (raw <= 0x5A)], minlength=n)
        small = np.bincount(row[(raw >= 0x61) & (raw <= 0x7A)], minlength=n)
        out[rows, mark + 64 + (capital[rows] * 10 // np.maximum(capital[rows] + small[rows], 1))] = 0.2
        marks = np.bincount(row[(SHAPE[raw] > 6)], minlength=n)
        out[rows, mark + 80 + np.minimum(marks[rows] * 20 // np.maximum(np.diff(offsets)[rows], 1), 19)] = 0.2
    return out


@dataclass
class Model:
    idf: np.ndarray
    base: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled x dimensions, unit length
    labels: np.ndarray
    mean: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        v = (np.sqrt(counts, dtype=np.float64) * self.idf) @ self.base
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        near = self.latent(counts) @ self.vectors.T
        k = min(neighbours, near.shape[1])
        least = np.partition(near, -k, axis=1)[:, -k][:, None]
        above, tied = near > least, near == least  # of those tied at the end, the first of the sample count
        used = above | tied & (np.cumsum(tied, axis=1) <= k - above.sum(1, keepdims=True))
        weight = np.where(used, np.maximum(near, 0) ** 8 + 1e-9, 0)
        score = weight @ self.labels / weight.sum(1)
        return np.where(counts.any(1), score, self.mean)


def _right_vectors(x: np.ndarray, k: int) -> np.ndarray:
    """The first right singular vectors by subspace iteration; beside ``x`` only thin matrices are held."""
    thin = min(k + 16, *x.shape)
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((x.shape[1], thin), np.float32))[0]
    for _ in range(12):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, small = np.linalg.svd((x @ q).astype(np.float64), full_matrices=False)
    return np.ascontiguousarray(q.astype(np.float64) @ small[:k].T)


def fit(texts: list[bytes], labels: list[int], dimensions: int = DIMENSIONS) -> Model | None:
    if not texts:
        return None
    counts = np.zeros((len(texts), TERMS), np.float32)
    for i, x in enumerate(texts):
        counts[i] = np.frombuffer(x, np.float32)
    idf = np.log((1 + len(texts)) / (1 + np.count_nonzero(counts, axis=0))) + 0.2
    weighted = np.sqrt(counts)
    weighted *= idf.astype(np.float32)
    base = _right_vectors(weighted, min(dimensions, len(texts)))
    del weighted
    y = np.array(labels, np.float64)
    model = Model(idf, base, np.zeros((0, base.shape[1])), y, float(y.mean()))  # float64: equal texts score alike in any batch
    model.vectors = np.concatenate([model.latent(counts[a : a + 256]) for a in range(0, len(texts), 256)])
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learns ``quality`` of the labelled documents that aren't held out; a document with several labels counts as its smallest."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # the labelled ids are thinned before any text moves: four samples of each label by hash, then the exact cut in training_rows
    counts = known.groupBy("quality").count().collect()  # two rows at most
    share = F.lit(0)
    for r in counts:
        share = F.when(F.col("quality") == r["quality"], F.lit(min(1 << 20, -(-(4 * sample << 20) // r["count"])))).otherwise(share)
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < share)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = training_rows(texts.join(F.broadcast(known), "doc_id"), "quality", sample, lambda text: [x.tobytes() for x in term_counts(*buffer_of(text))])
    return fit([r["vector"] for r in rows], [r["quality"] for r in rows])


def _scored(shared):
    def score(batches):
        model = shared.value
        for block in text_blocks(batches, 1 << 20):
            for a in range(0, block.num_rows, 256):
                part = block.slice(a, 256)
                raw, offsets = buffer_of(part.column(1))
                value = np.full(part.num_rows, 0.5) if model is None else np.clip(model.scores(term_counts(raw, offsets)), 0, 1)
                value = np.round(value.astype(np.float64), 6)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return score


def score_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return source.mapInArrow(_scored(shared), "doc_id long, held_out boolean, score double, predicted int")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, read_table(spark, sf_dir, "labels")))
