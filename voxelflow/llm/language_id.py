"""Language identification by string kernels.

Blended-spectrum presence kernel: k(x, y) is the number of distinct byte
n-grams (n = 1 to 3, over lower-cased letters, all else one gap symbol) that
two texts have in common, divided by the geometric mean of their own numbers.
Nyström: the kernel to ``landmarks`` training texts, times the inverse square
root of the landmarks' own kernel matrix, is the feature map; one-versus-rest
kernel ridge regression in it gives each language a value.  Batches of texts
are scored by matrix products.

The model is fitted on a sample of at most ``sample`` labelled texts, spread
evenly over the ``LABELS`` most frequent languages by the hash of their ids;
prediction reads the text alone.  Defined results: ``und`` with score 0 where the text is null or has no
letter; any length is read whole; repeated rows get equal values; null labels
aren't learned from; without a labelled text everything is ``und``; other
columns are ignored by the classifier and kept by the filter.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, bounded_collect, buffer_of, held_out, read_table, text_blocks

ORDERS = (1, 2, 3)
LANDMARKS = 160
#: Labelled texts in the fit at most.
SAMPLE = 2_000
#: Values of the label that are learned at most, the most frequent ones.
LABELS = 500
#: The filter rejects a text of EVIDENCE bytes or more of which the landmarks know less than a language's floor of the n-grams:
#: MARGIN of the least share of its training texts that are no landmarks, COVERAGE at most; FLOOR_TEXTS of them must be there, else it has none.
COVERAGE, EVIDENCE, MARGIN, FLOOR_TEXTS = 0.7, 40, 0.9, 20
RIDGE = 0.05
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Some numerals, such as superscripts, match the pattern but are no letters."""
    return any(m[0].isalpha() for m in LETTER.finditer(text))


#: Byte to symbol: a to z are 1 to 26, bytes beyond ASCII 27 to 154, all else 0.
SYMBOL = np.zeros(256, np.int64)
SYMBOL[0x61:0x7B] = np.arange(1, 27)
SYMBOL[0x80:] = np.arange(27, 155)
SYMBOL = SYMBOL[LOWER]
RADIX = 155


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram code) of every n-gram inside a row; runs of gaps count as one gap."""
    symbol = SYMBOL[raw]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if len(symbol):
        keep = np.r_[True, (symbol[1:] != 0) | (symbol[:-1] != 0) | (row[1:] != row[:-1])]
        symbol, row = symbol[keep], row[keep]
    rows, codes = [], []
    for n in ORDERS:
        m = len(symbol) - n + 1
        if m <= 0:
            continue
        code = np.zeros(m, np.int64)
        for i in range(n):
            code = code * RADIX + symbol[i : i + m]
        inside = row[:m] == row[n - 1 : n - 1 + m]
        rows.append(row[:m][inside])
        codes.append(code[inside] + (0, 0, RADIX, RADIX + RADIX**2)[n])
    return (np.concatenate(rows), np.concatenate(codes)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Model:
    labels: list[str]
    column: np.ndarray  # of each gram code, -1 where no landmark has it
    presence: np.ndarray  # grams x landmarks, float32
    norms: np.ndarray  # of the landmarks
    weights: np.ndarray  # landmarks x labels, with the Nyström map folded in
    bias: np.ndarray
    floors: np.ndarray  # for each label, the least share of known n-grams of a text in it

    @property
    def step(self) -> int:
        """Texts of a product, so that it holds some 32 MB whatever the scripts."""
        return int(np.clip((1 << 23) // (len(self.presence) + 1), 8, 256))

    def kernel(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows x landmarks, by one matrix product."""
        return self.kernel_of(*grams(raw, offsets), len(offsets) - 1)

    def kernel_of(self, rows: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
        seen = np.zeros((n, self.presence.shape[0] + 1), np.float32)
        seen[rows, self.column[codes]] = 1.0
        both = seen[:, :-1] @ self.presence
        own = np.maximum(seen[:, :-1].sum(1), 1.0)
        return both / np.sqrt(own[:, None] * self.norms[None, :])

    def coverage(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The share of each text's n-grams that some landmark has."""
        rows, codes = grams(raw, offsets)
        n = len(offsets) - 1
        return np.bincount(rows, weights=self.column[codes] >= 0, minlength=n) / np.maximum(np.bincount(rows, minlength=n), 1)

    def values(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.kernel(raw, offsets) @ self.weights + self.bias


def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)


def fit(texts: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    names = sorted(set(labels))
    if not names:
        return None
    by = {x: [t for t, y in zip(texts, labels, strict=True) if y == x] for x in names}
    names = [x for x in names if by[x]]
    if not names:
        return None
    each = max(1, landmarks // len(names))
    marks = [t for x in names for t in by[x][:each]]
    rows, codes = flat(marks)
    known = np.unique(codes)
    column = np.full(RADIX + RADIX**2 + RADIX**3, -1, np.int32)
    column[known] = np.arange(len(known))
    presence = np.zeros((len(known), len(marks)), np.float32)
    presence[column[codes], rows] = 1.0
    model = Model(names, column, presence, presence.sum(0), np.zeros((len(marks), len(names)), np.float32), np.zeros(len(names), np.float32), np.zeros(len(names)))
    own = model.kernel_of(rows, codes, len(marks)).astype(np.float64)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    use = value > 1e-6 * value.max()
    nystrom = vector[:, use] / np.sqrt(value[use])
    every = [(t, i) for i, x in enumerate(names) for t in by[x]]
    parts = [[t for t, _ in every[a : a + model.step]] for a in range(0, len(every), model.step)]
    features = np.concatenate([model.kernel_of(*flat(p), len(p)) for p in parts]).astype(np.float64) @ nystrom
    target = np.eye(len(names))[[i for _, i in every]] * 2 - 1
    weight = np.sqrt(1.0 / np.bincount([i for _, i in every], minlength=len(names)))[[i for _, i in every]][:, None]
    mean, goal = (features * weight**2).sum(0) / (weight**2).sum(), (target * weight**2).sum(0) / (weight**2).sum()
    x, y = (features - mean) * weight, (target - goal) * weight
    ridge = ridge * np.trace(x.T @ x) / x.shape[1]
    beta = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ y)
    model.weights = (nystrom @ beta).astype(np.float32)
    model.bias = (goal - mean @ beta).astype(np.float32)
    for i, x in enumerate(names):
        shares = [float((column[t] >= 0).mean()) for t in by[x][each:] if len(t)]
        if len(shares) >= FLOOR_TEXTS:
            model.floors[i] = min(COVERAGE, MARGIN * min(shares))
    return model


def training_rows(labelled: DataFrame, key: str, sample: int, vectors) -> list:
    """Bounded, the same at every run: at most sample / n documents of each of the n most frequent values of ``key``.

    ``n`` is LABELS at most.  The least hashes of doc_id win: a threshold from the numbers of distinct ids thins
    them in the tasks, and the few beyond are cut here.  An id counts once; of several texts, the one of least hash.
    ``vectors`` makes bytes of each whole text in the tasks; only these are collected.
    """
    counted = labelled.select("doc_id", key).distinct().groupBy(key).agg(F.count("*").alias("_n"))
    values = counted.orderBy(F.desc("_n"), key).limit(min(LABELS, sample)).collect()
    if not values:
        return []
    each = sample // len(values)
    most = each + 4 * math.isqrt(each) + 4  # nearly surely ``each`` at least
    shares = [(r[key], min(1 << 30, -(-(most << 30) // r["_n"]))) for r in values]
    kind = dict(labelled.dtypes)[key]
    share = F.broadcast(labelled.sparkSession.createDataFrame(shares, f"{key} {kind}, _share long"))
    hashed = labelled.select("doc_id", key, F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("_at"), F.xxhash64("text").alias("_text")).join(share, key).where(F.col("_at") < F.col("_share"))
    ids = hashed.groupBy("doc_id", key, "_at").agg(F.min("_text").alias("_text"))
    rows = labelled.select("doc_id", key, F.xxhash64("text").alias("_text"), "text").join(F.broadcast(ids), ["doc_id", key, "_text"]).select("doc_id", key, "_at", "text")

    def reduced(batches):
        for block in text_blocks(batches, 1 << 19):
            for a in range(0, block.num_rows, 256):
                part = block.slice(a, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(vectors(part.column(3)), pa.binary())], names=["doc_id", key, "_at", "vector"])

    out = rows.mapInArrow(reduced, f"doc_id long, {key} {kind}, _at long, vector binary").dropDuplicates(["doc_id", key])
    found = sorted(bounded_collect(out, 2 * most * len(values) + 1000, "training rows"), key=lambda r: (r["_at"], r["doc_id"]))
    by = {v[key]: [r for r in found if r[key] == v[key]][:each] for v in values}
    return sorted((r for rows in by.values() for r in rows), key=lambda r: (r["_at"], r["doc_id"]))


def gram_sets(text: pa.Array) -> list[bytes | None]:
    """The distinct grams of each text; None where it has no letter."""
    raw, offsets = buffer_of(text)
    rows, codes = grams(raw, offsets)
    both = np.unique(rows * len_codes() + codes)
    cuts = np.searchsorted(both, np.arange(len(text) + 1) * len_codes())
    codes = (both % len_codes()).astype(np.int32)
    return [codes[a:b].tobytes() if has_letter(t or "") else None for t, a, b in zip(text.to_pylist(), cuts[:-1], cuts[1:], strict=True)]


def len_codes() -> int:
    return RADIX + RADIX**2 + RADIX**3


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learns from doc_id, text and lang of the documents that aren't held out."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    rows = [r for r in training_rows(known, "lang", sample, gram_sets) if r["vector"] is not None]
    return fit([np.frombuffer(r["vector"], np.int32) for r in rows], [r["lang"] for r in rows])


def _judged(model: Model | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bool], list[str]]:
    """For each text the best label's number, the values, whether there is a letter, and the labels."""
    raw, offsets = buffer_of(texts)
    values = np.zeros((len(texts), 1)) if model is None else model.values(raw, offsets).astype(np.float64)
    ascii_letter = np.add.reduceat(np.r_[(SYMBOL[raw] > 0) & (SYMBOL[raw] < 27), False], np.minimum(offsets[:-1], len(raw))) * (np.diff(offsets) > 0)
    letter = [bool(n) or has_letter(t.as_py() or "") for n, t in zip(ascii_letter.tolist(), texts, strict=True)]
    return values.argmax(1), values, letter, ["und"] if model is None else model.labels


def _steps(batches, model: Model | None):
    for block in text_blocks(batches, 1 << 19):
        step = 256 if model is None else model.step
        for a in range(0, block.num_rows, step):
            yield block.slice(a, step)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        for part in _steps(batches, model):
            best, v, letter, names = _judged(model, part.column(1))
            e = np.exp(4 * (v - v.max(1, keepdims=True)))
            lang = [names[i] if ok else "und" for i, ok in zip(best.tolist(), letter, strict=True)]
            sure = np.where(letter, np.round(1 / e.sum(1), 6), 0.0) if model is not None else np.zeros(len(lang))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(lang, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return source.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model | None, languages: set[str] | None = None) -> DataFrame:
    """``docs`` without the rows that are rejected, columns as they are.

    A row is rejected where its text is null or has no letter; where it is like
    no language that is learned, as noise and other languages are: it has EVIDENCE
    bytes or more, and the landmarks know less of its n-grams than the floor of
    the language predicted; and where that language isn't one of ``languages``
    (None: all that are learned).  A floor is measured on training texts that are
    no landmarks; a language with too few of them has none, and no text goes for
    being unlike its landmarks.  Without a model nothing is known of languages, so
    only texts without letters go.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches):
        model = shared.value
        for part in _steps(batches, model):
            text = part.column(at).cast(pa.string())
            best, _, letter, names = _judged(model, text)
            stay = np.array(letter, bool)
            if model is not None:
                size = np.diff(buffer_of(text)[1])
                stay &= (model.coverage(*buffer_of(text)) >= model.floors[best]) | (size < EVIDENCE)
                if languages is not None:
                    stay &= np.array([names[i] in languages for i in best.tolist()], bool)
            yield part.filter(pa.array(stay))

    return docs.mapInArrow(keep, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
