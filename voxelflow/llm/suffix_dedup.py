"""Removal of repeated 200-byte strings by a logarithmic family of suffix arrays.

Texts are UTF-8 bytes; a byte goes when a 200-byte string that covers it also
starts anywhere else, in any document.  Overlaps count; the input alone decides.

The arrays are sparse: a dense one has a position for each byte, eight times
the input before anything is compared.  Each 200-byte string holds an anchor
that its content chooses (see ``anchors``), and the suffixes that begin at
anchors are kept, by their first 80 bytes.  Each batch of documents gets an
array of them in text order: shards are ranges of text between sampled
splitters, and a shard is sorted.  The array is merge-scanned, shard by shard
and in place, with those of the levels so far (see ``levels``): neighbours with
a common prefix of 80 bytes or more are candidates, and no match is lost, as
a repeated string repeats its anchor's suffix.  Suffixes whose texts agree over
all strings around the anchor (second fingerprint) are matches as a whole; of
the others the strings are compared one by one.  Arrays of equal level merge
geometrically.  ``SuffixArrays.add_batch`` takes a further batch.

Defined results: null text is empty; texts under 200 bytes keep all; rows of
one doc_id and text are one document, so a repeated row is not a repetition and
gets the same result; each row without id is a document of its own; no rows give no rows; a character
cut in part is dropped by ``drop_repeated``, which keeps the other columns.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer_of, fresh, read_table, text_blocks
from .anchors import BLOCK, KEY, PLACES_SQL, SPAN, Entries, block_rows, covered, packed, signed, structs
from .levels import Index, marked_runs

LENGTH = 200
GRAM = 80
BATCHES = 4


def byte_spans(text: pa.Array, window: int = LENGTH, most: int = SPAN):
    """The bytes of all rows; a long text alone comes in spans that overlap by a string less one byte."""
    raw, offsets = buffer_of(text)
    if len(text) != 1 or len(raw) <= most:
        yield KEY.symbols[raw], offsets, 0, raw
        return
    for at in range(0, len(raw) - window + 1, most):
        part = raw[at : at + most + window - 1]
        yield KEY.symbols[part], np.array([0, len(part)]), at, part


def prefix_column(raw: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """The n bytes from each place on."""
    data = np.ascontiguousarray(raw[at[:, None] + np.arange(n)])
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * n).astype(np.int32)), pa.py_buffer(data)])


def leads(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first eight bytes of suffixes as numbers whose signed order is text order."""
    eight = np.zeros(len(at), np.uint64)
    for i in range(8):
        eight = eight << np.uint64(8) | raw[at + i].astype(np.uint64)
    return (eight ^ np.uint64(1 << 63)).view(np.int64)


class SuffixArrays(Index):
    """Arrays of the first ``gram`` bytes of anchor suffixes, in shards by ranges of text.

    A shard's number is chosen so that each falls into a bucket of its own, in
    the order of the text.  Splitters follow from the first batch: the suffixes
    of one document in SAMPLED by hash (of all, where these have none); they
    only balance the shards.
    """

    KEYS = [("shard", "int"), ("suffix", "binary")]
    both = True
    band = 16
    SAMPLED = 16

    def __init__(self, spark: SparkSession, window: int = LENGTH, gram: int = GRAM, buckets: int | None = None):
        super().__init__(spark, "suffixes", functools.partial(byte_spans, window=window), window, gram, buckets)
        self.splitters: np.ndarray | None = None

    def shards(self) -> np.ndarray:
        """For each bucket the smallest number that Spark's bucketing puts there."""
        n = self.buckets
        found = self.spark.range(64 * n).select(F.expr(f"pmod(hash(cast(id AS int)), {n})").alias("bucket"), "id").groupBy("bucket").agg(F.min("id").alias("id")).collect()
        return np.array([r["id"] for r in sorted(found, key=lambda r: r["bucket"])], np.int32)

    def split(self, docs: DataFrame) -> None:
        spans, window, gram = self.spans, self.window, self.gram

        def sample(parts):
            for block in text_blocks(parts, BLOCK):
                for units, bounds, _, raw in spans(block.column(3)):
                    e = Entries(units, bounds, window, gram)
                    if len(e.row):
                        yield pa.RecordBatch.from_arrays([pa.array(leads(raw, e.anchor))], names=["lead"])

        self.numbers = self.shards()
        shares = [(i + 1) / len(self.numbers) for i in range(len(self.numbers) - 1)]
        for part in (docs.where(F.pmod(F.xxhash64("doc_id", "sub", "text"), F.lit(self.SAMPLED)) == 0), docs):
            cuts = part.mapInArrow(sample, "lead long").agg(F.percentile_approx("lead", shares, 1000).alias("p")).first()["p"] if shares else []
            if cuts is not None:
                break
        self.splitters = np.unique(np.array(cuts or [], np.int64))

    def entries(self, docs: DataFrame) -> DataFrame:
        if self.splitters is None:
            self.split(docs)
        spans, window, gram, splitters, numbers = self.spans, self.window, self.gram, self.splitters, self.numbers

        def make(parts):
            for block in text_blocks(parts, BLOCK):
                born, doc, sub = (block.column(i).to_numpy() for i in range(3))
                for units, bounds, base, raw in spans(block.column(3)):
                    e = Entries(units, bounds, window, gram)
                    if not len(e.row):
                        continue
                    keys = {
                        "shard": lambda first, raw=raw, e=e: pa.array(numbers[np.searchsorted(splitters, leads(raw, e.anchor[first]), "left")]),
                        "suffix": lambda first, raw=raw, e=e: prefix_column(raw, e.anchor[first], gram),
                    }
                    yield block_rows(keys, signed(e.key), signed(e.sig), [born[e.row], doc[e.row], sub[e.row], packed(e.start + base, e.n, e.ahead)])

        return docs.mapInArrow(make, f"shard int, suffix binary, sig long, born int, doc_id long, sub long, at long, {PLACES_SQL}")



def kept_parts(text: bytes, start: np.ndarray, length: np.ndarray) -> tuple[list[bytes], int]:
    s, e = covered(start, length, len(text))
    full = e > s
    s, e = s[full], e[full]
    cuts = [0, *np.stack([s, e], axis=1).ravel().tolist(), len(text)]
    return [text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)], len(s)


def _digests(batches):
    for block in text_blocks(batches):
        rows = []
        for text, (start, length) in zip(block.column(1).to_pylist(), structs(block.column(2), "start", "length"), strict=True):
            data = (text or "").encode()
            parts, spans = kept_parts(data, start, length)
            kept = b"".join(parts)
            rows.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
        c = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = marked_runs(SuffixArrays(docs.sparkSession, length, gram), source, batches)
    return out.mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``; n_chars, where there is one, follows.

    A text of which nothing is left stays as an empty text; a null stays null.
    """
    joined = marked_runs(SuffixArrays(docs.sparkSession, length, gram), docs, batches, fresh(docs, "found_runs"))
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches):
        for block in text_blocks(batches):
            texts = []
            for text, (start, length) in zip(block.column(at).to_pylist(), structs(block.column(block.num_columns - 1), "start", "length"), strict=True):
                if text is not None and len(start):
                    text = b"".join(x for x in kept_parts(text.encode(), start, length)[0]).decode(errors="ignore")
                texts.append(text)
            columns = list(block.columns[:-1])  # the last column has the runs found
            columns[at] = pa.array(texts, block.schema.field(at).type)
            if chars is not None:
                old = columns[chars]
                columns[chars] = pa.array([o if t is None or f is None else len(t) for o, t, f in zip(old.to_pylist(), texts, block.column(block.num_columns - 1).to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays(columns, names=block.schema.names[:-1])

    return joined.mapInArrow(cut, docs.schema)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(read_table(spark, sf_dir, "documents"))
