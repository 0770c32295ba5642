"""Incremental removal of repeated word windows by a log-structured fingerprint index.

Words are runs of characters other than ASCII white space.  A window is 20
consecutive words of one document; a word goes when a window that covers it
also starts earlier, in a document of smaller id or earlier in the same one.

Each batch of documents is fingerprinted, dealt by the hash of the fingerprint,
and merge-joined with the sorted immutable runs of the batches before, where
they lie (see ``levels``); then the batch's own run is compacted with runs of
its size.  Windows are fingerprinted by their anchors' entries (see
``anchors``); a match is verified by a second fingerprint of another base over
all words covered, and windows next to a difference are compared one by one.
``FingerprintRuns.add_batch`` takes a further batch.

Defined results: null text has no words; documents under 20 words keep all;
rows of one doc_id and text are one document, so a repeated row is not a
repetition and gets the same result; each row without id is a document of its
own, before all others; texts of one doc_id come in the order of their hash; no
rows give no rows; other columns are ignored, and kept by ``drop_repeated``.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, buffer_of, read_table, text_blocks, word_hashes, words_of
from .anchors import BLOCK, KEY, PLACES_SQL, SPAN, Entries, block_rows, covered, packed, signed, structs
from .levels import Index, marked_runs

WINDOW = 20
GRAM = 8
BATCHES = 4


def word_spans(text: pa.Array, window: int = WINDOW, most: int = SPAN):
    """Hashes of the words of all rows; a long text alone comes in spans that overlap by a window less one word."""
    raw, offsets = buffer_of(text)
    if len(text) != 1 or len(raw) <= most:
        starts, ends, first = words_of(raw, offsets, SPACE)
        yield word_hashes(KEY, raw, starts, ends), first, 0, None
        return
    at = base = 0
    size = most
    while True:
        stop = min(at + size, len(raw))
        while stop < len(raw) and not SPACE[raw[stop]]:
            stop += 1
        part = raw[at:stop]
        starts, ends, first = words_of(part, np.array([0, len(part)]), SPACE)
        if stop < len(raw) and len(starts) < 2 * window:  # huge words
            size *= 2
            continue
        yield word_hashes(KEY, part, starts, ends), first, base, None
        if stop == len(raw):
            return
        base += len(starts) - window + 1
        at += int(starts[len(starts) - window + 1])
        size = most


class FingerprintRuns(Index):
    """Runs of ``key``, the fingerprint of an anchor's words, and ``sig``, that of all words of its windows."""

    KEYS = [("key", "long")]
    both = False
    band = 4

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, buckets: int | None = None):
        super().__init__(spark, "windows", functools.partial(word_spans, window=window), window, gram, buckets)

    def entries(self, docs: DataFrame) -> DataFrame:
        spans, window, gram = self.spans, self.window, self.gram

        def make(parts):
            for block in text_blocks(parts, BLOCK):
                born, doc, sub = (block.column(i).to_numpy() for i in range(3))
                for units, bounds, base, _ in spans(block.column(3)):
                    e = Entries(units, bounds, window, gram)
                    if len(e.row):
                        key = signed(e.key)
                        yield block_rows({"key": lambda first, key=key: pa.array(key[first])}, key, signed(e.sig), [born[e.row], doc[e.row], sub[e.row], packed(e.start + base, e.n, e.ahead)])

        return docs.mapInArrow(make, f"key long, sig long, born int, doc_id long, sub long, at long, {PLACES_SQL}")



def _kept(batches, texts: bool = True):
    for block in text_blocks(batches):
        n_words, n_removed, digest, kept = [], [], [], []
        for text, (start, length) in zip(block.column(1).to_pylist(), structs(block.column(2), "start", "length"), strict=True):
            words = (text or "").encode().split()
            s, e = covered(start, length, len(words))
            stay, at = [], 0
            for a, b in zip(s.tolist(), e.tolist(), strict=True):
                stay += words[at:a]
                at = b
            stay += words[at:]
            line = b" ".join(stay)
            n_words.append(len(words))
            n_removed.append(len(words) - len(stay))
            digest.append(hashlib.sha256(line).hexdigest())
            kept.append(line.decode() if texts else None)
        yield pa.RecordBatch.from_arrays([block.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (null unless ``texts``) for each row of ``docs``."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = marked_runs(FingerprintRuns(docs.sparkSession, window, gram), source, batches)
    return out.mapInArrow(lambda parts: _kept(parts, texts), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(read_table(spark, sf_dir, "documents"), texts=False).drop("kept_text")
