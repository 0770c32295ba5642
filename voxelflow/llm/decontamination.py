"""Benchmark decontamination by size-partitioned MinHash containment search.

An item of n distinct shingles lies in a document when at least t * n of them
do, wherever they stand.  Each item is represented by its bottom-m MinHash
sketch, the m smallest of its shingle hashes.  Of any m = n - ceil(t * n) + 1
shingles, a document that reaches the threshold holds one or more, so items
are partitioned by size, each partition's m follows from its largest n, and a
document is held against the items of those partitions alone whose sketches it
meets: the search loses no pair, however long the document is.  Candidates are then
verified by exact containment of shingle texts.

Words: A-Z lower-cased, runs of letters, digits and characters beyond ASCII.
Shingles: five words; a shorter item is one shingle of all its words, sought as
that run of words.

Defined results: a null or empty text matches nothing; an item without words is
never found; equal items (ties) are sought once and reported each, however many; a repeated document row is
reported each time; null ids pass through; no rows give no rows; other columns
of either table are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NON_WORD, Roller, bounded_collect, buffer_of, read_table, text_blocks, word_hashes, words_of

SHINGLE = 5
THRESHOLD = 0.8
#: Distinct items that one pass over the documents searches for, and their bytes; more are taken in several blocks.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 32 << 20

SCHEMA = "doc_id long, _h0 long, _h1 long, n_shingles int, n_found int, containment double"


def _shingle_texts(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> list[bytes]:
    low = LOWER[raw].tobytes()
    words = [low[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    return [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


class Partition:
    """Items of about one size: their pooled sketches, and all their hashes with the items that own them."""

    def __init__(self, items: list[tuple[int, np.ndarray]], threshold: float):
        most = max(len(h) for _, h in items)
        m = most - math.ceil(threshold * most - 1e-9) + 1
        self.sketch = np.unique(np.concatenate([h[: max(m, len(h) - math.ceil(threshold * len(h) - 1e-9) + 1)] for _, h in items]))
        every = np.concatenate([h for _, h in items])
        owner = np.repeat([j for j, _ in items], [len(h) for _, h in items])
        order = np.argsort(every, kind="stable")
        self.every, self.owner = every[order], owner[order]
        self.low = np.zeros(1 << 20, bool)  # most absent hashes miss by their first 20 bits
        self.low[(self.sketch >> np.uint64(44)).astype(np.int64)] = True

    def met(self, high: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Where hashes are in a sketch."""
        near = np.flatnonzero(self.low[high])
        return near[self.sketch[np.minimum(np.searchsorted(self.sketch, h[near]), len(self.sketch) - 1)] == h[near]]


def owners_of(every: np.ndarray, owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in ``h``, the owners of equal hashes: places and owners, in line."""
    low, high = np.searchsorted(every, h, "left"), np.searchsorted(every, h, "right")
    n = high - low
    return np.repeat(np.arange(len(h)), n), owner[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


class SketchIndex:
    """One block of distinct items, in partitions by size: ceil(log2(n)) of n shingles in common."""

    def __init__(self, items: list[tuple[tuple, str | None]], threshold: float, k: int):
        self.threshold, self.k = threshold, k
        self.roller = Roller(11)
        ids, texts, words, need = [], [], [], []
        short: dict[int, list[tuple[np.uint64, int]]] = {}
        sized: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, text in items:
            raw, at = buffer_of(pa.array([text or ""], pa.string()))
            starts, ends, _ = words_of(raw, at, NON_WORD)
            if not len(starts):
                continue
            j, size = len(ids), min(k, len(starts))
            ids.append(item_id)
            words.append(size)
            texts.append(frozenset(_shingle_texts(raw, starts, ends, size)))
            hs = np.unique(self.hashes(raw, starts, ends, size))
            need.append(math.ceil(threshold * len(texts[-1]) - 1e-9))
            if size < k:
                short.setdefault(size, []).append((hs[0], j))
            else:
                sized.setdefault(math.ceil(math.log2(max(1, len(hs)))), []).append((j, hs))
        self.ids, self.texts, self.words, self.need = ids, texts, words, np.array(need, np.int64)
        self.short = {n: tuple(np.array(x) for x in zip(*sorted(v), strict=True)) for n, v in short.items()}
        self.partitions = [Partition(sized[n], threshold) for n in sorted(sized)]

    def hashes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
        sums = self.roller.prefixes(word_hashes(self.roller, LOWER[raw], starts, ends))
        first = np.arange(len(starts) - k + 1)
        return self.roller.ranges(sums, first, first + k)

    def search(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, shingles found), verified."""
        starts, ends, first_word = words_of(raw, offsets, NON_WORD)
        n = len(starts)
        row_of = np.searchsorted(offsets, starts, "right") - 1
        sums = self.roller.prefixes(word_hashes(self.roller, LOWER[raw], starts, ends))
        pairs: set[tuple[int, int]] = set()
        for size in {self.k, *self.short}:
            if n < size:
                continue
            first = np.arange(n - size + 1)
            first = first[row_of[first] == row_of[first + size - 1]]
            h = self.roller.ranges(sums, first, first + size)
            if size in self.short:
                place, owner = owners_of(*self.short[size], h)
                pairs.update(zip(row_of[first[place]].tolist(), owner.tolist(), strict=True))
            elif size == self.k:
                high = (h >> np.uint64(44)).astype(np.int64)
                for part in self.partitions:
                    for row in np.unique(row_of[first[part.met(high, h)]]).tolist():
                        at = np.arange(first_word[row], first_word[row + 1] - self.k + 1)
                        _, owner = owners_of(part.every, part.owner, np.unique(self.roller.ranges(sums, at, at + self.k)))
                        which, count = np.unique(owner, return_counts=True)
                        pairs.update((row, j) for j in which[count >= self.need[which]].tolist())
        key, seen = None, set()
        for row, size, j in sorted((row, self.words[j], j) for row, j in pairs):
            if key != (row, size):
                key, a, b, base = (row, size), first_word[row], first_word[row + 1], offsets[row]
                seen = set(_shingle_texts(raw[base : offsets[row + 1]], starts[a:b] - base, ends[a:b] - base, size))
            found = len(self.texts[j] & seen)
            if found >= self.need[j]:
                yield row, j, found


#: 128 bits that stand for an item's text.
ITEM_KEY = ("_h0", "_h1")


def keyed(items: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return items.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text"), F.xxhash64(text).alias(ITEM_KEY[0]), F.xxhash64(F.lit(77), text).alias(ITEM_KEY[1]))


def item_indexes(spark: SparkSession, items: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> Iterator:
    """Broadcast indexes of the distinct items, in blocks of at most BLOCK_ITEMS texts and BLOCK_BYTES (or one longer text)."""
    distinct = items.select(*ITEM_KEY, "text").dropDuplicates(list(ITEM_KEY))
    blocks = 1
    while True:
        number = F.pmod(F.xxhash64(*ITEM_KEY), F.lit(blocks))
        size = distinct.groupBy(number.alias("b")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
        most = size.agg(F.max("n").alias("n"), F.max(F.when(F.col("n") > 1, F.col("bytes"))).alias("bytes")).first()
        if (most["n"] or 0) <= BLOCK_ITEMS and (most["bytes"] or 0) <= BLOCK_BYTES:
            break
        blocks *= 2
    for b in range(blocks):
        rows = bounded_collect(distinct.where(number == b), BLOCK_ITEMS, "items of a block")
        yield spark.sparkContext.broadcast(SketchIndex(sorted(((r[0], r[1]), r["text"]) for r in rows), threshold, k))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """Pairs (doc_id, item_id) whose containment of the item's shingles is ``threshold`` or more.

    ``docs`` has doc_id and text, ``items`` has item_id and text.  Distinct
    items go to the tasks in blocks; each block is one pass over the documents,
    without a shuffle.  What is found joins the ids of equal items.
    """
    items = keyed(items)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in item_indexes(docs.sparkSession, items, threshold, k):

        def find(batches, index=index):
            ix = index.value
            for block in text_blocks(batches):
                raw, offsets = buffer_of(block.column(1))
                found = list(ix.search(raw, offsets))
                if found:
                    row, item, n = zip(*found, strict=True)
                    size = np.array([len(ix.texts[j]) for j in item], np.int32)
                    keys = [pa.array([ix.ids[j][i] for j in item], pa.int64()) for i in range(2)]
                    yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(row)), *keys, pa.array(size), pa.array(n, pa.int32()), pa.array(np.array(n) / size)], names=["doc_id", *ITEM_KEY, "n_shingles", "n_found", "containment"])

        part = source.mapInArrow(find, SCHEMA)
        out = part if out is None else out.unionAll(part)
    ids = items.select("item_id", *ITEM_KEY)
    return out.join(ids, list(ITEM_KEY)).select("doc_id", "item_id", "n_shingles", "n_found", "containment")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item, whatever their ids; other columns kept, no shuffle."""
    at, kept = docs.columns.index("text"), docs
    for index in item_indexes(docs.sparkSession, keyed(items)):

        def clean(batches, index=index):
            for block in text_blocks(batches):
                hit = {row for row, _, _ in index.value.search(*buffer_of(block.column(at).cast(pa.string())))}
                yield block.filter(pa.array([i not in hit for i in range(block.num_rows)], pa.bool_()))

        kept = kept.mapInArrow(clean, docs.schema)
    return kept


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
