"""Ranked lexical search over an inverted index in shards of documents.

``build_index`` packs blocks of documents into shards, one row each: the
documents in order of doc_id, their lengths, the hashes of the shard's terms in
order, and for each term its postings in order of the documents, gaps and term
frequencies as variable-length integers.  Blocks are cut in the tasks that read
them, so texts are not shuffled, and counts (N, L, document frequencies) are
sums over the index.

``search`` goes through each shard document at a time: a heap holds the next
document of each of an item's postings lists, the lists whose next document
lies in the window at the top of the heap add their scores, and go back into the
heap with their next document after it.  A window is WINDOW places wide, so the
work inside is numpy's.  Each item keeps a heap of its best documents, keyed by
score, then doc_id, over all shards of a task; tasks' heaps are merged in two
steps, by group of tasks, then over all.

Items are searched in groups of about ITEM_BYTES of text, each of which is sent
to the tasks; further groups make further passes over the index.

Terms are compared by 64-bit hashes.  Defined results: a null text has no term;
a document without terms is in no shard; repeated rows are documents each; rows
without doc_id are ranked after all others of their score.  An item_id that
repeats has the terms of all its rows; items without terms, and items whose terms
occur nowhere, give no rows; no documents or no items give none.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, NON_WORD, Roller, buffer_of, read_table, text_blocks, word_hashes, words_of, workspace

TOP = 10
#: Bytes of text of a shard; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20
#: Places of a shard whose scores are summed at once.
WINDOW = 4096
#: Text of the items that are sent to the tasks together.
ITEM_BYTES = 8 << 20
#: Heaps of tasks are merged in so many groups first.
GROUPS = 64
#: Stands for a missing doc_id, behind all others.
NO_ID = (1 << 63) - 1
TERMS = Roller(12)
SHARD = "n_docs long, n_terms long, ids binary, lengths binary, terms binary, dfs binary, ends binary, postings binary"


def encoded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 as variable-length bytes, seven bits each, the low ones first; and the end of each."""
    size = np.ones(len(values), np.int64)
    rest = values >> 7
    while rest.any():
        size += rest > 0
        rest >>= 7
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = ends - size
    for k in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        out[at[own] + k] = (values[own] >> 7 * k & 127) | np.where(size[own] > k + 1, 128, 0)
    return out, ends


def decoded(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 128)
    first = np.r_[0, last[:-1] + 1]
    size = last - first + 1
    out = np.zeros(len(last), np.int64)
    for k in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        out[own] |= (raw[first[own] + k].astype(np.int64) & 127) << 7 * k
    return out


def term_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all terms, and the rows' n + 1 bounds."""
    raw, offsets = buffer_of(text)
    starts, ends, first = words_of(raw, offsets, NON_WORD)
    return word_hashes(TERMS, LOWER[raw], starts, ends), first


def shard_of(ids: np.ndarray, text: pa.Array) -> dict | None:
    """One row of the index."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    h, first = term_hashes(text.take(pa.array(order)))
    n = np.diff(first)
    full = n > 0
    if not full.any():
        return None
    doc = np.repeat(np.cumsum(full) - 1, n)
    by = np.argsort(h, kind="stable")  # documents stay in order
    h, doc = h[by], doc[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.r_[at, len(h)])
    h, doc = h[at], doc[at]
    term = np.ones(len(h), bool)
    term[1:] = h[1:] != h[:-1]
    heads = np.flatnonzero(term)
    gap = np.r_[0, np.diff(doc)]
    gap[heads] = doc[heads]
    raw, ends = encoded(np.stack([gap, tf], 1).ravel())
    dfs = np.diff(np.r_[heads, len(h)])
    return {
        "n_docs": int(full.sum()), "n_terms": int(n.sum()), "ids": ids[full].tobytes(), "lengths": n[full].astype(np.int64).tobytes(),
        "terms": h[heads].tobytes(), "dfs": dfs.astype(np.int64).tobytes(), "ends": ends[2 * (heads + dfs) - 1].tobytes(), "postings": raw.tobytes(),
    }


def _shards(batches):
    names = [x.split()[0] for x in SHARD.split(", ")]
    for block in text_blocks(batches, SHARD_BYTES):
        ids = block.column(0).fill_null(NO_ID).to_numpy()
        if row := shard_of(ids, block.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array([row[x]], pa.int64() if x.startswith("n_") else pa.binary()) for x in names], names=names)


def build_index(docs: DataFrame, ws) -> DataFrame:
    """The index of all documents, a row for each shard, in the workspace."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ws.write(source.mapInArrow(_shards, SHARD), "index")


class Shard:
    """One row of the index, read: the postings lists of the terms asked for."""

    def __init__(self, row: dict, vocabulary: np.ndarray):
        self.ids, self.lengths, terms, dfs, ends = (np.frombuffer(row[x], t) for x, t in (("ids", np.int64), ("lengths", np.int64), ("terms", np.uint64), ("dfs", np.int64), ("ends", np.int64)))
        at = np.searchsorted(terms, vocabulary)
        hit = np.flatnonzero(at < len(terms))
        hit = hit[terms[at[hit]] == vocabulary[hit]]
        self.asked, self.place = hit, at[hit]  # numbers of the vocabulary, and of the shard's terms
        self.dfs, self.ends, self.raw = dfs, ends, np.frombuffer(row["postings"], np.uint8)

    def postings(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents of a term, in order, and its frequencies."""
        begin = self.ends[place - 1] if place else 0
        pairs = decoded(self.raw[begin : self.ends[place]]).reshape(-1, 2)
        return np.cumsum(pairs[:, 0]), pairs[:, 1]


def norms(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of each document: exact, whatever its length."""
    if int(lengths.max(initial=0)) * 90 * n < 1 << 63:
        return 10 + (lengths * (90 * n)) // total
    return np.array([10 + 90 * int(x) * n // total for x in lengths], np.int64)


def scores(tf: np.ndarray, m: np.ndarray, weight: int) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def by_window(lists: list[tuple[np.ndarray, np.ndarray]], window: int = WINDOW):
    """Documents of several postings lists with a summed score: (documents in order, sums), window by window.

    The heap holds the next document of each list.
    """
    heap = [(int(docs[0]), k, 0) for k, (docs, _) in enumerate(lists)]
    heapq.heapify(heap)
    while heap:
        base = heap[0][0]
        sums = np.zeros(window, np.int64)
        while heap and heap[0][0] < base + window:
            _, k, at = heap[0]
            docs, points = lists[k]
            to = len(docs) if docs[-1] < base + window else int(np.searchsorted(docs, base + window))
            sums[docs[at:to] - base] += points[at:to]
            if to < len(docs):
                heapq.heapreplace(heap, (int(docs[to]), k, to))
            else:
                heapq.heappop(heap)
        found = np.flatnonzero(sums)
        yield found + base, sums[found]


class Best:
    """A bounded heap of (score, doc_id): higher scores first, then smaller ids; the worst is on top."""

    def __init__(self, top: int):
        self.top, self.heap = top, []

    def add(self, ids: np.ndarray, points: np.ndarray) -> None:
        if len(self.heap) == self.top:
            keep = points >= self.heap[0][0]
            ids, points = ids[keep], points[keep]
        if len(ids) > self.top:
            order = np.lexsort((ids, -points))[: self.top] if len(ids) <= 4 * self.top else self._first(ids, points)
            ids, points = ids[order], points[order]
        for i, x in zip(ids.tolist(), points.tolist(), strict=True):
            if len(self.heap) < self.top:
                heapq.heappush(self.heap, (x, -i))
            elif (x, -i) > self.heap[0]:
                heapq.heapreplace(self.heap, (x, -i))

    def _first(self, ids: np.ndarray, points: np.ndarray) -> np.ndarray:
        least = np.partition(points, -self.top)[-self.top]
        own = np.flatnonzero(points >= least)
        return own[np.lexsort((ids[own], -points[own]))[: self.top]]


def _frequencies(vocabulary):
    def count(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, vocabulary)
                total[shard.asked] += shard.dfs[shard.place]
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["term", "df"])

    return count


def _searched(vocabulary, weights, items, n, total, top):
    """``items``: for each the numbers of its terms."""

    def run(batches):
        best = [Best(top) for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0], vocabulary)
                m = norms(shard.lengths, n, total)
                lists: list = [None] * len(vocabulary)
                for term, place in zip(shard.asked.tolist(), shard.place.tolist(), strict=True):
                    docs, tf = shard.postings(place)
                    if weights[term] > 0:
                        lists[term] = (docs, scores(tf, m[docs], weights[term]))
                for k, terms in enumerate(items):
                    for docs, points in by_window([lists[t] for t in terms if lists[t] is not None]):
                        best[k].add(shard.ids[docs], points)
        rows = [(k, -i, x) for k, b in enumerate(best) for x, i in b.heap]
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "id", "score"])

    return run


def _search_group(index: DataFrame, texts: dict, n: int, total: int, top: int) -> DataFrame | None:
    """item_id, id, score: the best of each item of one group."""
    spark = index.sparkSession
    h, first = term_hashes(pa.array(list(texts.values()), pa.large_string()))
    vocabulary, number = np.unique(h, return_inverse=True)
    items = [np.unique(number[a:b]).tolist() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    if not len(vocabulary):
        return None
    parts = index.select("ids", "lengths", "terms", "dfs", "ends", F.lit(b"").alias("postings"))
    counted = parts.mapInArrow(_frequencies(vocabulary), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(len(vocabulary), np.int64)
    for r in counted.collect():  # the terms of one group of items
        df[r.term] = r.df
    weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()]
    found = index.select("ids", "lengths", "terms", "dfs", "ends", "postings").mapInArrow(_searched(vocabulary, weights, items, n, total, top), "item int, id long, score long")
    order = [F.desc("score"), F.asc("id")]
    for key in (["item", "part"], ["item"]):
        found = found.withColumn("part", F.spark_partition_id() % GROUPS) if "part" in key else found
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= top)
    names = spark.createDataFrame([(k, i) for k, i in enumerate(texts)], "item int, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "id", "score")  # the ids of one group of items


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` highest-scoring documents with a score above 0."""
    spark = docs.sparkSession
    ws = workspace(spark, "lexical")
    index = build_index(docs, ws)
    counts = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("total")).first()
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    groups = 1 + int((asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES)
    out = []
    for g in range(groups if counts.n else 0):
        texts: dict = {}
        for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect():  # about ITEM_BYTES of text
            texts[r.item_id] = f"{texts[r.item_id]}\n{r.text}" if r.item_id in texts else r.text
        if texts and (found := _search_group(index, texts, counts.n, counts.total, top)) is not None:
            out.append(ws.write(found, f"found{g}"))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.select("item_id", "rank", F.nullif(F.col("id"), F.lit(NO_ID)).alias("doc_id"), "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {lower} AS text FROM documents),
words AS (SELECT r, doc_id, unnest(regexp_extract_all(text, '{term}')) AS term FROM docs),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY r, doc_id, term),
lengths AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({lower}, '{term}')) AS term FROM benchmark),
scored AS (
  SELECT item_id, r, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN lengths USING (r), totals
  GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= {TOP}
"""
