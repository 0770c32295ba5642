"""SimHash near-duplicates: tiled exact comparison within a Hamming radius.

Fingerprint: A-Z lower-cased, words between ASCII white space, three-word
shingles with repeats (fewer words: all of them as one shingle; none: zero),
XXH64 with seed 42 of each; a bit is one if it is set in over half of them.

Distinct fingerprints are tiled by the population counts of their eight bytes.
A pair within radius r has count vectors at an L1 distance of at most r, so
only such tiles meet; all other tile pairs are skipped, and no pair within the
radius is lost.  Tiles that meet are compared by exclusive-or and bit counts in
numpy blocks.  A task hands on a spanning forest of the links it finds, never
all of them, so large groups stay linear.  Components come from alternating
large-star and small-star steps over distinct fingerprints.

``drop_near_duplicates`` also links documents whose five-word shingles agree to
0.8 or more, which lie beyond so small a radius (see ``similar_pairs``).

Defined results: null text is empty; rows without words share fingerprint zero
and link like any others; a repeated row gets the same values; null ids count
as no smallest id (a component of null ids alone has null); no rows give none.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_blocks, workspace
from .similar_pairs import Forest, remaining_links, shared_tiles, similar_links, sketches, text_classes, text_hashes

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Rows of one side of a comparison block.
SIDE = 1024


def fingerprint_words(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """The shingle hashes of a document."""
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]]
    h = xxhash.xxh64_intdigest
    return np.array([h(line[s:e], SEED) for s, e in zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)


def bit_majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each group of hashes that begins at ``starts``, the bits set in over half."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = np.diff(np.r_[starts, len(hashes)])
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprints(batches, wide: bool = False):
    for block in text_blocks(batches, 1 << 19):
        hashes = [fingerprint_words((t or "").encode().lower().split()) for t in block.column(1).to_pylist()]
        sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
        out = np.zeros(len(hashes), np.uint64)
        full = sizes > 0
        if full.any():
            out[full] = bit_majority(np.concatenate(hashes), np.r_[0, np.cumsum(sizes[full])[:-1]])
        found = {"doc_id": block.column(0), "fp": pa.array(out.view(np.int64))}
        if wide:
            words, tiles, n = sketches(block.column(1), bit_majority)
            found |= {"h0": block.column(2), "h1": block.column(3), "n": pa.array(n, pa.int64()), "w0": pa.array(words[0].view(np.int64)), "w1": pa.array(words[1].view(np.int64)), "tiles": pa.array(tiles, pa.list_(pa.int64()))}
        yield pa.RecordBatch.from_arrays(list(found.values()), names=list(found))


def fingerprints(docs: DataFrame, wide: bool = False) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; with ``wide`` also what ``similar_links`` compares."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if wide:
        source = source.select("*", *text_hashes(F.coalesce("text", F.lit(""))))
    return source.mapInArrow(lambda parts: _fingerprints(parts, wide), "doc_id long, fp long" + ", h0 long, h1 long, n long, w0 long, w1 long, tiles array<long>" * wide)


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Vectors of eight differences with an L1 norm up to the radius, one of each pair of opposites; zero first."""
    found = [v for v in itertools.product(range(-radius, radius + 1), repeat=8) if sum(map(abs, v)) <= radius]
    return sorted((v for v in found if v >= (0,) * 8), key=lambda v: (sum(map(abs, v)), v))


def tile_keys(fps: np.ndarray) -> np.ndarray:
    """Four bits for each byte's population count: a 64-bit key with room for sums up to 15."""
    counts = np.bitwise_count(fps.view(np.uint8).reshape(-1, 8)).astype(np.int64)
    return (counts << np.arange(0, 32, 4)).sum(1)


def _dealt(radius: int):
    """Every fingerprint goes to its own tile and, as a guest, to each tile ahead of it within the radius."""
    steps = [np.array(v, np.int64) for v in _steps(radius)]

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            counts = np.bitwise_count(fp.view(np.uint8).reshape(-1, 8)).astype(np.int64)
            for k, step in enumerate(steps):
                to = counts + step
                ok = ((to >= 0) & (to <= 8)).all(1)
                key = (to[ok] << np.arange(0, 32, 4)).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[ok]), pa.array(np.full(len(key), k > 0))], names=["tile", "fp", "guest"])

    return deal


def _blocks(own: np.ndarray, guests: np.ndarray, radius: int):
    """Links between own fingerprints, and from guests to own ones; numbers: own first."""
    every = np.concatenate([own, guests])
    for a in range(0, len(own), SIDE):
        left = own[a : a + SIDE]
        for b in range(a, len(every), SIDE):
            right = every[b : b + SIDE]
            near = np.bitwise_count(left[:, None] ^ right[None, :]) <= radius
            x, y = np.nonzero(near)
            x, y = x + a, y + b
            keep = x < y
            if keep.any():
                yield x[keep], y[keep]


def _compared(radius: int):
    def compare(batches):
        """Tiles come sorted, a row at a time over any number of batches."""
        key, own, guests = None, [], []

        def links():
            mine, theirs = np.concatenate(own), np.concatenate(guests)
            if not len(mine) or len(mine) + len(theirs) < 2:
                return None
            every, forest, out = np.concatenate([mine, theirs]), Forest(len(mine) + len(theirs)), []
            for x, y in _blocks(mine, theirs, radius):
                out += [(a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True) if forest.link(a, b)]
            if not out:
                return None
            a, b = np.array(out).T
            return pa.RecordBatch.from_arrays([pa.array(every[a].view(np.int64)), pa.array(every[b].view(np.int64))], names=["u", "v"])

        for batch in batches:
            tile = batch.column(0).to_numpy()
            fp = batch.column(1).to_numpy().view(np.uint64)
            guest = batch.column(2).to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.flatnonzero(np.diff(tile)) + 1, len(tile)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if tile[a] != key:
                    if key is not None and (found := links()) is not None:
                        yield found
                    key, own, guests = tile[a], [], []
                own.append(fp[a:b][~guest[a:b]])
                guests.append(fp[a:b][guest[a:b]])
        if key is not None and (found := links()) is not None:
            yield found

    return compare


def links_within(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that span the components of distinct fingerprints ``fp`` within the radius."""
    dealt = fps.select("fp").mapInArrow(_dealt(radius), "tile long, fp long, guest boolean")
    return dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(_compared(radius), "u long, v long")


def components(links: DataFrame, ws) -> DataFrame:
    """node, root: the smallest node of each node that has a link, by large and small stars.

    Each round is written to the shared folder; rounds grow with the logarithm
    of the longest chain.
    """
    edges = ws.write(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges0")
    k = 0
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v")))
        after = ws.write(small.distinct(), f"edges{k + 1}")
        moved = after.exceptAll(edges).limit(1).count() or edges.exceptAll(after).limit(1).count()
        ws.drop(f"edges{k}")
        edges, k = after, k + 1
        if not moved:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, similar: bool = False) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable), one row for each row of ``docs``.

    ``similar``: documents also link where their shingles agree, at any
    distance; then h0 and h1, which stand for the text, are there as well.
    """
    ws = workspace(docs.sparkSession, "simhash")
    fps = ws.write(fingerprints(docs, similar), "fingerprints")
    classes = ws.write(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    links = links_within(classes, radius)
    if similar:
        met, texts = shared_tiles(ws.write(text_classes(fps), "text_classes"), docs, ws)
        links = links.unionByName(similar_links(met, texts, ws))
    roots = components(links, ws)
    if similar:
        left = remaining_links(met, texts, roots, ws)
        if left.limit(1).count():
            roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(left), workspace(docs.sparkSession, "remaining"))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = ws.write(rooted.join(smallest, "root").select("fp", "component_id"), "components")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id", *["h0", "h1"] * similar)


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component of similar ones, that of the smallest doc_id.

    Rows that repeat a kept doc_id stay with it; rows without a doc_id stay.  A
    row goes by its doc_id and its text, so of one doc_id with several texts
    only those go that are like another document's.
    """
    found = near_duplicates(docs, radius, similar=True)
    gone = found.where("doc_id <> component_id").select("doc_id", "h0", "h1").distinct()
    h0, h1 = text_hashes(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["doc_id"]) & (h0 == gone["h0"]) & (h1 == gone["h1"]), "left_anti")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
