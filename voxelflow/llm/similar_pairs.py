"""Links between documents whose five-word shingles agree to 0.8 or more.

A document that differs from another by a few words has a fingerprint that is
several bits away, so a small radius misses it, and tiles by population count
no longer tell documents apart at a large one.  Here a tile is a band of
min-hashes instead: documents meet where three of their least shingle hashes
agree.  At a similarity of 0.8 two documents share one of ``BANDS`` tiles with
a probability of 0.9998.  Inside a tile, 128-bit SimHashes are compared by
exclusive-or and bit counts, block by block, all with all; each document hands
on its nearest neighbour, its nearest earlier one and its first one within the
radius, so that the links of a tile are linear in its size.  A tile of more than
TILE members is dealt to parts of about that size, and a few leads of the tile
are guests in each part, so that no task holds a whole tile.  Every link is then
verified by the exact Jaccard similarity of the shingle sets.  These links join
nearly all that is alike.  Where a tile still has texts of several components,
all pairs of texts of different components are compared exactly
(``remaining_links``), so that no pair that meets in a tile is left out, parts
or not.  Members of a tile are distinct texts, whatever their ids and fingerprints; links are handed on
between fingerprints, as equal ones have met before.

Words stand between ASCII white space, A-Z lower-cased; a text of fewer words
is one shingle, one without words has no tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, Roller, buffer_of, mixed, text_blocks, word_hashes, words_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
#: Of 128 bits; the mean distance at a similarity of 0.8 is 19, its standard deviation 4.
RADIUS = 31
SIDE = 1024
#: Members of a tile that are compared in one task; larger tiles make several parts, with as many leads as guests of each.
TILE, LEADS = 4096, 8
#: Shingles of one side of a cell, in which all pairs are compared exactly; larger tiles make several cells.
CELL = 1 << 19
#: What a text does in a cell: bits of ``side``.
ASKS, IS_ASKED = 1, 2
ROLLER = Roller(31)
_SEEDS = np.random.default_rng(77).integers(0, 1 << 64, BANDS * ROWS + BANDS + 2, dtype=np.uint64) | np.uint64(1)
PERMUTE, BAND_SALT, WIDE_SALT = _SEEDS[: BANDS * ROWS], _SEEDS[BANDS * ROWS : -2], _SEEDS[-2:]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted in each row, and the rows' n + 1 bounds."""
    starts, ends, first = words_of(raw, offsets, SPACE)
    sums = ROLLER.prefixes(word_hashes(ROLLER, LOWER[raw], starts, ends))
    words = np.diff(first)
    n = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(len(words)), n)
    begin = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    h = ROLLER.ranges(sums, begin, np.minimum(begin + k, first[1:][row]))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(words) + 1))


def sketches(text: pa.Array, majority) -> tuple[np.ndarray, list, np.ndarray]:
    """Two 64-bit words of each row's wide SimHash, its tiles (none without words) and its number of shingles."""
    h, bounds = shingle_sets(*buffer_of(text))
    full = np.flatnonzero(np.diff(bounds))
    wide = np.zeros((2, len(bounds) - 1), np.uint64)
    tiles: list = [[]] * (len(bounds) - 1)
    if len(full):
        starts = bounds[full]
        for i, salt in enumerate(WIDE_SALT):
            wide[i, full] = majority(mixed(h ^ salt), starts)
        least = np.stack([np.minimum.reduceat(h * p, starts) for p in PERMUTE]).reshape(BANDS, ROWS, -1)
        band = BAND_SALT[:, None].repeat(len(full), 1)
        for i in range(ROWS):
            band = mixed(band * np.uint64(0x9E3779B97F4A7C15) + least[:, i])
        for r, t in zip(full.tolist(), band.T.copy().view(np.int64), strict=True):
            tiles[r] = t
    return wide, tiles, np.diff(bounds)


def nearest(wide: np.ndarray, radius: int) -> np.ndarray:
    """Rows (a, b) of links inside a tile whose members are in order; ``wide`` has two words each."""
    m = wide.shape[1]
    at = np.arange(m)
    best, least = np.full(m, -1), np.full(m, 255)  # nearest of all
    before, near = np.full(m, -1), np.full(m, 255)  # nearest earlier one
    head = np.full(m, -1)  # first within the radius
    for a in range(0, m, SIDE):
        left = wide[:, a : a + SIDE, None]
        rows = at[a : a + SIDE]
        for b in range(0, m, SIDE):
            right = wide[:, None, b : b + SIDE]
            d = (np.bitwise_count(left[0] ^ right[0]) + np.bitwise_count(left[1] ^ right[1])).astype(np.int16)
            if a == b:
                np.fill_diagonal(d, 255)
            j = d.argmin(1)
            v = d[np.arange(len(rows)), j]
            better = v < least[rows]
            best[rows[better]], least[rows[better]] = j[better] + b, v[better]
            if b <= a:
                hit = d <= radius
                first = hit.argmax(1)
                found = hit.any(1) & (head[rows] < 0) & (first + b < rows)
                head[rows[found]] = first[found] + b
                if a == b:
                    d[np.triu_indices(len(rows))] = 255
                    j = d.argmin(1)
                    v = d[np.arange(len(rows)), j]
                better = v < near[rows]
                before[rows[better]], near[rows[better]] = j[better] + b, v[better]
    parts = [np.stack([at[ok], to[ok]]) for to, ok in ((best, least <= radius), (before, near <= radius), (head, head >= 0))]
    links = np.concatenate(parts, axis=1)
    return np.unique(np.sort(links, axis=0), axis=1)


def _compared(radius: int):
    def compare(batches):
        """Parts of tiles come sorted, a row at a time over any number of batches."""
        key, tids, wides = None, [], []

        def links():
            tid, wide = np.concatenate(tids), np.concatenate(wides, axis=1)
            a, b = nearest(wide, radius)
            return pa.RecordBatch.from_arrays([pa.array(tid[a]), pa.array(tid[b])], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tile, part, tid = (batch.column(i).to_numpy() for i in range(3))
            wide = np.stack([batch.column(3).to_numpy(), batch.column(4).to_numpy()]).view(np.uint64)
            cuts = np.r_[0, np.flatnonzero((tile[1:] != tile[:-1]) | (part[1:] != part[:-1])) + 1, len(tile)]
            size = np.diff(cuts)
            alone = size == 1
            alone[[0, -1]] = False  # their tiles may go on in another batch
            for i in np.flatnonzero(~alone).tolist():
                a, b = cuts[i], cuts[i + 1]
                if (tile[a], part[a]) != key:
                    if sum(map(len, tids)) > 1:
                        yield links()
                    key, tids, wides = (tile[a], part[a]), [], []
                tids.append(tid[a:b])
                wides.append(wide[:, a:b])
        if sum(map(len, tids)) > 1:
            yield links()

    return compare


def _verified(similarity: float):
    def verify(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                (x, bx), (y, by) = (shingle_sets(*buffer_of(part.column(i))) for i in (2, 3))
                for r in range(part.num_rows):
                    p, q = x[bx[r] : bx[r + 1]], y[by[r] : by[r + 1]]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep[a + r] = both >= similarity * (len(p) + len(q) - both) - 1e-9
            out = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1)], names=["u", "v"])

    return verify


def text_hashes(text) -> tuple:
    """128 bits that stand for a text, as two longs."""
    return F.xxhash64(text).alias("h0"), F.xxhash64(F.lit(77), text).alias("h1")


def text_classes(fps: DataFrame) -> DataFrame:
    """A row for each distinct text, numbered by ``tid``; write it once, as the numbers follow the run."""
    same = [F.first(x).alias(x) for x in ("fp", "w0", "w1", "n", "tiles")]  # all follow from the text
    return fps.groupBy("h0", "h1").agg(F.min("doc_id").alias("first_id"), *same).withColumn("tid", F.monotonically_increasing_id())


def shared_tiles(classes: DataFrame, docs: DataFrame, ws) -> tuple[DataFrame, DataFrame]:
    """Members of the tiles where distinct texts meet, and a text for each ``tid`` among them."""
    tiled = classes.select(F.explode("tiles").alias("tile"), "tid", "fp", "w0", "w1", "n")
    several = tiled.groupBy("tile").count().where("count > 1").select("tile", F.ceil(F.col("count") / TILE).cast("int").alias("parts"))
    met = ws.write(tiled.join(several, "tile"), "met")
    known = lambda x: F.coalesce(x, F.lit(-(1 << 63)))
    ids = classes.join(met.select("tid").distinct(), "tid").select("tid", "fp", "h0", "h1", known(F.col("first_id")).alias("first_id"))
    source = docs.select(known(F.col("doc_id").cast("long")).alias("first_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    source = source.select("first_id", "text", *text_hashes(F.col("text")))
    texts = source.join(ids, ["first_id", "h0", "h1"]).groupBy("tid", "fp").agg(F.min("text").alias("text"))
    return met, ws.write(texts, "texts")


def similar_links(met: DataFrame, texts: DataFrame, ws, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Verified links (u, v) between the fingerprints of near texts, linear in the size of each tile."""
    own = F.expr("int(pmod(xxhash64(tid), parts))")
    members = met.select("tile", own.alias("part"), "tid", "w0", "w1")
    slot = F.pmod(F.xxhash64(F.lit(LEADS), "tid"), F.lit(LEADS)).alias("slot")
    leads = met.where("parts > 1").groupBy("tile", slot).agg(F.min(F.struct("tid", "w0", "w1", "parts")).alias("lead")).select("tile", "lead.*")
    guests = leads.select("tile", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "tid", "w0", "w1", own.alias("own")).where("part <> own").drop("own")
    dealt = members.unionByName(guests).repartition("tile", "part").sortWithinPartitions("tile", "part", "tid")
    links = ws.write(dealt.mapInArrow(_compared(radius), "u long, v long").where("u <> v").distinct(), "near")
    one, two = (texts.select(F.col("tid").alias(t), F.col("fp").alias(f), F.col("text").alias(x)) for t, f, x in (("u", "fu", "a"), ("v", "fv", "b")))
    pairs = links.join(one, "u").join(two, "v")
    return pairs.select("fu", "fv", "a", "b").mapInArrow(_verified(similarity), "u long, v long")


class Forest:
    """Union-find over the fingerprints of a tile, by their numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def exact_links(h: np.ndarray, bounds: np.ndarray, roots: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that span the components of roots; all sets of ``left`` are compared with all of ``right``."""
    sizes = np.diff(bounds)
    m = len(sizes)
    _, code, count = np.unique(h, return_inverse=True, return_counts=True)
    holders = np.repeat(np.arange(m), sizes)[np.argsort(code, kind="stable")]
    first = np.cumsum(count) - count
    names, number = np.unique(roots, return_inverse=True)
    forest, out = Forest(len(names)), []
    for a in np.flatnonzero(left).tolist():
        c = code[bounds[a] : bounds[a + 1]]
        c = c[count[c] > 1]
        n = count[c]
        at = np.repeat(first[c], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        both = np.bincount(holders[at], minlength=m)
        near = right & (both >= similarity * (sizes[a] + sizes - both) - 1e-9) & (number != number[a])
        for b in np.flatnonzero(near).tolist():
            if forest.link(int(number[a]), int(number[b])):
                out.append((int(roots[a]), int(roots[b])))
    return out


def _compared_exactly(similarity: float):
    def compare(batches):
        """Cells come sorted, over any number of batches."""
        key, sets, sizes, sides, roots = None, [], [], [], []

        def links():
            bounds, side = np.r_[0, np.cumsum(np.concatenate(sizes))], np.concatenate(sides)
            found = exact_links(np.concatenate(sets), bounds, np.concatenate(roots), side & ASKS > 0, side & IS_ASKED > 0, similarity)
            u, v = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            for block in text_blocks([batch]):
                columns = [block.column(i).to_numpy() for i in range(5)]
                h, bounds = shingle_sets(*buffer_of(block.column(5)))
                cell = np.stack(columns[:3])
                cuts = np.r_[0, np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(0)) + 1, block.num_rows]
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if (now := tuple(cell[:, a].tolist())) != key:
                        if key is not None:
                            yield links()
                        key, sets, sizes, sides, roots = now, [], [], [], []
                    sets.append(h[bounds[a] : bounds[b]])
                    sizes.append(np.diff(bounds[a : b + 1]))
                    sides.append(columns[3][a:b])
                    roots.append(columns[4][a:b])
        if key is not None:
            yield links()

    return compare


def remaining_links(met: DataFrame, texts: DataFrame, roots: DataFrame, ws, similarity: float = SIMILARITY) -> DataFrame:
    """Links (u, v) between the ``roots`` of fingerprints: every pair of texts of a tile that lie under different roots is verified.

    Texts under the largest root of a tile are only asked, all others also ask.
    Both are dealt to groups of about CELL shingles, and a group that asks makes
    a cell with each group that is asked, so that no task holds more than two
    groups, and a tile that is nearly one component is sent about once.
    """
    rooted = met.join(roots, met["fp"] == roots["node"], "left").select("tile", "tid", "n", F.coalesce("root", "fp").alias("root"))
    sizes = rooted.groupBy("tile", "root").agg(F.sum("n").alias("n"))
    tiles = sizes.groupBy("tile").agg(F.count("*").alias("several"), F.sum("n").alias("total"), F.max(F.struct("n", "root")).alias("most")).where("several > 1")
    groups = lambda n: F.greatest(F.lit(1), F.ceil(n / CELL).cast("int"))
    plan = tiles.select("tile", F.col("most.root").alias("largest"), groups(F.col("total") - F.col("most.n")).alias("asking"), groups(F.col("total")).alias("asked"))
    members = rooted.join(plan, "tile").withColumns({"asks": F.col("root") != F.col("largest"), "h": F.xxhash64("tid")})
    place = lambda n: F.expr(f"int(pmod(h, {n}))")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    whole, split = members.where("asked = 1"), members.where("asked > 1")
    cells = [
        whole.select("tile", F.lit(0).alias("one"), F.lit(0).alias("two"), F.when(F.col("asks"), ASKS | IS_ASKED).otherwise(IS_ASKED).alias("side"), "root", "tid"),
        split.select("tile", every("asking").alias("one"), place("asked").alias("two"), F.lit(IS_ASKED).alias("side"), "root", "tid"),
        split.where("asks").select("tile", place("asking").alias("one"), every("asked").alias("two"), F.lit(ASKS).alias("side"), "root", "tid"),
    ]
    members = cells[0].unionByName(cells[1]).unionByName(cells[2])
    members = members.join(texts.select("tid", "text"), "tid").select("tile", "one", "two", "side", "root", "text")
    dealt = members.repartition("tile", "one", "two").sortWithinPartitions("tile", "one", "two")
    return ws.write(dealt.mapInArrow(_compared_exactly(similarity), "u long, v long").distinct(), "remaining")
