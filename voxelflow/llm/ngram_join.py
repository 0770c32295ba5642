"""N-gram Jaccard join: sets of four-word shingles that agree to 0.85 or more, by vertical partitioning.

The shingles' 64-bit hashes are their global order, and the order is cut into
fragments.  Two sets of similarity t differ in a number of shingles that is
bounded by their sizes, and each difference lies in one fragment.  So with more
fragments than differences some fragment is identical in both, and sets that
agree nowhere are never compared.  Then overlaps are counted fragment by
fragment and summed for each pair, which decides it exactly.

* Sizes are cut into levels, each half again as large as the one before.  A level
  has a scheme for pairs inside it, and one for pairs across its upper end; a
  scheme has some fragments beyond its bound on differences.  A set makes a key
  of each fragment that is not empty.  A set whose full fragments are no more
  than its differences from a partner can be also makes a key of each shingle of
  its prefix (as many as must hold a common one), under a key space of its own: a
  pair whose identical fragments are all empty has two such sets.  All other
  linked sets share several keys, so each leaves out its most frequent ones, as
  many as it can do without.  No pair is lost.
* Equal sets are one class, so copies cost nothing further.
* Keys that occur once cannot link.  Blocks of keys are dealt to buckets by
  range, each key once for a block, and each block gets back those that occur
  again; neither a hot key nor a large group is gathered in one task.
* Sets that share a key are first compared with one lead of the key, then, where
  they lie in other components, with a lead that each key picks anew, and at
  last, where a key's sets still lie in several components, across them, in
  cells of bounded size.  Sets that are alike already are compared no more.
* A pair is handed on to be counted only if its sizes and its parities allow a
  link: 512 bits, of which each shingle turns one over, so that sets differ in at
  least as many shingles as bits.

Words stand between ASCII white space, A-Z lower-cased; a text of fewer words is
one shingle.

Defined results: null text is empty; a document without words has no shingles
and links with nothing, its component is its own doc_id; a repeated row gets the
same values; null ids count as no smallest id (a component of null ids alone has
null); no rows give none.  Shingles are compared by 64-bit hashes, sets by 128
bits.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACE, Roller, buffer_of, mixed, read_table, text_blocks, word_hashes, words_of, workspace
from .simhash import components

SHINGLE = 4
#: Sets link where PERCENT[1] * intersection >= PERCENT[0] * union.
PERCENT = (85, 100)
#: Sets below this size link with no other set.
LEAST = 6
#: Fragments by which overlaps are counted.
FRAGMENTS = 4
#: A scheme has one more fragment for so many differences, which lets a set leave out as many keys.
SPARE = 6
#: Kinds of keys: of fragments inside a level and across levels, and of single shingles.
INSIDE, ACROSS, PREFIX = 0, 1, 2
#: Words of a set's parities.
BITS = [f"w{k}" for k in range(8)]
#: Members of one side of a cell, in which sets of one key are compared.
CELL = 2048
#: What a set does in a cell: bits of ``side``.
ASKS, IS_ASKED = 1, 2
#: Keys of a block, and of a bucket.
BLOCK, BUCKET = 1 << 18, 1 << 20
#: Stands for a missing doc_id.
NO_ID = -(1 << 63)
ROLLER = Roller(13)
SALT, ODD = np.random.default_rng(85).integers(0, 1 << 64, 2, dtype=np.uint64)


def needed(a: int, b: int) -> int:
    """The least intersection of linked sets of these sizes."""
    p, q = PERCENT
    return -(-p * (a + b) // (p + q))


def differences(most: int) -> int:
    """The most elements in which linked sets of ``most`` elements together, or fewer, differ."""
    return max(s - 2 * needed(s, 0) for s in range(max(2, most - 2 * sum(PERCENT)), most + 1))


@functools.cache
def level_starts(most: int, count: int = 0) -> list[int]:
    """The smallest sizes of the levels up to a size, and one more; ``count`` of them at least."""
    starts = [LEAST]
    while starts[-1] <= most or len(starts) < count:
        starts.append(starts[-1] + max(1, starts[-1] // 2))
    return starts


@functools.cache
def scheme(level: int, across: bool) -> int:
    """Fragments for pairs inside a level, or across its upper end."""
    low, up = level_starts(LEAST, level + 2)[level : level + 2]
    d = differences(up - 1 + _partner(up - 1) if across else 2 * (up - 1))
    empty = (d + 1) * math.exp(-(-(-up * PERCENT[0] // PERCENT[1]) if across else low) / (d + 1))
    return d + 1 + math.ceil(empty + 2 * math.sqrt(empty)) + d // SPARE


def _partner(n: int) -> int:
    """The largest set that can link with one of size n."""
    return n * PERCENT[1] // PERCENT[0]


@functools.cache
def schemes_of(n: int) -> list[tuple[int, int, int, int]]:
    """(kind, number, fragments, the most differences from a partner) of the schemes that a set of size n takes part in."""
    if n < LEAST:
        return []
    starts = level_starts(n)
    level = bisect.bisect_right(starts, n) - 1
    low, up = starts[level : level + 2]
    found = [(INSIDE, 2 * level, scheme(level, False), differences(n + min(up - 1, _partner(n))))]
    if level and n <= _partner(low - 1):
        found.append((ACROSS, 2 * level - 1, scheme(level - 1, True), differences(n + low - 1)))
    if _partner(n) >= up:
        found.append((ACROSS, 2 * level + 1, scheme(level, True), differences(n + _partner(n))))
    return found


def shingle_sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted in each row, and the rows' n + 1 bounds."""
    raw, offsets = buffer_of(text)
    starts, ends, first = words_of(raw, offsets, SPACE)
    sums = ROLLER.prefixes(word_hashes(ROLLER, LOWER[raw], starts, ends))
    begin = np.arange(len(starts))
    end = np.minimum(begin + SHINGLE, np.repeat(first[1:], np.diff(first)))
    keep = (end - begin == SHINGLE) | (begin == np.repeat(first[:-1], np.diff(first)))  # whole ones, and the first
    h = ROLLER.ranges(sums, begin[keep], end[keep])
    words = np.diff(first)
    bounds = np.r_[0, np.cumsum(np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1)))]
    for a, b in itertools.pairwise(bounds.tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    return h[new], np.r_[0, np.cumsum(new)][bounds]


def keys_of(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of the sets, set by set, the sets' n + 1 bounds, and how many keys of each kind a set may leave out.

    A key's last two bits are its kind.
    """
    sizes = np.diff(bounds)
    left = np.zeros((2, len(sizes)), np.int64)
    part = [(r, *s) for r, n in enumerate(sizes.tolist()) for s in schemes_of(n)]
    if not part:
        return np.zeros(0, np.uint64), np.zeros(len(sizes) + 1, np.int64), left
    spread = mixed(h ^ SALT)
    row, kind, number, count, apart = np.array(part, np.int64).T
    size = sizes[row]
    which = np.repeat(np.arange(len(row)), size)
    at = bounds[row][which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    fragment = ((h[at] >> np.uint64(32)) * count[which].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (fragment[1:] != fragment[:-1]) | (which[1:] != which[:-1])
    heads = np.flatnonzero(new)
    of = which[heads]
    keys = mixed(np.add.reduceat(spread[at], heads) ^ mixed((number[of].astype(np.uint64) << np.uint64(40)) + fragment[heads].astype(np.uint64)))
    keys = keys & ~np.uint64(3) | kind[of].astype(np.uint64)
    shared = np.bincount(of, minlength=len(row)) - apart  # full fragments that a partner has as well, at least
    left[kind, row] = np.maximum(shared - 1, 0)
    more, owners = [], []
    for p in np.flatnonzero(shared < 1).tolist():
        n, a = int(size[p]), int(bounds[row[p]])
        prefix = h[a : a + n - -(-n * PERCENT[0] // PERCENT[1]) + 1]
        more.append(mixed(mixed(prefix ^ ODD) + np.uint64(number[p])) & ~np.uint64(3) | np.uint64(PREFIX))
        owners.append(np.full(len(prefix), row[p]))
    keys, owner = np.concatenate([keys, *more]), np.concatenate([row[of], *owners])
    order = np.argsort(owner, kind="stable")
    return keys[order], np.searchsorted(owner[order], np.arange(len(sizes) + 1)), left


def parities(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each of the words of BITS, whether odd numbers of each set's shingles fall on its bits.

    One shingle more or less changes one bit, so sets differ in as many
    shingles as bits, at least.
    """
    out = np.zeros((len(BITS), len(bounds) - 1), np.int64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        bit = np.uint64(1) << (h & np.uint64(63))
        word = h >> np.uint64(6) & np.uint64(len(BITS) - 1)
        for k in range(len(BITS)):
            out[k, full] = np.bitwise_xor.reduceat(np.where(word == np.uint64(k), bit, np.uint64(0)), bounds[full]).view(np.int64)
    return out


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _sets(batches):
    for block in text_blocks(batches):
        h, bounds = shingle_sets(block.column(2))
        keys, ends, left = keys_of(h, bounds)
        full = np.flatnonzero(np.diff(bounds))
        sums = np.zeros((2, block.num_rows), np.uint64)
        for k, salt in enumerate((SALT, ODD)):
            sums[k, full] = np.add.reduceat(mixed(h ^ salt), bounds[full]) if len(full) else 0
        columns = [block.column(0), block.column(1), pa.array(np.diff(bounds)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), *map(pa.array, left), *map(pa.array, parities(h, bounds)), _lists(keys, ends)]
        yield pa.RecordBatch.from_arrays(columns, names=SETS.replace(" long", "").replace(" array<long>", "").split(", "))


SETS = f"doc_id long, t0 long, n long, h0 long, h1 long, inside long, across long, {', '.join(f'{w} long' for w in BITS)}, keys array<long>"


def _source(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t0"), text.alias("text"))


def _blocked(batches):
    """Rows of sets in blocks of about BLOCK keys; a block's number is its first set's."""
    tids, counts, keys, held = [], [], [], 0

    def block():
        return pa.RecordBatch.from_arrays([pa.array([int(tids[0][0])]), *[pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in (tids, counts, keys)]], names=["block", "tids", "counts", "keys"])

    for batch in batches:
        lists = batch.column(1)
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        every = lists.flatten().to_numpy()
        tid = batch.column(0).to_numpy()
        ends = np.cumsum(sizes)
        a = 0
        while a < len(sizes):
            base = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, base + BLOCK - held, "right")))
            tids.append(tid[a:b])
            counts.append(sizes[a:b])
            keys.append(every[base : ends[b - 1]])
            held += int(ends[b - 1]) - base
            a = b
            if held >= BLOCK or a < len(sizes):
                yield block()
                tids, counts, keys, held = [], [], [], 0
    if tids:
        yield block()


def _dealt(buckets: int):
    """Each key of a block once, or twice if it occurs more than once, to its bucket."""

    def deal(batches):
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, count = np.unique(np.frombuffer(raw.as_buffer(), np.uint64), return_counts=True)
                keys = np.repeat(keys, np.minimum(count, 2))
                bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.r_[cuts[1:], len(keys)].tolist()
                rows = [keys[a:b].tobytes() for a, b in zip(cuts.tolist(), ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array([number] * len(rows), pa.int64()), pa.array(rows, pa.binary())], names=["bucket", "block", "keys"])

    return deal


def _again(batches):
    """For each block of a bucket its keys that occur again; buckets come sorted, over any number of batches."""
    bucket, blocks, parts = None, [], []

    def found():
        every = np.sort(np.concatenate(parts))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        for number, keys in zip(blocks, parts, strict=True):
            own = np.unique(keys[np.isin(keys, twice)])
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["block", "again"])

    for batch in batches:
        for b, number, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if b != bucket:
                if parts:
                    yield from found()
                bucket, blocks, parts = b, [], []
            blocks.append(number)
            parts.append(np.frombuffer(raw.as_py(), np.uint64))
    if parts:
        yield from found()


def _matched(batches):
    for batch in batches:
        for tids, counts, keys, again in zip(*(batch.column(i) for i in range(4)), strict=True):
            tid, count, key = np.frombuffer(tids.as_py(), np.int64), np.frombuffer(counts.as_py(), np.int64), np.frombuffer(keys.as_py(), np.uint64)
            hit = np.isin(key, np.frombuffer(b"".join(again.as_py()), np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key[hit].view(np.int64)), pa.array(np.repeat(tid, count)[hit])], names=["key", "tid"])


def shared_keys(classes: DataFrame, ws) -> DataFrame:
    """(key, tid) of every key that several sets have."""
    blocks = ws.write(classes.where(F.size("keys") > 0).select("tid", "keys").mapInArrow(_blocked, "block long, tids binary, counts binary, keys binary"), "blocks")
    total = blocks.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    dealt = blocks.select("block", "keys").mapInArrow(_dealt(1 + total // (8 * BUCKET)), "bucket long, block long, keys binary")
    again = ws.write(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_again, "block long, again binary"), "again")
    back = again.groupBy("block").agg(F.collect_list("again").alias("again"))  # no more than the block itself
    met = ws.write(blocks.join(back, "block").select("tids", "counts", "keys", "again").mapInArrow(_matched, "key long, tid long"), "met")
    ws.drop("blocks")
    ws.drop("again")
    return met


def rare_keys(met: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, tid, n) without the most frequent keys of each set, as many as it may leave out, and without keys of one set.

    Linked sets share more full fragments than either may leave out, so in the
    common order of the keys by frequency they share one that both keep.
    """
    counts = met.groupBy("key").agg(F.count("*").alias("sets"))
    kind = F.col("key").bitwiseAND(F.lit(3))
    known = met.join(counts, "key").join(classes.select("tid", "n", "inside", "across"), "tid")
    rank = F.row_number().over(Window.partitionBy("tid", kind).orderBy(F.desc("sets"), F.desc("key")))
    left = F.when(kind == INSIDE, F.col("inside")).when(kind == ACROSS, F.col("across")).otherwise(0)
    return known.withColumn("rank", rank).where(F.col("rank") > left).select("key", "tid", "n")


def _fragmented(batches):
    for block in text_blocks(batches):
        h, bounds = shingle_sets(block.column(1))
        row = np.repeat(np.arange(block.num_rows), np.diff(bounds))
        fragment = ((h >> np.uint64(32)) * np.uint64(FRAGMENTS) >> np.uint64(32)).astype(np.int64)
        heads = np.flatnonzero(np.diff(row * FRAGMENTS + fragment, prepend=-1))
        tid = block.column(0).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(tid[row[heads]]), pa.array(fragment[heads].astype(np.int32)), _lists(h, np.r_[heads, len(h)])], names=["tid", "fragment", "part"])


def fragments(docs: DataFrame, classes: DataFrame, met: DataFrame, ws) -> DataFrame:
    """tid, fragment and the shingles there, of each set that shares a key."""
    known = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    own = classes.join(met.select("tid").distinct(), "tid", "left_semi").select("tid", "first.*")
    texts = _source(docs).select(known.alias("id"), "t0", "text").join(own, ["id", "t0"]).groupBy("id", "t0", "tid").agg(F.first("text").alias("text"))
    return ws.write(texts.select("tid", "text").mapInArrow(_fragmented, "tid long, fragment int, part array<long>"), "fragments")


def linked(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b, of sizes na, nb) that link: overlaps are counted in each fragment and summed."""
    one, two = (parts.select(F.col("tid").alias(t), "fragment", F.col("part").alias(p)) for t, p in (("a", "pa"), ("b", "pb")))
    counted = pairs.join(one, "a").join(two, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).cast("long").alias("both"))
    summed = counted.groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both"))
    return summed.where(F.col("both") * PERCENT[1] >= (F.col("na") + F.col("nb") - F.col("both")) * PERCENT[0]).select("a", "b")


def _compared(batches):
    """Cells come sorted, over any number of batches: pairs of different components that may link."""
    key, held = None, []

    def pairs():
        x = np.concatenate(held, axis=1)
        side, root, tid, n, bits = x[0], x[1], x[2], x[3], x[4:].view(np.uint64)
        right = np.flatnonzero(side & IS_ASKED)
        left = np.flatnonzero(side & ASKS)
        for a in range(0, len(left), 256):
            own = left[a : a + 256]
            apart = sum(np.bitwise_count(w[own][:, None] ^ w[right][None, :]).astype(np.int16) for w in bits)
            both = n[own][:, None] + n[right][None, :]
            open_ = (apart <= most_apart(both)) & (root[own][:, None] != root[right][None, :]) & (n[own][:, None] * PERCENT[1] >= n[right][None, :] * PERCENT[0]) & (n[right][None, :] * PERCENT[1] >= n[own][:, None] * PERCENT[0])
            i, j = np.nonzero(open_)
            if len(i):
                i, j = own[i], right[j]
                swap = tid[i] > tid[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                yield pa.RecordBatch.from_arrays([pa.array(y) for y in (tid[i], tid[j], n[i], n[j])], names=["a", "b", "na", "nb"])

    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.stack([c.to_numpy() for c in batch.columns])
        cuts = np.r_[0, np.flatnonzero((x[:3, 1:] != x[:3, :-1]).any(0)) + 1, x.shape[1]]
        for a, b in itertools.pairwise(cuts.tolist()):
            if (now := tuple(x[:3, a].tolist())) != key:
                if held:
                    yield from pairs()
                key, held = now, []
            held.append(x[3:, a:b])
    if held:
        yield from pairs()


def most_apart(both):
    """The most shingles in which linked sets of so many together differ; columns or numpy."""
    p, q = PERCENT
    return both - 2 * ((p * both + p + q - 1) // (p + q))


def cells(rooted: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) of sets of one key that lie in different components and may link.

    Sets of a key's largest component are only asked, all others also ask; both
    are dealt to parts of about CELL, and each part that asks makes a cell with
    each part that is asked.
    """
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("sets"))
    several = sizes.groupBy("key").agg(F.count("*").alias("roots"), F.sum("sets").alias("sets"), F.max(F.struct("sets", "root")).alias("most")).where("roots > 1")
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / CELL).cast("long"))
    plan = several.select("key", F.col("most.root").alias("largest"), parts(F.col("sets") - F.col("most.sets")).alias("asking"), parts(F.col("sets")).alias("asked"))
    members = rooted.join(plan, "key").withColumns({"asks": F.col("root") != F.col("largest"), "h": F.xxhash64("tid")})
    place = lambda n: F.expr(f"pmod(h, {n})")
    every = lambda n: F.explode(F.expr(f"sequence(0L, {n} - 1)"))
    rest = ["root", "tid", "n", *BITS]
    whole, split = members.where("asked = 1"), members.where("asked > 1")
    dealt = whole.select("key", F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"), F.when(F.col("asks"), ASKS | IS_ASKED).otherwise(IS_ASKED).cast("long").alias("side"), *rest)
    dealt = dealt.unionByName(split.select("key", every("asking").alias("one"), place("asked").alias("two"), F.lit(IS_ASKED).cast("long").alias("side"), *rest))
    dealt = dealt.unionByName(split.where("asks").select("key", place("asking").alias("one"), every("asked").alias("two"), F.lit(ASKS).cast("long").alias("side"), *rest))
    return dealt.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two").mapInArrow(_compared, "a long, b long, na long, nb long").distinct()


def stars(rooted: DataFrame, place) -> DataFrame:
    """Pairs (a, b, na, nb) of each set with its keys' leads, those of the least ``place``, if they may link."""
    lead = F.min(F.struct(place.alias("place"), F.col("tid").alias("u"), F.col("n").alias("nu"), F.col("root").alias("ru"), *[F.col(w).alias(f"l{w}") for w in BITS]))
    met = rooted.join(rooted.groupBy("key").agg(lead.alias("lead")).select("key", "lead.*"), "key")
    p, q = PERCENT
    apart = " + ".join(f"bit_count({w} ^ l{w})" for w in BITS)
    both = "(n + nu)"
    met = met.where(f"root <> ru and least(n, nu) * {q} >= greatest(n, nu) * {p} and {apart} <= {both} - 2 * (({p} * {both} + {p + q - 1}) div {p + q})")
    return met.selectExpr("least(tid, u) as a", "greatest(tid, u) as b", "if(tid < u, n, nu) as na", "if(tid < u, nu, n) as nb").distinct()


def class_links(met: DataFrame, parts: DataFrame, ws) -> DataFrame:
    """node, root: for each set that links, the smallest number of its component.  ``met``: key, tid, n, parities."""
    rooted, roots = met.withColumn("root", F.col("tid")), None
    for k, place in enumerate((F.xxhash64("tid"), F.xxhash64("tid", "key"))):
        rooted, roots = _rooted(met, linked(ws.write(stars(rooted, place), f"stars{k}"), parts), roots, ws)
    return _rooted(met, linked(ws.write(cells(rooted), "across"), parts), roots, ws)[1]


def _rooted(met: DataFrame, links: DataFrame, roots: DataFrame | None, ws) -> tuple[DataFrame, DataFrame]:
    links = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if roots is not None:
        links = links.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
    roots = components(links, workspace(met.sparkSession, "ngram_links"))
    return met.join(roots, met["tid"] == roots["node"], "left").select("key", "tid", "n", *BITS, F.coalesce("root", "tid").alias("root")), roots


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable), one row for each row of ``docs``."""
    ws = workspace(docs.sparkSession, "ngram_join")
    sets = ws.write(_source(docs).mapInArrow(_sets, SETS), "sets")
    known = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    same = sets.where("n > 0").groupBy("h0", "h1").agg(F.min("doc_id").alias("first_id"), F.min(F.struct(known.alias("id"), "t0")).alias("first"), *[F.first(c).alias(c) for c in ("n", "inside", "across", *BITS, "keys")])
    classes = ws.write(same.withColumn("tid", F.monotonically_increasing_id()), "classes")
    kept = ws.write(rare_keys(shared_keys(classes, ws), classes), "kept")
    ws.drop("met")
    several = kept.groupBy("key").count().where("count > 1").select("key")
    met = ws.write(kept.join(several, "key").join(classes.select("tid", *BITS), "tid"), "members")
    roots = class_links(met, fragments(docs, classes, met, ws), ws)
    rooted = classes.join(roots, classes["tid"] == roots["node"], "left").select("h0", "h1", "first_id", F.coalesce("root", "tid").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = ws.write(rooted.join(smallest, "root").select("h0", "h1", "component_id"), "components")
    full = sets.where("n > 0").select("doc_id", "n", "h0", "h1").join(by_class, ["h0", "h1"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))
