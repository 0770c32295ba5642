"""Content-chosen anchors of windows, and what both repeated-text indexes do with them.

Every run of W units (words or bytes) of a text is a window.  Each window has
an anchor: the leftmost k-gram with the smallest hash inside it.  The anchor
follows from the window's content, so equal windows have equal anchors at equal
places, and about one unit in (W - k + 2) / 2 is an anchor.  The windows that
share an anchor occurrence are consecutive; together they are one *entry*.  An
index of entries therefore loses no repeated window, and has one row where an
index of all windows would have W - k + 2 halves.

Texts over SPAN bytes are taken in spans that overlap by a window less one
unit, so that a kernel's memory does not follow the longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Roller, merged, mixed, text_blocks

NULL_ID = -(1 << 63)
#: ``at`` holds the start of the first window, how far behind it the anchor lies, and the number of windows (8 bits each).
N_BITS = 8
START = 2 * N_BITS
KEY, SIG = Roller(101), Roller(202)
BLOCK, SPAN = 1 << 19, 1 << 20
PLACE = ["born", "doc_id", "sub", "at"]
PLACE_TYPE = pa.struct([("born", pa.int32()), ("doc_id", pa.int64()), ("sub", pa.int64()), ("at", pa.int64())])
PLACES_SQL = "more array<struct<born:int,doc_id:long,sub:long,at:long>>"

#: (units, bounds, base, raw) of a text array, in spans: 64-bit units of all rows in a line, their n + 1 offsets,
#: the number of the first unit, and the bytes that units stand for, where they are bytes.
Spans = Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray | None]]]


def packed(start, n, ahead=0):
    return (start << START) | (ahead << N_BITS) | n


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def window_sums(units: np.ndarray) -> np.ndarray:
    return SIG.prefixes(mixed(units ^ np.uint64(0x5851F42D4C957F2D)))


class Entries:
    """Entries of a block: row, start and number n of windows, anchor (``ahead`` of the start), ``key`` of its gram and ``sig`` of all that is covered."""

    def __init__(self, units: np.ndarray, bounds: np.ndarray, window: int, gram: int):
        n, w = len(units), window - gram + 1
        none = np.zeros(0, np.int64)
        self.row = self.start = self.ahead = self.n = self.anchor = none
        self.key = self.sig = np.zeros(0, np.uint64)
        if n < window:
            return
        sums = KEY.prefixes(units)
        first = np.arange(n - gram + 1)
        grams = KEY.ranges(sums, first, first + gram)
        order = (grams & np.uint64(0xFFFFFFFF00000000)) | first.astype(np.uint64)
        anchor = (sliding_least(order, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        starts = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
        if not len(starts):
            return
        anchor = anchor[starts]
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)]
        at = np.flatnonzero(new)
        self.n = np.diff(np.r_[at, len(starts)])
        begin = starts[at]
        self.row, self.anchor = row[begin], anchor[at]
        self.start, self.ahead = begin - bounds[self.row], self.anchor - begin
        self.key = grams[self.anchor]
        self.sig = SIG.ranges(window_sums(units), begin, begin + self.n + window - 1)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def first_places(key: np.ndarray, sig: np.ndarray, place: list[np.ndarray]) -> tuple[np.ndarray, pa.Array]:
    """For each (key, sig) of a block, where its first place is, and its other places as a list."""
    order = np.lexsort((*reversed(place), sig, key))
    k, s = key[order], sig[order]
    same = np.r_[False, (k[1:] == k[:-1]) & (s[1:] == s[:-1])]
    twin = same.copy()  # repeated rows of one document
    for p in place:
        twin[1:] &= p[order][1:] == p[order][:-1]
    order, same = order[~twin], same[~twin]
    group = np.cumsum(~same) - 1
    rest = order[same]
    offsets = np.r_[0, np.cumsum(np.bincount(group[same], minlength=group[-1] + 1 if len(group) else 0))]
    others = pa.StructArray.from_arrays([pa.array(p[rest], t.type) for p, t in zip(place, PLACE_TYPE, strict=True)], fields=list(PLACE_TYPE))
    return order[~same], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), others)


def block_rows(keys: dict[str, Callable[[np.ndarray], pa.Array]], key: np.ndarray, sig: np.ndarray, place: list[np.ndarray]) -> pa.RecordBatch:
    """A batch of entries: the key columns, sig, the first place, and ``more``."""
    first, more = first_places(key, sig, place)
    columns = {x: make(first) for x, make in keys.items()} | {"sig": pa.array(sig[first])}
    columns |= {x: pa.array(p[first], t.type) for x, p, t in zip(PLACE, place, PLACE_TYPE, strict=True)} | {"more": more}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def told_apart(docs: DataFrame, ws, key: str, sub: str) -> DataFrame:
    """``docs`` with a key for each document: its id and 0.

    Rows without id get a positive ``sub`` each, and rows whose id has several
    texts a negative one by text; only these rows are written.  Repeated rows
    of one id and text share their key.
    """
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    number = F.col("doc_id").cast("long")
    known = docs.where(number.isNotNull())
    hashed = known.select(number.alias(key), text.alias("_h")).groupBy(key).agg(F.min("_h").alias("a"), F.max("_h").alias("b"))
    several = ws.write(hashed.where("a <> b").select(key), ws.name("several"))
    clear = known.withColumn(key, number).join(several, key, "left_anti").withColumn(sub, F.lit(0).cast("long"))
    mixed_up = known.withColumn(key, number).join(several, key, "left_semi").withColumn(sub, text.bitwiseOR(F.lit(-(1 << 63))))
    nameless = docs.where(number.isNull()).withColumn(key, F.lit(NULL_ID)).withColumn(sub, F.monotonically_increasing_id() + 1)
    apart = ws.write(mixed_up.unionByName(nameless), ws.name("apart"))
    return clear.unionByName(apart)


def opened_bands(spans: Spans, window: int, band: int):
    """Entries opened into bands: rows of (born, doc_id, sub, text, found) to key, sig, place, more and windows.

    A band has the windows that begin ``band`` * i and up to ``band`` - 1 units more before the anchor.  All of them
    hold a core of window - band + 1 units, whose fingerprint is the key; sig is that of all that the band covers, and
    ``windows`` has those of its windows.  Equal windows lie in bands of equal keys.
    """

    def opened(parts):
        for block in text_blocks(parts, BLOCK):
            found = [np.unique(x[0]) for x in structs(block.column(4), "at")]
            places = [block.column(i).to_numpy() for i in range(3)]
            for units, bounds, base, _ in spans(block.column(3)):
                at = np.concatenate(found)
                row = np.repeat(np.arange(len(found)), list(map(len, found)))
                begin, ahead, n = (at >> START) - base, at >> N_BITS & ((1 << N_BITS) - 1), at & ((1 << N_BITS) - 1)
                fits = (begin >= 0) & (begin + n + window - 1 <= np.diff(bounds)[row])
                row, begin, ahead, n = row[fits], begin[fits], ahead[fits], n[fits]
                if not len(row):
                    continue
                high, low = ahead // band, (ahead - n + 1) // band  # bands of the first and the last window
                many = high - low + 1
                e = np.repeat(np.arange(len(row)), many)
                no = high[e] - (np.arange(len(e)) - np.repeat(np.cumsum(many) - many, many))
                anchor = (bounds[row] + begin + ahead)[e]
                first = np.maximum(anchor - no * band - band + 1, anchor - ahead[e])
                count = np.minimum(anchor - no * band, anchor - ahead[e] + n[e] - 1) - first + 1
                sums = window_sums(units)
                core = anchor - no * band
                key = signed(mixed(SIG.ranges(sums, core, core + window - band + 1) + no.astype(np.uint64)))
                sig = signed(SIG.ranges(sums, first, first + count + window - 1))
                offsets = np.r_[0, np.cumsum(count)]
                each = np.repeat(first - offsets[:-1], count) + np.arange(offsets[-1])
                inner = signed(SIG.ranges(sums, each, each + window))
                windows = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(inner))
                row = row[e]
                place = [*(p[row] for p in places), packed(first - bounds[row] + base, count)]
                keys = {"key": lambda f, key=key: pa.array(key[f]), "windows": lambda f, windows=windows: windows.take(pa.array(f))}
                yield block_rows(keys, key, sig, place)

    return opened


def structs(column: pa.Array, *fields: str) -> list[list[np.ndarray]]:
    """For each row of a column of lists of structs, the named fields as arrays; a null is empty."""
    inner = column.flatten()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    cuts = np.cumsum(sizes)[:-1]
    return list(map(list, zip(*(np.split(inner.field(x).to_numpy(zero_copy_only=False), cuts) for x in fields), strict=True)))


def covered(start: np.ndarray, length: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the pieces [start, start + length), inside n units."""
    return merged(np.minimum(start, n), np.minimum(start + length, n))
