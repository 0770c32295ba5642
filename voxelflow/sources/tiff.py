"""Volumes from TIFF stacks, and stacks from volumes.

``TiffPages`` is a data source with a row for each page.  A large file becomes
many partitions by ranges of its pages, which its directories tell; small files
share one.  Only the bytes of directories and of the pages asked for are read, and
without pixels directories alone.

Pages are gray or have interleaved samples (RGB), of 8, 16 or 32 bits and either
byte order, in strips or tiles, plain or packed by Deflate, LZW or PackBits, with
or without horizontal differences; others raise ``TiffError``.  Files have 32-bit
or 64-bit offsets.
"""

from __future__ import annotations

import fnmatch
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Bytes of each TIFF field type.
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}
#: Bytes of files or pages in a partition.
PIECE_BYTES = 64 << 20
LAYOUT = "path string, page int, width int, height int, data_type string, description string, samples int"
PAGES = "path string, page int, width int, height int, data_type string, description string, vmin double, vmax double, samples int, pixels array<double>"


class TiffError(ValueError):
    pass


def unpack_bits(body: bytes) -> bytes:
    """PackBits: a count, then so many bytes as they are, or one byte to be repeated."""
    out, at = bytearray(), 0
    while at < len(body):
        n = body[at]
        if n < 128:
            out += body[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += body[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(body: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, high bits first; 256 clears the table and 257 ends the data."""
    single = [bytes([k]) for k in range(256)] + [b"", b""]
    known, last, width = list(single), b"", 9
    out, held, bits = [], 0, 0
    for byte in body:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            known, last, width = list(single), b"", 9
            continue
        if code > len(known) or (code == len(known) and not last):
            raise TiffError("broken LZW data")
        word = known[code] if code < len(known) else last + last[:1]
        if last:
            known.append(last + word[:1])
        out.append(word)
        last = word
        # a code is written one entry before it is needed
        width = min(12, max(9, (len(known) + 1).bit_length()))
    return b"".join(out)


#: Fixed values of the compression tag.
UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


class Ranges:
    """Byte ranges of one file, in any file system that pyarrow opens; ``total`` counts the bytes read in this process."""

    total = 0

    def __init__(self, path: str):
        system, name = located(path)
        self.file = system.open_input_file(name)

    def __call__(self, at: int, n: int) -> bytes:
        Ranges.total += n
        return self.file.read_at(n, at)

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """The files of a folder or of a pattern in its last part, or the one file: path and bytes, without hidden ones."""
    system, name = located(path)
    local = isinstance(system, pyarrow.fs.LocalFileSystem)
    head = "file:" if local else path[: len(path) - len(name)] if path.endswith(name) else path.split("://")[0] + "://"
    folder, _, last = name.rpartition("/")
    if any(c in last for c in "*?["):
        found = [f for f in system.get_file_info(pyarrow.fs.FileSelector(folder)) if fnmatch.fnmatchcase(f.base_name, last)]
    else:
        info = system.get_file_info(name)
        if info.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = system.get_file_info(pyarrow.fs.FileSelector(name)) if info.type == pyarrow.fs.FileType.Directory else [info]
    return sorted((head + f.path, f.size) for f in found if f.type == pyarrow.fs.FileType.File and f.base_name[0] not in "._")


Read = Callable[[int, int], bytes]


def directories(data: bytes | Read, only: list[int] | None = None) -> Iterator[dict]:
    """Each page's width, height, data type, description and where its blocks (strips or tiles) lie, without its pixels.

    ``only``: the places of the directories to read, as ``at`` of an earlier call.
    """
    read = data if callable(data) else lambda at, n: data[at : at + n]
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    kind = struct.unpack_from(order + "H", head, 2)[0] if order and len(head) >= 8 else None
    if kind not in (42, 43):
        raise TiffError("no TIFF file")
    small = kind == 42
    word, number, entry, inline = ("I", "H", 12, 4) if small else ("Q", "Q", 20, 8)
    every = iter(only or ())
    at = next(every, 0) if only is not None else struct.unpack_from(order + word, head, 4 if small else 8)[0]
    while at:
        size = struct.calcsize(number)
        (count,) = struct.unpack(order + number, read(at, size))
        body = read(at + size, entry * count + inline)
        tags: dict[int, tuple] = {}
        for k in range(count):
            tag, form, n = struct.unpack_from(order + "HH" + word, body, entry * k)
            field = body[entry * k + entry - inline : entry * (k + 1)]
            length = FIELD_BYTES.get(form, 8) * n
            if form in (1, 2, 3, 4, 16):
                raw = field if length <= inline else read(struct.unpack(order + word, field)[0], length)
                tags[tag] = (raw[:n].rstrip(b"\0").decode("latin-1"),) if form == 2 else struct.unpack_from(order + {1: "B", 3: "H", 4: "I", 16: "Q"}[form] * n, raw)
        bits, form, samples = tags.get(258, (1,)), tags.get(339, (1,))[0], tags.get(277, (1,))[0]
        packing, predictor, tiled = tags.get(259, (1,))[0], tags.get(317, (1,))[0], 324 in tags
        if packing not in UNPACK or bits[0] not in (8, 16, 32) or len(set(bits)) > 1 or (samples > 1 and tags.get(284, (1,))[0] != 1) or predictor not in (1, 2) or form not in (1, 2, 3):
            raise TiffError("only pages of interleaved samples of 8, 16 or 32 bits, plain or packed by Deflate, LZW or PackBits, are read")
        name = {1: "uint", 2: "int", 3: "float"}[form] + str(bits[0])
        width, height = tags[256][0], tags[257][0]
        block = (tags[323][0], tags[322][0]) if tiled else (min(height, tags.get(278, (height,))[0]), width)
        places = zip(*((tags[324], tags[325]) if tiled else (tags[273], tags[279])), strict=True)
        yield {"at": at, "width": width, "height": height, "data_type": name, "order": order, "samples": samples, "packing": packing, "predictor": predictor, "tiled": tiled, "block": block, "places": list(places), "description": tags.get(270, ("",))[0]}
        at = next(every, 0) if only is not None else struct.unpack_from(order + word, body, entry * count)[0]


def _blocks(read: Read, places: list[tuple[int, int]]) -> list[bytes]:
    """The bytes of a page's blocks; blocks that lie close together are one read."""
    first, end = min(a for a, _ in places), max(a + n for a, n in places)
    if end - first > 1.25 * sum(n for _, n in places):
        return [read(a, n) for a, n in places]
    body = read(first, end - first)
    return [body[a - first : a - first + n] for a, n in places]


def pixels(data: bytes | Read, d: dict) -> np.ndarray:
    """One page by its directory: height x width, and x samples where there are several."""
    read = data if callable(data) else lambda at, n: data[at : at + n]
    kind = np.dtype(d["data_type"])
    (high, wide), n = d["block"], d["samples"]
    page = np.empty((d["height"], d["width"], n), kind)
    across = -(-d["width"] // wide)
    for k, packed in enumerate(_blocks(read, d["places"])):
        y, x = k // across * high, k % across * wide
        rows = high if d["tiled"] else min(high, d["height"] - y)
        body = UNPACK[d["packing"]](packed)
        if len(body) < rows * wide * n * kind.itemsize:
            raise TiffError("a block of a page is too short")
        block = np.frombuffer(body, kind.newbyteorder(d["order"]), rows * wide * n).reshape(rows, wide, n).astype(kind)
        if d["predictor"] == 2:
            block = np.cumsum(block, axis=1, dtype=kind)
        page[y : y + rows, x : x + wide] = block[: d["height"] - y, : d["width"] - x]
    return page[:, :, 0] if n == 1 else page


def pages(data: bytes) -> Iterator[tuple[np.ndarray, str]]:
    """The pages of a stack, and each one's description."""
    for d in directories(data):
        yield pixels(data, d), d["description"]


def encode(stack: np.ndarray, description: str = "", packed: bool = False) -> bytes:
    """A little-endian stack of gray pages (pages x height x width) or colour pages (x samples), plain or packed by Deflate."""
    kind = {"u": 1, "i": 2, "f": 3}[stack.dtype.kind]
    samples = stack.shape[3] if stack.ndim == 4 else 1
    out = bytearray(b"II*\0\x08\0\0\0")
    for k, page in enumerate(stack):
        body = page.astype(page.dtype.newbyteorder("<")).tobytes()
        body = zlib.compress(body) if packed else body
        bits = struct.pack(f"<{samples}H", *[stack.dtype.itemsize * 8] * samples)
        text = description.encode("latin-1") + b"\0" if k == 0 else b""
        n = 9 + bool(text)
        end = len(out) + 2 + 12 * n + 4
        extra = bytearray()

        def value(raw: bytes, end: int = end, extra: bytearray = extra) -> int:
            if len(raw) <= 4:
                return int.from_bytes(raw.ljust(4, b"\0"), "little")
            extra.extend(raw)
            return end + len(extra) - len(raw)

        fields = [(256, 4, 1, page.shape[1]), (257, 4, 1, page.shape[0]), (258, 3, samples, value(bits)), (259, 3, 1, 8 if packed else 1), (262, 3, 1, 2 if samples > 2 else 1)]
        fields += [(270, 2, len(text), value(text))] if text else []
        start = end + len(extra)
        fields += [(273, 4, 1, start), (277, 3, 1, samples), (279, 4, 1, len(body)), (339, 3, 1, kind)]
        out += struct.pack("<H", n) + b"".join(struct.pack("<HHII", *f) for f in fields)
        out += struct.pack("<I", start + len(body) if k + 1 < len(stack) else 0) + extra + body
    return bytes(out)


@dataclass
class Piece(InputPartition):
    """Pages of a large file, by number and place of the directory; or whole small files."""

    files: list[str]
    pages: list[tuple[int, int]] | None = None


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}  # Spark hands them on so
        self.path = options["path"]
        self.piece_bytes = int(options.get("piecebytes", PIECE_BYTES))
        self.pixels = options.get("pixels", "true") == "true"
        self.one_scan = options.get("onescan", "false") == "true"
        self.wanted: list[tuple[str, str, object]] = []
        if "pages" in options:
            self.wanted.append(("page", "in", frozenset(map(int, options["pages"].split(",")))))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        known = {EqualTo: "eq", In: "in", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le"}
        for f in filters:
            if self.one_scan and type(f) in known and f.attribute in (("page",), ("path",)):
                self.wanted.append((f.attribute[0], known[type(f)], f.value))
            else:
                yield f

    def asked(self, column: str, value: object) -> bool:
        tests = {"eq": lambda v: value == v, "in": lambda v: value in v, "gt": lambda v: value > v, "ge": lambda v: value >= v, "lt": lambda v: value < v, "le": lambda v: value <= v}
        return all(tests[kind](v) for c, kind, v in self.wanted if c == column)

    def partitions(self) -> list[Piece]:
        """The directories of files beyond a piece are read here, those of small files in their task."""
        pieces, small, held = [], [], 0
        for path, size in listed(self.path):
            if not self.asked("path", path):
                continue
            if size <= self.piece_bytes:
                if small and held + size > self.piece_bytes:
                    pieces.append(Piece(small))
                    small, held = [], 0
                small, held = [*small, path], held + size
                continue
            pages, read = [], 0
            with Ranges(path) as file:
                for k, d in enumerate(directories(file)):
                    if not self.asked("page", k):
                        continue
                    n = sum(n for _, n in d["places"]) if self.pixels else 64
                    if pages and read + n > self.piece_bytes:
                        pieces.append(Piece([path], pages))
                        pages, read = [], 0
                    pages, read = [*pages, (k, d["at"])], read + n
            if pages:
                pieces.append(Piece([path], pages))
        return [*pieces, Piece(small)] if small or not pieces else pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        for path in partition.files:
            with Ranges(path) as file:
                if partition.pages is None:
                    numbered = ((k, d) for k, d in enumerate(directories(file)) if self.asked("page", k))
                else:
                    numbered = zip([k for k, _ in partition.pages], directories(file, [at for _, at in partition.pages]), strict=True)
                for k, d in numbered:
                    yield self.row(path, k, d, file)

    def row(self, path: str, k: int, d: dict, file: Ranges) -> pa.RecordBatch:
        found = {"path": [path], "page": pa.array([k], pa.int32()), "width": pa.array([d["width"]], pa.int32()), "height": pa.array([d["height"]], pa.int32()), "data_type": [d["data_type"]], "description": [d["description"]]}
        if self.pixels:
            v = pixels(file, d).astype(np.float64).ravel()
            seen = v[~np.isnan(v)]
            low, high = (float(seen.min()), float(seen.max())) if seen.size else (0.0, 1.0)
            found |= {"vmin": [low], "vmax": [high if high > low else low + 1]}
        found |= {"samples": pa.array([d["samples"]], pa.int32())}
        if self.pixels:
            found |= {"pixels": pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v))}
        return pa.RecordBatch.from_pydict(found)


class TiffPages(DataSource):
    """Options: ``path``, ``pixels`` (true or false), ``pages`` (numbers with commas), ``pieceBytes``, ``oneScan``."""

    @classmethod
    def name(cls) -> str:
        return "voxelflow_tiff"

    def schema(self) -> str:
        return PAGES if self.options.get("pixels", "true") == "true" else LAYOUT

    def reader(self, schema) -> TiffReader:
        return TiffReader(dict(self.options))


def _source(spark: SparkSession, path: str, **options: object) -> DataFrame:
    spark.dataSource.register(TiffPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(TiffPages.name()).options(**{k: str(v) for k, v in options.items()}).load(path)


def read_pages(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES, pages: Iterable[int] | None = None, one_scan: bool = False) -> DataFrame:
    """A row for each page with its pixels and their range; a constant page gets vmax = vmin + 1.

    A file over ``piece_bytes`` is read by several tasks.  With ``pages`` only
    these pages are read.  With ``one_scan`` filters on ``page`` and ``path`` are
    pushed into the source, and other pages are not read: Spark keeps what is
    pushed for the whole table, so such a table must not occur twice in a plan.
    """
    options = {"pages": ",".join(map(str, pages))} if pages is not None else {}
    return _source(spark, path, pieceBytes=piece_bytes, oneScan=str(one_scan).lower(), **options)


def hyperstack(description):
    """channels, slices and frames of an ImageJ description, null where it isn't one: a struct column."""
    pairs = F.str_to_map(description, F.lit("\n"), F.lit("="))
    number = lambda k: F.coalesce(F.element_at(pairs, k).try_cast("int"), F.lit(1))
    c, z, t = number("channels"), number("slices"), number("frames")
    ok = F.contains(description, F.lit("ImageJ")) & (F.element_at(pairs, "hyperstack") == "true") & (c * z * t == F.element_at(pairs, "images").try_cast("int"))
    return F.when(ok, F.struct(c.alias("channels"), z.alias("slices"), t.alias("frames")))


def channel_layout(description, samples_per_pixel: int = 1):
    """Channels and slices of a stack whose pages are channels (one frame, several channels); null where they aren't."""
    h = hyperstack(description)
    return F.when((h["frames"] == 1) & (h["channels"] > 1) & F.lit(samples_per_pixel == 1), F.struct(h["channels"].alias("channels"), h["slices"].alias("slices")))


def channel_voxels_of(page_rows: DataFrame) -> DataFrame:
    """Files as t, and pages as channel and z by the stack's description (page = z * channels + channel): t, z, y, x, channel, value.

    In a file whose description names no channels the samples of a pixel are the
    channels; a gray one has channel 0 alone.
    """
    gray = F.when(F.col("samples") == 1, F.col("description"))
    first = page_rows.where("page = 0").select("path", channel_layout(gray).alias("layout"))
    v = _samples_of(page_rows, "3d-movie", ("path",)).join(first, "path")
    n = F.coalesce(F.col("layout.channels"), F.lit(1))
    return v.select("t", F.floor(F.col("z") / n).cast("int").alias("z"), "y", "x", F.when(n > 1, F.pmod("z", n)).otherwise(F.col("sample")).cast("int").alias("channel"), "value")


def layout(spark: SparkSession, path: str) -> DataFrame:
    """A row for each page without its pixels, of which no byte is read."""
    return _source(spark, path, pixels="false")


def probe(spark: SparkSession, path: str) -> DataFrame:
    """path, pages, width, height, data_type and description of each file, from its directories alone."""
    first = [F.min_by(c, "page").alias(c) for c in ("width", "height", "data_type", "description")]
    return layout(spark, path).groupBy("path").agg(F.count("*").cast("int").alias("pages"), *first)


def voxels_of(page_rows: DataFrame, interpretation: str = "3d-movie") -> DataFrame:
    """file order t, page z (3d-movie); page as t (2d-movie); or files as z (single-3d-volume): t, z, y, x, value.

    Files are numbered by name; there are far fewer of them than voxels.  Pages
    of files that become one volume must have one shape.  Colour pages are an
    error here; ``channel_voxels_of`` reads them.
    """
    colour = F.raise_error(F.concat(F.lit("pixels of several samples: "), F.col("path"))).cast("array<double>")
    gray = page_rows.withColumn("pixels", F.when(F.col("samples") == 1, F.col("pixels")).otherwise(colour))
    return _samples_of(gray, interpretation).drop("sample")


def _samples_of(page_rows: DataFrame, interpretation: str, keep: tuple[str, ...] = ()) -> DataFrame:
    from ..functions.text import natural_key
    from ..operators.ranks import ranked

    paths = page_rows.select("path").distinct().select("path", natural_key(F.col("path")).alias("name"))
    files = ranked(paths, ("name", "path"), "file_no").select("path", (F.col("file_no") - 1).alias("file_no"))
    p = page_rows.join(files, "path")
    if interpretation == "single-3d-volume":
        shape = page_rows.agg(F.first("width").alias("w0"), F.first("height").alias("h0"))
        same = (F.col("width") == F.col("w0")) & (F.col("height") == F.col("h0")) & (F.col("page") == 0)
        wrong = F.raise_error(F.concat(F.lit("another shape, or several pages: "), F.col("path"))).cast("array<double>")
        # on the pixels, which no plan prunes
        p = p.join(F.broadcast(shape)).withColumn("pixels", F.when(same, F.col("pixels")).otherwise(wrong))
    t, z = {"3d-movie": ("file_no", "page"), "2d-movie": ("page", None), "single-3d-volume": (None, "file_no")}[interpretation]
    column = lambda c, name: (F.col(c) if c else F.lit(0)).cast("int").alias(name)
    dealt = p.select(*keep, column(t, "t"), column(z, "z"), "width", "samples", F.posexplode("pixels").alias("i", "value"))
    at = F.floor(F.col("i") / F.col("samples"))
    return dealt.select(*keep, "t", "z", F.floor(at / F.col("width")).cast("int").alias("y"), F.pmod(at, F.col("width")).cast("int").alias("x"), F.pmod("i", "samples").alias("sample"), "value")
