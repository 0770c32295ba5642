"""Channels written as TIFF stacks, a file for each timepoint.

Plain pages have one size, so every page's place in its file is known before any
is written.  Tasks write ranges of pages, several for a large stack, as pieces
with their final offsets; then a task for each file puts its pieces one behind
the other, and moves the whole into place.  A task holds one page.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .tiff import located

#: Kinds of samples: code in the file, bits.
KINDS = {"uint8": (1, 8), "uint16": (1, 16), "uint32": (1, 32), "float32": (3, 32)}
#: Pages of a piece hold about so many bytes.
PIECE_BYTES = 64 << 20
COPY_BYTES = 4 << 20
FIELDS = 10


@dataclass
class Stack:
    """The layout of a file: pages of one size, 64-bit offsets where 32 do not reach."""

    depth: int
    height: int
    width: int
    kind: str
    big: bool | None = None

    def __post_init__(self):
        self.body = self.height * self.width * KINDS[self.kind][1] // 8
        if self.big is None:
            self.big = 8 + self.depth * (2 + 12 * FIELDS + 4 + self.body + 8) >= 1 << 32
        self.head = 16 if self.big else 8
        self.directory = 8 + 20 * FIELDS + 8 if self.big else 2 + 12 * FIELDS + 4
        self.page = -(-(self.directory + self.body) // 8) * 8

    def header(self) -> bytes:
        return b"II" + (struct.pack("<HHHQ", 43, 8, 0, 16) if self.big else struct.pack("<HI", 42, 8))

    def encoded(self, z: int, samples: np.ndarray | None) -> bytes:
        """Page ``z`` with its directory in front; without samples it is all zeros."""
        at = self.head + z * self.page
        form, bits = KINDS[self.kind]
        whole = 16 if self.big else 4  # the type of a number as wide as an offset
        fields = [(256, 4, self.width), (257, 4, self.height), (258, 3, bits), (259, 3, 1), (262, 3, 1), (273, whole, at + self.directory), (277, 3, 1), (278, 4, self.height), (279, whole, self.body), (339, 3, form)]
        count, entry, word = ("<Q", "<HHQQ", "<Q") if self.big else ("<H", "<HHII", "<I")
        following = at + self.page if z + 1 < self.depth else 0
        head = struct.pack(count, FIELDS) + b"".join(struct.pack(entry, tag, kind, 1, v) for tag, kind, v in fields) + struct.pack(word, following)
        body = bytes(self.body) if samples is None else samples.tobytes()
        return (head + body).ljust(self.page, b"\0")


def export_channel(voxels: DataFrame, path: str, dims: tuple[int, int, int], timepoints: int, name: str = "", kind: str = "uint8", value: str = "value", piece_bytes: int = PIECE_BYTES, big: bool | None = None) -> DataFrame:
    """Writes ``voxels`` (t, z, y, x and a value) below ``path``; a row for each file: t, entry, n_pages, n_bytes.

    One timepoint becomes ``name``.tif, several ``name``/001.tif and so on.  Voxels
    that are not there, or have no value, are zero; of repeated ones the largest
    holds.  A place outside the volume, or a value that ``kind`` cannot hold, is an
    error; rows without a place are left out.  Files are there only once they are
    whole, and existing ones are replaced.
    """
    if timepoints <= 0 or min(dims) <= 0:
        raise ValueError("a channel without volumes cannot be exported")
    if kind not in KINDS:
        raise ValueError(f"no samples of {kind}; there are {', '.join(KINDS)}")
    spark, path = voxels.sparkSession, path.rstrip("/")
    stack = Stack(*dims, kind, big)
    per_piece = max(1, piece_bytes // stack.page)
    work = f"{path}/_export-{uuid.uuid4().hex[:12]}"
    fs, folder = located(path)
    fs.create_dir(folder, recursive=True)
    try:
        rows = _checked(voxels, stack, timepoints, value).withColumn("piece", F.floor(F.col("z") / per_piece).cast("int"))
        dealt = rows.repartition("t", "piece").sortWithinPartitions("t", "piece", "z", "v")
        dealt.mapInArrow(_piece_writer(stack, per_piece, f"{work}/pieces"), "t int, piece int, file string").write.parquet(f"{work}/written")
        pieces = spark.read.schema("t int, piece int, file string").parquet(f"{work}/written")
        of_file = pieces.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("piece", "file"))).alias("pieces"))  # a row for each 64 MB of a file
        every = spark.range(timepoints).select(F.col("id").cast("int").alias("t")).join(of_file, "t", "left")
        named = every.withColumn("entry", _entry(name, timepoints)).repartition(min(timepoints, 10_000), "t")
        done = named.mapInArrow(_file_writer(stack, per_piece, path), "t int, entry string, n_pages long, n_bytes long")
        done.write.mode("overwrite").parquet(f"{path}/_entries")
    finally:
        if fs.get_file_info(located(work)[1]).type != pa.fs.FileType.NotFound:
            fs.delete_dir(located(work)[1])
    return spark.read.parquet(f"{path}/_entries")


def _entry(name: str, timepoints: int) -> Column:
    base = text.file_base(F.lit(name))
    if timepoints == 1:
        return F.concat(base, F.lit(".tif"))
    return F.concat(base, F.lit("/"), F.lpad((F.col("t") + 1).cast("string"), max(3, len(str(timepoints))), "0"), F.lit(".tif"))


def _checked(voxels: DataFrame, stack: Stack, timepoints: int, value: str) -> DataFrame:
    """t, z, y, x, v with an error for what the file cannot hold."""
    sizes = {"t": timepoints, "z": stack.depth, "y": stack.height, "x": stack.width}
    placed = voxels.dropna(subset=list(sizes))
    inside = F.lit(True)
    for c, n in sizes.items():
        inside = inside & F.col(c).between(0, n - 1)
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    fits = F.lit(True) if stack.kind == "float32" else v.between(0, 2 ** KINDS[stack.kind][1] - 1) & (v == F.floor(v))
    at = F.concat_ws(", ", *(F.col(c).cast("string") for c in sizes))
    wrong = F.when(~inside, F.concat(F.lit("outside of the volume: t, z, y, x = "), at)).when(~fits, F.concat(F.lit(f"no {stack.kind}: "), v.cast("string"), F.lit(" at t, z, y, x = "), at))
    held = F.when(wrong.isNull(), v).otherwise(F.raise_error(wrong).cast("double"))
    return placed.select(*(F.col(c).cast("int").alias(c) for c in sizes), held.alias("v"))


def _piece_writer(stack: Stack, per_piece: int, folder: str):
    """Writes rows sorted by t, piece and z as files of whole pages, and tells each one's name: a repeated task writes another."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = located(folder)
        fs.create_dir(root, recursive=True)
        samples = np.zeros((stack.height, stack.width), np.dtype(stack.kind).newbyteorder("<"))
        key = out = name = None
        z = written = 0

        def pages_to(end: int, filled: int | None) -> None:
            nonlocal written
            for k in range(written, end):
                out.write(stack.encoded(k, samples if k == filled else None))
            written = max(written, end)

        def finished() -> pa.RecordBatch:
            pages_to(z + 1, z)
            pages_to(min(stack.depth, (key[1] + 1) * per_piece), None)
            out.close()
            return pa.RecordBatch.from_pydict({"t": pa.array([key[0]], pa.int32()), "piece": pa.array([key[1]], pa.int32()), "file": [name]})

        for batch in batches:
            if not batch.num_rows:
                continue
            t, zs, y, x, v, piece = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "z", "y", "x", "v", "piece"))
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(zs) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(t)], strict=True):
                now = (int(t[a]), int(piece[a]))
                if now != key:
                    if key is not None:
                        yield finished()
                    key, name = now, f"{root}/{now[0]}-{now[1]}-{uuid.uuid4().hex}"
                    out, written, z = fs.open_output_stream(name), now[1] * per_piece, int(zs[a])
                    samples[:] = 0
                elif zs[a] != z:
                    pages_to(z + 1, z)
                    z = int(zs[a])
                    samples[:] = 0
                samples[y[a:b], x[a:b]] = v[a:b]
        if key is not None:
            yield finished()

    return write


def _file_writer(stack: Stack, per_piece: int, path: str):
    """Puts the pieces of a file behind its header, zeros where there is none, and moves the file into place."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = located(path)
        for batch in batches:
            for row in batch.to_pylist():
                pieces, target = dict(row["pieces"] or ()), f"{root}/{row['entry']}"
                fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                hidden = f"{target.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(hidden) as out:
                    out.write(stack.header())
                    for k in range(-(-stack.depth // per_piece)):
                        if k not in pieces:
                            for z in range(k * per_piece, min(stack.depth, (k + 1) * per_piece)):
                                out.write(stack.encoded(z, None))
                            continue
                        with fs.open_input_stream(pieces[k]) as piece:
                            while body := piece.read(COPY_BYTES):
                                out.write(body)
                fs.move(hidden, target)
                yield pa.RecordBatch.from_pydict({"t": pa.array([row["t"]], pa.int32()), "entry": [row["entry"]], "n_pages": [stack.depth], "n_bytes": [stack.head + stack.depth * stack.page]})

    return write
