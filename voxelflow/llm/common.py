"""What the corpus operators share: table access, shared-folder tables, and
numpy kernels over Arrow string buffers.

Every kernel works on whole texts.  A null text is the empty text throughout.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy kernel takes at once; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table that is written needs no shuffle files any more.
FREE_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings with others for a while."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def shared_folder(spark: SparkSession) -> str:
    """Where tables between jobs go: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    A session on one machine that has neither gets a local folder; on a cluster
    executors could not read each other's, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.gettempdir() + "/checkpoints"


class Workspace:
    """Tables in the folder that the cluster shares.

    Tables are written once and read back, so a lost executor costs a re-read,
    not a recomputation of the lineage.  The folder goes when the session's
    Python ends, or its JVM, whichever is first.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.tables: list[str] = []  # of the catalogue
        self._count = 0
        system, path = self._at()
        system.mkdirs(path)
        system.deleteOnExit(path)

    def _at(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def name(self, prefix: str) -> str:
        """A table name not given before."""
        self._count += 1
        return f"{prefix}{self._count}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        with settings(self.spark, FREE_SHUFFLES):
            df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str = "") -> None:
        """Deletes a table that nothing reads any more, or the whole folder."""
        if not name:
            for table in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            self.tables.clear()
        system, path = self._at(name)
        system.delete(path, True)


_KEPT: list[Workspace] = []


def workspace(spark: SparkSession, name: str) -> Workspace:
    w = Workspace(spark, name)
    _KEPT.append(w)
    return w


@atexit.register
def _clean() -> None:
    for w in _KEPT:
        try:
            w.drop()
        except Exception:  # the session has ended before, and its JVM has deleted the folder
            pass


def text_blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Splits Arrow batches with a column ``text`` into slices of about ``most`` bytes."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        text = batch.column(batch.schema.get_field_index("text"))
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64))
        start = 0
        while start < n:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def buffer_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and the n + 1 offsets of its rows."""
    if pa.types.is_large_string(text.type):
        kind = np.int64
    else:
        text, kind = text.cast(pa.string()), np.int32
    if text.null_count:
        text = pc.fill_null(text, "")
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, dtype=kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _class_table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


#: White space x20 and x09 to x0D.
SPACE = _class_table(bytes([0x20, *range(0x09, 0x0E)]))
#: ASCII that is neither a digit nor a letter; everything above x7F belongs to words.
NON_WORD = _class_table(bytes(x for x in range(128) if not chr(x).isalnum()))
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def words_of(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between ``gap`` bytes, never across rows: starts, ends and, for each row, the number of its first word."""
    inside = ~gap[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


class Roller:
    """64-bit polynomial fingerprints of ranges of a sequence of 64-bit units.

    With a random odd base and units spread over 64 bits, equal ranges always
    agree; two Rollers of different seeds give 128 bits together.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62, dtype=np.uint64)) * 8 + 5 & (1 << 64) - 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.symbols = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.salt = np.uint64(rng.integers(0, 1 << 64, dtype=np.uint64) | np.uint64(1))
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self._up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.base, np.uint64)])
                self._down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.inverse, np.uint64)])
        return self._up[:n], self._down[:n]

    def prefixes(self, units: np.ndarray) -> np.ndarray:
        """n + 1 prefix sums to give to ``ranges``."""
        up, _ = self._powers(len(units) + 1)
        sums = np.empty(len(units) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(units * up[: len(units)], out=sums[1:])
        return sums

    def ranges(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, down = self._powers(len(sums))
        return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * self.salt)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads low bits to high ones."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(roller: Roller, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = roller.prefixes(roller.symbols[raw])
    return roller.ranges(sums, starts, ends)


def bounded_collect(df: DataFrame, most: int, what: str) -> list:
    """Rows of a table whose size is fixed by a parameter; raises where it isn't."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows


def fresh(df: DataFrame, name: str) -> str:
    """A column name that a table doesn't have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id's decimal text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as sorted maximal runs; touching runs become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, s[1:] > e[:-1]]
    return s[new], e[np.r_[new[1:], True]]
