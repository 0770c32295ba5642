"""Sequence packing by shortest-pack-first over the length histogram.

Documents are tokenized (an end id follows each) and cut into pieces of at most
``width`` ids.  The histogram of piece lengths, at most ``width`` rows however
large the corpus, is packed on the driver: lengths are placed longest first,
each piece into the shortest pack that has room, whole groups of equal packs at
a time, so that only packing patterns and their counts are kept.  Patterns are
then joined back to pieces by rank: the n-th piece of a length goes to the n-th
place for it.  Ranks come from counts by partition, not from one sorted task.

Defined results: null and empty texts are one piece, the end id alone; repeated
rows are packed each; null ids stay null; no rows give no rows; documents
longer than ``width`` ids continue in further pieces; other columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_collect, read_table, text_blocks, workspace

WIDTH = 4096
END_ID = 2
#: Words of which a worker remembers the ids; beyond that it starts anew.
CACHE_WORDS = 800_000
TRAILING = b".,!?;:"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordTokenizer:
    """Ids of texts by a tokenizers file whose tokens never span white space.

    Words repeat far more often than texts, so ids are kept by word, after
    lower-casing A-Z, which the file's own normalizer does too.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.stand_in = byte_characters()

    def _learn(self, words: set[bytes]) -> None:
        known = self.known
        whole, split, parts = [], [], set()
        for w in words:
            core = w.rstrip(TRAILING)
            if core and len(core) < len(w) and core[-1:].isalnum():
                split.append((w, core, w[len(core) :]))
                parts |= {core, w[len(core) :]}
            else:
                whole.append(w)
        whole += [p for p in parts.difference(whole) if p not in known]
        rest = []
        for w in whole:
            text = w.decode()
            low = text.lower()
            if low.isalpha() and "Σ" not in text and unicodedata.is_normalized("NFC", low):
                token = "".join(map(self.stand_in.__getitem__, low.encode()))
                known[w] = np.array([t.id for t in self.tokenizer.model.tokenize(token)], self.kind).tobytes()
            else:
                rest.append((w, text))
        if rest:
            for (w, _), e in zip(rest, self.tokenizer.encode_batch([t for _, t in rest], add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, self.kind).tobytes()
        for w, core, tail in split:
            known[w] = known[core] + known[tail]

    def ids(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if "<|" in (text or ""):  # the file's special tokens, which the tokenizer finds before it splits
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
        try:
            return np.frombuffer(b"".join(map(self.known.__getitem__, words)), self.kind)
        except KeyError:
            missing = set(words).difference(self.known)
            if len(self.known) + len(missing) > CACHE_WORDS:
                self.known.clear()
                missing = set(words)
            self._learn(missing)
            return np.frombuffer(b"".join(map(self.known.__getitem__, words)), self.kind)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """One for each worker process, kept over its tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def pieces(docs: DataFrame, path: str, width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """A row for each piece; nth: its number among those of its length in its partition."""

    def cut(batches):
        tokenizer = tokenizer_of(path)
        part = TaskContext.get().partitionId()
        counts = np.zeros(width + 1, np.int64)
        for block in text_blocks(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                ids = np.r_[tokenizer.ids(text).astype("<u4"), np.uint32(end_id)].astype("<u4")
                for start in range(0, len(ids), width):
                    piece = ids[start : start + width]
                    n = len(piece)
                    rows.append((doc_id, start, n, zlib.crc32(piece.tobytes()), len(ids), part, int(counts[n])))
                    counts[n] += 1
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:5]), pa.array(c[5], pa.int32()), pa.array(c[6], pa.int64())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def pack_histogram(counts: dict[int, int], width: int = WIDTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (number of packs, [(length, how many of it in a pack), ...])."""
    open_packs: list[tuple[int, int, int, tuple]] = []  # (-room, tie, packs, pattern), shortest pack first
    done: list[tuple[int, tuple]] = []
    tie = 0

    def put(room: int, packs: int, pattern: tuple) -> None:
        nonlocal tie
        tie += 1
        heapq.heappush(open_packs, (-room, tie, packs, pattern))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if open_packs and -open_packs[0][0] >= length:
                room, _, packs, pattern = heapq.heappop(open_packs)
                room = -room
                # as many rounds over the whole group as it stays the shortest
                each = 1
                used = min(packs, left)
                if used == packs:
                    below = -open_packs[0][0] if open_packs else 0
                    each = max(1, min(left // packs, room // length, (room - below) // length + 1))
                if packs > used:
                    put(room, packs - used, pattern)
                put(room - each * length, used, (*pattern, (length, each)))
                left -= used * each
            else:
                each = min(width // length, left)
                packs = left // each
                put(width - each * length, packs, ((length, each),))
                left -= packs * each
        smallest_left = [x for x in open_packs if x[0] == 0]
        if smallest_left and len(smallest_left) == len(open_packs):
            done += [(p, pattern) for _, _, p, pattern in open_packs]
            open_packs.clear()
    done += [(p, pattern) for _, _, p, pattern in sorted(open_packs)]
    return [(p, list(pattern)) for p, pattern in done]


class Places:
    """For each length, the sequences and offsets of its ranks."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]]):
        next_rank: dict[int, int] = {}
        rows, base = [], 0
        for packs, pattern in patterns:
            offset = 0
            for length, each in pattern:
                rank = next_rank.get(length, 0)
                next_rank[length] = rank + packs * each
                rows.append((length, rank, base, packs, offset))
                offset += length * each
            base += packs
        a = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.key = (a[:, 0] << 48) | a[:, 1]
        self.rank, self.base, self.packs, self.offset = a[:, 1], a[:, 2], a[:, 3], a[:, 4]

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, (length << 48) | rank, "right") - 1
        k = rank - self.rank[i]
        return self.base[i] + k % self.packs[i], self.offset[i] + k // self.packs[i] * length


def pack(docs: DataFrame, path: str, width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    ws = workspace(spark, "packing")
    cut = ws.write(pieces(docs, path, width, end_id), "pieces")
    counts = ws.write(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = bounded_collect(counts.groupBy("length").agg(F.sum("n").alias("n")), width, "lengths")
    places = spark.sparkContext.broadcast(Places(pack_histogram({r["length"]: r["n"] for r in histogram}, width)))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = cut.join(before, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches):
        for b in batches:
            sequence, offset = places.value.of(b.column(2).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), default_tokenizer())
