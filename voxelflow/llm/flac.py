"""Media columns in FLAC: texts as 8-bit mono samples, stored losslessly and read back.

Encoding: frames of 1024 samples; for each, the cheapest of a constant, fixed
predictors of order 0 to 2, a quantized linear predictor of order 4, or verbatim
samples; residuals are Rice coded.  The stream has a seek table with a point
for every frame.  Streams are read back as PCM blocks with their sample
offsets, and digests and features are folded from these blocks.  Decoding checks the header's CRC-8 and the frame's CRC-16,
unfolds Rice codes and runs the predictors, and hands out PCM blocks with their
sample offsets.  All frames of a batch advance together, one numpy step for the
n-th sample of each, so that no Python runs for single samples.

Byte b is stored as the signed sample b - 128.

Defined results: a null or empty text is a payload of 64 zero bytes; payloads
up to MOST_SAMPLES, as many as one seek table can point into (954 MB; a longer
one raises, before it is encoded); equal texts give equal streams wherever they lie; a stream
whose checksum or frame number is wrong raises ``FlacError``; no rows give no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_blocks

BLOCK = 1024
RATE = 16_000
LPC_ORDER, LPC_BITS = 4, 10
UNIT = 64
#: Samples of as many blocks as a seek table has points at most.
MOST_SAMPLES = ((1 << 24) - 1) // 18 * BLOCK
FIXED = {1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}


class FlacError(ValueError):
    pass


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    t = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        t = np.where(t & top, (t << 1) ^ polynomial, t << 1) & mask
    return t


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(start), np.int64)
    for i in range(int(n.max(initial=0))):
        crc = np.where(i < n, CRC8[crc ^ data[np.minimum(start + i, len(data) - 1)]], crc)
    return crc


#: CRC-16 of two bytes in one step.
CRC16_PAIR = CRC16[np.arange(1 << 16) >> 8]
CRC16_PAIR = (((CRC16_PAIR << 8) & 0xFFFF) ^ CRC16[(CRC16_PAIR >> 8) ^ (np.arange(1 << 16) & 0xFF)]).astype(np.int32)


def crc16(data: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Lanes sorted by length, so that each step touches only those that still run."""
    order = np.argsort(-n, kind="stable")
    begin, size = start[order], n[order]
    pair = np.zeros(len(data), np.int32)
    pair[:-1] = data[:-1].astype(np.int32) << 8 | data[1:]
    odd = size % 2
    crc = np.where(odd == 1, CRC16[data[np.minimum(begin, len(data) - 1)]], 0).astype(np.int32)
    begin, steps = begin + odd, size // 2
    live = len(start)
    for i in range(int(steps.max(initial=0))):
        while steps[live - 1] <= i:
            live -= 1
        crc[:live] = CRC16_PAIR[crc[:live] ^ pair[begin[:live] + 2 * i]]
    out = np.empty(len(start), np.int64)
    out[order] = crc
    return out


#: Zeros before the first one of 16 bits.
ZEROS = 16 - np.ceil(np.log2(np.arange(1 << 16) + 1)).astype(np.int32)


def utf8_number(n: int) -> bytes:
    """Frame numbers are written as UTF-8 writes code points, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    return bytes([(0xFF00 >> size & 0xFF) | n >> 6 * (size - 1), *(0x80 | n >> 6 * i & 0x3F for i in reversed(range(size - 1)))])


def frames_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For streams of ``sizes`` samples: each frame's stream, its number there and its samples."""
    frames = -(-sizes // BLOCK)
    stream = np.repeat(np.arange(len(sizes)), frames)
    number = np.arange(len(stream)) - np.repeat(np.cumsum(frames) - frames, frames)
    return stream, number, np.minimum(sizes[stream] - number * BLOCK, BLOCK)


def _linear(x: np.ndarray) -> np.ndarray:
    """Quantized coefficients of order LPC_ORDER of frames x samples, zero beyond their end.

    Sums stay within 2^24, so that float32 holds them exactly and a frame's
    coefficients don't depend on the batch.
    """
    p = LPC_ORDER
    auto = np.stack([np.einsum("ij,ij->i", x[:, : x.shape[1] - k], x[:, k:]) for k in range(p + 1)], axis=1).astype(np.float64)
    matrix = auto[:, np.abs(np.arange(p)[:, None] - np.arange(p)[None, :])]
    matrix[:, np.arange(p), np.arange(p)] += auto[:, :1] * 1e-6 + 1e-3
    solved = np.linalg.solve(matrix, auto[:, 1:, None])[:, :, 0]
    return np.clip(np.round(solved * (1 << LPC_BITS)), -(1 << 11), (1 << 11) - 1).astype(np.int64)


class _Bits:
    """Values of up to 16 bits at bit positions, gathered and written as one line of bytes."""

    def __init__(self):
        self.at: list[np.ndarray] = []
        self.value: list[np.ndarray] = []
        self.width: list[np.ndarray] = []

    def put(self, at: np.ndarray, value, width) -> None:
        self.at.append(at)
        self.value.append(np.broadcast_to(np.asarray(value, np.int64), at.shape))
        self.width.append(np.broadcast_to(np.asarray(width, np.int64), at.shape))

    def bytes(self, size: int) -> np.ndarray:
        """No two values share a bit, so sums of shifted values are exact in float64."""
        at, value, width = map(np.concatenate, (self.at, self.value, self.width))
        wide = value << (48 - (at & 31) - width)
        words = size // 4 + 2
        word = at >> 5
        total = np.bincount(word, weights=wide >> 16, minlength=words) + np.bincount(word + 1, weights=(wide & 0xFFFF) << 16, minlength=words)
        return total.astype(np.uint32).astype(">u4").view(np.uint8)[:size].copy()


def encode(payload: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """FLAC streams of consecutive payloads (uint8) of ``sizes`` bytes."""
    stream, number, n = frames_of(sizes)
    offset = (np.cumsum(sizes) - sizes)[stream] + number * BLOCK
    frames = len(stream)
    column = np.arange(BLOCK)
    inside = column[None, :] < n[:, None]
    x = np.zeros((frames, BLOCK), np.int16)
    x[inside] = payload[: int(sizes.sum())].astype(np.int16) - 128  # frames lie in the payload's order
    # residuals of each predictor; beyond a frame's end they are zero
    f32 = x.astype(np.float32)
    coef = _linear(f32)
    total = np.zeros((frames, BLOCK - LPC_ORDER), np.float32)
    for j in range(LPC_ORDER):
        total += coef[:, j : j + 1].astype(np.float32) * f32[:, LPC_ORDER - 1 - j : BLOCK - 1 - j]
    total *= np.float32(1 / (1 << LPC_BITS))
    linear_r = x.copy()
    linear_r[:, LPC_ORDER:] -= np.floor(total, out=total).astype(np.int16)
    one = x.copy()
    one[:, 1:] -= x[:, :-1]
    two = one.copy()
    two[:, 1:] -= one[:, :-1]
    two[:, 1] = one[:, 1]
    del total, f32
    orders = np.array([0, 1, 2, LPC_ORDER])
    sums = []
    for r, o in zip((x, one, two, linear_r), orders.tolist(), strict=True):
        r *= inside  # in place: what lies beyond the end is zero
        sums.append(np.abs(r[:, o:]).sum(1, dtype=np.int64))
    mean = np.stack(sums) * 2 / np.maximum(n - orders[:, None], 1)
    rice = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 14).astype(np.int64)
    bits = (n - orders[:, None]) * (rice + 1 + mean / (1 << rice)) + 8 * orders[:, None] + np.where(orders == LPC_ORDER, 9 + 12 * LPC_ORDER, 0)[:, None]
    bits = np.where(n > orders[:, None], bits, np.inf)
    choice = bits.argmin(0)  # 0 to 2 fixed, 3 linear, 4 constant, 5 verbatim
    constant = (sums[1] == 0) & (n > 0)
    verbatim = bits.min(0) >= 8 * n
    choice = np.where(constant, 4, np.where(verbatim, 5, choice))
    coded, linear = choice < 4, choice == 3
    order = np.where(coded, orders[np.minimum(choice, 3)], 0)
    k = rice[np.minimum(choice, 3), np.arange(frames)]
    r = np.where(linear[:, None], linear_r, x)
    for c, other in ((1, one), (2, two)):
        r[choice == c] = other[choice == c]
    del linear_r, one, two

    numbers = [utf8_number(i) for i in number.tolist()]
    number_size = np.array([len(b) for b in numbers])
    header = 4 + number_size + 2 + 1  # with the 16-bit block size and the CRC-8
    lead = header * 8 + 8  # the subframe's own byte
    code_at = lead + 8 * order + np.where(linear, 9 + 12 * LPC_ORDER, 0) + np.where(coded, 10, 0)
    used = inside & (column[None, :] >= order[:, None]) & coded[:, None]
    per_frame = used.sum(1)
    folded = ((r << 1) ^ (r >> 15))[used].astype(np.int64)
    kk = np.repeat(k, per_frame)
    quotient = folded >> kk
    ends = np.cumsum(quotient + 1 + kk)
    edge = np.r_[0, ends][np.r_[0, np.cumsum(per_frame)]]
    body = np.where(coded, np.diff(edge), np.where(choice == 4, 8, 8 * n))
    frame_bytes = -(-(code_at + body) // 8) + 2
    at = np.cumsum(frame_bytes) - frame_bytes
    bit = at * 8
    out = _Bits()
    # a code ends with its stop bit and k low bits; the zeros before it need no writing
    out.put(ends - kk - 1 + np.repeat(bit + code_at - edge[:-1], per_frame), (1 << kk) | folded & ((1 << kk) - 1), kk + 1)
    out.put(bit, 0xFFF8, 16)
    out.put(bit + 16, 0x7002, 16)  # block size in 16 bits at the end, rate as in STREAMINFO; mono, 8 bits a sample
    for i in range(int(number_size.max(initial=0))):
        has = np.flatnonzero(number_size > i)
        out.put(bit[has] + 32 + 8 * i, np.array([numbers[f][i] for f in has.tolist()]), 8)
    out.put(bit + 32 + 8 * number_size, n - 1, 16)
    kind = np.select([choice == 4, choice == 5, linear], [0, 1, 0x20 | (LPC_ORDER - 1)], 0x08 | order)
    out.put(bit + header * 8, kind << 1, 8)
    wide = x.astype(np.int64)[:, : LPC_ORDER + 1] & 0xFF
    for i in range(int(order.max(initial=0))):
        f = np.flatnonzero(order > i)
        out.put(bit[f] + lead[f] + 8 * i, wide[f, i], 8)
    f = np.flatnonzero(linear)
    base = bit[f] + lead[f] + 8 * order[f]
    out.put(base, 11 << 5 | LPC_BITS, 9)
    for j in range(LPC_ORDER):
        out.put(base + 9 + 12 * j, coef[f, j] & 0xFFF, 12)
    f = np.flatnonzero(coded)
    out.put(bit[f] + code_at[f] - 10, k[f], 10)  # method 0, one partition, its parameter
    f = np.flatnonzero(choice == 4)
    out.put(bit[f] + lead[f], wide[f, 0], 8)
    f = np.flatnonzero(choice == 5)
    g, c = np.nonzero(inside[f])
    out.put(bit[f][g] + lead[f][g] + 8 * c, x[f][g, c].astype(np.int64) & 0xFF, 8)
    data = out.bytes(int(frame_bytes.sum()))
    data[at + header - 1] = crc8(data, at, header - 1)
    check = crc16(data, at, frame_bytes - 2)
    data[at + frame_bytes - 2], data[at + frame_bytes - 1] = check >> 8, check & 0xFF

    streams = []
    first = np.searchsorted(stream, np.arange(len(sizes)), "left")
    last = np.searchsorted(stream, np.arange(len(sizes)), "right")
    stops = np.cumsum(sizes)
    for s in range(len(sizes)):
        a, b = first[s], last[s]
        begin, size_b = at[a:b] - at[a], frame_bytes[a:b]
        raw = payload[stops[s] - sizes[s] : stops[s]]
        signed = (raw ^ 0x80).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(size_b.min()).to_bytes(3, "big") + int(size_b.max()).to_bytes(3, "big")
        info += ((RATE << 44) | (7 << 36) | int(sizes[s])).to_bytes(8, "big") + hashlib.md5(signed).digest()
        points = np.zeros(b - a, [("sample", ">u8"), ("at", ">u8"), ("n", ">u2")])
        points["sample"], points["at"], points["n"] = number[a:b] * BLOCK, begin, n[a:b]
        table = points.tobytes()
        if len(table) >= 1 << 24:
            raise FlacError("too long for one seek table")  # payload_of has seen to it
        blocks = b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table
        streams.append(b"fLaC" + blocks + data[at[a] : at[b - 1] + frame_bytes[b - 1]].tobytes())
    return streams


def _opened(media: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """Samples, MD5, seek points and where the frames begin."""
    if media[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, total, digest, points, last = 4, 0, b"", None, False
    while not last:
        kind, size = media[at], int.from_bytes(media[at + 1 : at + 4], "big")
        last, body = kind >= 0x80, media[at + 4 : at + 4 + size]
        if kind & 0x7F == 0:
            total, digest = int.from_bytes(body[10:18], "big") & (1 << 36) - 1, body[18:34]
        elif kind & 0x7F == 3:
            points = np.frombuffer(body, [("sample", ">u8"), ("at", ">u8"), ("n", ">u2")])
        at += 4 + size
    if points is None:
        raise FlacError("a seek table is needed")
    return total, digest, points, at


def decode(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """PCM of all streams as uint8, and of each block its stream, its sample offset there and its samples."""
    data = np.frombuffer(b"".join(streams) + bytes(8), np.uint8)
    base, start, stop, stream, number, sample, count = 0, [], [], [], [], [], []
    for s, media in enumerate(streams):
        total, _, points, at = _opened(media)
        if int(points["n"].sum()) != total:
            raise FlacError("the seek table does not cover the stream")
        begin = base + at + points["at"].astype(np.int64)
        start.append(begin)
        stop.append(np.r_[begin[1:], base + len(media)])
        stream.append(np.full(len(begin), s))
        number.append(np.arange(len(begin)))
        sample.append(points["sample"].astype(np.int64))
        count.append(points["n"].astype(np.int64))
        base += len(media)
    start, stop, stream, number, sample, count = map(np.concatenate, (start, stop, stream, number, sample, count))
    lanes = len(start)
    # headers
    if not ((data[start] == 0xFF) & (data[start + 1] == 0xF8) & (data[start + 2] == 0x70) & (data[start + 3] == 0x02)).all():
        raise FlacError("not a frame of this form")
    lead = data[start + 4].astype(np.int64)
    more = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [0, 1, 2, 3, 4], 5)
    value = np.where(more == 0, lead, lead & (0x3F >> more))
    for i in range(int(more.max(initial=0))):
        value = np.where(more > i, value << 6 | data[start + 5 + i] & 0x3F, value)
    header = 8 + more
    n = (data[start + 5 + more].astype(np.int64) << 8 | data[start + 6 + more]) + 1
    if (crc8(data, start, header - 1) != data[start + header - 1]).any() or (value != number).any() or (n != count).any():
        raise FlacError("a frame header is damaged")
    size = stop - start
    if (crc16(data, start, size - 2) != (data[stop - 2].astype(np.int64) << 8 | data[stop - 1])).any():
        raise FlacError("a frame checksum is wrong")

    # the four bytes from each byte on, as one number
    padded = np.concatenate([data, np.zeros(-len(data) % 4 + 4, np.uint8)])
    four = np.empty(len(padded) - 4, np.uint32)
    for i in range(4):
        four[i::4] = padded[i : i + len(four)].view(">u4")

    def field(bit: np.ndarray, width: int) -> np.ndarray:
        word = four[bit >> 3].astype(np.int64)
        return word >> (32 - width - (bit & 7)) & ((1 << width) - 1)

    def signed(v: np.ndarray, width: int) -> np.ndarray:
        return v - ((v >> (width - 1)) << width)

    bit = (start + header) * 8
    kind = field(bit, 8) >> 1
    bit = bit + 8
    order = np.select([kind < 8, kind < 0x20], [0, kind - 8], (kind & 0x1F) + 1)
    coded = kind >= 8
    top = int(order.max(initial=0))
    width = int(n.max(initial=0))
    x = np.zeros((width + top, lanes), np.int32)  # ``top`` rows of zeros lie before the first sample
    coef, shift = np.zeros((max(top, 1), lanes), np.int32), np.zeros(lanes, np.int32)
    f = np.flatnonzero(kind == 0)
    x[top:, f] = signed(field(bit[f], 8), 8)
    f = np.flatnonzero(kind == 1)
    for i in range(int(n[f].max(initial=0))):
        g = f[n[f] > i]
        x[top + i, g] = signed(field(bit[g] + 8 * i, 8), 8)
    for i in range(top):
        f = np.flatnonzero(coded & (order > i))
        x[top + i, f] = signed(field(bit[f] + 8 * i, 8), 8)
    bit = bit + np.where(coded, 8 * order, 0)
    for o, c in FIXED.items():
        f = np.flatnonzero(kind == 8 + o)
        for j, v in enumerate(c if len(f) else ()):
            coef[j, f] = v
    f = np.flatnonzero(kind >= 0x20)
    if len(f):
        precision = field(bit[f], 4) + 1
        shift[f] = signed(field(bit[f] + 4, 5), 5)
        for j in range(int(order[f].max())):
            for p in np.unique(precision).tolist():
                g = f[(order[f] > j) & (precision == p)]
                coef[j, g] = signed(field(bit[g] + 9 + j * p, p), p)
        width_of = np.zeros(lanes, np.int64)
        width_of[f] = 9 + precision * order[f]
        bit = bit + width_of
    # Rice codes: the n-th code of every frame in one step
    lane = np.flatnonzero(coded)
    if len(lane):
        if (field(bit[lane], 6) != 0).any():
            raise FlacError("one Rice partition with 4-bit parameters is read")
        k = field(bit[lane] + 6, 4)
        todo = n[lane] - order[lane]
        by = np.argsort(-todo, kind="stable")
        lane, k, todo = lane[by], k[by], todo[by]
        pos = bit[lane] + 10
        steps = int(todo.max(initial=0))
        zeros = np.zeros((steps, len(lane)), np.int32)
        ends = np.zeros((steps, len(lane)), np.int64)
        live, k1 = len(lane), k + 1
        for i in range(steps):
            while todo[live - 1] <= i:
                live -= 1
            p = pos[:live]
            z = ZEROS[(four[p >> 3] << (p & 7).astype(np.uint32)) >> 16]
            long = np.flatnonzero(z == 16)
            while len(long):  # a run over the window's end
                q = p[long] + z[long]
                more = ZEROS[(four[q >> 3] << (q & 7).astype(np.uint32)) >> 16]
                z[long] += more
                long = long[more == 16]
            zeros[i, :live] = z
            ends[i, :live] = pos[:live] = p + z + k1[:live]
        first = np.maximum(ends - k, 0)  # of the low bits
        rest = four[first >> 3] >> np.maximum(32 - k - (first & 7), 0).astype(np.uint32) & ((1 << k) - 1).astype(np.uint32)
        folded = (zeros << k.astype(np.int32)) | rest.astype(np.int32)
        residual = (folded >> 1) ^ -(folded & 1)
        residual[np.arange(steps)[:, None] >= todo[None, :]] = 0
        for o in np.unique(order[lane]).tolist():
            j = np.flatnonzero(order[lane] == o)
            m = min(steps, width - o)
            x[top + o : top + o + m, lane[j]] = residual[:m, j]
        # predictors, in step again
        by = np.flatnonzero(coded & (order > 0))
        if len(by):
            by = by[np.argsort(-n[by], kind="stable")]
            y, c, s, o, m = np.ascontiguousarray(x[:, by]), coef[:, by], shift[by], order[by], n[by]
            live, least = len(by), int(o.min())
            for i in range(least, int(m.max())):
                while m[live - 1] <= i:
                    live -= 1
                total = c[0, :live] * y[top + i - 1, :live]
                for j in range(1, top):
                    total += c[j, :live] * y[top + i - 1 - j, :live]
                total >>= s[:live]
                if i < top:
                    total[o[:live] > i] = 0
                y[top + i, :live] += total
            x[:, by] = y
    used = np.arange(width)[None, :] < n[:, None]
    pcm = (x[top:].T[used] + 128).astype(np.uint8)
    ends = np.cumsum(np.bincount(stream, weights=n, minlength=len(streams)).astype(np.int64))
    for s, media in enumerate(streams):
        piece = pcm[ends[s - 1] if s else 0 : ends[s]]
        if hashlib.md5((piece ^ 0x80).tobytes()).digest() != _opened(media)[1]:
            raise FlacError("the samples do not match the stream's MD5")
    return pcm, stream, sample, n


def payload_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 with zero bytes up to a positive multiple of 64; padded and plain sizes."""
    raw = [(t or "").encode() for t in texts]
    if max(map(len, raw), default=0) > MOST_SAMPLES:
        raise FlacError(f"a payload has more than {MOST_SAMPLES} samples")
    plain = np.array([len(b) for b in raw], np.int64)
    sizes = np.maximum(-(-plain // UNIT), 1) * UNIT
    padded = b"".join(b + bytes(int(s) - len(b)) for b, s in zip(raw, sizes, strict=True))
    return np.frombuffer(padded, np.uint8), sizes, plain


def flac_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the FLAC stream of each row's text; no shuffle."""

    def store(batches):
        for block in text_blocks(batches, 1 << 20):
            payload, sizes, plain = payload_of(block.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(plain), pa.array(encode(payload, sizes), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def _media_blocks(batches):
    for block in text_blocks((b.rename_columns([*b.schema.names[:2], "text"]) for b in batches), 1 << 20):
        yield block, block.column(2).to_pylist()


def pcm_blocks(media: DataFrame) -> DataFrame:
    """A row for each stored frame: doc_id, block, sample_offset, n_samples, pcm (unsigned 8-bit).

    The blocks of a stream stand together, in order.  Its first block also has
    n_bytes (of the plain text), media_bytes and media_sha256.
    """

    def read(batches):
        for block, streams in _media_blocks(batches):
            pcm, stream, sample, n = decode(streams)
            ends = np.cumsum(n)
            parts = [pcm[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            first = pa.array(np.where(sample == 0, stream, -1), pa.int64(), mask=sample > 0)
            sizes, digests = pa.array([len(s) for s in streams], pa.int64()), pa.array([hashlib.sha256(s).hexdigest() for s in streams])
            columns = {"doc_id": block.column(0).take(pa.array(stream)), "block": pa.array(sample // BLOCK, pa.int32()), "sample_offset": pa.array(sample), "n_samples": pa.array(n), "pcm": pa.array(parts, pa.binary())}
            columns |= {"n_bytes": block.column(1).take(first), "media_bytes": sizes.take(first), "media_sha256": digests.take(first)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, "doc_id long, block int, sample_offset long, n_samples long, pcm binary, n_bytes long, media_bytes long, media_sha256 string")


def features(pcm: np.ndarray, ends: np.ndarray) -> list[str]:
    """Of each payload: peak, mean square in hundredths, and crossings of the mean sample."""
    starts = np.r_[0, ends[:-1]]
    v = pcm.astype(np.int64) - 128
    peak = np.maximum.reduceat(np.abs(v), starts)
    energy = np.add.reduceat(v * v, starts)
    n = ends - starts
    mean = np.add.reduceat(v, starts) // n
    above = v > np.repeat(mean, n)
    cross = np.r_[above[1:] != above[:-1], False]
    cross[ends - 1] = False
    crossings = np.add.reduceat(cross.astype(np.int64), starts)
    return [f"peak={p};ms={e * 100 // k};cross={c}" for p, e, k, c in zip(peak.tolist(), energy.tolist(), n.tolist(), crossings.tolist(), strict=True)]


def folded(blocks: DataFrame) -> DataFrame:
    """Digests and features of each stream, from its PCM blocks as ``pcm_blocks`` hands them out; no shuffle.

    A stream's blocks may lie in several batches; what is open goes on in the next one.
    """

    def digests(heads: list[tuple], parts: list[bytes]) -> pa.RecordBatch:
        doc, plain, size, digest = zip(*heads, strict=True)
        sizes = np.array([len(p) for p in parts], np.int64)
        told = features(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes))
        columns = {"doc_id": pa.array(doc, pa.int64()), "n_bytes": pa.array(plain, pa.int64()), "payload_bytes": pa.array(sizes), "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in parts]), "tail_crc32": pa.array([zlib.crc32(p[-UNIT:]) for p in parts], pa.int64())}
        columns |= {"media_bytes": pa.array(size, pa.int64()), "media_sha256": pa.array(digest, pa.string()), "feature": pa.array(told)}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def fold(batches):
        head, pieces = None, []  # of the stream that is open
        for batch in batches:
            starts = np.flatnonzero(batch.column(2).to_numpy() == 0)
            pcm = batch.column(4).to_pylist()
            cuts = [0, *starts.tolist(), batch.num_rows]
            heads, parts = [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < batch.num_rows and batch.column(2)[a].as_py() == 0 and a < b:
                    if head is not None:
                        heads.append(head)
                        parts.append(b"".join(pieces))
                    head, pieces = tuple(batch.column(i)[a].as_py() for i in (0, 5, 6, 7)), []
                pieces += pcm[a:b]
            if heads:
                yield digests(heads, parts)
        if head is not None:
            yield digests([head], [b"".join(pieces)])

    return blocks.mapInArrow(fold, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features of each stored stream, from its decoded blocks."""
    return folded(pcm_blocks(media))


def op6_media_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(flac_column(read_table(spark, sf_dir, "documents")))
