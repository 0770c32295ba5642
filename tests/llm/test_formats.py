import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelflow.llm import chat_format, flac, packing

BITS = ["\\", "<", "|", "turn", "|>", "<|turn|>", "<|end|>", "\n", "[INST]", "</s>", "a", "/", "s>", "[", "]", " "]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=4), st.lists(st.one_of(st.sampled_from(BITS), st.text(max_size=3)), max_size=10))
def test_turns_survive_the_round_trip(role, text):
    role, text = "".join(role), "".join(text)
    rendered = chat_format.render_turn(role, text)
    got = chat_format.parse_turn(rendered)
    assert got[:2] == (role, text) and got[4] == len(rendered)
    inside = rendered[len(chat_format.OPEN) : -len(chat_format.CLOSE) - 1]
    assert not any(c in inside for c in chat_format.CONTROL)


def test_damaged_turns_are_errors():
    for bad in ("", "<|turn|>user", "<|turn|>user\nhi", "user\nhi<|end|>\n"):
        with pytest.raises(chat_format.ParseError):
            chat_format.parse_turn(bad)


def test_conversations_are_read_back(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (2, 0, None, None), (2, 1, "assistant", ""), (None, 0, "user", "lost"), (3, None, "system", "first"), (3, 0, "assistant", "<|end|>\nx"), (3, 0, "assistant", "<|end|>\nx"), (4, 0, "assistant", "long " * 50_000)]
    turns = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, n_turns int, formatted string").repartition(3)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(turns)).collect()}
    assert len(got) == 5
    for c, r in got.items():
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0))
        every = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars > len(every)
    assert chat_format.read_back(chat_format.format_turns(turns.limit(0))).collect() == []


def test_tokens_are_those_of_the_file():
    t = packing.tokenizer_of(packing.default_tokenizer())
    texts = ["", "Hello, World... 3.14's", "áb É x", "it's we've  don't. U.S.A.", "x\x1cy\x00z   É ǅ İ ΑΣ. ſ's", "日本語。テスト", "<|endoftext|> hi", "a!!?b...", "\x85ok\xa0no", "ẞ straße'LL"]
    for x in texts * 2:
        assert t.ids(x).tolist() == t.tokenizer.encode(x, add_special_tokens=False).ids, x


def test_token_cache_may_start_anew(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    t = packing.WordTokenizer(packing.default_tokenizer())
    for x in ("one two three four five six", "six seven eight nine", "one, two. three!"):
        assert t.ids(x).tolist() == t.tokenizer.encode(x, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), min_size=1, max_size=20))
def test_every_length_gets_its_places(counts):
    patterns = packing.pack_histogram(counts, 64)
    got: dict[int, int] = {}
    for packs, pattern in patterns:
        assert sum(n * k for n, k in pattern) <= 64 and packs > 0
        for n, k in pattern:
            got[n] = got.get(n, 0) + packs * k
    assert got == counts
    places = packing.Places(patterns)
    taken: dict[int, list[tuple[int, int]]] = {}
    for n, c in counts.items():
        s, o = places.of(np.full(c, n), np.arange(c))
        for a, b in zip(s.tolist(), o.tolist()):
            taken.setdefault(a, []).append((b, n))
    for spans in taken.values():
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end += n
        assert end <= 64


def test_packing_holds_every_id_once(spark, table, odd_rows):
    out = packing.pack(table(odd_rows), packing.default_tokenizer()).collect()
    t = packing.tokenizer_of(packing.default_tokenizer())
    pieces = {}
    for d, text, *_ in odd_rows:
        ids = np.array([*t.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for a in range(0, len(ids), 4096):
            k = (d, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes()), len(ids))
            pieces[k] = pieces.get(k, 0) + 1
    got = {}
    for r in out:
        k = (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
        got[k] = got.get(k, 0) + 1
    assert got == pieces
    end = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end.get(r.sequence_id, 0)
        end[r.sequence_id] = r.offset + r.length
    assert max(end.values()) <= 4096
    assert packing.pack(table([]), packing.default_tokenizer()).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=3000), min_size=1, max_size=6), st.integers(0, 3))
def test_flac_is_lossless(payloads, repeat):
    payloads = [p * (1 + repeat * 5) for p in payloads]
    sizes = np.array([len(p) for p in payloads])
    streams = flac.encode(np.frombuffer(b"".join(payloads), np.uint8), sizes)
    pcm, stream, sample, n = flac.decode(streams)
    assert pcm.tobytes() == b"".join(payloads)
    assert all(sample[i] == (0 if i == 0 or stream[i] != stream[i - 1] else sample[i - 1] + n[i - 1]) for i in range(len(n)))


def test_flac_streams_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    parts = [rng.integers(97, 123, 64 * k, dtype=np.uint8) for k in (1, 3, 40, 70)] + [np.zeros(128, np.uint8), rng.integers(0, 256, 5000, dtype=np.uint8)]
    together = flac.encode(np.concatenate(parts), np.array([len(p) for p in parts]))
    assert together == [flac.encode(p, np.array([len(p)]))[0] for p in parts]
    assert len(together[3]) < len(parts[3])


def test_damaged_streams_are_errors():
    media = flac.encode(np.frombuffer(b"some text, some more text. " * 90, np.uint8), np.array([27 * 90]))[0]
    for at in (1, len(media) - 1, len(media) - 300, media.find(b"\xff\xf8") + 4):
        bad = bytearray(media)
        bad[at] ^= 0x10
        with pytest.raises(flac.FlacError):
            flac.decode([bytes(bad)])


def test_media_are_read_back(spark, table, odd_rows):
    docs = table(odd_rows)
    out = flac.read_media(flac.flac_column(docs)).collect()
    assert len(out) == len(odd_rows)
    want = {}
    for d, text, *_ in odd_rows:
        b = (text or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        want.setdefault(d, set()).add((len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    for r in out:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in want[r.doc_id]
    assert len({(r.media_sha256, r.feature) for r in out if r.doc_id in (6, 7, 13)}) == 1
    blocks = flac.pcm_blocks(flac.flac_column(docs)).where("doc_id = 9").orderBy("sample_offset").collect()
    assert b"".join(bytes(b.pcm) for b in blocks).rstrip(b"\0") == next(t for d, t in odd_rows if d == 9).encode()
    assert [b.sample_offset for b in blocks] == [1024 * i for i in range(len(blocks))]
    assert flac.read_media(flac.flac_column(table([]))).collect() == []
