"""Token files and packing: equal to whole-text encoding, exact round trips, gapless sequences."""

import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from seriesloom.llm import packing, token_files, tokens
from seriesloom.session import scratch_path
from tests.llm.fixtures import corpus, frame


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.public_file())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer(tokenizer):
    texts = [t or "" for _, t, *_ in corpus()] + [
        "a<|endoftext|>b", "it's  ok\t1", "\x1c a", "! \x85 a", "x y z", " a", "a ", "a\nb c\nd", "don't 'tis",
        "é" * 50 + " " + "x" * 100, "12 345 6,7", "  a b", "a　b c", "￿ \U0001f600 ok", "a ​b"]
    encode = tokens.Encoder(tokens.public_file())
    for _ in range(2):  # without and with words remembered
        for t, ids in zip(texts, encode(texts)):
            assert ids.tolist() == ids_of(tokenizer, t), t[:60]


def test_full_memo_changes_nothing(tokenizer):
    texts = [t or "" for _, t, *_ in corpus()]
    encode = tokens.Encoder(tokens.public_file(), memo_bytes=4000)
    for t in texts:
        assert encode([t])[0].tolist() == ids_of(tokenizer, t)
    assert 10 < len(encode.memo) <= 4000 // tokens.ENTRY_BYTES + 1
    nothing = tokens.Encoder(tokens.public_file(), memo_bytes=0)
    assert [x.tolist() for x in nothing(texts)] == [ids_of(tokenizer, t) for t in texts] and not nothing.memo


def test_slices_of_long_texts_change_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", 30)
    texts = [t or "" for _, t, *_ in corpus()] + ["a\nb " * 40 + "c", "x" * 90 + "\n" + "y" * 90, "x" * 90 + " " + "y" * 31]
    encode = tokens.Encoder(tokens.public_file())
    for _ in range(2):
        for t, ids in zip(texts, encode(texts)):
            assert ids.tolist() == ids_of(tokenizer, t), t[:60]


@pytest.mark.parametrize("width", range(1, 33))
def test_bits_round_trip(width):
    r = np.random.default_rng(width)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = r.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
        data = token_files.pack(ids, width)
        assert len(data) == -(-n // 8) * width
        assert np.array_equal(token_files.unpack(data, width, n), ids)


class Stream(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_random_access(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 16)
    r, stream = random.Random(0), Stream()
    docs = [(k if k % 3 else None, np.array([r.randrange(50257) for _ in range(r.choice([0, 1, 5, 16, 100]))], np.uint32))
            for k in range(40)]
    writer = token_files.Writer(stream, 50257)
    for k, ids in docs:
        writer.add(k, ids)
    writer.close()
    reader = token_files.Reader(stream)
    assert reader.width == 16 and reader.doc_ids == [k for k, _ in docs]
    for k in r.sample(range(40), 40):
        assert np.array_equal(reader.document(k), docs[k][1])
    whole = np.concatenate([d for _, d in docs])
    for _ in range(50):
        a = r.randrange(len(whole))
        n = r.randrange(len(whole) - a)
        assert np.array_equal(reader.ids(a, n), whole[a:a + n])
    with pytest.raises(ValueError):
        writer.add(1, np.array([70000], np.uint32))


def test_files_of_a_corpus(spark, tokenizer):
    rows = corpus()
    folder = scratch_path(spark, "test")
    files = token_files.write(frame(spark, rows, True), folder)
    got = token_files.read(spark, folder, files).collect()
    want = sorted(((d is not None, d or 0), tuple(ids_of(tokenizer, t)) + (0,)) for d, t, *_ in rows)
    got = sorted(got, key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [k for k, _ in want]
    assert sorted((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got if r.doc_id is not None) == \
        [(k[1], ids) for k, ids in want if k[0]]
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    none = scratch_path(spark, "test")
    assert token_files.read(spark, none, token_files.write(frame(spark, []), none)).collect() == []


def test_tournament_is_first_fit():
    r = random.Random(0)
    lengths = sorted((r.randint(1, 100) for _ in range(500)), reverse=True)
    tree, rooms = packing.Tournament(100), []
    for n in lengths:
        k = next((i for i, room in enumerate(rooms) if room >= n), len(rooms))
        if k == len(rooms):
            rooms.append(100)
        assert tree.place(n) == (k, 100 - rooms[k])
        rooms[k] -= n


@pytest.mark.parametrize("capacity,group", [(2048, 1024), (64, 10)])
def test_packing(spark, tokenizer, capacity, group):
    rows = corpus()
    df = frame(spark, rows, True)
    packed = packing.pack(df, capacity=capacity, group=group)
    got = packing.digest(packed).collect()
    docs = {}
    for d, t, *_ in rows:
        ids = ids_of(tokenizer, t) + [1]
        for s in range(0, len(ids), capacity):
            part = ids[s:s + capacity]
            docs.setdefault((d, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)), []).append(0)
    seen = {}
    for r in got:
        seen.setdefault(tuple(r)[:5], []).append(0)
    assert seen == docs
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    whole = packing.sequences(packed, capacity).collect()
    assert {w.sequence_id: w.fill for w in whole} == {k: sum(n for _, n in v) for k, v in by.items()}
    assert all(len(w.ids) == 4 * w.fill and w.padded_length in (w.fill, capacity) for w in whole)
    key = lambda rs: sorted(map(str, rs))
    assert key(got) == key(packing.digest(packing.pack(frame(spark, rows[::-1]), capacity=capacity, group=group)).collect())
    assert packing.pack(frame(spark, [])).collect() == []
