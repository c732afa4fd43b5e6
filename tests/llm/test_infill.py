"""Fill-in-the-middle over compressed frames against plain string work."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from seriesloom.llm import infill as I
from tests.llm.fixtures import corpus, frame


def by_hand(id, text, seed=1, plain=10, spm=20, marks=I.SENTINELS):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in marks) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), marks[1] + s + marks[0] + p + marks[2] + m
    return n, "psm", len(p), len(m), marks[0] + p + marks[1] + s + marks[2] + m


def odd():
    r = random.Random(2)
    texts = ["".join(r.choice("abZ<PSM>é 日\n9😀") for _ in range(r.randint(0, 60))) for _ in range(80)]
    texts += ["<", "<P", "x" * 500, "é" * 200, "a<P>b", "ab<" * 9 + "S>", "<M>", "日" * 7 + "<P>" + "y" * 40, "@[`{AZaz" * 20]
    texts += ["x" * k + "<S>" for k in range(1, 20)]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)]


@pytest.mark.parametrize("size", [4, 7, 64, 1 << 16])
def test_forms(spark, size):
    rows = corpus() + odd()
    df = frame(spark, rows, True).withColumns({c: F.lit("clash") for c in ("n", "form", "output", "frames", "_id", "_text")})
    done = I.infill(I.compressed(df, frame_bytes=size), frame_bytes=size)
    got = I.texts(done).collect()
    assert got[0].__fields__ == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_text", "restored_text"]
    want = [(r[0], *by_hand(r[0], r[1]), r[1] or "") for r in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = I.digests(done).select("doc_id", "output_sha256", "restored_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((w[0], sha(w[5]), sha(w[6]))) for w in want)


def test_parameters(spark):
    rows = odd()
    marks = ("[pre]", "(suf)", "{mid}")
    got = I.texts(I.infill(I.compressed(frame(spark, rows)), seed=7, plain=0, spm=100, sentinels=marks), marks).collect()
    assert sorted((r.doc_id, r.form, r.output_text, r.restored_text) for r in got) == sorted(
        (r[0], *[by_hand(r[0], r[1], 7, 0, 100, marks)[k] for k in (1, 4)], r[1]) for r in rows)
    for bad in (("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("aa", "b", "c"), ("", "b", "c"), ("xay", "a", "c")):
        with pytest.raises(ValueError):
            I.infill(I.compressed(frame(spark, rows)), sentinels=bad)
    with pytest.raises(ValueError):
        I.compressed(frame(spark, rows), frame_bytes=3)


def test_frames():
    """A cut opens one frame, and frames end between code points."""
    text = ("Word é日 " * 4000).encode()
    frames = I.Frames.of([text[:1001], b"", text[1001:]], 256)
    assert b"".join(frames.stream()) == text and all(frames.plain(k).decode() for k in range(len(frames.data)))
    opened = []
    plain = frames.plain
    frames.plain = lambda k: opened.append(k) or plain(k)
    units = [m.end() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text.decode())]
    for c in (1, 7, 9_999, len(units) - 1):
        del opened[:]
        at, chars = frames.locate(c)
        assert len(opened) == 1 and chars == units[c - 1] and text[:at].decode() == text.decode()[:chars]
        del opened[:]
        assert b"".join(frames.stream(at, at + 10)) == text[at:at + 10] and len(opened) <= 2
    assert frames.locate(0) == (0, 0) and frames.locate(10**9) == (len(text), len(text.decode()))
    again = I.Frames.from_rows(frames.rows())
    assert (again.units, again.chars, again.bytes, again.joins) == (frames.units, frames.chars, frames.bytes, frames.joins)
    assert I.Frames.of([]).rows() == [] and I.Frames.from_rows(None).locate(0) == (0, 0)


def test_long_and_empty(spark):
    text = "Some words, 日本 and more.\n" * 100_000
    rows = [(i, text, None, None, 0) for i in range(3)]
    got = I.digests(I.infill(I.compressed(frame(spark, rows)))).collect()
    want = hashlib.sha256(text.encode()).hexdigest()
    assert all(r.restored_sha256 == want and r.n == by_hand(r.doc_id, text)[0] for r in got) and len(got) == 3
    none = frame(spark, [])
    assert I.digests(I.infill(I.compressed(none))).collect() == [] == I.texts(I.infill(I.compressed(none))).collect()
