"""Fill-in-the-middle examples over seekable compressed texts.

A text is stored as independent zstandard frames of bounded size, each with the numbers of units, code points and bytes in
front of it. A unit is a run of ASCII letters or one other code point. To cut after c units, the frame that holds the start of
unit c is found by its cumulative count and is the only one that is decompressed; output and digests are streamed frame by
frame, in the order of the pieces. So a task holds the compressed texts of a batch and one plain frame at a time. Rows are
worked on where they lie: nothing is shuffled. Frames are ordinary columns, fit to be written as Parquet and cut later.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import query, short_batches, table, text_bytes

#: Plain bytes in a frame.
FRAME_BYTES = 1 << 16
#: Marks in front of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")

FRAMES = "array<struct<data: binary, units: long, chars: long, bytes: long, joins: boolean>>"
_FRAMES = pa.list_(pa.struct([("data", pa.binary()), ("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()),
                              ("joins", pa.bool_())]))

_pack, _unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _marks(a: np.ndarray, joins: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Where units start, where code points start, and whether the last byte is a letter. ``joins``: a letter comes before."""
    letter = ((a | 32) - np.uint8(97)) < 26
    point = (a & 0xC0) != 0x80
    before = np.empty(len(a), bool)
    before[:1], before[1:] = joins, letter[:-1]
    return np.where(letter, ~before, point), point, bool(letter[-1]) if len(a) else joins


class Frames:
    """Frames of one text with what lies before each; the last entry of each count is that of the whole text."""

    def __init__(self, data: list[bytes], units: list[int], chars: list[int], sizes: list[int], joins: list[bool]):
        self.data, self.units, self.chars, self.bytes, self.joins = data, units, chars, sizes, joins

    @classmethod
    def of(cls, chunks: Iterable[bytes], size: int = FRAME_BYTES) -> Frames:
        """Compress a text that comes in pieces; frames end between code points."""
        out = cls([], [0], [0], [0], [False])
        held = bytearray()
        for chunk in chunks:
            held += chunk
            at = 0
            while len(held) - at >= size + 4:
                cut = at + size
                while cut > at + size - 3 and held[cut] & 0xC0 == 0x80:
                    cut -= 1
                out._add(bytes(held[at:cut]))
                at = cut
            if at:
                del held[:at]
        if held:
            out._add(bytes(held))
        return out

    def _add(self, plain: bytes) -> None:
        unit, point, last = _marks(np.frombuffer(plain, np.uint8), self.joins[-1])
        self.data.append(_pack.compress(plain))
        self.units.append(self.units[-1] + int(np.count_nonzero(unit)))
        self.chars.append(self.chars[-1] + int(np.count_nonzero(point)))
        self.bytes.append(self.bytes[-1] + len(plain))
        self.joins.append(last)

    def rows(self) -> list[dict]:
        """As a column value: cumulative counts are those at the end of each frame, ``joins`` that of its last byte."""
        return [dict(zip(("data", "units", "chars", "bytes", "joins"), x))
                for x in zip(self.data, self.units[1:], self.chars[1:], self.bytes[1:], self.joins[1:])]

    @classmethod
    def from_rows(cls, rows: list[dict] | None) -> Frames:
        rows = rows or []
        return cls([r["data"] for r in rows], [0] + [r["units"] for r in rows], [0] + [r["chars"] for r in rows],
                   [0] + [r["bytes"] for r in rows], [False] + [r["joins"] for r in rows])

    def plain(self, k: int) -> bytes:
        return _unpack.decompress(self.data[k])

    def locate(self, unit: int) -> tuple[int, int]:
        """Bytes and code points in front of unit number ``unit`` (from 0); one frame is decompressed."""
        if unit >= self.units[-1]:
            return self.bytes[-1], self.chars[-1]
        k = bisect_right(self.units, unit) - 1
        starts, point, _ = _marks(np.frombuffer(self.plain(k), np.uint8), self.joins[k])
        at = int(np.flatnonzero(starts)[unit - self.units[k]])
        return self.bytes[k] + at, self.chars[k] + int(np.count_nonzero(point[:at]))

    def stream(self, start: int = 0, end: int | None = None) -> Iterator[bytes]:
        """The bytes from ``start`` to ``end``; frames outside are not touched."""
        end = self.bytes[-1] if end is None else end
        k = bisect_right(self.bytes, start) - 1
        while k < len(self.data) and self.bytes[k] < end:
            plain = self.plain(k)
            yield plain[max(0, start - self.bytes[k]):end - self.bytes[k]]
            k += 1

    def find(self, mark: bytes) -> int:
        """Place of the first occurrence of a mark, -1 if there is none; marks may lie across frames."""
        tail, at = b"", 0
        for k in range(len(self.data)):
            piece = tail + self.plain(k)
            hit = piece.find(mark)
            if hit >= 0:
                return at - len(tail) + hit
            at = self.bytes[k + 1]
            tail = piece[-(len(mark) - 1):] if len(mark) > 1 else b""
        return -1


def _checked(sentinels: tuple[str, str, str]) -> tuple[bytes, bytes, bytes]:
    """The sentinels as bytes. Neither lies in another and no end of one starts another, so none can arise where pieces meet."""
    marks = tuple(s.encode() for s in sentinels)
    clash = any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)) + (a is not b)))
    if len(set(marks)) < 3 or not all(marks) or clash or any(a in b for a in marks for b in marks if a != b):
        raise ValueError(f"sentinels overlap: {sentinels}")
    return marks


def compressed(df: DataFrame, text: str = "text", id: str = "doc_id", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The id and the ``frames`` of each text, row by row. Null and empty texts have no frames; ids may be null or repeat."""
    if frame_bytes < 4:
        raise ValueError("a frame needs at least four bytes")
    short_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            frames = [Frames.of([v.as_buffer().to_pybytes()], frame_bytes).rows() for v in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(frames, _FRAMES)], ["_id", "frames"])

    rows = df.select(F.col(f"`{id}`").cast("long").alias("_id"), text_bytes(F.col(f"`{text}`")).alias("_text"))
    return rows.mapInArrow(run, f"_id long, frames {FRAMES}").withColumnRenamed("_id", id)


def _transform(frames: Frames, id: int | None, seed: int, plain: int, spm: int, marks: tuple) -> tuple:
    """Units, form, code points of prefix and middle, and the pieces of the output."""
    digest = hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = frames.units[-1]
    if not n or h[2] % 100 >= 100 - plain or any(frames.find(m) >= 0 for m in marks):
        return n, "plain", None, None, frames.stream()
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    (a, chars), (b, more) = frames.locate(a), frames.locate(b)
    prefix, middle, suffix = frames.stream(0, a), frames.stream(a, b), frames.stream(b)
    p, s, m = ([mark] for mark in marks)
    if h[3] % 100 < spm:
        return n, "spm", chars, more - chars, chain(s, suffix, p, prefix, m, middle)
    return n, "psm", chars, more - chars, chain(p, prefix, s, suffix, m, middle)


def infill(stored: DataFrame, id: str = "doc_id", seed: int = 1, plain: int = 10, spm: int = 20,
           sentinels: tuple[str, str, str] = SENTINELS, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Fill-in-the-middle form of stored texts: id, n (units), form, prefix_chars, middle_chars, ``output`` (frames).

    Cuts and form come from the SHA-256 of seed and id, so reruns agree and rows that repeat an id with a text give the same
    row; a null id hashes as an empty one. ``plain`` and ``spm`` are percentages; empty texts and texts that contain a
    sentinel stay plain, with null character counts. Only id and ``frames`` of the input are read.
    """
    marks = _checked(sentinels)
    short_batches(stored.sparkSession)
    shape = f"_id long, n long, form string, prefix_chars long, middle_chars long, output {FRAMES}"

    def run(batches):
        for batch in batches:
            out = []
            for key, rows in zip(batch.column("_id").to_pylist(), batch.column("frames")):
                *said, pieces = _transform(Frames.from_rows(rows.as_py()), key, seed, plain, spm, marks)
                out.append((*said, Frames.of(pieces, frame_bytes).rows()))
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), _FRAMES]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                             ["_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = stored.select(F.col(f"`{id}`").cast("long").alias("_id"), "frames")
    return rows.mapInArrow(run, shape).withColumnRenamed("_id", id)


def _restored(frames: Frames, form: str, marks: tuple) -> Iterator[bytes]:
    """The text that an output was made of, from the output and its form alone."""
    p, s, m = marks
    if form == "plain":
        return frames.stream()
    last = frames.find(m)
    if form == "psm":
        between = frames.find(s)
        return chain(frames.stream(len(p), between), frames.stream(last + len(m)), frames.stream(between + len(s), last))
    between = frames.find(p)
    return chain(frames.stream(between + len(p), last), frames.stream(last + len(m)), frames.stream(len(s), between))


def _read_back(done: DataFrame, add: list[tuple[str, pa.DataType]], make) -> DataFrame:
    """``done`` without its frames, and with what ``make(frames, form)`` derives from them."""
    short_batches(done.sparkSession)
    names = [c for c in done.columns if c != "output"]
    schema = ", ".join([f"`{n}` {done.schema[n].dataType.simpleString()}" for n in names] + [f"{n} string" for n, _ in add])

    def run(batches):
        for batch in batches:
            got = [make(Frames.from_rows(rows.as_py()), form)
                   for rows, form in zip(batch.column("output"), batch.column("form").to_pylist())]
            cols = [pa.array(c, k) for c, (_, k) in zip(list(zip(*got)) or [()] * len(add), add)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *cols], [*names, *[n for n, _ in add]])

    return done.mapInArrow(run, schema)


def _sha256(pieces: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for piece in pieces:
        digest.update(piece)
    return digest.hexdigest()


def digests(done: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The rows of ``infill`` with SHA-256 of the output and of the text restored from it, streamed frame by frame."""
    marks = _checked(sentinels)
    return _read_back(done, [("output_sha256", pa.string()), ("restored_sha256", pa.string())],
                      lambda frames, form: (_sha256(frames.stream()), _sha256(_restored(frames, form, marks))))


def texts(done: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The rows of ``infill`` with ``output_text`` and ``restored_text`` instead of frames."""
    marks = _checked(sentinels)
    return _read_back(done, [("output_text", pa.string()), ("restored_text", pa.string())],
                      lambda frames, form: (b"".join(frames.stream()).decode("utf-8", "replace"),
                                            b"".join(_restored(frames, form, marks)).decode("utf-8", "replace")))


@query("op11_fill_in_middle", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1,
             ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3,
             ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
             greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, n, form, t, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle,
             array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
""")
def op11(spark, sf_dir):
    return digests(infill(compressed(table(spark, sf_dir, "documents"))))
