"""Token-id files: ids bit-packed at the least width of the vocabulary, with block offsets for random access.

A file holds, in little-endian order: the magic, then blocks of BLOCK ids (the last may be shorter, padded to 8 ids), then a
footer of block offsets, document ids, null marks and token counts, then a trailer of FIXED sizes. Eight ids of ``width`` bits
fill ``width`` bytes, so numpy packs and unpacks all groups of eight at once, with one shift for each byte that an id touches.
Files are written by the tasks that encode, each under a name of its own and moved into place when whole, and hold documents in
ascending order of ids; the shared folder may be any that pyarrow's file systems reach.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import query, short_batches, staged, table
from seriesloom.llm.tokens import MEMO_BYTES, encoder, public_file
from seriesloom.session import scratch_path

MAGIC, BLOCK = b"IDBITS01", 1 << 16
#: width, blocks, documents, ids, place of the footer, magic
TRAILER = struct.Struct("<QQQQQ8s")
#: Bytes of ids in a batch that a reader passes on.
READ_BYTES = 4 << 20


def width_of(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def _touching(width: int):
    """(id of eight, byte of width, shift): the id's bits, shifted right (or left, if negative) by shift, go to the byte."""
    return [(j, k, 8 * k - j * width) for j in range(8) for k in range(j * width // 8, ((j + 1) * width - 1) // 8 + 1)]


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids at ``width`` bits each; a last group of less than eight is filled with zeros."""
    full = np.zeros(-(-len(ids) // 8) * 8, np.uint64)
    full[:len(ids)] = ids
    full, out = full.reshape(-1, 8), np.zeros((len(full) // 8, width), np.uint8)
    for j, k, shift in _touching(width):
        part = full[:, j] >> np.uint64(shift) if shift >= 0 else full[:, j] << np.uint64(-shift)
        out[:, k] |= part.astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    """The first n ids of packed bytes."""
    groups = np.frombuffer(data, np.uint8).reshape(-1, width).astype(np.uint64)
    out = np.zeros((len(groups), 8), np.uint64)
    for j, k, shift in _touching(width):
        out[:, j] |= groups[:, k] << np.uint64(shift) if shift >= 0 else groups[:, k] >> np.uint64(-shift)
    return (out & np.uint64((1 << width) - 1)).astype(np.uint32).ravel()[:n]


class Writer:
    """Writes documents one after the other; holds one block of ids and the counts of the file's documents."""

    def __init__(self, stream, vocabulary: int):
        self.stream, self.width = stream, width_of(vocabulary)
        self.stream.write(MAGIC)
        self.at, self.offsets, self.held, self.parts = len(MAGIC), [], 0, []
        self.ids, self.counts, self.total = [], [], 0

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.offsets.append(self.at)
        self.stream.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError("an id does not fit the vocabulary")
        self.ids.append(doc_id)
        self.counts.append(len(ids))
        self.total += len(ids)
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            all_ids = np.concatenate(self.parts)
            whole = len(all_ids) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                self._block(all_ids[k:k + BLOCK])
            self.parts, self.held = [all_ids[whole:].copy()], len(all_ids) - whole

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.parts))
        null = np.array([x is None for x in self.ids], np.uint8)
        ids = np.array([x or 0 for x in self.ids], np.int64)
        for part in (np.array(self.offsets, np.uint64), ids, null, np.array(self.counts, np.uint64)):
            self.stream.write(part.tobytes())
        self.stream.write(TRAILER.pack(self.width, len(self.offsets), len(self.ids), self.total, self.at, MAGIC))


class Reader:
    """Random access to a file: reads the footer, then only the blocks that are asked for."""

    def __init__(self, stream):
        self.stream = stream
        end = stream.size()
        self.width, blocks, docs, self.total, at, magic = TRAILER.unpack(self._read(end - TRAILER.size, TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.end = at
        self.offsets = np.frombuffer(self._read(at, 8 * blocks), np.uint64)
        at += 8 * blocks
        ids = np.frombuffer(self._read(at, 8 * docs), np.int64)
        null = np.frombuffer(self._read(at + 8 * docs, docs), np.uint8)
        self.counts = np.frombuffer(self._read(at + 9 * docs, 8 * docs), np.uint64).astype(np.int64)
        self.doc_ids = [None if z else x for x, z in zip(ids.tolist(), null.tolist())]
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))
        self._last = (-1, None)

    def _read(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def _block(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            start = int(self.offsets[k])
            end = int(self.offsets[k + 1]) if k + 1 < len(self.offsets) else self.end
            self._last = (k, unpack(self._read(start, end - start), self.width, min(BLOCK, self.total - k * BLOCK)))
        return self._last[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from the position ``start`` of the file."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        parts = [self._block(k)[max(0, start - k * BLOCK):start + n - k * BLOCK]
                 for k in range(start // BLOCK, (start + n - 1) // BLOCK + 1)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.counts[k]))


def _open(folder: str):
    store, path = pafs.FileSystem.from_uri(folder)
    return store, path.rstrip("/")


def write(df: DataFrame, folder: str, tokenizer: str | None = None, text: str = "text", id: str = "doc_id",
          end_id: int = 0, split: bool = True, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """Encode all texts into files of the folder; returns their list (part, file, documents, ids), a staged frame.

    Documents are in ascending order of ids over the files by part, null ids first; equal ids are ordered by a hash of their
    texts. A null text is empty. ``end_id`` is added to each document. An empty table gives no files.
    Each Python worker remembers words and their ids up to ``memo_bytes``.
    """
    spark = df.sparkSession
    short_batches(spark)
    path = tokenizer
    rows = df.select(F.col(f"`{id}`").cast("long").alias("doc_id"),
                     F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        writer = stream = None
        for batch in batches:
            if writer is None:
                if not batch.num_rows:
                    continue
                encode = encoder(path or public_file(), split, memo_bytes)
                store, place = _open(folder)
                store.create_dir(place, recursive=True)
                part = TaskContext.get().partitionId()
                name, draft = f"part-{part:06d}.ids", f"{place}/.{uuid.uuid4().hex}"
                stream = store.open_output_stream(draft)
                writer = Writer(stream, encode.vocabulary)
            end = np.array([end_id], np.uint32)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                writer.add(doc_id, np.concatenate((ids, end)))
        if writer is not None:
            writer.close()
            stream.close()
            try:
                store.move(draft, f"{place}/{name}")
            except OSError:  # another attempt of this task has put the same file there
                if store.get_file_info(f"{place}/{name}").type == pafs.FileType.NotFound:
                    raise
                store.delete_file(draft)
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "documents": [len(writer.ids)],
                                              "ids": [writer.total]},
                                             pa.schema([("part", pa.int64()), ("file", pa.string()),
                                                        ("documents", pa.int64()), ("ids", pa.int64())]))

    return staged(rows.mapInArrow(run, "part long, file string, documents long, ids long"))


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start (ids before it, in the order of the files), n_tokens, and ids (binary, unsigned
    32-bit little-endian). Each file is read by a task of its own, a block at a time."""
    count = max(1, files.count())
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    placed = files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                store, place = _open(folder)
                with store.open_input_file(f"{place}/{name}") as stream:
                    reader, rows, size = Reader(stream), [], 0
                    for k, doc_id in enumerate(reader.doc_ids):
                        data = reader.document(k).astype("<u4").tobytes()
                        rows.append((doc_id, start + int(reader.starts[k]), int(reader.counts[k]), data))
                        size += len(data)
                        if size > READ_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)],
                                                             schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)],
                                                         schema=schema)

    return placed.repartitionByRange(count, "part").select("file", "start") \
        .mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


@query("op4_token_files")
def op4(spark, sf_dir):
    folder = scratch_path(spark, "tokens")
    files = write(table(spark, sf_dir, "documents"), folder, end_id=0, memo_bytes=192 << 20)
    return read(spark, folder, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
