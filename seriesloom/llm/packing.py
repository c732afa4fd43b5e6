"""Packing token ids into sequences: first-fit decreasing with a tournament tree, in randomised groups of documents.

Documents are encoded, cut into pieces of at most ``capacity`` ids and dealt to groups by a hash. Spark sorts a group by falling
length, so a task places each piece as it comes, passes it on at once and keeps only the free room of the group's sequences: a
tournament tree whose nodes hold the largest room below leads to the first sequence that fits in logarithmic time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import query, short_batches, table
from seriesloom.llm.tokens import MEMO_BYTES, encoder, public_file

#: Documents in a group on average. The padding of first-fit decreasing shrinks with it, the tree grows with it.
GROUP = 1024
#: Bytes of ids in a batch passed on by a task.
OUT_BYTES = 4 << 20


class Tournament:
    """Rooms of sequences under a tree of maxima; ``place`` puts a length into the first that fits, or opens one."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves, self.count = capacity, 1, 0
        self.best = [0, 0]

    def _open(self) -> int:
        if self.count == self.leaves:
            rooms = self.best[self.leaves:]
            self.leaves *= 2
            self.best = [0] * self.leaves + rooms + [0] * (self.leaves - len(rooms))
            for k in range(self.leaves - 1, 0, -1):
                self.best[k] = max(self.best[2 * k], self.best[2 * k + 1])
        self.count += 1
        return self.count - 1

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset in it)"""
        best = self.best
        if best[1] >= length:
            k = 1
            while k < self.leaves:
                k *= 2
                if best[k] < length:
                    k += 1
            room = best[k]
        else:
            at = self._open()
            best, k, room = self.best, self.leaves + at, self.capacity
        sequence, best[k] = k - self.leaves, room - length
        while k > 1:
            k //= 2
            top = best[2 * k] if best[2 * k] >= best[2 * k + 1] else best[2 * k + 1]
            if best[k] == top:
                break
            best[k] = top
        return sequence, self.capacity - room


def pieces(df: DataFrame, tokenizer: str | None = None, text: str = "text", id: str = "doc_id", end_id: int = 1,
           capacity: int = 2048, group: int = GROUP, split: bool = True, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """Pieces of all documents before packing: group, length, doc_id, start, doc_tokens, ids (packed at 2 or 4 bytes)."""
    spark = df.sparkSession
    short_batches(spark)
    path = tokenizer
    rows = df.select(F.col(f"`{id}`").cast("long").alias("doc_id"),
                     F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    groups = max(1, -(-rows.count() // group))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))
    schema = pa.schema([("group", pa.int64()), ("length", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()),
                        ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    def run(batches):
        encode, end = encoder(path or public_file(), split, memo_bytes), np.array([end_id], np.uint32)
        for batch in batches:
            out, size = [], 0
            found = encode(batch.column("text").to_pylist())
            for k, doc_id, ids in zip(batch.column("group").to_pylist(), batch.column("doc_id").to_pylist(), found):
                ids = np.concatenate((ids, end)).astype(encode.kind)
                for start in range(0, len(ids), capacity):
                    part = ids[start:start + capacity]
                    out.append((k, len(part), doc_id, start, len(ids), part.tobytes()))
                    size += 2 * len(part)
                if size > OUT_BYTES:
                    yield batch_of(out)
                    out, size = [], 0
            if out:
                yield batch_of(out)

    return rows.select("group", "doc_id", "text").mapInArrow(
        run, "group long, length int, doc_id long, start long, doc_tokens long, ids binary")


def pack(df: DataFrame, tokenizer: str | None = None, text: str = "text", id: str = "doc_id", end_id: int = 1,
         capacity: int = 2048, group: int = GROUP, split: bool = True, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, unsigned 32-bit little-endian).

    Every id of every document is in just one piece. Offsets of a sequence run on without gaps from 0. Null texts are empty
    and have the end id alone; null ids and repeated rows are documents of their own. Equal input gives equal sequences,
    whatever its order. An empty table gives no pieces. Bins of a group are numbered from 0 and the group goes to the upper
    32 bits of sequence_id. Each Python worker remembers words and their ids up to ``memo_bytes``.
    """
    found = pieces(df, tokenizer, text, id, end_id, capacity, group, split, memo_bytes)
    by_length = found.repartition("group").sortWithinPartitions("group", F.desc("length"), "doc_id", "start", "ids")

    def run(batches):
        tree = now = None
        for batch in batches:
            lengths, groups = batch.column("length").to_pylist(), batch.column("group").to_pylist()
            sequences, offsets, ids = [], [], []
            for k, n, data in zip(groups, lengths, batch.column("ids").to_pylist()):
                if k != now:
                    tree, now, full = Tournament(capacity), k, 0
                if n == capacity:  # these come first and leave no room
                    sequence, offset = full, 0
                    full += 1
                else:
                    sequence, offset = tree.place(n)
                    sequence += full
                sequences.append((k << 32) + sequence)
                offsets.append(offset)
                kind = np.uint16 if len(data) == 2 * n else np.uint32
                ids.append(np.frombuffer(data, kind).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("length").cast(pa.int64()),
                 batch.column("doc_tokens"), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64()),
                 pa.array(ids, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return by_length.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, "
                                     "offset long, ids binary")


def sequences(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Whole sequences: sequence_id, fill, padded_length (fill itself at a power of two, else capacity), ids, doc_ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most ``capacity`` pieces
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill"), parts.alias("parts"))
    even = F.bit_count("fill") == 1
    joined = F.aggregate("parts", F.lit("").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return whole.select("sequence_id", "fill", F.when(even, F.col("fill")).otherwise(F.lit(capacity)).cast("long")
                        .alias("padded_length"), joined.alias("ids"), F.transform("parts", lambda p: p["doc_id"])
                        .alias("doc_ids"))


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


@query("op6_packing")
def op6(spark, sf_dir):
    return digest(pack(table(spark, sf_dir, "documents"), end_id=1, memo_bytes=192 << 20))
