"""Exact dedup: owners of equal texts, found in Patricia tries over length-and-content-hash partitions.

Each map task first inserts its texts into a small trie and passes on one row per distinct text (owner and count), so a
text that fills a third of the table costs one row per task. Those rows are partitioned and sorted by (byte length, content
hash) and inserted, as full byte strings, into a compressed radix trie whose terminal nodes hold the owner. When the bytes
held pass the budget, the finished subtree (all keys before the current length and hash) is written out and freed; equal
texts share length and hash, so none straddles two subtrees. Sorting is Spark's and spills by itself.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import attach, query, short_batches, staged, table, text_bytes

#: Bytes of text that a task holds in its trie before it writes out finished subtrees.
SUBTREE_BYTES = 16 << 20


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection over slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Compressed radix trie over byte strings; ``insert`` returns a number that is the same for equal strings."""

    def __init__(self):
        self.root = [b"", {}, None]  # label of the edge above, children by first byte, terminal number
        self.size = 0

    def insert(self, key: bytes) -> int:
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = [key[at:], {}, None]
                node[1][key[at]] = child
                node = child
                break
            label = child[0]
            if not key.startswith(label, at):
                cut = _shared(label, key[at:at + len(label)])
                upper = [label[:cut], {label[cut]: child}, None]
                child[0] = label[cut:]
                node[1][key[at]] = upper
                child = upper
                label = upper[0]
            node, at = child, at + len(label)
        if node[2] is None:
            node[2] = self.size
            self.size += 1
        return node[2]


def _better(one, other, largest: bool) -> bool:
    """Whether (id, tie) one owns a text before other: null ids come last, equal ids go by the smaller tie."""
    if one[0] is None or other[0] is None:
        return other[0] is None and (one[0] is not None or one[1] < other[1])
    if one[0] != other[0]:
        return (one[0] > other[0]) is largest
    return one[1] < other[1]


class _Owners:
    """The trie of one subtree with the owner row of each terminal node."""

    def __init__(self, largest: bool):
        self.largest, self.chunks, self.held = largest, [], 0
        self.trie, self.owner = PatriciaTrie(), []  # owner: [id, tie, rows, chunk, place]

    def add(self, batch: pa.RecordBatch) -> None:
        texts, ids = batch.column("_text").to_pylist(), batch.column("_id").to_pylist()
        ties, counts = batch.column("_tie").to_pylist(), batch.column("_n").to_pylist()
        rows: dict[int, int] = {}
        for i, text in enumerate(texts):
            k = self.trie.insert(text)
            if k == len(self.owner):
                self.owner.append([ids[i], ties[i], counts[i], None, None])
                self.held += len(text) + 200
                rows[k] = i
            else:
                o = self.owner[k]
                o[2] += counts[i]
                if _better((ids[i], ties[i]), o, self.largest):
                    o[0], o[1] = ids[i], ties[i]
                    rows[k] = i
        if rows:
            for place, k in enumerate(rows):
                self.owner[k][3:] = len(self.chunks), place
            self.chunks.append(batch.take(pa.array(list(rows.values()), pa.int64())))

    def batches(self):
        if not self.owner:
            return
        starts, total = [], 0
        for c in self.chunks:
            starts.append(total)
            total += c.num_rows
        out = pa.Table.from_batches(self.chunks).take(pa.array([starts[o[3]] + o[4] for o in self.owner], pa.int64()))
        at = out.schema.get_field_index("_n")
        out = out.set_column(at, out.schema.field(at), pa.array([o[2] for o in self.owner], pa.int64()))
        yield from out.to_batches(max_chunksize=512)


def _insert(largest: bool, budget: int, sorted_by_key: bool):
    def run(batches):
        own, last = _Owners(largest), None
        for batch in batches:
            if own.held > budget:
                cut = 0
                if sorted_by_key:
                    keys = zip(batch.column("_length").to_pylist(), batch.column("_hash").to_pylist())
                    cut = next((i for i, k in enumerate(keys) if k != last), batch.num_rows)
                if cut:
                    own.add(batch.slice(0, cut))
                batch = batch.slice(cut)
                if batch.num_rows or not sorted_by_key:
                    yield from own.batches()
                    own = _Owners(largest)
            if batch.num_rows:
                own.add(batch)
                if sorted_by_key:
                    end = batch.num_rows - 1
                    last = (batch.column("_length")[end].as_py(), batch.column("_hash")[end].as_py())
        yield from own.batches()

    return run


def owners(df: DataFrame, text: str = "text", id: str = "doc_id", keep: str = "smallest",
           subtree_bytes: int = SUBTREE_BYTES) -> DataFrame:
    """One row per distinct text: the row that owns it, with all its columns, ``group_size`` and ``text_sha256``.

    keep: "smallest" or "largest" id owns. Null texts count as empty ones. Null ids own only where all ids are null; rows
    with equal text and id are told apart by a hash of their other columns, and the copies fall together. An empty table
    gives an empty result. Columns called group_size or text_sha256 in the input are replaced.
    """
    made = {"group_size": "_sl_rows", "text_sha256": "_sl_sha256"}
    own = _own(df, text, id, keep, subtree_bytes)
    return own.select(
        *[F.col(f"`{c}`") for c in df.columns if c.lower() not in made], *[F.col(v).alias(k) for k, v in made.items()])


def _own(df: DataFrame, text: str, id: str, keep: str, subtree_bytes: int = SUBTREE_BYTES) -> DataFrame:
    """The owner rows with all columns of the input, _sl_rows and _sl_sha256."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    short_batches(df.sparkSession)
    names = df.columns
    others = [c for c in names if c != text]
    body = text_bytes(F.col(f"`{text}`"))
    rows = df.select(
        F.octet_length(body).alias("_length"), F.xxhash64(body).alias("_hash"),
        F.col(f"`{id}`").cast("long").alias("_id"),
        F.xxhash64(F.col(f"`{text}`").isNull(), *[F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) for c in others])
        .alias("_tie"),
        F.lit(1).cast("long").alias("_n"), F.col(f"`{text}`").isNull().alias("_null"), body.alias("_text"),
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("_row"))
    largest = keep == "largest"
    local = rows.mapInArrow(_insert(largest, subtree_bytes, False), rows.schema)
    by_key = local.repartition("_length", "_hash").sortWithinPartitions("_length", "_hash")
    found = by_key.mapInArrow(_insert(largest, subtree_bytes, True), rows.schema)
    back = {c: F.col(f"_row.c{i}") for i, c in enumerate(others)}
    back[text] = F.when(~F.col("_null"), F.col("_text").cast("string"))
    return found.select(*[back[c].alias(c) for c in names], F.col("_n").alias("_sl_rows"),
                        F.sha2(F.col("_text"), 256).alias("_sl_sha256"))


def drop_copies(df: DataFrame, text: str = "text", id: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """The rows that own their text, with the columns of the input."""
    return _own(df, text, id, keep).select(*[F.col(f"`{c}`") for c in df.columns])


def groups(df: DataFrame, text: str = "text", id: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The tries decide on full bytes; the way back from a document to its group goes by (length, SHA-256) of its text. Rows
    that repeat both id and text are one document read twice and share its ``kept``.
    """
    own = owners(df.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")),
                 "text", "doc_id", keep)
    classes = staged(own.select("text_sha256", F.octet_length(text_bytes(F.col("text"))).alias("_length"),
                                F.col("doc_id").alias("keep_id"), "group_size"))
    body = text_bytes(F.col(f"`{text}`"))
    rows = df.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.sha2(body, 256).alias("text_sha256"),
                     F.octet_length(body).alias("_length"))
    return attach(rows, classes, ["text_sha256", "_length"], "group_size").select(
        F.col("doc_id").alias(id), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256")


@query("op9_exact_dedup", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
""")
def op9(spark, sf_dir):
    return groups(table(spark, sf_dir, "documents"), keep="largest")
