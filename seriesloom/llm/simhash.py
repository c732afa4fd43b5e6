"""SimHash near-dedup: fingerprints, vantage-point shards with overlapping boundaries, and components of the links.

Fingerprints that differ in at most ``max_bits`` bits differ in at most max_bits // trees bits of at least one of ``trees``
bands of the fingerprint. So every band has a vantage-point tree of its own, whose metric is the Hamming distance within the
band and whose query radius is that smaller number. A leaf is a shard: a fingerprint lives in one shard of every tree, and is
a guest in each shard across a boundary that its query ball overlaps. The tree is laid out over a bounded sample, which moves
the boundaries only; all fingerprints are placed and queried.

Within a shard a second vantage-point tree, now over all 64 bits, is queried for exact neighbours; branches are pruned by the
triangle bounds on the distances to their vantage point. A shard passes on a forest of its links, never all pairs. The
components come from alternating large-star and small-star steps, each written to the shared folder.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import attach, query, short_batches, staged, table, text_bytes

#: Distinct fingerprints that the driver sees to lay out the shards, and those that a shard holds on average.
SAMPLE, SHARD = 4096, 16384
#: Fingerprints in a leaf of the tree within a shard; queries compared at a time; links held before they are thinned out.
LEAF, QUERIES_AT_ONCE, LINKS_HELD = 96, 8192, 1 << 20


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64 bits: a bit is set if it is in over half the hashes of the shingles, repeats included."""
    words = text.lower().split()  # on ASCII: A-Z only, and the six blanks only
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), (starts + lengths)[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    ones, at_once = np.zeros(64, np.int64), 1 << 16
    for k in range(0, n, at_once):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(first[k:k + at_once], last[k:k + at_once])],
                          np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = 4) -> DataFrame:
    """doc_id and fingerprint (long, the 64 bits as signed), one row per row; null texts count as empty, with 0."""
    short_batches(df.sparkSession)
    rows = df.select(F.col(f"`{id}`").cast("long").alias("doc_id"), text_bytes(F.col(f"`{text}`")).alias("text"))

    def run(batches):
        for batch in batches:
            marks = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks.view(np.int64))],
                                             ["doc_id", "fingerprint"])

    return rows.mapInArrow(run, "doc_id long, fingerprint long")


def distances(marks: np.ndarray, vantage, mask=np.uint64(2**64 - 1)) -> np.ndarray:
    return np.bitwise_count((marks ^ vantage) & mask).astype(np.int64)


class ShardTree:
    """Vantage-point tree over one band: nodes are (vantage, radius, inner, outer), leaves are shard numbers."""

    def __init__(self, sample: np.ndarray, mask: int, radius: int, depth: int, seed: int):
        self.mask, self.radius, self.leaves = np.uint64(mask), radius, 0
        self.root = self._node(sample, depth, np.random.default_rng(seed))

    def _node(self, marks, depth, random):
        if depth > 0 and len(marks) > 1:
            for _ in range(4):  # a vantage point that has the sample all on one distance divides nothing
                vantage = marks[random.integers(len(marks))]
                d = distances(marks, vantage, self.mask)
                cut = int(np.sort(d)[(len(d) - 1) // 2])
                cut = cut if (d > cut).any() else cut - 1
                if cut >= 0:
                    return (vantage, cut, self._node(marks[d <= cut], depth - 1, random),
                            self._node(marks[d > cut], depth - 1, random))
        self.leaves += 1
        return self.leaves - 1

    def place(self, marks: np.ndarray):
        """Arrays (row, shard, home): one home for each row, and guests where the query ball crosses a boundary."""
        out, todo = [], [(self.root, np.arange(len(marks)), np.ones(len(marks), bool))]
        while todo:
            node, rows, home = todo.pop()
            if isinstance(node, int):
                out.append((rows, np.full(len(rows), node, np.int64), home))
                continue
            vantage, cut, inner, outer = node
            d = distances(marks[rows], vantage, self.mask)
            # homes live on one side; of a pair cut apart, the one inside goes out to meet the other
            into = np.where(home, d <= cut, d <= cut + self.radius)
            over = np.where(home, d > cut, d > cut - self.radius)
            visit = home & (d <= cut) & (d > cut - self.radius)
            if into.any():
                todo.append((inner, rows[into], home[into]))
            if over.any() or visit.any():
                todo.append((outer, np.concatenate((rows[over], rows[visit])),
                             np.concatenate((home[over], np.zeros(visit.sum(), bool)))))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def forest(a: np.ndarray, b: np.ndarray, rank: np.ndarray):
    """Links (a, b) between positions, thinned out to (position, root of its component), the root having the least rank."""
    ends, back = np.unique(np.concatenate((a, b)), return_inverse=True)
    order = np.argsort(rank[ends], kind="stable")
    place = np.empty(len(ends), np.int64)
    place[order] = np.arange(len(ends))
    a, b = place[back[:len(a)]], place[back[len(a):]]
    root = np.arange(len(ends))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            break
        root = new
    ends = ends[order]
    own = root != np.arange(len(ends))
    return ends[own], ends[root[own]]


def shard_links(marks: np.ndarray, home: np.ndarray, max_bits: int):
    """Forest of the links between the homes of a shard and all its fingerprints, as two arrays of fingerprints."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def link(a, b):
        nonlocal found, held
        found.append((a, b))
        held += len(a)
        if held > LINKS_HELD:
            thin = forest(*map(np.concatenate, zip(*found)), marks)
            found, held = [thin], 0

    homes = np.flatnonzero(home)
    todo = [(homes, np.arange(len(marks)))]
    random = np.random.default_rng(0)
    while todo:
        tree, asking = todo.pop()
        if not len(tree) or not len(asking):
            continue
        if len(tree) > LEAF:
            vantage = marks[tree[random.integers(len(tree))]]
            d, q = distances(marks[tree], vantage), distances(marks[asking], vantage)
            cut = int(np.sort(d)[(len(d) - 1) // 2])
            cut = cut if (d > cut).any() else cut - 1
            if cut >= 0:
                for part in (d <= cut, d > cut):
                    low, high = d[part].min(), d[part].max()
                    todo.append((tree[part], asking[(q >= low - max_bits) & (q <= high + max_bits)]))
                continue
        for k in range(0, len(asking), QUERIES_AT_ONCE):
            some = asking[k:k + QUERIES_AT_ONCE]
            near = np.bitwise_count(marks[some][:, None] ^ marks[tree][None, :]) <= max_bits
            x, y = np.nonzero(near)
            x, y = some[x], tree[y]
            apart = x != y
            if apart.any():
                link(x[apart], y[apart])
    if not found:
        return marks[:0], marks[:0]
    a, b = forest(*map(np.concatenate, zip(*found)), marks)
    return marks[a], marks[b]


def _bands(trees: int) -> list[int]:
    ends = [round(64 * k / trees) for k in range(trees + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]


def links(distinct: DataFrame, max_bits: int = 4, trees: int = 3, shard: int = SHARD) -> DataFrame:
    """A forest (fingerprint, other) over distinct fingerprints, which connects just those that a chain of links connects,
    a link being at most ``max_bits`` differing bits. ``distinct`` is a staged frame."""
    n = distinct.count()
    sample = distinct.orderBy(F.xxhash64("fingerprint")).limit(SAMPLE).select("fingerprint").toPandas()
    marks = sample["fingerprint"].to_numpy(np.int64).view(np.uint64)
    depth = max(0, math.ceil(math.log2(max(1, n) / shard)))
    plan = [ShardTree(marks, m, max_bits // trees, depth, k) for k, m in enumerate(_bands(trees))]
    offsets = np.cumsum([0] + [t.leaves for t in plan]).tolist()

    def place(batches):
        for batch in batches:
            marks = batch.column("fingerprint").to_numpy().view(np.uint64)
            for tree, offset in zip(plan, offsets):
                rows, shards, home = tree.place(marks)
                if len(rows):
                    some = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(shards + offset), some.column("fingerprint"),
                                                      pa.array(home.astype(bool))], ["shard", "fingerprint", "home"])

    def join(batches):
        held, shard_no = [], None

        def close():
            if held:
                rows = pa.Table.from_batches(held)
                a, b = shard_links(rows["fingerprint"].to_numpy().view(np.uint64), rows["home"].to_numpy(), max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                                                 ["fingerprint", "other"])

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.diff(shards)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shards)]):
                if b > a:
                    if shards[a] != shard_no:
                        yield from close()
                        held, shard_no = [], shards[a]
                    held.append(batch.slice(a, b - a))
        yield from close()

    placed = distinct.select("fingerprint").mapInArrow(place, "shard long, fingerprint long, home boolean")
    return placed.repartition("shard").sortWithinPartitions("shard") \
        .mapInArrow(join, "fingerprint long, other long").distinct()


def _signature(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """The least value that each value in edges (fingerprint, other) reaches: columns fingerprint, root.

    Large-star and small-star steps, each a partial minimum by node and a join back, until the edges stay the same; they
    are then stars around the least values.
    """
    u, v = F.col("u"), F.col("v")
    edges = edges.select(F.greatest("fingerprint", "other").alias("u"), F.least("fingerprint", "other").alias("v")) \
        .where("u <> v").distinct()
    edges = staged(edges)
    last = _signature(edges)
    while last[0]:
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(v.alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(v.alias("u"), F.col("m").alias("v"))
        edges = staged(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        now = _signature(edges)
        if now == last:
            break
        last = now
    return edges.select(u.alias("fingerprint"), v.alias("root"))


def near_groups(df: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = 4, max_bits: int = 4,
                trees: int = 3) -> DataFrame:
    """One row per row: doc_id, fingerprint (long), component_id, the least doc_id that links reach, itself included.

    Texts without words have fingerprint 0 and are linked like others. A null id is larger than all others: component_id is
    null only where all ids of a component are. Repeated rows share a component. An empty table gives an empty result.
    """
    marks = staged(fingerprints(df, text, id, shingle))
    distinct = staged(marks.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    roots = components(links(distinct, max_bits, trees))
    rooted = staged(distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("marks"))
    classes = staged(attach(rooted, staged(least), ["root"], "marks").select("fingerprint", "rows", "component_id"))
    return attach(marks, classes, ["fingerprint"], "rows").select(
        F.col("doc_id").alias(id), "fingerprint", "component_id")


def drop_near(df: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows with the least id of every component, with the columns of the input.

    Rows that repeat an id are one document: one of them stays (the least by a hash of its other columns).
    """
    whole = staged(df.withColumn("_sl_row", F.monotonically_increasing_id()))
    kept = near_groups(whole.select(F.col("_sl_row").alias("doc_id"), F.col(f"`{text}`").alias("text")),
                       shingle=shingle, max_bits=max_bits)
    order = F.struct(F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(2**63 - 1)).alias("id"),
                     F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) for c in df.columns]).alias("tie"),
                     "_sl_row")
    chosen = whole.select("_sl_row", order.alias("order")).join(kept.withColumnRenamed("doc_id", "_sl_row"), "_sl_row") \
        .groupBy("component_id").agg(F.min("order").alias("order")).select(F.col("order._sl_row").alias("_sl_row"))
    return whole.join(chosen, "_sl_row").select(*[F.col(f"`{c}`") for c in df.columns])


@query("op3_simhash_components")
def op3(spark, sf_dir):
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
