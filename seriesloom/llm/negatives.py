"""Hard negatives by shared candidate lists of anchor clusters.

Anchors are clustered by direction. A row v can reach at most |a| |v| cos(max(0, angle(v, c) - r)) with any anchor a of a
cluster with centre c and angular radius r. So for each cluster the rows are sorted once by |v| cos(max(0, angle(v, c) - r)),
the largest first, and all members walk this list together, a block at a time, with exact integer products. A member leaves
when the bound of the next row proves that nothing ahead can enter its results.

Rows are dealt to shards of bounded size by a hash; each is sent once a pass and its shard keeps it in memory, while the
anchors stream by in the order of their clusters. Pass one finds the positives of each anchor, pass two, with their scores
known, the best negatives below each of these scores. Partial results of the shards are a few rows for each anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import query, staged, table
from seriesloom.llm.impact import _matrix, quantised, usable

#: Most rows in a shard, least rows worth a shard of its own, rows of a list scored at a time (at first; then more).
SHARD, LEAST, STEP = 65536, 8192, 256
#: Anchors that the cluster centres are fitted on (all anchors are assigned), most clusters, anchors wanted in a cluster.
SAMPLE, MOST_CLUSTERS, MEMBERS = 8192, 512, 64
#: Anchors that walk a list together.
TOGETHER = 512


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and vectors of length one (zeros stay)."""
    lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))
    return lengths, vectors / np.where(lengths > 0, lengths, 1.0)[:, None]


def centres(vectors: np.ndarray, clusters: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Spherical k-means: directions that the vectors gather around."""
    _, unit = _units(vectors.astype(np.float64))
    found = unit[np.random.default_rng(seed).choice(len(unit), min(clusters, len(unit)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(unit @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, unit)
        lengths, fresh = _units(sums)
        found = np.where(lengths[:, None] > 0, fresh, found)
    return found


def _angles(lengths: np.ndarray, dots: np.ndarray) -> np.ndarray:
    """Angles to a centre; a vector of length zero has any angle, 0 is the safe one for a bound."""
    return np.where(lengths > 0, np.arccos(np.clip(dots, -1.0, 1.0)), 0.0)


def _dot(vectors: np.ndarray, others: np.ndarray, safe: bool) -> np.ndarray:
    """Integer products: by doubles where these are exact."""
    if safe:
        return (vectors.astype(np.float64, copy=False) @ others.astype(np.float64).T).astype(np.int64)
    return vectors.astype(np.int64, copy=False) @ others.T


class Shard:
    """Rows of a shard, and the walk of anchors along the list of their cluster."""

    def __init__(self, row: np.ndarray, tie: np.ndarray, label: np.ndarray, vectors: np.ndarray, found: np.ndarray):
        order = np.lexsort((row, tie))  # among equal scores the first place wins
        self.row, self.tie, self.label, self.vectors = row[order], tie[order], label[order], vectors[order]
        self.lengths, unit = _units(self.vectors.astype(np.float64))
        self.angles = [_angles(self.lengths, unit @ c) for c in found]
        self.largest = float(np.abs(self.vectors).max(initial=0))

    def listed(self, cluster: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Places by falling bound for anchors of length one, and the bounds, with room for rounding."""
        bound = self.lengths * np.cos(np.maximum(0.0, self.angles[cluster] - radius - 1e-7)) + self.lengths * 1e-7
        order = np.argsort(-bound, kind="stable")
        return order, bound[order]

    def walk(self, order: np.ndarray, bound: np.ndarray, own: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int,
             caps: list[np.ndarray] | None, low: int, high: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """For each anchor and each of its lists the k best (places, scores), ties to the smaller place.

        Without ``caps`` an anchor has one list: other rows of its label. With caps it has one for each cap: rows of other
        labels with low * cap <= high * score <= high * cap.
        """
        lengths, _ = _units(vectors.astype(np.float64))
        limits = [np.zeros(1, np.int64)] * len(own) if caps is None else caps
        safe = self.largest * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1]) < 2**52
        best = [[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in c] for c in limits]
        active = np.array([i for i, c in enumerate(limits) if len(c)], np.int64)
        at, step = 0, STEP
        while at < len(order) and len(active):
            places = order[at:at + step]
            scores = _dot(self.vectors[places], vectors[active], safe)  # a column for each anchor
            at, step = at + len(places), min(2 * step, 8192)
            ahead = bound[at] if at < len(order) else -np.inf
            same = self.label[places][:, None] == labels[active][None, :]
            fits = same & (self.row[places][:, None] != own[active][None, :]) if caps is None else ~same
            going = []
            for j, i in enumerate(active.tolist()):
                reach = ahead * lengths[i] + 1e-3
                some = np.flatnonzero(fits[:, j])
                mine, where = scores[some, j], places[some]
                done = True
                for c, cap in enumerate(limits[i].tolist()):
                    if caps is None:
                        new = np.arange(len(mine))
                    else:
                        new = np.flatnonzero((mine <= cap) & (mine >= -(-low * cap // high)))
                    old_at, old = best[i][c]
                    if len(old) == k:
                        new = new[mine[new] >= old[-1]]
                    if len(new):
                        p, s = np.concatenate((old_at, where[new])), np.concatenate((old, mine[new]))
                        first = np.lexsort((p, -s))[:k]
                        best[i][c] = old_at, old = p[first], s[first]
                    # proof: full, and what lies ahead is less than the worst of the list; or below the least score wanted
                    if not (len(old) == k and reach < old[-1]) and not (caps is not None and high * reach < low * cap):
                        done = False
                if not done:
                    going.append(i)
            active = np.array(going, np.int64)
        return best


def _search(width: int, found: np.ndarray, radii: np.ndarray, k: int, scale: float, low: int, high: int, mining: bool):
    """Arrow helper: rows of each shard first, then the anchors by cluster."""

    def load(parts: list[pa.RecordBatch]) -> Shard | None:
        if not parts:
            return None
        t = pa.Table.from_batches(parts)
        tie = np.array([2**63 - 1 if x is None else x for x in t["id"].to_pylist()], np.int64)
        return Shard(t["row"].to_numpy(), tie, t["label"].to_numpy(), _matrix(t["vector"], width), found)

    def answer(shard: Shard, number: int, cluster: int, part: pa.RecordBatch, lists: dict):
        if (number, cluster) not in lists:
            lists.clear()
            lists[number, cluster] = shard.listed(cluster, float(radii[cluster]))
        order, bound = lists[number, cluster]
        own, labels, vectors = part["row"].to_numpy(), part["label"].to_numpy(), _matrix(part["vector"], width)
        caps = [np.array(c or [], np.int64) for c in part["caps"].to_pylist()] if mining else None
        if mining:  # nothing lies between the low and the high share of a negative score
            caps = [c[low * c <= high * c] for c in caps]
        best = shard.walk(order, bound, own, labels, vectors, k, caps, low, high)
        out = {"anchor": [], "cap": [], "row": [], "id": [], "score": []}
        for i, lists_ in enumerate(best):
            for c, (places, scores) in enumerate(lists_):
                out["anchor"] += [int(own[i])] * len(places)
                out["cap"] += [int(caps[i][c]) if mining else None] * len(places)
                out["row"] += shard.row[places].tolist()
                out["id"] += [None if t == 2**63 - 1 else t for t in shard.tie[places].tolist()]
                out["score"] += scores.tolist()
        return pa.RecordBatch.from_pydict(out, pa.schema([(c, pa.int64()) for c in out]))

    def run(batches):
        number, parts, shard, lists = None, [], None, {}
        for batch in batches:
            keys = np.stack([batch["shard"].to_numpy(), batch["cluster"].to_numpy()])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(edges, edges[1:]):
                s, cluster = int(keys[0, a]), int(keys[1, a])
                if s != number:
                    number, parts, shard = s, [], None
                if cluster < 0:
                    parts.append(batch.slice(a, b - a))
                    continue
                if shard is None:
                    shard, parts = load(parts), []
                for at in range(a, b, TOGETHER):
                    if shard is not None:
                        yield answer(shard, s, cluster, batch.slice(at, min(TOGETHER, b - at)), lists)

    return run


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def mine(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0,
         shard: int = SHARD) -> DataFrame:
    """Hard negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of floor(scale * component). The positives of an anchor are its first other rows of the same
    label; the negatives of a positive are the first rows of other labels with low * positive_score <= high * negative_score
    <= high * positive_score. Higher scores come first, ties go to the smaller id, null ids last. Rows with a null label or
    an unusable vector take no part; shorter vectors count as filled up with zeros. Rows that repeat an id are rows of their
    own: repeated anchors each get their results, and a repeated row can be a positive. Fewer candidates give fewer rows; an
    empty table, no anchors or no fitting negatives give none. Scores are exact while they fit a long. Labels are cast to
    long; other columns are not read.
    """
    spark = df.sparkSession
    rows = staged(df.where(usable(F.col(f"`{vector}`")) & F.col(f"`{label}`").isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id}`").cast("long").alias("id"),
        F.col(f"`{label}`").cast("long").alias("label"), quantised(F.col(f"`{vector}`"), scale).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks")))
    n, asking, width = rows.agg(F.count("*"), F.sum(F.col("asks").cast("long")), F.max(F.size("vector"))).first()
    asking, width = asking or 0, max(1, width or 1)
    shards = max(1, -(-n // shard), min(spark.sparkContext.defaultParallelism * 2, n // LEAST))
    drawn = rows.where("asks").select("vector").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).toArrow()
    sample = _matrix(drawn["vector"], width) if asking else np.zeros((1, width))
    found = centres(sample, max(1, min(MOST_CLUSTERS, asking // MEMBERS)))

    def assign(batches):
        for batch in batches:
            lengths, unit = _units(_matrix(batch["vector"], width).astype(np.float64))
            near = unit @ found.T
            own = np.argmax(near, axis=1)
            angle = _angles(lengths, near[np.arange(len(own)), own])
            yield pa.RecordBatch.from_arrays([batch["row"], batch["id"], batch["label"], batch["vector"], pa.array(own, pa.int64()),
                                              pa.array(angle, pa.float64())], ["row", "id", "label", "vector", "cluster", "angle"])

    shape = "row long, id long, label long, vector array<long>, cluster long, angle double"
    anchors = staged(rows.where("asks").select("row", "id", "label", "vector").mapInArrow(assign, shape))
    radii = np.zeros(len(found))
    for c, r in anchors.groupBy("cluster").agg(F.max("angle")).collect():  # at most MOST_CLUSTERS
        radii[c] = r
    candidates = rows.select(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), F.lit(-1).cast("long").alias("cluster"),
                             "row", "id", "label", "vector", F.lit(None).cast("array<long>").alias("caps"))

    def pass_over(asked: DataFrame, k: int, mining: bool) -> DataFrame:
        """The k best of each shard for each anchor (and cap): each shard is one group, and its anchors follow its rows."""
        each = asked.select(F.explode(_numbers(shards)).alias("shard"), "cluster", "row", "id", "label", "vector", "caps")
        dealt = candidates.unionByName(each).repartition(shards, "shard").sortWithinPartitions("shard", "cluster", "row")
        return dealt.mapInArrow(_search(width, found, radii, k, scale, low, high, mining),
                                "anchor long, cap long, row long, id long, score long")

    def first(part: DataFrame, keys: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
        return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    plain = anchors.withColumn("caps", F.lit(None).cast("array<long>"))
    good = staged(first(pass_over(plain, positives, False), ["anchor"], positives))
    caps = good.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_set("score")).alias("caps"))
    hard = first(pass_over(anchors.join(caps, "row"), negatives, True), ["anchor", "cap"], negatives)
    named = good.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("cap"), F.col("row").alias("positive"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return hard.select("anchor", "cap", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")) \
        .join(named, ["anchor", "cap"]).join(ids, "anchor").select(
            "anchor_id", "positive_id", "rank", "negative_id", F.col("cap").alias("positive_score"), "negative_score")


@query("op12_hard_negatives", """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS anchor_id, c.vec_id, c.rid AS other, q.label = c.label AS same,
             coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: coalesce(z[1] * z[2], 0))), 0)::BIGINT AS score
      FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST, other) AS place
                     FROM s WHERE same) WHERE place <= 5),
r AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
             row_number() OVER (PARTITION BY p.rid, p.other ORDER BY n.score DESC, n.vec_id NULLS LAST, n.other)::INT AS rank
      FROM p JOIN s n ON p.rid = n.rid AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5
""")
def op12(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
