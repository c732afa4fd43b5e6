"""Exact top-k by inner product: an impact-ordered index processed score at a time.

Rows are dealt to shards by a hash and queries to blocks; every block meets every shard in a task of its own, so the work is
queries times rows in pieces of bounded size. A shard keeps a posting list for each dimension, ordered by value and cut into
segments of one quantised level. For a query, the impact of a segment is how near its best value comes to the best contribution
of its dimension; segments are taken by falling impact and each adds what its rows fall short of that best. What a row may still
reach follows from its shortfall so far and from the impact that is up next, so processing ends on proof: when the rows that may
reach the k best are few, these are scored exactly. Otherwise it ends when all segments are processed and all sums are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import query, staged, table

#: Rows in a shard and queries in a block on average; levels of a dimension; candidates that are scored rather than narrowed.
SHARD, BLOCK, LEVELS, RESCORE = 8192, 1024, 8, 128


class ImpactIndex:
    """Posting lists of a shard: rows by value in each dimension, with the edges and values of the segments."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n, dims = vectors.shape
        order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.asfortranarray(np.take_along_axis(vectors, order, axis=0))  # a posting list is a column
        self.order = np.asfortranarray(order)
        low, high = self.values[0], self.values[-1]
        cuts = low + (high - low)[None, :].astype(np.float64) * (np.arange(1, LEVELS) / LEVELS)[:, None]
        edges = [np.searchsorted(self.values[:, d], cuts[:, d]) for d in range(dims)]
        self.edges = np.stack([np.concatenate(([0], e, [n])) for e in edges]) if dims else np.zeros((0, LEVELS + 1), int)

    def search(self, q: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of at least all rows that are among the k best, ties included; ``own`` rows are left out."""
        n = len(self.vectors)
        dims = np.flatnonzero(q)
        short, seen = np.zeros(n, np.int64), np.zeros(n, np.int64)
        out = np.zeros(n, bool)
        if own is not None:
            out[own] = True
        best = np.where(q > 0, q * self.values[-1], q * self.values[0])
        total = int(best[dims].sum())
        # segments as (least shortfall, dimension, from, to), by falling impact
        d = np.repeat(dims, LEVELS)
        start, end = self.edges[dims, :-1].ravel(), self.edges[dims, 1:].ravel()
        some = end > start
        d, start, end = d[some], start[some], end[some]
        least = best[d] - q[d] * self.values[np.where(q[d] > 0, end - 1, start), d]
        order = np.argsort(least, kind="stable")
        scored = np.zeros(n, bool)
        exact = np.full(n, np.iinfo(np.int64).min)
        step = max(1, len(order) // 16)
        for at in range(0, len(order) + step, step):
            for i in order[at:at + step].tolist():
                c, a, b = d[i], start[i], end[i]
                rows = self.order[a:b, c]
                short[rows] += best[c] - q[c] * self.values[a:b, c]
                seen[rows] += 1
            ahead = order[at + step] if at + step < len(order) else None
            bound = total - short - (0 if ahead is None else (len(dims) - seen) * least[ahead])
            bound[out] = np.iinfo(np.int64).min
            live = n - int(out.sum())
            if live <= k:
                found = np.flatnonzero(~out)
                return found, self.vectors[found] @ q
            top = np.argpartition(bound, n - k)[n - k:]
            new = top[~scored[top] & ~out[top]]
            exact[new] = self.vectors[new] @ q
            scored[new] = True
            reach = np.partition(exact, n - k)[n - k]  # k rows have at least this
            possible = np.flatnonzero((bound >= reach) & ~out)
            if len(possible) <= max(RESCORE, k) or ahead is None:
                return possible, self.vectors[possible] @ q
        raise AssertionError("not reached")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers, filled up with zeros on the right."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy()
    return out


def quantised(vector: Column, scale: float = 1024.0) -> Column:
    """Each component x as floor(scale * x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def top_k(df: DataFrame, is_query: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding",
          scale: float = 1024.0, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The k rows with the largest integer inner product for each query row: query_id, rank, vec_id, score.

    Ties go to the smaller id, null ids last. Rows with unusable vectors take no part; shorter vectors count as filled up
    with zeros. A row is no candidate for itself, but rows that repeat its id or vector are. Fewer than k candidates give
    fewer rows; no queries or an empty table give none. Scores are exact while they fit a long.
    """
    rows = staged(df.where(usable(F.col(f"`{vector}`"))).select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id}`").cast("long").alias("id"),
        quantised(F.col(f"`{vector}`"), scale).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")))
    sizes = rows.agg(F.count("*"), F.sum(F.col("asks").cast("long")), F.max(F.size("vector"))).first()
    shards, blocks, width = max(1, -(-sizes[0] // shard)), max(1, -(-(sizes[1] or 0) // block)), max(1, sizes[2] or 1)
    spread = F.xxhash64("row")
    each = rows.select("row", "id", "vector", F.pmod(spread, F.lit(shards)).alias("shard"),
                       F.explode(_numbers(blocks)).alias("block"))
    asking = rows.where("asks").select("row", "id", "vector", F.pmod(spread, F.lit(blocks)).alias("block"),
                                       F.explode(_numbers(shards)).alias("shard"))

    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query": [], "query_id": [], "row": [], "vec_id": [], "score": []}
        if rows.num_rows and queries.num_rows:
            order = np.argsort(rows["row"].to_numpy())
            rows = rows.take(pa.array(order))
            row, ids = rows["row"].to_numpy(), np.array(rows["id"].to_pylist(), object)
            tie = np.array([2**63 - 1 if x is None else x for x in ids], np.int64)
            index = ImpactIndex(_matrix(rows["vector"], width))
            for q_row, q_id, q in zip(queries["row"].to_pylist(), queries["id"].to_pylist(),
                                      _matrix(queries["vector"], width)):
                at, scores = index.search(q, k, np.flatnonzero(row == q_row))
                first = np.lexsort((row[at], tie[at], -scores))[:k]
                out["query"] += [q_row] * len(first)
                out["query_id"] += [q_id] * len(first)
                out["row"] += row[at[first]].tolist()
                out["vec_id"] += ids[at[first]].tolist()
                out["score"] += scores[first].tolist()
        return pa.Table.from_pydict(out, pa.schema([(c, pa.int64()) for c in out]))

    found = each.groupBy("shard", "block").cogroup(asking.groupBy("shard", "block")).applyInArrow(
        search, "query long, query_id long, row long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


@query("op8_exact_top_k", """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
           FROM embeddings
           WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, c.rid AS other,
             coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: coalesce(z[1] * z[2], 0))), 0)::BIGINT AS score
      FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST, other)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""")
def op8(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
