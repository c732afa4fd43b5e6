"""Hard negatives against brute force, and the proof that ends a walk."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(seed, n=260, dims=6, labels=4):
    r = random.Random(seed)
    middle = [[r.gauss(0, 0.5) for _ in range(dims)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = r.randrange(labels)
        rows.append((i, [m + r.gauss(0, 0.3) for m in middle[label]], label))
    rows += [(1000 + i, rows[5][1], i % 3) for i in range(60)]  # ties
    rows += [(2000, [0.0] * dims, 1), (2010, [-x for x in rows[10][1]], rows[10][2]), (2020, rows[20][1][:2], 0)]
    rows += [(3000, None, 1), (3010, [0.1] * dims, None), (3020, [float("nan")] * dims, 1), (3030, [0.1, None], 2),
             (3040, [float("inf")] * dims, 0), (None, [0.4] * dims, 1), (None, None, None), (3050, [], 1)]
    return rows + [rows[0], rows[20], (20, rows[3][1], 2)]  # repeated ids


def by_hand(rows, every=10, positives=5, negatives=5, low=80, high=100, scale=256):
    f32 = lambda x: float(np.float32(x))
    fine = [(i, v, k) for i, v, k in rows if v is not None and k is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(scale * f32(x)) for x in v] for _, v, _ in fine]
    tie = [2**63 if i is None else i for i, *_ in fine]
    out = []
    for a, (i, _, k) in enumerate(fine):
        if i is None or i % every:
            continue
        score = [sum(x * y for x, y in zip(whole[a], w)) for w in whole]
        order = sorted((b for b in range(len(fine)) if b != a), key=lambda b: (-score[b], tie[b]))
        for p in [b for b in order if fine[b][2] == k][:positives]:
            hard = [b for b in order if fine[b][2] != k and low * score[p] <= high * score[b] <= high * score[p]]
            out += [(i, fine[p][0], rank, fine[b][0], score[p], score[b]) for rank, b in enumerate(hard[:negatives], 1)]
    return out


@pytest.mark.parametrize("seed, shard, options", [(1, 50, {}), (2, 10_000, {}), (3, 90, {"positives": 2, "negatives": 9}),
                                                   (4, 400, {"low": 50}), (5, 60, {"scale": 5000.0})])
def test_mine(spark, monkeypatch, seed, shard, options):
    monkeypatch.setattr(N, "MEMBERS", 4)
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("row", "id", "caps", "score", "shard")})
    got = N.mine(df, F.col("vec_id") % 10 == 0, shard=shard, **options).collect()
    assert got[0].__fields__ == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = by_hand(rows, **options)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and want


def test_large_numbers(spark):
    """Products beyond what doubles hold are exact."""
    rows = [(i, [1.0 + (i * 7 % 13) * 2.0**-22, 1.0], i % 2) for i in range(0, 60)]
    got = N.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, scale=2.0**29).collect()
    assert sorted(map(tuple, got)) == sorted(by_hand(rows, scale=2**29))


def test_nothing_to_mine(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert N.mine(none, F.lit(True)).collect() == []
    rows = spark.createDataFrame(rows_of(1), SCHEMA)
    assert N.mine(rows, F.lit(False)).collect() == [] == N.mine(rows, F.lit(None).cast("boolean")).collect()
    assert N.mine(spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 0)], SCHEMA), F.lit(True)).collect() == []
    assert N.mine(spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 1)], SCHEMA), F.lit(True)).collect() == []


def test_bounds_and_early_end(monkeypatch):
    r = np.random.default_rng(0)
    middle = r.normal(size=(8, 16))
    group = r.integers(0, 8, 4000)
    vectors = np.floor(256 * (middle[group] + 0.1 * r.normal(size=(4000, 16)))).astype(np.int64)
    found = N.centres(vectors[:200], 8)
    shard = N.Shard(np.arange(4000), np.arange(4000), group, vectors, found)
    lengths, unit = N._units(vectors.astype(np.float64))
    near = unit[:100] @ found.T
    own = near.argmax(1)
    angle = N._angles(lengths[:100], near[np.arange(100), own])
    products, work = N._dot, []
    monkeypatch.setattr(N, "_dot", lambda v, a, safe: work.append(len(v) * len(a)) or products(v, a, safe))
    for c in range(8):
        mine = np.flatnonzero(own == c)
        if not len(mine):
            continue
        order, bound = shard.listed(c, angle[mine].max())
        assert (np.diff(bound) <= 0).all()
        assert (vectors[order] @ vectors[mine].T <= bound[:, None] * lengths[mine][None, :] + 1e-3).all()
        best = shard.walk(order, bound, mine, group[mine], vectors[mine], 5, None, 80, 100)
        for i, [(places, scores)] in zip(mine, best):
            s = np.where((group == group[i]) & (np.arange(4000) != i), vectors @ vectors[i], -2**62)
            want = np.lexsort((np.arange(4000), -s))[:5]
            assert places.tolist() == want.tolist() and scores.tolist() == s[want].tolist()
    assert sum(work) < 0.5 * 4000 * 100  # most of the list is never scored
