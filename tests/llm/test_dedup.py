"""Exact dedup, SimHash components and substring dedup against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash

from seriesloom.llm import exact_dedup, simhash, substrings
from tests.llm.fixtures import corpus, frame

BLANKS = " \t\n\v\f\r"


def split(text):
    for b in BLANKS:
        text = text.replace(b, " ")
    return [w for w in text.split(" ") if w]


def test_trie_numbers_equal_strings():
    trie, seen, r = exact_dedup.PatriciaTrie(), {}, random.Random(0)
    for _ in range(4000):
        key = bytes(r.choice(b"ab") for _ in range(r.randint(0, 12)))
        assert trie.insert(key) == seen.setdefault(key, len(seen))
    assert trie.size == len(seen)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("clash", [False, True])
def test_exact_groups(spark, keep, clash):
    rows = corpus()
    got = exact_dedup.groups(frame(spark, rows, clash), keep=keep).collect()
    by = {}
    for d, t, *_ in rows:
        by.setdefault(t or "", []).append(d)
    best = max if keep == "largest" else min
    owner = {t: best((d for d in ds if d is not None), default=None) for t, ds in by.items()}
    want = [(d, owner[t or ""], len(by[t or ""]), d == owner[t or ""], hashlib.sha256((t or "").encode()).hexdigest())
            for d, t, *_ in rows]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_owners_keep_whole_rows_and_small_budgets_change_nothing(spark):
    rows = corpus()
    df = frame(spark, rows, True)
    got = exact_dedup.drop_copies(df, keep="largest").collect()
    assert got[0].__fields__ == df.columns and len(got) == len({t or "" for _, t, *_ in rows})
    assert {tuple(r)[:5] for r in got} <= set(rows)
    small = exact_dedup.owners(df, keep="largest", subtree_bytes=1).collect()
    pick = lambda rs: sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rs)
    assert pick(small) == pick(got)


def test_empty_tables(spark):
    df = frame(spark, [])
    assert exact_dedup.groups(df).collect() == []
    assert exact_dedup.drop_copies(df).collect() == []
    assert simhash.near_groups(df).collect() == [] and simhash.drop_near(df).collect() == []
    assert substrings.remove_repeats(df).collect() == []


def mark(text, k=4):
    w = split((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    grams = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(marks, ids, bits):
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(marks)), 2):
        if (marks[i] ^ marks[j]).bit_count() <= bits:
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(marks)):
        groups.setdefault(find(i), []).append(i)
    least = {g: min((ids[i] for i in m if ids[i] is not None), default=None) for g, m in groups.items()}
    return [least[find(i)] for i in range(len(marks))]


def test_near_groups(spark):
    rows = corpus()
    got = simhash.near_groups(frame(spark, rows, True)).collect()
    marks = [mark(t) for _, t, *_ in rows]
    want = [(d, m, c) for (d, *_), m, c in zip(rows, marks, closure(marks, [r[0] for r in rows], 4))]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r[0], r[1] & (2**64 - 1), r[2]) for r in got), key=key) == sorted(want, key=key)
    kept = simhash.drop_near(frame(spark, rows)).collect()
    assert len(kept) == len({(c, m) if c is None else c for _, m, c in want})
    assert sorted(map(tuple, kept), key=key) == sorted(map(tuple, simhash.drop_near(frame(spark, rows[::-1])).collect()), key=key)


@pytest.mark.parametrize("trees", [1, 2, 3, 5])
def test_shards_lose_no_link(spark, trees):
    """Clusters of close fingerprints around random centres, in shards so small that boundaries cut through them."""
    r = random.Random(trees)
    marks = set()
    for _ in range(25):
        centre = r.getrandbits(64)
        marks.add(centre)
        for _ in range(r.randint(0, 14)):
            m = centre
            for b in r.sample(range(64), r.randint(1, 5)):
                m ^= 1 << b
            marks.add(m)
            centre = r.choice([centre, m])
    marks = sorted(marks)
    signed = np.array(marks, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(m,) for m in signed], "fingerprint long")
    roots = {x.fingerprint: x.root for x in simhash.components(simhash.links(df, 4, trees, shard=8)).collect()}
    assert [roots.get(m, m) for m in signed] == closure(marks, signed, 4)


def test_large_group_within_a_shard():
    """All pairs of a dense group are links; the forest of a shard has a node less than there are fingerprints."""
    marks = np.array([1 << a | 1 << b for a, b in itertools.combinations(range(64), 2)] + [0], np.uint64)
    a, b = simhash.shard_links(marks, np.ones(len(marks), bool), 4)
    assert len(a) == len(marks) - 1 and set(b.tolist()) == {0}


def removed(rows, window):
    first = {}
    for d, t, *_ in rows:
        w = split(t or "")
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            d_ = 2**63 - 1 if d is None else d
            first[k] = min(first.get(k, d_), d_)
    out = []
    for d, t, *_ in rows:
        w = split(t or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < (2**63 - 1 if d is None else d):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("window", [50, 6])
def test_remove_repeats(spark, window, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 40)
    rows = corpus()
    got = substrings.remove_repeats(frame(spark, rows, True), window=window).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(removed(rows, window), key=key)
    for r in got:
        assert sum(s.words for s in r.removed) == r.n_removed


def test_full_tables_change_nothing(spark, monkeypatch):
    """Sketches of few cells, all of them met by many anchors, only send more windows to the second pass."""
    monkeypatch.setattr(substrings, "CHUNK", 40)
    monkeypatch.setattr(substrings, "CELL_BITS", 2)
    rows = corpus()
    got = substrings.remove_repeats(frame(spark, rows), window=6).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(removed(rows, 6), key=key)


@pytest.mark.parametrize("width", [16, 1 << 20])
def test_merged_sketches_never_underestimate(width):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, 60).astype(np.uint64)
    parts = [keys[rng.integers(0, 60, 50)] for _ in range(4)]  # anchors of four tasks
    sketches = [np.unique(p, return_counts=True) for p in parts]
    counts = np.concatenate([np.minimum(n, 2) for _, n in sketches])
    got = substrings._estimates(np.concatenate([substrings._cells(k, width) for k, _ in sketches]), counts,
                                substrings._cells(keys, width), width)
    tables = [[0] * width for _ in range(substrings.DEPTH)]
    place = lambda k, d: int(substrings._mixed(np.array([k], np.uint64), 3 + d)[0]) % width
    for k, n in zip(np.concatenate([k for k, _ in sketches]), counts):
        for d, t in enumerate(tables):
            t[place(k, d)] += int(n)
    assert got.tolist() == [min(t[place(k, d)] for d, t in enumerate(tables)) for k in keys]
    true = [sum(int((p == k).sum()) for p in parts) for k in keys]
    assert all(g >= min(t, 2) for g, t in zip(got, true))


def test_slices_of_anchors_are_even():
    hashes = np.random.default_rng(4).integers(0, 2**63, 60_000).astype(np.uint64) * np.uint64(2)
    keys = np.unique(substrings._anchor_runs(hashes, 50)[0])
    sizes = np.bincount(substrings._slice_of(keys, 16), minlength=16)
    assert len(keys) > 3000 and sizes.max() < 1.4 * sizes.mean()


@pytest.mark.parametrize("kind,top", [("<u4", 2**32 - 1), ("<i8", 2**63 - 1), ("<u8", 2**64 - 1)])
def test_byte_planes(kind, top):
    import pyarrow as pa

    rows = [np.array(x, kind) for x in ([1, top, 256], [], [0])]
    sent = pa.array([substrings._planes(x, kind) for x in rows] + [None], pa.binary())
    assert substrings._from_planes(sent, kind).tolist() == [1, top, 256, 0]


def test_rows_that_repeat_cost_no_more(spark):
    """5,000 equal rows, and a document with a larger id that holds the same text."""
    import time

    r = random.Random(1)
    text = " ".join(f"w{r.randrange(5000)}" for _ in range(600))
    rows = [(5, text, "en", "s", 0)] * 5000 + [(9, "x " + text + " y", "en", "s", 0), (3, "short", "en", "s", 0)]
    at = time.time()
    got = substrings.remove_repeats(frame(spark, rows).repartition(7)).select("doc_id", "n_words", "n_removed").collect()
    assert sorted(map(tuple, got)) == sorted([(5, 600, 0)] * 5000 + [(9, 602, 600), (3, 1, 0)])
    assert time.time() - at < 60
