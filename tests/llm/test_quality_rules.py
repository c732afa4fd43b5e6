"""Rule ledger, policies and ablations against plain Python."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from seriesloom.llm import quality_rules as Q
from tests.llm.fixtures import corpus, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, chars, symbols = len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>")
    dup, letters = len(lines) - len(set(lines)), sum(any(c.isalpha() for c in w) for w in words)
    bits = [n < 50, 100 * len(covered) > 50 * n, 10 * symbols > n, chars < 2 * n, chars > 15 * n, 2 * dup > len(lines),
            10 * letters < 8 * n]
    return n, chars, symbols, len(lines), dup, len(covered), letters, sum(b << i for i, b in enumerate(bits))


def odd():
    r = random.Random(4)
    few = ["a", "b", "c", "#", "d$", "12"]
    texts = [" ".join(r.choice(few[:k]) for _ in range(r.randint(1, 90))) for k in (1, 2, 3, 4, 6) for _ in range(12)]
    texts += ["\n".join(r.choice(["x y z", " x y z", "", " \t", "one two"]) for _ in range(r.randint(1, 30))) for _ in range(20)]
    texts += ["# " * 60, "|" * 400, "a\x0bb\x0cc\rd " * 20, "é" * 16 + " " + "ß " * 60, "    x " * 30]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rows", [corpus(), odd(), [(None, None, None, None, None)] * 2])
def test_ledger(spark, rows):
    got = Q.ledger(frame(spark, rows, True).withColumn("failures", F.lit("clash"))).collect()
    assert got[0].__fields__ == ["doc_id", *Q.MEASURES, "failures"]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((r[0], *by_hand(r[1]))) for r in rows)


def test_policies(spark):
    rows = corpus() + odd()
    df = frame(spark, rows, True)
    entries = Q.ledger(df).withColumn("KEPT_base_1", F.lit("clash"))
    got = Q.verdicts(entries, [("base", 1), ("prose", 2)]).collect()
    assert all(r.kept_base_1 == (r.failures & 3 == 0) and r.kept_prose_2 == (r.failures == 0) for r in got)
    out = Q.kept(df, ("prose", 1))
    assert out.columns == df.columns
    want = [r for r in rows if by_hand(r[1])[-1] & 7 == 0]
    assert sorted(str(tuple(r)[:2]) for r in out.collect()) == sorted(str(r[:2]) for r in want) and want
    with pytest.raises(ValueError):
        Q.kept(df, ("prose", 9))


def test_ablations(spark):
    rows = corpus() + odd()
    bits = [by_hand(r[1])[-1] for r in rows]
    got = Q.ablations(Q.ledger(frame(spark, rows))).collect()
    assert len(got) == sum(map(len, Q.POLICIES.values()))
    for r in got:
        m, b = Q.policy_mask(r.policy, r.version), Q.mask([r.rule])
        assert r.failed == sum(x & b != 0 for x in bits) and r.failed_alone == sum(x & m == b for x in bits)
        assert r.kept == sum(x & m == 0 for x in bits) and r.kept_without == r.kept + r.failed_alone


def test_empty(spark):
    none = frame(spark, [])
    assert Q.ledger(none).collect() == [] and Q.kept(none).collect() == []
    assert all(r.kept == r.failed == 0 for r in Q.ablations(Q.ledger(none)).collect())


def test_long_text(spark):
    """Five times the words take about five times as long, repeats and all."""
    took = []
    for n in (40_000, 40_000, 200_000):
        text = " ".join(f"w{i % 7 * (i % 11)}" for i in range(n)) + " " + "1" * n
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        at = time.time()
        row = Q.ledger(df).first()
        took.append(time.time() - at)
        assert row.n_words == n + 1 and row.n_repeat_words == n
    assert took[2] < 12 * took[1] + 2
