"""Small awkward corpora shared by the tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(random_, n):
    return " ".join("".join(random_.choice("abcdefghijklmnop") for _ in range(random_.randint(1, 7))) for _ in range(n))


def corpus(seed=1, n=60):
    """Copies, near copies, shared passages, nulls, blanks, long texts, ties, repeated rows and null ids."""
    r = random.Random(seed)
    base = [words(r, r.randint(1, 160)) for _ in range(n)]
    passage = words(r, 70)
    texts = list(base)
    texts += base[:8] * 2  # copies
    texts += [b + " tail" for b in base[:5]]  # near copies
    texts += [words(r, 30) + " " + passage + "\n" + words(r, 12) for _ in range(6)]
    texts += [None, "", " \t\n", "one", "ONE", words(r, 3000), "a  b\n\nc ", "é ü 日本 " * 30, passage + " " + passage]
    rows = [(3 * i % 997, t, r.choice(["en", "de", None]), r.choice(["s0", "s0", "s1", "s2", "é", None]), None if t is None
             else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base[1], "en", "s1", 1), (None, "no id", None, None, None), (5, base[2], "en", "s1", 7)]
    return rows


def frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        for name in ("kept", "Group_Size", "row", "size", "score", "taken", "rank", "fingerprint", "runs", "length"):
            df = df.withColumn(name, F.lit("clash"))
    return df
