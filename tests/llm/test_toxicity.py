"""The classifier against a plain convolution: scores of the query, and the direction of training against numeric gradients."""

import zlib

import numpy as np
import pytest

from seriesloom.llm import toxicity as T


def plain(model, text):
    """Score by loops over windows, filters and words."""
    vectors = [model["embed"][T._buckets(w)].sum(0) for w in text.split()] or [np.zeros(T.DIM)]
    n = len(vectors)
    vectors += [np.zeros(T.DIM)] * max(T.WIDTHS)
    z, at = model["out_bias"], 0
    for w, filters, bias in zip(T.WIDTHS, model["filters"], model["bias"]):
        for f in range(T.FILTERS):
            top = max(sum(vectors[i + j] @ filters[j * T.DIM:(j + 1) * T.DIM, f] for j in range(w)) for i in range(n))
            z += max(top + bias[f], 0.0) * model["out"][at]
            at += 1
    return 1 / (1 + np.exp(-z))


def weights(model):
    return {"embed": model.embed.astype(float), "filters": [f.astype(float) for f in model.filters],
            "bias": [b.astype(float) for b in model.bias], "out": model.out.astype(float), "out_bias": model.out_bias}


def corpus(n, words=12, seed=2):
    r = np.random.default_rng(seed)
    return [" ".join(("bad" if i % 2 and j == 3 else f"w{r.integers(40)}") for j in range(words)) for i in range(n)]


def test_scores_equal_a_plain_convolution():
    model = T.train([t.encode() for t in corpus(40)], np.array([i % 2 for i in range(40)], float), epochs=2)
    score, own = T.Scorer(model), weights(model)
    for text in [*corpus(6, 9, 5), "", " \n", "one", "two words", "BAD, bad! (bad)"]:
        assert score(text.encode()) == pytest.approx(plain(own, text.encode()), abs=1e-5)


def test_first_step_goes_against_numeric_gradients(monkeypatch):
    """The first step of Adam has the size of the rate and the sign of the gradient, turned round."""
    for name, x in (("DROP", 0.0), ("MIN_DOCS", 1), ("STEPS", 0)):
        monkeypatch.setattr(T, name, x)
    texts, labels, rate = [t.encode() for t in corpus(8)], np.array([i % 2 for i in range(8)], float), 1e-3
    before, after = weights(T.Model.start(7)), weights(T.train(texts, labels, epochs=1, batch=8, rate=rate))
    unmet = np.ones(T.BUCKETS, bool)
    unmet[[b for t in texts for w in t.split() for b in T._buckets(w)]] = False
    before["embed"][unmet] = 0

    def loss():
        p = np.array([plain(before, t) for t in texts])
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    r, seen = np.random.default_rng(1), 0
    places = [(before["embed"], after["embed"], (b, r.integers(T.DIM))) for b in T._buckets(b"bad")]
    for a, b in [*zip(before["filters"], after["filters"]), *zip(before["bias"], after["bias"]), (before["out"], after["out"])]:
        places += [(a, b, tuple(int(r.integers(s)) for s in a.shape)) for _ in range(8)]
    for old, new, at in places:
        kept = old[at]
        old[at] = kept + 1e-5
        up = loss()
        old[at] = kept - 1e-5
        slope = (up - loss()) / 2e-5
        old[at] = kept
        if abs(slope) > 1e-4:
            seen += 1
            assert new[at] - kept == pytest.approx(-rate * np.sign(slope), rel=0.05)
    assert seen > 20


def test_query_on_null_ids_and_long_texts(spark, tmp_path):
    texts = corpus(60)
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, texts[1], None), (100, None, "en"), (101, "", None),
                                                            (102, " ".join(texts) * 3, "de"), (5, texts[5], "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(i, i % 2) for i in range(60)] + [(None, 1), (101, None)]
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = T.op5(spark, str(tmp_path)).collect()
    model = weights(T.fit(spark.read.parquet(str(tmp_path / "documents.parquet")),
                          T.marks_of(spark.read.parquet(str(tmp_path / "labels.parquet")))))
    assert len(got) == len(rows)
    known = {i: t for i, t, _ in rows}
    for row in got:
        assert row.held_out == (row.doc_id is None or zlib.crc32(str(row.doc_id).encode()) % 3 == 1)
        assert row.score == pytest.approx(plain(model, (known[row.doc_id] or "").encode()), abs=1e-5)
        assert row.predicted == int(row.score >= 0.7)
