"""Toxicity on held-out rows and the pipeline against its parts done by hand."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seriesloom.llm import QUERIES, toxicity
from tests.llm.fixtures import SCHEMA, corpus, frame
from tests.llm.test_dedup import closure, mark

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = QUERIES["op5_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    rows = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    toxic, found = {r.doc_id for r in rows if r.toxic}, {r.doc_id for r in rows if r.predicted}
    assert len(found - toxic) <= 0.02 * len(rows) and len(toxic & found) >= 0.8 * len(toxic)


def little(n=240):
    r = random.Random(3)
    good = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    out = []
    for i in range(n):
        w = [r.choice(good) for _ in range(r.randint(1, 60))]
        bad = i % 4 == 0
        if bad:
            w.insert(r.randrange(len(w) + 1), r.choice(["nasty", "vile", "awful"]))
        out.append((i, " ".join(w), "en" if i // 4 % 2 else "de", f"s{i % 3}", int(bad)))
    return out


def test_edges_of_scores(spark):
    rows = little()
    df = spark.createDataFrame([(a, b, c, d, len(b)) for a, b, c, d, _ in rows], SCHEMA)
    marks = spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(df, marks)
    odd = frame(spark, corpus(), True)
    got = toxicity.score(odd, model)
    assert len(got.columns) == len(odd.columns) and all(0 <= r.score <= 1 for r in got.collect())
    scored = toxicity.score(df, model)
    limits = toxicity.thresholds(scored, marks)
    assert set(limits) == {None, "en", "de"}
    wrong = toxicity.reject(scored, limits).join(marks, "doc_id").where("rejected <> (toxic = 1)").count()
    assert wrong <= 6
    assert toxicity.score(df.limit(0), model).collect() == []
    none = toxicity.fit(df, marks.limit(0))
    assert toxicity.score(df, none).agg(F.countDistinct("score")).first()[0] == 1
    assert toxicity.thresholds(scored, marks.limit(0)) == {None: 0.5}
    one = toxicity.fit(df, marks.where("toxic = 1"))
    assert toxicity.score(df, one).agg(F.min("score")).first()[0] > 0.5


def test_blocks_lose_nothing(monkeypatch):
    model = toxicity.Model.start(1)
    text = " ".join(f"w{i % 37}" for i in range(500)).encode()
    whole = toxicity.Scorer(model)(text)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    monkeypatch.setattr(toxicity, "MEMO", 10)
    assert np.isclose(toxicity.Scorer(model)(text), whole, rtol=1e-5)


def test_gradients():
    """Training moves the loss down on a task that one word decides."""
    rows = little()
    model = toxicity.train([r[1].encode() for r in rows], np.array([float(r[4]) for r in rows]), epochs=10)
    score = toxicity.Scorer(model)
    assert sum((score(r[1].encode()) >= 0.5) != bool(r[4]) for r in rows) <= 4


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Documents before and after each stage, written and reread."""
    folder = tmp_path_factory.mktemp("pipeline")
    rows = little()
    rows += [(1000 + i, rows[i * 4 + 1][1], "en", "s1", 0) for i in range(12)]  # copies
    r = random.Random(5)
    long = [" ".join(r.choice("abcdefgh") * 2 + str(r.randrange(99)) for _ in range(400)) for _ in range(4)]
    rows += [(2000 + 10 * i + k, t + f" end{k}", "de", "s2", 0) for i, t in enumerate(long) for k in range(3)]
    docs = spark.createDataFrame([(a, b, c, d, len(b)) for a, b, c, d, _ in rows], SCHEMA)
    spark.createDataFrame([(x[0], 1, x[4]) for x in rows], "doc_id long, quality int, toxic int") \
        .write.parquet(str(folder / "labels.parquet"))
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], str(folder)).write.parquet(str(folder / str(k)))
        out.append(spark.read.parquet(str(folder / str(k))))
    return rows, out


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "source_mixing", "packing"]


def test_stages(spark, stages):
    rows, (docs, clean, exact, near, mixed, packed) = stages
    for frame_ in (clean, exact, near, mixed):
        assert frame_.columns == docs.columns
    toxic = {r[0] for r in rows if r[4]}
    kept = {r.doc_id for r in clean.collect()}
    assert len(kept & toxic) <= 5 and len({r[0] for r in rows} - kept - toxic) <= 5
    by = {}
    for r in clean.collect():
        by[r.text] = max(by.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in exact.collect()} == set(by.values())
    left = exact.collect()
    roots = closure([mark(r.text) for r in left], [r.doc_id for r in left], 4)
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(roots)) and len(set(roots)) < len(left)
    words = near.select(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert mixed.select(F.sum(F.size(F.split("text", " ")))).first()[0] == int(1.5 * words)
    assert packed.agg(F.countDistinct("doc_id")).first()[0] == mixed.agg(F.countDistinct("doc_id")).first()[0]


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns)
