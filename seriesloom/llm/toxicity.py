"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

A word is hashed, whole and by its prefixes, into embedding buckets whose vectors add up. Filters of several widths slide over
the word vectors of the whole text, each keeps its largest response, and a logistic layer reads those. Training looks at a
bounded, documented sample of labelled rows (MAX_TRAIN); scoring reads every word of every text in blocks that overlap by the
widest filter, so memory is bounded and long texts lose nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import query, short_batches, table, text_bytes, without

#: Labelled documents that are fitted at most, with their whole texts, taken in the order of a hash.
MAX_TRAIN = 6000
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 8
#: Buckets met in fewer fitted documents keep a vector of zeros: a word of one document says nothing of others. In training a
#: word is left out at this rate, so that no single word carries a document.
MIN_DOCS, DROP, STEPS = 5, 0.7, 1000
PREFIXES = (3, 4, 5, 6)
#: Words in a block of a text; words whose vectors a task remembers (the first ones met, so the common ones).
BLOCK, MEMO = 1 << 14, 200_000
#: Language thresholds are kept within these bounds, and languages with fewer labelled documents use that of all.
LOW, HIGH, ENOUGH = 0.05, 0.95, 50


def _buckets(word: bytes) -> list[int]:
    """Embedding buckets of a word: the word, and its prefixes in letters; A-Z, punctuation around it and case fall away."""
    w = word.lower().strip(b".,;:!?\"'()[]")
    letters = w.decode("utf-8", "replace")
    grams = [b"w" + w] + [b"p" + letters[:k].encode() for k in PREFIXES]
    return [zlib.crc32(g) % BUCKETS for g in grams]


class Words:
    """Numbers for words, and the words that were new since ``fresh`` was last emptied, with their buckets in ``rows``."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.rows: list[list[int]] = []
        self.fresh: list[bytes] = []

    def __call__(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        out = list(map(get, words))
        if None in out:
            for i, k in enumerate(out):
                if k is None:
                    w = words[i]
                    k = get(w)
                    if k is None:
                        k = self.number[w] = len(self.number)
                        self.rows.append(_buckets(w))
                        self.fresh.append(w)
                    out[i] = k
        return np.array(out, np.int64)


@dataclass
class Model:
    """Weights: embeddings (BUCKETS, DIM), per width filters (width * DIM, FILTERS) and biases, output weights and bias."""

    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float

    @staticmethod
    def start(seed: int) -> "Model":
        random = np.random.default_rng(seed)
        wide = [random.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        return Model(random.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), wide,
                     [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                     random.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)

    def responses(self, vectors: np.ndarray, starts: int) -> np.ndarray:
        """Largest response of each filter over the windows that start at the first ``starts`` words; zeros follow the last."""
        top = []
        padded = np.concatenate((vectors, np.zeros((max(WIDTHS) - 1, DIM), np.float32)))
        n = starts
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            total = padded[:n] @ f[:DIM]
            for k in range(1, w):
                total += padded[k:n + k] @ f[k * DIM:(k + 1) * DIM]
            top.append(total.max(0) + b)
        return np.concatenate(top)

    def score(self, top: np.ndarray) -> float:
        z = float(np.maximum(top, 0) @ self.out + self.out_bias)
        return 1.0 / (1.0 + np.exp(-min(max(z, -30.0), 30.0)))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7, epochs: int = 6, batch: int = 32,
          rate: float = 0.01, balance: float = 0.5) -> Model:
    """Adam on the logistic loss; gradients flow through the word at which a filter was largest.

    Classes are weighted by their share to the power -balance. Small samples are gone over more often, for STEPS steps.
    """
    model, random = Model.start(seed), np.random.default_rng(seed)
    if not len(texts) or labels.min() == labels.max():
        model.out[:] = 0
        model.out_bias = -3.0 if not len(texts) or labels.max() == 0 else 3.0
        return model
    words, docs = Words(), []
    for t in texts:
        docs.append(words(t.split()))
    rows = np.array(words.rows or [[0] * (1 + len(PREFIXES))], np.int64)
    met = np.zeros(BUCKETS, np.int64)
    for d in docs:
        met[np.unique(rows[d])] += 1
    model.embed[met < MIN_DOCS] = 0
    share = np.where(labels == 1, labels.mean(), 1 - labels.mean())
    weight = share ** -balance / np.mean(share ** -balance)
    epochs = max(epochs, min(8 * epochs, -(-STEPS * batch // len(docs))))
    pad, tail = max(WIDTHS) - 1, np.zeros((max(WIDTHS) - 1, DIM), np.float32)
    params = [*model.filters, *model.bias, model.out]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    em, ev = np.zeros_like(model.embed), np.zeros_like(model.embed)
    step, slope, slope_m, slope_v = 0, 0.0, 0.0, 0.0
    for _ in range(epochs):
        order = random.permutation(len(docs))
        for k in range(0, len(order), batch):
            step += 1
            grads = [np.zeros_like(p) for p in params]
            slope = 0.0
            touched, steps = [], []
            for d in order[k:k + batch]:
                ids = docs[d]
                ids = ids[random.random(len(ids)) >= DROP]
                vectors = model.embed[rows[ids]].sum(1) if len(ids) else np.zeros((1, DIM), np.float32)
                padded = np.concatenate((vectors, tail))
                n, top, where = len(vectors), [], []
                for w, f, b in zip(WIDTHS, model.filters, model.bias):
                    total = padded[:n] @ f[:DIM]
                    for j in range(1, w):
                        total += padded[j:n + j] @ f[j * DIM:(j + 1) * DIM]
                    at = total.argmax(0)
                    where.append(at)
                    top.append(total[at, np.arange(FILTERS)] + b)
                top = np.concatenate(top)
                error = (model.score(top) - labels[d]) * weight[d] / batch
                live = top > 0
                grads[-1] += (error * np.maximum(top, 0)).astype(np.float32)
                slope += error
                down = (error * model.out * live).astype(np.float32)
                back = np.zeros((n + pad, DIM), np.float32)
                for i, w in enumerate(WIDTHS):
                    g = down[i * FILTERS:(i + 1) * FILTERS]
                    grads[len(WIDTHS) + i] += g
                    for j in range(w):
                        part = slice(j * DIM, (j + 1) * DIM)
                        grads[i][part] += padded[where[i] + j].T * g
                        np.add.at(back, where[i] + j, (model.filters[i][part] * g).T)
                if len(ids):
                    hit = np.flatnonzero(back[:n].any(1))
                    touched.append(rows[ids[hit]].ravel())
                    steps.append(np.repeat(back[hit], rows.shape[1], axis=0))
            scale = rate * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= scale * a / (np.sqrt(b) + 1e-8)
            slope_m += 0.1 * (slope - slope_m)
            slope_v += 0.001 * (slope * slope - slope_v)
            model.out_bias -= float(scale * slope_m / (np.sqrt(slope_v) + 1e-8))
            if touched:
                at, back = np.unique(np.concatenate(touched), return_inverse=True)
                g = np.zeros((len(at), DIM), np.float32)
                np.add.at(g, back, np.concatenate(steps))
                g[met[at] < MIN_DOCS] = 0
                em[at] += 0.1 * (g - em[at])
                ev[at] += 0.001 * (g * g - ev[at])
                model.embed[at] -= (scale * em[at] / (np.sqrt(ev[at]) + 1e-8)).astype(np.float32)
    return model


class Scorer:
    """Scores of whole texts; word vectors are remembered up to MEMO words."""

    def __init__(self, model: Model):
        self.model, self.words = model, Words()
        self.vectors = np.zeros((1 << 12, DIM), np.float32)
        self.known = 0

    def _vectors(self, words: list[bytes]) -> np.ndarray:
        ids = self.words(words)
        now = len(self.words.number)
        if now > self.known:
            if now > len(self.vectors):
                self.vectors = np.concatenate((self.vectors, np.zeros((max(now, len(self.vectors)), DIM), np.float32)))
            self.vectors[self.known:now] = self.model.embed[np.array(self.words.rows, np.int64)].sum(1)
            self.known = now
            found = self.vectors[ids]
            if now > MEMO:  # what came last is forgotten
                for w in self.words.fresh[-(now - MEMO):]:
                    del self.words.number[w]
                self.known = MEMO
            self.words.rows.clear()
            self.words.fresh.clear()
            return found
        return self.vectors[ids]

    def __call__(self, text: bytes) -> float:
        words = text.split()
        if not words:
            return self.model.score(self.model.responses(np.zeros((1, DIM), np.float32), 1))
        top, over = None, max(WIDTHS) - 1
        for k in range(0, len(words), BLOCK):
            part = self.model.responses(self._vectors(words[k:k + BLOCK + over]), min(BLOCK, len(words) - k))
            top = part if top is None else np.maximum(top, part)
        return self.model.score(top)


def fit(documents: DataFrame, marks: DataFrame, text: str = "text", label: str = "toxic", id: str = "doc_id",
        max_train: int = MAX_TRAIN, seed: int = 7) -> Model:
    """A model of at most ``max_train`` labelled documents, half of them at most from each label, by a hash of the id.

    marks: id and label, one row per id. The sample is chosen before texts are read, so its ids are all that is broadcast.
    Null labels are left out. Without labelled documents, or with one label only, every text gets the same score.
    """
    known = marks.where(F.col(label).isNotNull() & F.col(id).isNotNull()).select(
        F.col(f"`{id}`").alias("id"), (F.col(f"`{label}`") > 0).cast("int").alias("label"))
    order = F.xxhash64("id")
    halves = [known.where(F.col("label") == k).orderBy(order, "id").limit(max_train // 2) for k in (0, 1)]
    chosen = halves[0].unionByName(halves[1])
    rows = documents.select(F.col(f"`{id}`").alias("id"), text_bytes(F.col(f"`{text}`")).alias("text"))
    found = rows.join(F.broadcast(chosen), "id").orderBy(order, F.xxhash64("text")).limit(max_train).collect()
    return train([bytes(r["text"]) for r in found], np.array([r["label"] for r in found], np.float64), seed)


def score(df: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """The table with a score from 0 to 1 for every whole text; null texts count as empty ones, which have a score too."""
    spark = df.sparkSession
    short_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # BUCKETS * DIM floats, whatever the input

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.value)
        for texts in batches:
            yield pd.Series([scorer(t) for t in texts])

    df = without(df, [column])
    return df.withColumn(column, scored(text_bytes(F.col(f"`{text}`"))))


def thresholds(scored: DataFrame, marks: DataFrame, lang: str = "lang", label: str = "toxic",
               id: str = "doc_id", score: str = "score") -> dict[str | None, float]:
    """For each language the threshold that errs least on its labelled rows, and under None that of all rows.

    All labelled rows count, over a histogram of 100 scores a language, aggregated by Spark. Toxic rows count as much as clean
    ones. Between thresholds that err alike the middle one is taken. The languages are as few as there are of them.
    """
    scored = scored.select(id, F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{score}`").alias("score")) \
        .join(marks.select(id, label), id)
    bins = scored.where(F.col(label).isNotNull()).groupBy("lang", F.floor(F.least("score", F.lit(0.9999)) * 100).alias("bin")) \
        .agg(F.sum((F.col(label) > 0).cast("long")).alias("toxic"), F.count("*").alias("rows")).collect()
    counts: dict[str | None, np.ndarray] = {None: np.zeros((2, 100))}
    for r in bins:
        for k in {r["lang"], None}:
            counts.setdefault(k, np.zeros((2, 100)))[:, int(r["bin"])] += r["rows"] - r["toxic"], r["toxic"]
    found = {}
    for k, (clean, toxic) in counts.items():
        if clean.sum() and toxic.sum() and (k is None or clean.sum() + toxic.sum() >= ENOUGH):
            over = np.concatenate((clean[::-1].cumsum()[::-1], [0])) / clean.sum()
            under = np.concatenate(([0], toxic.cumsum())) / toxic.sum()
            best = np.flatnonzero(np.isclose(over + under, (over + under).min()))
            found[k] = float(np.clip(best[len(best) // 2] / 100, LOW, HIGH))
    found.setdefault(None, 0.5)
    return found


def reject(scored: DataFrame, limits: dict[str | None, float], lang: str = "lang", column: str = "rejected",
           score: str = "score") -> DataFrame:
    """Whether the score reaches the threshold of the document's language, or that of all where it has none."""
    limit: Column = F.lit(limits[None])
    for k, x in limits.items():
        if k is not None:
            limit = F.when(F.col(f"`{lang}`") == k, F.lit(x)).otherwise(limit)
    return without(scored, [column]).withColumn(column, F.col(f"`{score}`") >= limit)


def learnable(id: Column) -> Column:
    """Rows that labels may be learned from: two of three parts by the crc32 of the id as text; null ids are held out."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def marks_of(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the rows that labels may be learned from; of repeated labels the largest counts."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learnable(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


@query("op5_toxicity")
def op5(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(documents, marks_of(labels))
    scored = score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
