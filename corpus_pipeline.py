"""Corpus pipeline: documents without toxic ones, copies and near copies, mixed by source and packed into sequences.

Each stage works on all that its predecessor kept. All but the last return the columns of ``documents``; the mix repeats a
document that it takes twice, and the last stage returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm import exact_dedup, mixing, packing, simhash, toxicity
from seriesloom.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold of their language."""
    marks = toxicity.marks_of(table(spark, sf_dir, "labels"))
    model = toxicity.fit(docs, marks)
    scored = staged(toxicity.score(docs, model, column="_sl_score"))
    limits = toxicity.thresholds(scored, marks, score="_sl_score")
    kept = toxicity.reject(scored, limits, column="_sl_rejected", score="_sl_score").where("NOT _sl_rejected")
    return kept.select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that chains of near fingerprints connect the one with the smallest doc_id."""
    return simhash.drop_near(docs, shingle=4, max_bits=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 3, 1, 2 in turn, over 150 % of all words, at most twice."""
    return mixing.mixed(docs, mixing.cycle_weights((3.0, 1.0, 2.0)), budget_share=1.5, max_repeats=2)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids."""
    return packing.digest(packing.pack(docs, end_id=1, capacity=2048))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies),
          ("source_mixing", mix_sources), ("packing", pack_sequences)]

#: Classifier, fingerprints and tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the whole pipeline makes of ``documents``; every stage is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
