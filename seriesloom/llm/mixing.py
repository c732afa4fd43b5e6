"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source is a queue of its documents in a shuffled order, repeated up to ``max_repeats`` times. A copy's virtual finish
time is the cumulative size of its source up to and with the copy, divided by the weight of the source. All copies are then
ordered by finish time over the whole table and the order is cut at the total budget. A queue that runs dry leaves its share
to the others by weight, which is the water level that ``targets`` computes.

Running sums never gather a source in one task: a source is cut into BUCKETS ranges of the shuffle hash, the global order
into ranges of finish time (SLOTS for each doubling), and sums of the ranges before are joined to sums within a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import WORD, query, staged, table, word_count

BUCKETS, SLOTS = 4096, 2048


def cycle_weights(values: tuple[float, ...] = (3.0, 1.0, 2.0)) -> Column:
    """Weights dealt out by the rank of a source: the values in turn. To be given to ``mix``."""
    parts = F.array(*[F.lit(float(v)) for v in values])
    return F.element_at(parts, F.pmod(F.col("source_rank"), F.lit(len(values))).cast("int") + 1)


def targets(sources: DataFrame, budget_share: float, max_repeats: int) -> tuple[DataFrame, float, float]:
    """Targets of sources (source_rank, source_size, weight), the water level and the budget.

    The level is the virtual time at which the queues have given the budget: target = min(max_repeats * size, weight *
    level). ``sources`` has one row per source, a table as small as the list of weights that goes with it.
    """
    cap = F.col("source_size") * F.lit(max_repeats)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget = min(budget_share * total, float(max_repeats * total))
    by_time = Window.orderBy((cap / F.col("weight")).asc(), F.col("source_rank"))
    level = sources.select(
        (cap / F.col("weight")).alias("full_at"), F.row_number().over(by_time).alias("place"),
        ((F.lit(budget) - F.coalesce(F.sum(cap).over(by_time.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
         / F.sum("weight").over(by_time.rowsBetween(0, Window.unboundedFollowing))).alias("level"))
    found = level.where("level <= full_at").agg(F.min_by("level", "place")).first()[0]
    target = cap.cast("double")
    if found is not None:
        target = F.when(cap / F.col("weight") < F.lit(found), target).otherwise(F.col("weight") * F.lit(found))
    return sources.withColumn("target", target), found if found is not None else float("inf"), budget


def shuffle_key(epoch: Column, id: Column) -> Column:
    """60 bits that order the documents of a source in one pass over it."""
    text = F.concat_ws(":", epoch.cast("string"), F.coalesce(id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def mix(df: DataFrame, weight: Column | None = None, id: str = "doc_id", source: str = "source",
        size: Column | None = None, budget_share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """Copies that the mix takes and those it leaves: one row per document with doc_id, source, size, source_size, weight,
    target, taken, and ``copies``, the words taken in each pass over its source.

    weight: an expression over ``source_rank`` (from 0, sources by code point, null last) and ``source``, positive. size: an
    expression over the columns of df, words of ``text`` by default. The copy at the cut is taken in part, so all taken
    words together are the budget. Sizes of 0 take 0. Null ids and repeated rows are documents of their own; equal ids are
    ordered by size, and the same rows give the same mix whatever their order. An empty table gives an empty result.
    """
    weight = cycle_weights() if weight is None else weight
    size = word_count(F.col("text")) if size is None else size
    docs = staged(df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id}`").cast("long").alias("doc_id"),
                            F.col(f"`{source}`").cast("string").alias("source"),
                            F.coalesce(size.cast("long"), F.lit(0)).alias("size")))
    return mix_sizes(docs, weight, budget_share, max_repeats)


def mix_sizes(docs: DataFrame, weight: Column, budget_share: float, max_repeats: int) -> DataFrame:
    """``mix`` over a staged table of row (unique), doc_id, source and size."""
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sums.withColumn("source_rank", (F.row_number().over(by_name) - 1).cast("long")) \
        .withColumn("weight", weight.cast("double"))
    sources = staged(sources)
    sources, level, budget = targets(sources, budget_share, max_repeats)
    known = docs.withColumn("_source", F.concat(F.lit("s"), F.col("source"))).fillna({"_source": "n"}) \
        .join(sources.withColumn("_source", F.concat(F.lit("s"), F.col("source"))).fillna({"_source": "n"})
              .drop("source"), "_source").drop("_source")

    epochs = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("epoch")
    copies = known.where("size > 0").select("row", "doc_id", "size", "source_rank", "weight", epochs)
    copies = copies.withColumn("key", shuffle_key(F.col("epoch"), F.col("doc_id"))) \
        .withColumn("bucket", F.shiftright("key", 48).cast("int"))
    parts = ["source_rank", "epoch", "bucket"]
    before = Window.partitionBy("source_rank").orderBy("epoch", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = copies.groupBy(*parts).agg(F.sum("size").alias("words")) \
        .select(*parts, F.coalesce(F.sum("words").over(before), F.lit(0)).alias("words_before"))
    within = Window.partitionBy(*parts).orderBy("key", "doc_id", "size", "row") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timed = copies.join(offsets, parts).withColumn(
        "finish", (F.col("words_before") + F.sum("size").over(within)) / F.col("weight"))

    scale = level if 0 < level < float("inf") else 1.0
    timed = timed.withColumn("slot", F.floor(F.log2(F.col("finish") / F.lit(scale)) * F.lit(SLOTS)))
    timed = staged(timed.select("row", "doc_id", "size", "source_rank", "epoch", "key", "finish", "slot"))
    earlier = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # at most SLOTS rows a doubling
    slots = timed.groupBy("slot").agg(F.sum("size").alias("words")) \
        .select("slot", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("words_before"))
    inside = Window.partitionBy("slot").orderBy("finish", "source_rank", "epoch", "key", "doc_id", "size", "row") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = timed.join(slots, "slot").withColumn("start", F.col("words_before") + F.sum("size").over(inside)
                                                  - F.col("size"))
    words = F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.lit(budget)).cast("long") - F.col("start")))
    taken = placed.groupBy("row").agg(
        F.sum(words).alias("taken"),
        F.transform(F.array_sort(F.collect_list(F.struct("epoch", words.alias("words")))), lambda c: c["words"])
        .alias("copies"))
    none = F.array_repeat(F.lit(0).cast("long"), max_repeats)
    return known.join(taken, "row", "left").select(
        "row", "doc_id", "source", "size", "source_size", "weight", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("copies", none).alias("copies"))


def mixed(df: DataFrame, weight: Column | None = None, id: str = "doc_id", source: str = "source", text: str = "text",
          budget_share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """The mixed corpus: a row per copy taken, with the columns of the input; the copy at the cut keeps its first words."""
    weight = cycle_weights() if weight is None else weight
    names = df.columns
    whole = staged(df.withColumn("_sl_row", F.monotonically_increasing_id()))
    docs = staged(whole.select(F.col("_sl_row").alias("row"), F.col(f"`{id}`").cast("long").alias("doc_id"),
                               F.col(f"`{source}`").cast("string").alias("source"),
                               word_count(F.col(f"`{text}`")).alias("size")))
    plan = mix_sizes(docs, weight, budget_share, max_repeats).where("taken > 0 OR size = 0") \
        .select(F.col("row").alias("_sl_row"), F.col("size").alias("_sl_size"), F.col("copies").alias("_sl_copies"))
    rows = whole.join(plan, "_sl_row").withColumn(
        "_sl_take", F.explode(F.when(F.col("_sl_size") == 0, F.array(F.lit(0).cast("long")))
                              .otherwise(F.filter("_sl_copies", lambda c: c > 0))))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(WORD), F.lit(0)), 1,
                               F.greatest(F.col("_sl_take"), F.lit(1)).cast("int")), " ")
    kept = F.when(F.col("_sl_take") == F.col("_sl_size"), F.col(f"`{text}`")).otherwise(cut)
    return rows.select(*[kept.alias(c) if c == text else F.col(f"`{c}`") for c in names])


@query("op1_source_mixing", r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank
      FROM d GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[(source_rank % 3 + 1)::INT] AS weight FROM s),
b AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS budget FROM w),
l AS (SELECT (2 * source_size)::DOUBLE / weight AS full_at,
             row_number() OVER (ORDER BY (2 * source_size)::DOUBLE / weight, source_rank) AS place,
             (budget - coalesce(sum((2 * source_size)::DOUBLE) OVER (ORDER BY (2 * source_size)::DOUBLE / weight, source_rank
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
             sum(weight) OVER (ORDER BY (2 * source_size)::DOUBLE / weight, source_rank
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w, b),
lev AS (SELECT arg_min(level, place) AS level FROM l WHERE level <= full_at),
t AS (SELECT w.*, CASE WHEN level IS NULL OR (2 * source_size)::DOUBLE / weight < level THEN (2 * source_size)::DOUBLE
                       ELSE weight * level END AS target FROM w, lev),
c AS (SELECT rid, doc_id, size, source_rank, weight, epoch,
             ('0x' || substr(md5(epoch::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (SELECT unnest([0, 1]) AS epoch) e WHERE size > 0),
f AS (SELECT *, (sum(size) OVER (PARTITION BY source_rank ORDER BY epoch, key, doc_id, size, rid
                                 ROWS UNBOUNDED PRECEDING))::DOUBLE / weight AS finish FROM c),
p AS (SELECT *, sum(size) OVER (ORDER BY finish, source_rank, epoch, key, doc_id, size, rid ROWS UNBOUNDED PRECEDING) - size
             AS start FROM f),
k AS (SELECT rid, sum(greatest(0, least(size, floor(budget)::BIGINT - start)))::BIGINT AS taken FROM p, b GROUP BY rid)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(k.taken, 0) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON k.rid = d.rid
""")
def op1(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
