"""Mixing sources to target weights by weighted fair queueing.

Every source queues its documents in a shuffled order, ``epochs`` times over. A copy's
virtual finish time is the source's tokens up to and including it, divided by the
source's weight. All copies are sorted by finish time across the cluster and cut where
their tokens reach the budget. A source whose queue ends early leaves its share to the
others, in proportion to their weights: serving by finish time *is* that sharing.

* Running totals of a hot source are taken in slices of its shuffled order; only the
  slices' sums (at most ``SLICES`` per source) are scanned in one window.
* The global order is a range partitioning. Partition sums tell which partition holds
  the cut, and only that one is scanned row by row.
* The result is one threshold per source (how many full rounds, and up to which ticket
  of the next). Documents are compared with it in place: no text is ever shuffled.

Defined cases: a null text has no words and is never taken; a null source is a source,
ranked last; rows equal in doc_id and text share a ticket and are taken together; an
empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import free_names, quoted, stage, whole, words

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"
SLICES = 16 ** 3  # the first three hex digits of a ticket


def ticket(doc_id: Column, text: Column) -> Column:
    """Place in the shuffled order: the same for the same document in any run."""
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), whole(text)))


def sized(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, size in words and ticket of every row, staged."""
    return stage(docs.select(
        quoted(doc_id).alias("doc_id"), quoted(source).alias("source"),
        F.size(words(quoted(text))).cast("long").alias("size"),
        ticket(quoted(doc_id), quoted(text)).alias("ticket")), "mix-sizes")


def shares(rows: DataFrame, weights: tuple = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: rank, weight, source_size, target. The windows run over
    sources, never over documents.

    With every source capped at epochs times its size, the level at which the capped
    shares fill the budget is the largest of the levels found by taking the k sources
    that cap first as full.
    """
    everyone = Window.partitionBy()
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per_source.withColumn("rank", F.row_number().over(everyone.orderBy(F.col("source").asc_nulls_last())) - 1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = (ranked.withColumn("weight", pick)
              .withColumn("cap", (epochs * F.col("source_size")).cast("double")))
    early = everyone.orderBy(F.col("cap") / F.col("weight"), "rank")
    filled = F.coalesce(F.sum("cap").over(early.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(early.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(everyone).cast("double")
    level = capped.withColumn("level", (budget - filled) / open_weight)
    return (level.withColumn("level", F.max("level").over(everyone))
            .select("source", "rank", "weight", "source_size",
                    F.least("cap", F.col("level") * F.col("weight")).alias("target")))


def thresholds(rows: DataFrame, weights: tuple = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """shares() with the last copy that the mix takes of each source: last_round, last_ticket."""
    plan = stage(shares(rows, weights, epochs), "mix-shares")
    facts = plan.select(F.col("source").alias("of"), "rank", "weight", "source_size")
    queued = (rows.where("size > 0").join(facts, rows.source.eqNullSafe(facts["of"]))
              .select("rank", "weight", "source_size", "size", "ticket",
                      F.substring("ticket", 1, 3).alias("slice")))
    sums = queued.groupBy("rank", "slice").agg(F.sum("size").alias("slice_size"))
    before = (Window.partitionBy("rank").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("rank", "slice", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("rank", "slice").orderBy("ticket").rangeBetween(Window.unboundedPreceding, 0)
    placed = (queued.withColumn("within", F.sum("size").over(inside)).join(starts, ["rank", "slice"])
              .withColumn("place", F.col("start") + F.col("within")))
    copies = placed.withColumn("round", F.explode(F.array(*map(F.lit, range(epochs)))))
    timed = copies.select(
        ((F.col("round") * F.col("source_size") + F.col("place")) / F.col("weight")).alias("finish"),
        "rank", "round", "ticket", "size")
    queue = stage(timed.repartitionByRange("finish", "rank").sortWithinPartitions("finish", "rank")
                  .withColumn("part", F.spark_partition_id()), "mix-queue")

    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
    parts = queue.groupBy("part").agg(F.sum("size").alias("part_size"))
    upto = Window.partitionBy().orderBy("part")
    edge = (parts.withColumn("upto", F.sum("part_size").over(upto)).crossJoin(budget)
            .where("upto >= budget").orderBy("part").limit(1)
            .select(F.col("part").alias("edge"), (F.col("upto") - F.col("part_size")).alias("served"), "budget"))
    edge = stage(edge, "mix-edge")
    # The partition with the cut, row by row; equal finish times are served together.
    moment = F.struct("finish", "rank")
    row = Window.partitionBy("part").orderBy(moment).rangeBetween(Window.unboundedPreceding, 0)
    last = (queue.join(edge, queue.part == edge.edge)
            .withColumn("so_far", F.col("served") + F.sum("size").over(row))
            .where("so_far <= budget").agg(F.max(moment).alias("cut")))
    served = (queue.crossJoin(edge.select("edge")).crossJoin(last)
              .where((F.col("part") < F.col("edge")) | ((F.col("part") == F.col("edge")) & (moment <= F.col("cut"))))
              .groupBy("rank").agg(F.max(F.struct("round", "ticket")).alias("last")))
    return stage(plan.join(served.select(F.col("rank").alias("r"), "last"), F.col("rank") == F.col("r"), "left")
                 .select("source", "source_size", "target", F.col("last.round").alias("last_round"),
                         F.col("last.ticket").alias("last_ticket")), "mix-thresholds")


def copies_taken(size: Column, own: Column, last_round: Column, last_ticket: Column) -> Column:
    """How often the mix takes a document of this size and ticket, from its source's threshold."""
    return F.when((size > 0) & last_round.isNotNull(), last_round + (own <= last_ticket).cast("int")).otherwise(0)


def mark(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
         weights: tuple = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words the mix takes)."""
    rows = sized(docs, doc_id, source, text)
    limits = thresholds(rows, weights, epochs).withColumnRenamed("source", "of")
    return rows.join(limits, rows.source.eqNullSafe(limits["of"])).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * copies_taken(*map(F.col, ("size", "ticket", "last_round", "last_ticket"))))
        .cast("long").alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
        weights: tuple = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, columns unchanged."""
    limits = thresholds(sized(docs, doc_id, source, text), weights, epochs)
    of, times = free_names(docs, "mix_of", "mix_times")
    limits = limits.select(F.col("source").alias(of), F.struct("last_round", "last_ticket").alias(times))
    joined = docs.join(limits, docs[f"`{source}`"].eqNullSafe(limits[f"`{of}`"]))
    limit = quoted(times)
    n = copies_taken(F.size(words(quoted(text))), ticket(quoted(doc_id), quoted(text)),
                     limit["last_round"], limit["last_ticket"])
    return (joined.withColumn(times, F.explode(F.array_repeat(F.lit(1), n.cast("int"))))
            .select(*map(quoted, docs.columns)))
