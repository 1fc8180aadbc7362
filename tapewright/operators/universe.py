"""Contract universe: ranking and changes between two lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_contracts(chain: DataFrame, n: int) -> DataFrame:
    """The n contracts with the highest score, larger of open interest and day volume.

    Ordering with a limit keeps n rows per task and merges them.
    """
    score = F.greatest(F.coalesce("open_interest", F.lit(0.0)), F.coalesce("volume", F.lit(0.0)))
    return (
        chain.select("contract", score.alias("score"))
        .orderBy(F.col("score").desc(), "contract").limit(n)
    )


def universe_delta(old: DataFrame, new: DataFrame, key: str = "contract") -> DataFrame:
    """Keys to add and to remove to get from the old list to the new one."""
    before, after = old.select(key).distinct(), new.select(key).distinct()
    added = after.join(before, key, "left_anti").withColumn("change", F.lit("add"))
    removed = before.join(after, key, "left_anti").withColumn("change", F.lit("remove"))
    return added.unionByName(removed)


def event_union(underlying_trades: DataFrame, option_trades: DataFrame) -> DataFrame:
    """Underlying and option trades as one event set keyed by symbol."""
    stock = underlying_trades.withColumnRenamed("instrument_id", "symbol").withColumn(
        "kind", F.lit("underlying"))
    option = option_trades.withColumnRenamed("underlying", "symbol").withColumn(
        "kind", F.lit("option"))
    return stock.unionByName(option, allowMissingColumns=True)
