"""Landed JSON pages of yield curves and option chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Yield fields and their tenors in years (fixed values).
YIELD_FIELDS = (
    ("yield_1_month", 1.0 / 12.0), ("yield_3_month", 0.25), ("yield_6_month", 0.5),
    ("yield_1_year", 1.0), ("yield_2_year", 2.0), ("yield_3_year", 3.0), ("yield_5_year", 5.0),
    ("yield_7_year", 7.0), ("yield_10_year", 10.0), ("yield_20_year", 20.0),
    ("yield_30_year", 30.0),
)
YIELD_PAGE = "next_url string, results array<struct<`date`:string," + ",".join(
    f"{name}:double" for name, _ in YIELD_FIELDS) + ">>"
CHAIN_PAGE = ("next_url string, results array<struct<open_interest:double,"
              "day:struct<volume:double>,details:struct<ticker:string>>>")


def read_yield_pages(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Curve points ``curve_date, tenor_years, rate, position``.

    Missing tenors drop out, and so do records whose date does not parse. ``position`` orders
    records that repeat a date: by page, then by place in it.
    """
    pages = spark.read.schema(YIELD_PAGE).json(path, multiLine=multi_line)
    placed = pages.select(F.col("_metadata.file_path").alias("page"), F.monotonically_increasing_id().alias("line"),
                          F.posexplode("results").alias("place", "r"))
    records = placed.select("r.*", F.struct("page", "line", "place").alias("position"))
    tenors = F.array(*[
        F.struct(F.lit(t).alias("tenor_years"), (F.col(name) / 100.0).alias("rate"))
        for name, t in YIELD_FIELDS
    ])
    return (
        records.select(F.col("date").try_cast("date").alias("curve_date"), "position", F.inline(tenors))
        .where(F.col("curve_date").isNotNull() & F.col("rate").isNotNull())
        .select("curve_date", "tenor_years", "rate", "position")
    )


def read_option_chain(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Contracts of chain snapshots: ``contract, open_interest, volume``; nameless ones drop out."""
    pages = spark.read.schema(CHAIN_PAGE).json(path, multiLine=multi_line)
    return pages.select(F.explode("results").alias("r")).select(
        F.col("r.details.ticker").alias("contract"), F.col("r.open_interest").alias("open_interest"),
        F.col("r.day.volume").alias("volume"),
    ).where(F.col("contract").isNotNull())
