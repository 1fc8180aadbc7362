"""Partitioned Parquet tables, run manifests, progress and run log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright import schemas
from tapewright.functions import scalars as S
from tapewright.operators import hygiene, ordered

REASON_CHARS = 256
ROWS_PER_FILE = 5_000_000


def write_partitioned(df: DataFrame, path: str, partitions: list[str], mode: str = "append",
                      observed: str | None = None, days: Sequence[str] = ()) -> dict | None:
    """ZSTD Parquet under ``partitions``.

    The rebalance hint gathers small partitions into few files and splits a partition
    that holds much of the data over several tasks. With the time column ``observed``, the counters
    of ``observe_ingest`` are taken from the rows as they are written, and returned.
    """
    rows, seen = df.hint("rebalance", *partitions), None
    if observed is not None:
        rows, seen = hygiene.observe_ingest(rows, observed, days)
    writer = rows.write.mode(mode)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    (
        writer.option("compression", "zstd").option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy(*partitions).parquet(path)
    )
    return seen.get if seen is not None else None


def option_trade_partitions(df: DataFrame) -> DataFrame:
    return df.withColumns({"dt": S.utc_date("trade_ts_ns"), "root": S.option_prefix("contract")})


def equity_trade_partitions(df: DataFrame) -> DataFrame:
    return df.withColumns({"dt": S.utc_date("trade_ts_ns"), "symbol_prefix": S.equity_prefix("symbol")})


def quote_partitions(df: DataFrame) -> DataFrame:
    """The date comes from each quote."""
    return df.withColumns({"dt": S.utc_date("quote_ts_ns"),
                           "prefix": S.instrument_prefix("instrument_id")})


def write_option_trades(df: DataFrame, root: str, mode: str = "append") -> str:
    """Deduplicate, then write ``option_trades/dt=/root=``.

    As for the other trade and quote sinks, parts of a day are appended; a whole day that
    is loaded again is written with ``mode="overwrite"``, which replaces its partitions."""
    path = f"{root}/option_trades"
    first = hygiene.dedup_first(df, ["contract", "trade_ts_ns", "price", "size"],
                                ["trade_ts_ns", "trade_uid"])
    write_partitioned(option_trade_partitions(first), path, ["dt", "root"], mode)
    return path


def write_equity_trades(df: DataFrame, root: str, mode: str = "append") -> str:
    path = f"{root}/equity_trades"
    first = hygiene.dedup_equity_trades(df)
    write_partitioned(equity_trade_partitions(first), path, ["dt", "symbol_prefix"], mode)
    return path


def write_quotes(df: DataFrame, root: str, mode: str = "append") -> str:
    path = f"{root}/nbbo"
    write_partitioned(quote_partitions(df), path, ["dt", "prefix"], mode)
    return path


def write_aggregations(df: DataFrame, root: str) -> str:
    path = f"{root}/aggregations"
    dated = df.withColumn("dt", S.utc_date("window_start_ns"))
    write_partitioned(dated, path, ["symbol", "window", "dt"])
    return path


def write_greeks_overlay(df: DataFrame, root: str, dataset: str = "options") -> str:
    """A repeated run replaces its own partitions (``dt``, ``run_id``) and no others."""
    path = f"{root}/greeks/{dataset}"
    dated = df.withColumn("dt", S.utc_date("trade_ts_ns"))
    write_partitioned(dated, path, ["dt", "run_id"], mode="overwrite")
    return path


# --------------------------------------------------------------------- manifest
def file_stats(df: DataFrame, by: list[Column | str], ts: str = "trade_ts_ns",
               uid: str = "trade_uid") -> DataFrame:
    """Row count and bounds per group; ids are ordered byte by byte."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.min(ts).alias("min_ts_ns"), F.max(ts).alias("max_ts_ns"),
        F.min(S.uid_hex(uid)).alias("min_trade_uid"), F.max(S.uid_hex(uid)).alias("max_trade_uid"),
    )


def write_manifest(spark: SparkSession, table: str, root: str, dataset: str, run_id: str,
                   schema_version: int, generated_ns: int, date: str | None = None) -> str:
    """Statistics of every file of a table (of one date, or all), as JSON lines."""
    path = f"{root}/manifests/{dataset}/{run_id}"
    rows = spark.read.parquet(table)
    if date is not None:
        rows = rows.where(F.col("dt") == F.lit(date).cast("date"))
    if "run_id" in rows.columns:
        rows = rows.where(F.col("run_id") == run_id)
    named = rows.withColumn("__file", F.col("_metadata.file_path"))
    relative = F.regexp_extract("__file", f"({table.rsplit('/', 1)[-1]}/dt=.*)$", 1)
    stats = file_stats(named, [F.col("dt").cast("string").alias("date"),
                               relative.alias("relative_path")])
    stats.select(
        F.lit(dataset).alias("dataset"), F.lit(run_id).alias("run_id"),
        F.lit(schema_version).alias("schema_version"), F.lit(generated_ns).alias("generated_ns"), "*",
    ).write.mode("overwrite").json(path)
    return path


# ------------------------------------------------------------- progress, run log
def save_progress(progress: DataFrame, root: str, dataset: str, day: str, now_ns: int) -> None:
    """Overwrite the progress of one dataset and day."""
    (
        progress.where(F.col("max_hour") >= 0)
        .select("symbol", F.col("max_hour").cast("smallint").alias("max_hour"),
                F.lit(now_ns).cast("bigint").alias("updated_ns"))
        .write.mode("overwrite").parquet(f"{root}/progress/{dataset}/{day}")
    )


def trim_reason(reason: Column) -> Column:
    """Reason text cut to 256 characters, the cut marked."""
    return F.when(F.length(reason) > REASON_CHARS,
                  F.concat(F.substring(reason, 1, REASON_CHARS), F.lit("…"))).otherwise(reason)


def log_run_states(states: DataFrame, root: str) -> None:
    """Append state transitions (columns of the run log) in one write."""
    known = F.col("state").isin(*schemas.RUN_STATES)
    checked = states.withColumns({
        "state": F.when(known, F.col("state")).otherwise(F.raise_error(F.lit("unknown run state"))),
        "reason": trim_reason(F.col("reason")),
    })
    checked.select(*schemas.RUN_LOG.fieldNames()).write.mode("append").parquet(f"{root}/run_log")


# --------------------------------------------------------------------- finalize
FINAL_COLUMNS = ("aggressor_side", "class_method", "aggressor_offset_mid_bp",
                 "aggressor_confidence", "tick_size_used")


def finalize_trades(trades: DataFrame, delta: DataFrame) -> DataFrame:
    """Apply classification updates by ``trade_uid``; updated rows become Final."""
    marked = delta.select("trade_uid", F.lit(True).alias("__hit"),
                          *[F.col(c).alias(f"__{c}") for c in FINAL_COLUMNS])
    joined = trades.join(marked, "trade_uid", "left")
    updated = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in FINAL_COLUMNS}
    quality = F.when(F.col("__hit"), F.lit("Final")).otherwise(F.col("quality"))
    return joined.withColumns({**updated, "quality": quality}).select(*trades.columns)


def finalize_table(spark: SparkSession, path: str, partitions: list[str], delta: DataFrame) -> None:
    """Apply classification updates to a stored table, rewriting only partitions they touch.

    The new partitions are written to the work folder first, because a table cannot be
    overwritten while it is read; applying the same updates again changes nothing.
    """
    stored = spark.read.parquet(path)
    touched = stored.join(delta.select("trade_uid"), "trade_uid", "left_semi").select(*partitions).distinct()
    affected = stored.join(ordered.landed(touched, "finalize-partitions"), partitions, "left_semi")
    write_partitioned(ordered.landed(finalize_trades(affected, delta), "finalize"), path, partitions, mode="overwrite")
