"""Live tumbling windows, bounded-memory dedup, and the sink helper they share."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.scalars import floor_div, ts_from_ns
from tapewright.operators.windows import parse_window
from tapewright.session import fresh_dir


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Add the timestamp ``event_time`` and its watermark."""
    return df.withColumn("event_time", ts_from_ns(ts)).withWatermark("event_time", delay)


def stream_windows(trades: DataFrame, label: str, delay: str, key: str = "instrument_id",
                   ts: str = "trade_ts_ns") -> DataFrame:
    """Window features of a live trade stream; a window appears once the watermark passes it.

    Events belong to the window of their own time. One query per window length. Later rows
    of a closed window are dropped and counted by the engine.
    """
    seconds = parse_window(label) // 1_000_000_000
    timed = with_event_time(trades, ts, delay)
    value = F.abs(F.col("price") * F.col("size"))
    out = timed.groupBy(F.window("event_time", f"{seconds} seconds").alias("w"), key).agg(
        F.count(F.lit(1)).alias("trades"), F.min("price").alias("low"), F.max("price").alias("high"),
        F.sum(value).alias("total"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("stddev"))
    return out.select(
        key, F.lit(label).alias("window"), (F.unix_micros("w.start") * 1000).alias("window_start_ns"),
        (F.unix_micros("w.end") * 1000).alias("window_end_ns"), "trades", "low", "high", "total",
        "mean", "stddev", F.lit("Partial").alias("completeness"))


def stream_dedup(trades: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """First trade of each key; a key is remembered for the length of the delay."""
    return with_event_time(trades, ts, delay).dropDuplicatesWithinWatermark(list(keys))


def run_to_files(spark: SparkSession, stream: DataFrame, label: str, out: str | None = None,
                 checkpoint: str | None = None):
    """Run a stream over what has landed, into Parquet; returns (all results so far, the query).

    With ``out`` and ``checkpoint`` of an earlier run the stream goes on where that ended."""
    out = out or fresh_dir(spark, label)
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint or fresh_dir(spark, f"{label}-state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), query


def run_windows(spark: SparkSession, trades: DataFrame, label: str, delay: str, out: str, checkpoint: str,
                passed_ms: int = 0, ts: str = "trade_ts_ns"):
    """One run of ``stream_windows`` over what has landed: (results, late rows, watermark in ms).

    ``passed_ms`` is the watermark that the run before returned. Without a rate limit a run
    reads its input in one batch, so that is the watermark of all its rows: those whose
    window it has passed are late, counted row by row before anything is aggregated.
    """
    length = parse_window(label)
    window_end = (floor_div(ts, length) + 1) * length
    late = F.count_if(window_end <= F.lit(passed_ms) * 1_000_000)
    counted = trades.observe("late", late.alias("rows"))
    result, query = run_to_files(spark, stream_windows(counted, label, delay, ts=ts), "windows", out, checkpoint)
    rows, watermark = 0, passed_ms
    for report in query.recentProgress:   # of this run alone: its batch, and the one that closes windows
        metrics = (report["observedMetrics"] or {}).get("late")
        rows += metrics["rows"] or 0 if metrics else 0
        if "watermark" in report["eventTime"]:
            moment = datetime.fromisoformat(report["eventTime"]["watermark"].replace("Z", "+00:00"))
            watermark = max(watermark, round(moment.timestamp() * 1000))
    return result, rows, watermark
