"""Derived-Greeks run: stored option trades of a run to a published overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.scalars import utc_date
from tapewright.operators import curves as K
from tapewright.operators import greeks as G
from tapewright.sinks import tables
from tapewright.sources import stored

OVERLAY_SCHEMA_VERSION = 1


def _log(spark: SparkSession, root: str, dataset: str, run_id: str, days: DataFrame, state: Column,
         reason: Column, now_ns: int) -> None:
    tables.log_run_states(days.select(
        F.lit(dataset).alias("dataset"), F.col("dt").cast("string").alias("run_date"),
        F.lit(run_id).alias("run_id"), state.alias("state"), reason.alias("reason"),
        F.lit(now_ns).cast("bigint").alias("updated_ns")), root)


def enrich_run(
    spark: SparkSession, root: str, manifest_path: str, run_id: str, underlying_quotes: DataFrame,
    curves: DataFrame, staleness_us: int, engine_version: str, now_ns: int,
    dataset: str = "options", date: str | None = None, vol: Column | None = None,
) -> str:
    """Enrich the stored trades of a run, write the overlay, its manifest and the run log.

    Days without any curve up to them are Blocked and left out; the others end Published.
    """
    trades = stored.scan_run(spark, root, manifest_path, date)
    trades = trades.drop("delta", "gamma", "vega", "theta", "iv", "greeks_flags",
                         *[c for c in trades.columns if c.startswith("nbbo_")])
    trades = trades.withColumn("seq", F.xxhash64("trade_uid"))
    days = trades.select(utc_date("trade_ts_ns").alias("dt")).distinct()
    usable = K.with_day_curve(days, curves).drop("points")
    none = F.lit(None).cast("string")
    _log(spark, root, dataset, run_id, usable, F.lit("InFlight"), none, now_ns)

    # At most one row for each day that a time in nanoseconds can name; trades are not shuffled for it.
    curved = F.broadcast(usable.where(F.col("curve_date").isNotNull()).select(F.col("dt").alias("__day")))
    ready = trades.join(curved, utc_date("trade_ts_ns") == F.col("__day"), "left_semi")
    enriched = G.enrich_greeks(ready, underlying_quotes, curves, staleness_us, vol=vol)
    overlay = G.overlay(enriched, engine_version, run_id, F.lit(now_ns))
    path = tables.write_greeks_overlay(overlay, root, dataset)
    tables.write_manifest(spark, path, root, f"greeks_{dataset}", run_id, OVERLAY_SCHEMA_VERSION, now_ns)

    blocked = F.col("curve_date").isNull()
    _log(spark, root, dataset, run_id, usable,
         F.when(blocked, F.lit("Blocked")).otherwise(F.lit("Published")),
         F.when(blocked, F.lit("no rate curve on or before the day")), now_ns + 1)
    return path


def trades_with_greeks(trades: DataFrame, overlay: DataFrame, run_id: str) -> DataFrame:
    """Raw trades with the Greeks of one run."""
    columns = ["delta", "gamma", "vega", "theta", "iv", "greeks_flags"]
    chosen = overlay.where(F.col("run_id") == run_id).select("trade_uid", *columns)
    return trades.join(chosen, "trade_uid", "left")
