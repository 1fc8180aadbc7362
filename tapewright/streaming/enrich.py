"""Live option trades: micro-batches are enriched, stamped and written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.scalars import utc_date
from tapewright.operators import greeks as G
from tapewright.operators import hygiene
from tapewright.operators.asof import NBBO_COLUMNS, asof_join, mark_stale
from tapewright.operators.ordered import SLICE_NS, landed
from tapewright.streaming.tape import live_events, take_ready

SCHEMA_VERSION = 2


def stamped(batch: DataFrame, completeness: str = "Unknown", events: DataFrame | None = None) -> DataFrame:
    """Metadata of a live batch; its watermark is the newest event, of ``events`` if given."""
    return hygiene.with_metadata(
        batch, "Ws", "Prelim", SCHEMA_VERSION, "live", "trade_ts_ns", events,
    ).withColumn("completeness", F.lit(completeness))


def enrich_stream(
    spark: SparkSession, trades: DataFrame, underlying_quotes: DataFrame,
    curves_at: Callable[[int], DataFrame], staleness_us: int, out: str, checkpoint: str,
    dividend: float = 0.0, trigger: dict | None = None,
):
    """Start the sink over a table of quotes. Each micro-batch is written under its batch id, so a
    repeated batch replaces itself. A restart with the same ``checkpoint`` goes on with the next batch id;
    a new checkpoint needs a new ``out``. ``trigger`` holds the arguments of the trigger; by
    default the query takes what is there and ends. Until there is a curve, rows carry the no-curve flag and no Greeks.

    ``curves_at`` gives the curves known at a batch; the newest one is used for all rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = landed(batch, "live-batch")   # a batch is computed once, however often it is used
        curves = _newest_curve(batch, curves_at(batch_id))
        _write(G.enrich_greeks(batch, underlying_quotes, curves, staleness_us, dividend), batch, out, batch_id)

    return _start(trades, write, checkpoint, trigger)


def enrich_live(
    trades: DataFrame, underlying_quotes: DataFrame, curves_at: Callable[[int], DataFrame], staleness_us: int, delay: str,
    out: str, checkpoint: str, dividend: float = 0.0, vol: Column | None = None, trigger: dict | None = None,
    slice_ns: int = SLICE_NS,
):
    """The same with quotes as a second stream. A trade waits for the watermark and then takes the
    latest quote of its underlying in event order, by the batch join. What waits is kept in a table beside
    the engine's own files in ``checkpoint``: the last quote of each underlying and what is younger
    than the delay. ``seq`` breaks ties of quotes."""
    events = live_events(underlying_quotes, trades, NBBO_COLUMNS, trade_key="underlying")

    def write(batch: DataFrame, batch_id: int) -> None:
        ready, quotes = take_ready(landed(batch, "live-batch"), f"{checkpoint}/waiting", batch_id, delay)
        quoted = asof_join(ready, quotes, trade_key="underlying", quote_key="tape_key", quote_ts="ts", slice_ns=slice_ns)
        curves = _newest_curve(ready, curves_at(batch_id))
        _write(G.enrich_quoted(mark_stale(quoted, staleness_us), curves, dividend, vol=vol), ready, out, batch_id)

    return _start(events, write, checkpoint, trigger)


def _newest_curve(batch: DataFrame, curves: DataFrame) -> DataFrame:
    """The newest curve stands for every day: it is dated at the first day of the batch."""
    newest = curves.agg(F.max_by("points", "curve_date").alias("points")).where(F.col("points").isNotNull())
    first_day = batch.agg(utc_date(F.min("trade_ts_ns")).alias("curve_date"))
    return landed(newest.crossJoin(first_day).select("curve_date", "points"), "live-curve")   # one row, used twice


def _write(enriched: DataFrame, trades: DataFrame, out: str, batch_id: int) -> None:
    stamped(enriched, events=trades).write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch_id={batch_id}")


def _start(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None):
    return (
        rows.writeStream.foreachBatch(write).trigger(**(trigger or {"availableNow": True}))
        .option("checkpointLocation", checkpoint).start()
    )
