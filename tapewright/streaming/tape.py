"""Live as-of join and look-back: quotes and trades of a key meet in keyed state.

Analytic windows do not run on streams. Events wait in the state, in time buckets, until the
watermark passes them; they are then taken in event order, quotes before trades at equal
times, as in the batch join. A bucket is written once per micro-batch that adds to it, read
once when the watermark reaches it, and then removed, so the state holds what is younger
than the delay, plus one quote and one trade per key. A bucket is sorted and matched as
arrays; no event is handled by itself. All buckets of a key belong to one task.

``take_ready`` serves sinks that are given whole micro-batches: events wait in a table, and
those that the watermark has passed go to the batch join, which cuts time into slices. There a
busy key spreads over tasks and no row leaves the engine.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapewright.functions.scalars import NANOS, floor_div
from tapewright.streaming.windows import with_event_time

BUCKET_NS = 3_600 * NANOS
OUTPUT = "tape_key string, trade string, quote string, quote_ts bigint, before string"


def _pack(events: dict) -> bytes:
    batch = pa.record_batch(events)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(parts: Sequence[bytes]) -> dict[str, np.ndarray]:
    table = pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in parts])
    return {name: table[name].to_numpy() for name in table.column_names}


def match(events: dict[str, np.ndarray], last: tuple) -> tuple[dict[str, np.ndarray], tuple]:
    """Trades of events with the quote and the trade before each; ``last`` goes in and out as
    (quote, its time, trade). Events are ts, side (0 quote, 1 trade), seq and body."""
    order = np.lexsort((events["seq"], events["side"], events["ts"]))
    ts, side, body = (events[c][order] for c in ("ts", "side", "body"))
    quote, quote_ts, trade = last
    is_trade = side == 1
    at = np.flatnonzero(is_trade)
    # The latest quote up to each event; place 0 stands for the one that came in.
    latest = np.maximum.accumulate(np.where(is_trade, 0, np.arange(1, len(ts) + 1))) if len(ts) else np.empty(0, np.int64)
    bodies = np.concatenate([np.array([quote], object), body])
    times = np.concatenate([np.array([-1 if quote_ts is None else quote_ts]), ts])
    out = {"trade": body[at], "quote": bodies[latest[at]], "quote_ts": times[latest[at]],
           "before": np.concatenate([np.array([trade], object), body[at]])[:-1]}
    if len(ts) and latest[-1]:
        quote, quote_ts = bodies[latest[-1]], int(times[latest[-1]])
    return out, (quote, quote_ts, body[at[-1]] if len(at) else trade)


class TapeProcessor(StatefulProcessor):
    """Buckets of waiting events; emits each trade with its quote and the trade before."""

    def __init__(self, bucket_ns: int = BUCKET_NS, ttl_ms: int | None = None):
        self.bucket_ns, self.ttl_ms = bucket_ns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "bucket bigint", "low bigint, parts int")
        self.parts = handle.getMapState("parts", "bucket bigint, part int", "data binary")
        self.last = handle.getValueState("last", "quote string, quote_ts bigint, trade string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            events = {"ts": batch["ts"].to_numpy(np.int64), "side": batch["side"].to_numpy(np.int8),
                      "seq": batch["seq"].to_numpy(np.int64), "body": batch["body"].to_numpy(object)}
            bucket = events["ts"] // self.bucket_ns
            for b in np.unique(bucket).tolist():
                own = bucket == b
                low, n = self.buckets.getValue((b,)) if self.buckets.containsKey((b,)) else (2 ** 63 - 1, 0)
                self._keep(b, {name: column[own] for name, column in events.items()}, low, n)
        yield from self._drain(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._drain(key, timerValues.getCurrentWatermarkInMs())

    def _keep(self, bucket: int, events: dict, low: int, n: int) -> None:
        self.parts.updateValue((bucket, n), (_pack(events),))
        self.buckets.updateValue((bucket,), (min(low, int(events["ts"].min())), n + 1))

    def _drain(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Take what the watermark has passed, bucket by bucket, and set a timer for what is left."""
        limit = watermark_ms * 1_000_000
        waiting = sorted((k[0], v[0], v[1]) for k, v in self.buckets.iterator())
        last = self.last.get() if self.last.exists() else (None, None, None)
        done = 0
        for bucket, low, n in waiting:
            if low >= limit:
                break
            events = _unpack([self.parts.getValue((bucket, i))[0] for i in range(n)])
            for i in range(n):
                self.parts.removeKey((bucket, i))
            self.buckets.removeKey((bucket,))
            ready = events["ts"] < limit
            if not ready.all():
                self._keep(bucket, {name: column[~ready] for name, column in events.items()}, 2 ** 63 - 1, 0)
            out, last = match({name: column[ready] for name, column in events.items()}, last)
            done += 1
            if len(out["trade"]):
                yield pd.DataFrame({
                    "tape_key": key[0], "trade": out["trade"], "quote": out["quote"],
                    "quote_ts": pd.Series(out["quote_ts"], dtype="Int64").mask(out["quote_ts"] < 0), "before": out["before"]})
        if done:
            self.last.update(last)
            waiting = sorted((k[0], v[0], v[1]) for k, v in self.buckets.iterator())
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if waiting:
            self.handle.registerTimer(waiting[0][1] // 1_000_000 + 1)

    def close(self) -> None:
        pass


def stream_lookup(
    quotes: DataFrame, trades: DataFrame, delay: str, columns: Sequence[str], quote_key: str = "instrument_id",
    trade_key: str = "instrument_id", quote_ts: str = "quote_ts_ns", trade_ts: str = "trade_ts_ns", seq: str = "seq",
    bucket_ns: int = BUCKET_NS, ttl_ms: int | None = None,
) -> DataFrame:
    """Trades of a live stream, all their columns, with ``quote`` (the named columns of the latest
    quote), ``quote_ts`` and ``before`` (the trade before, all columns). Rows without a time
    or key have no place in the order and are left out; a null ``seq`` counts as 0."""
    spark = trades.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def events(df, key, ts, side, names):
        return df.select(F.col(key).alias("tape_key"), F.col(ts).alias("ts"), F.lit(side).alias("side"),
                         F.coalesce(seq, F.lit(0)).alias("seq"), F.to_json(F.struct(*names)).alias("body"),
                         ).where("ts is not null and tape_key is not null")

    both = events(quotes, quote_key, quote_ts, 0, columns).unionByName(events(trades, trade_key, trade_ts, 1, trades.columns))
    matched = with_event_time(both, "ts", delay).groupBy("tape_key").transformWithStateInPandas(
        TapeProcessor(bucket_ns, ttl_ms), OUTPUT, "append", "EventTime")
    quote = T.StructType([quotes.schema[c] for c in columns])
    return matched.select(
        F.from_json("trade", trades.schema).alias("t"), F.from_json("quote", quote).alias("quote"), "quote_ts",
        F.from_json("before", trades.schema).alias("before")).select("t.*", "quote", "quote_ts", "before")


def live_events(
    quotes: DataFrame, trades: DataFrame, columns: Sequence[str], quote_key: str = "instrument_id",
    trade_key: str = "instrument_id", quote_ts: str = "quote_ts_ns", trade_ts: str = "trade_ts_ns", seq: str = "seq",
) -> DataFrame:
    """Both streams as one: ``tape_key``, ``ts``, ``seq`` and either ``quote`` (the named columns) or ``trade``
    (all columns). Rows without a time or key are left out; a null ``seq`` counts as 0."""

    def events(df, key, ts, name, names):
        return df.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(
            F.col(key).alias("tape_key"), F.col(ts).alias("ts"), F.lit(name == "trade").alias("is_trade"),
            F.coalesce(seq, F.lit(0)).cast("bigint").alias("seq"), F.struct(*names).alias(name))

    return events(quotes, quote_key, quote_ts, "quote", columns).unionByName(
        events(trades, trade_key, trade_ts, "trade", trades.columns), allowMissingColumns=True)


def take_ready(events: DataFrame, waiting: str, batch_id: int, delay: str) -> tuple[DataFrame, DataFrame]:
    """Of a micro-batch of ``live_events`` and what waits from the one before: (trades that the watermark has
    passed, quotes that they may meet), for the batch join.

    The watermark is the newest event of all batches so far, in whole milliseconds, less the delay. Events older
    than the watermark of the batch before are late: they are dropped, and their number is logged. ``waiting``
    keeps two tables in turn, so a repeated batch finds what it found the first time. A table holds what is
    younger than the delay and the last quote of each key. ``events`` is read several times.
    """
    mark = F.unix_millis(F.timestamp_millis(floor_div(F.max("ts"), 1_000_000)) - F.lit(delay).cast("interval")) * 1_000_000
    limit = None
    if batch_id:
        # The newest event of all waits, as nothing has passed it.
        held = events.sparkSession.read.schema(events.schema).parquet(f"{waiting}/{(batch_id - 1) % 2}")
        limit = held.agg(mark).first()[0]
        if limit is not None:
            late = events.where(F.col("ts") < limit).count()
            if late:
                logging.getLogger(__name__).warning("batch %d: %d late events dropped", batch_id, late)
        events = (events if limit is None else events.where(F.col("ts") >= limit)).unionByName(held)
    limit = events.agg(mark).first()[0]
    passed = F.coalesce(F.col("ts") < F.lit(limit).cast("bigint"), F.lit(False))
    trades, quotes = (events.where(passed & (F.col("is_trade") == side)) for side in (True, False))
    last = quotes.groupBy("tape_key").agg(F.max_by(F.struct(*events.columns), F.struct("ts", "seq")).alias("last"))
    events.where(~passed).unionByName(last.select("last.*")).write.mode("overwrite").option(
        "compression", "zstd").parquet(f"{waiting}/{batch_id % 2}")
    return trades.select("trade.*"), quotes.select("tape_key", "ts", "seq", "quote.*")


def stream_asof(quotes: DataFrame, trades: DataFrame, max_age_us: int, delay: str, ttl_ms: int | None = None,
                bucket_ns: int = BUCKET_NS) -> DataFrame:
    """Trades of a live stream with their quote, where it is fresh, and the previous trade price."""
    found = stream_lookup(quotes, trades.select("instrument_id", "seq", "trade_ts_ns", "price"), delay, ("bid", "ask"),
                          ttl_ms=ttl_ms, bucket_ns=bucket_ns)
    age = floor_div(F.col("trade_ts_ns") - F.col("quote_ts"), 1_000)
    fresh = age <= max_age_us
    return found.select(
        "instrument_id", "seq", "trade_ts_ns", "price", F.when(fresh, F.col("quote.bid")).alias("nbbo_bid"),
        F.when(fresh, F.col("quote.ask")).alias("nbbo_ask"), F.when(fresh, F.col("quote_ts")).alias("nbbo_ts_ns"),
        F.when(fresh, age).alias("nbbo_age_us"), F.col("before.price").alias("prev_price"))
