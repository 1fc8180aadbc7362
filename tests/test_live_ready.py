"""Micro-batches that wait in a table: equal to the batch join, repeatable, bounded, spread over tasks."""

import glob
import random

from pyspark.sql import functions as F

from tapewright.operators import asof
from tapewright.streaming import enrich as E
from tapewright.streaming import tape

SEC = 1_000_000_000
QUOTE = "instrument_id string, quote_ts_ns bigint, bid double, ask double, bid_sz bigint, ask_sz bigint, state string, seq bigint"
TRADE = ("contract string, underlying string, trade_ts_ns bigint, contract_direction string, strike_price double, "
         "expiry_ts_ns bigint, price double, size bigint, seq bigint")


def test_batches_equal_the_batch_join(spark, tmp_path):
    rng = random.Random(4)
    quotes = spark.createDataFrame([("AB"[i % 2], rng.randrange(4_000) * SEC, float(i), i + 1.0, i, i, "Normal", i)
                                    for i in range(600)], QUOTE)
    trades = spark.createDataFrame([(f"O{i}", "ABC"[i % 3], rng.randrange(4_000) * SEC, "C", 1.0, 0, 1.0, 1, i)
                                    for i in range(600)], TRADE)
    events = tape.live_events(quotes, trades, asof.NBBO_COLUMNS, trade_key="underlying").localCheckpoint()
    names = ["seq", "nbbo_bid", "nbbo_ts_ns", "nbbo_age_us"]
    got, edges = [], [0, 900, 2_100, 2_200, 4_000]
    for n, (low, high) in enumerate(zip(edges, edges[1:])):
        batch = events.where(F.col("ts").between(low * SEC, high * SEC - 1))
        if n == 2:   # a late trade and a late quote: neither counts
            batch = batch.unionByName(events.where(F.col("ts") < 100 * SEC))
        for _ in range(2):   # a repeated batch finds the same
            ready, quoted = tape.take_ready(batch, f"{tmp_path}/w", n, "200 seconds")
            rows = asof.asof_join(ready, quoted, "underlying", "tape_key", quote_ts="ts").select(*names).collect()
        got += map(tuple, rows)
        waiting = spark.read.schema(events.schema).parquet(f"{tmp_path}/w/{n % 2}")
        newest = waiting.agg(F.max("ts")).first()[0]
        assert waiting.where(F.col("ts") < newest - 200 * SEC).count() == 2   # a last quote of each key
    joined = asof.asof_join(trades, quotes, trade_key="underlying").where(F.col("trade_ts_ns") < newest - 200 * SEC)
    want = [tuple(r) for r in joined.select(*names).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 500


def test_batch_without_events(spark, tmp_path):
    quotes, trades = spark.createDataFrame([], QUOTE), spark.createDataFrame([], TRADE)
    empty = tape.live_events(quotes, trades, asof.NBBO_COLUMNS, trade_key="underlying")
    one = tape.live_events(quotes, spark.createDataFrame([("O", "A", at * SEC, "C", 1.0, 0, 1.0, 1, at) for at in (1, 9)], TRADE),
                           asof.NBBO_COLUMNS, trade_key="underlying")
    counts = [tape.take_ready(batch, f"{tmp_path}/w", n, "5 seconds")[0].count() for n, batch in enumerate((empty, one, empty))]
    assert counts == [0, 1, 0]


def test_a_busy_key_is_spread_over_tasks(spark, tmp_path):
    """All events have one underlying; one task for each key would write one file."""
    hour = 3_600 * SEC
    spark.range(400).selectExpr("'U' as instrument_id", f"id * {hour} as quote_ts_ns", "99D as bid", "101D as ask", "1L as bid_sz",
                                "1L as ask_sz", "'Normal' as state", "id as seq").write.parquet(f"{tmp_path}/q")
    spark.range(400).selectExpr("'O' as contract", "'U' as underlying", f"id * {hour} + 5 as trade_ts_ns", "'C' as contract_direction",
                                "100D as strike_price", f"id * {hour} + {300 * 24 * hour} as expiry_ts_ns", "5D as price", "1L as size",
                                "id as seq").write.parquet(f"{tmp_path}/t")
    curves = spark.sql("select date'1970-01-01' as curve_date, array(named_struct('tenor', 1D, 'rate', 0.02D)) as points")
    trades, quotes = (spark.readStream.schema(s).parquet(f"{tmp_path}/{n}") for n, s in (("t", TRADE), ("q", QUOTE)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        E.enrich_live(trades, quotes, lambda batch: curves, 3_600_000_000, "1 seconds", f"{tmp_path}/out", f"{tmp_path}/state",
                      vol=F.lit(0.3)).awaitTermination()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    rows = spark.read.parquet(f"{tmp_path}/out")
    assert rows.where("nbbo_bid = 99 and delta is not null").count() == 399   # the last one waits
    held = [f for f in glob.glob(f"{tmp_path}/out/*/*.parquet") if spark.read.parquet(f).count()]
    assert len(held) > 1
