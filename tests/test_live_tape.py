"""Live look-ups in bucketed state: equal to the batch join, restartable, bounded."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.operators import asof
from tapewright.streaming import enrich as E
from tapewright.streaming import tape

SEC = 1_000_000_000
QUOTE = "instrument_id string, quote_ts_ns bigint, bid double, ask double, seq bigint"
TRADE = "instrument_id string, seq bigint, trade_ts_ns bigint, price double"


def test_match_against_a_loop():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(0, 30)
        events = [(rng.randrange(6), rng.randrange(2), i, f"b{i}") for i in range(n)]
        rng.shuffle(events)
        columns = {name: np.array([e[i] for e in events], object if name == "body" else np.int64)
                   for i, name in enumerate(("ts", "side", "seq", "body"))}
        last = rng.choice([(None, None, None), ("q", -5, "t")])
        out, after = tape.match(columns, last)
        quote, quote_ts, trade = last
        want = []
        for ts, side, _, body in sorted(events):
            if side:
                want.append((body, quote, -1 if quote_ts is None else quote_ts, trade))
                trade = body
            else:
                quote, quote_ts = body, ts
        assert list(zip(*(out[c].tolist() for c in ("trade", "quote", "quote_ts", "before")))) == want
        assert after == (quote, quote_ts, trade)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(9)
    quotes = [(rng.choice("AB"), rng.randrange(40_000) * SEC // 10, float(i), i + 0.5, i) for i in range(900)]
    trades = [(rng.choice("ABC"), i, rng.randrange(40_000) * SEC // 10, i / 4) for i in range(900)]
    return spark.createDataFrame(quotes, QUOTE), spark.createDataFrame(trades, TRADE)


def run(spark, tables, root, bucket_ns, edges):
    quotes, trades = tables
    held = []
    for low, high in zip(edges, edges[1:]):
        for name, ts, df in (("q", "quote_ts_ns", quotes), ("t", "trade_ts_ns", trades)):
            df.where(f"{ts} >= {low * SEC} and {ts} < {high * SEC}").coalesce(1).write.mode("append").parquet(f"{root}/{name}")
        streams = [spark.readStream.schema(df.schema).parquet(f"{root}/{n}") for n, df in (("q", quotes), ("t", trades))]
        query = (tape.stream_asof(*streams, 60_000_000, "200 seconds", bucket_ns=bucket_ns).writeStream.format("parquet")
                 .option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
        query.awaitTermination()
        held.append(query.recentProgress[-1].stateOperators[0])
    return spark.read.parquet(f"{root}/out"), held


@pytest.mark.parametrize("bucket", [7 * SEC, 10_000 * SEC])
def test_equals_the_batch_join_over_restarts(spark, tables, tmp_path, bucket):
    quotes, trades = tables
    live, held = run(spark, tables, tmp_path, bucket, [0, 900, 2100, 3000, 5000])
    joined = asof.prev_price(asof.asof_join(trades, quotes, columns=("bid", "ask"), max_age_us=60_000_000))
    end = max(df.agg(F.max(c)).first()[0] for df, c in ((quotes, "quote_ts_ns"), (trades, "trade_ts_ns"))) - 200 * SEC
    names = ["instrument_id", "seq", "trade_ts_ns", "price", "nbbo_bid", "nbbo_ask", "nbbo_ts_ns", "nbbo_age_us", "prev_price"]
    want = sorted(map(tuple, joined.where(F.floor(F.col("trade_ts_ns") / 1_000_000) < end // 1_000_000).select(*names).collect()), key=str)
    assert sorted(map(tuple, live.select(*names).collect()), key=str) == want and len(want) > 800


def test_state_is_bounded_by_the_delay(spark, tables, tmp_path):
    """1 800 events over 4 000 s with a delay of 200 s: buckets that are passed leave the state."""
    _, held = run(spark, tables, tmp_path, 10 * SEC, [0, 1000, 2000, 3000, 4000])
    rows = [h.numRowsTotal for h in held]
    # Two map entries for each of 20 or 21 open buckets of three keys, a value and a timer for each key.
    assert max(rows) <= 2 * 21 * 3 + 2 * 3


def test_enrichment_goes_on_from_its_checkpoint(spark, tmp_path):
    """Trades wait for their quote; a second run adds rows and repeats none."""
    quote = QUOTE + ", bid_sz bigint, ask_sz bigint, state string"
    trade = ("contract string, underlying string, trade_ts_ns bigint, contract_direction string, strike_price double, "
             "expiry_ts_ns bigint, price double, size bigint, seq bigint")
    day = 86_400 * SEC
    curves = spark.createDataFrame([("1970-01-01", [(1.0, 0.02)])], "curve_date string, points array<struct<tenor: double, rate: double>>"
                                   ).withColumn("curve_date", F.col("curve_date").cast("date"))
    for run_no in range(2):
        at = run_no * day
        spark.createDataFrame([("U", at + k * SEC, 99.0 + k + run_no, 101.0 + k + run_no, k, 1, 1, "Normal") for k in (5, 20)], quote
                              ).write.mode("append").parquet(f"{tmp_path}/q")
        spark.createDataFrame([(f"O{k}", "U", at + k * SEC, "C", 100.0, at + 300 * day, 5.0, 1, k) for k in (1, 5, 10, 30)], trade
                              ).write.mode("append").parquet(f"{tmp_path}/t")
        trades, quotes = (spark.readStream.schema(s).parquet(f"{tmp_path}/{n}") for n, s in (("t", trade), ("q", quote)))
        E.enrich_live(trades, quotes, lambda batch: curves, 3_600_000_000, "1 seconds", f"{tmp_path}/out", f"{tmp_path}/state",
                      vol=F.lit(0.3)).awaitTermination()
    rows = {(r.trade_ts_ns // day, r.seq): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert set(rows) == {(0, 1), (0, 5), (0, 10), (0, 30), (1, 1), (1, 5), (1, 10)}
    assert rows[0, 1].nbbo_bid is None and rows[0, 1].greeks_flags != 0
    assert (rows[0, 5].nbbo_bid, rows[0, 10].nbbo_bid, rows[0, 30].nbbo_bid) == (104.0, 104.0, 119.0)
    # The quote of the first run is still the last one, but too old.
    assert rows[1, 1].nbbo_bid == 119.0 and rows[1, 1].nbbo_stale and rows[1, 10].nbbo_bid == 105.0
    assert rows[0, 10].delta is not None
