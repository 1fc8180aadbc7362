"""Look-backs with a busy hour: crowded slices are cut until none is too deep."""

import pytest
from pyspark.sql import functions as F

from tapewright.operators import asof, ordered

SEC = 1_000_000_000


def busy(spark, n=8000, burst_ns=1):
    """95 of 100 rows in one burst of one key, the others days apart over three keys."""
    spread = F.col("id") % 20 == 0
    return spark.range(n).select(
        F.when(spread & (F.col("id") % 40 == 0), F.concat(F.lit("K"), F.col("id") % 3)).otherwise("HOT").alias("k"),
        F.when(spread, F.col("id") * 10**13).otherwise(7_200 * SEC + F.col("id") * burst_ns).alias("ts"),
        F.col("id").alias("seq"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))


@pytest.mark.parametrize("burst_ns", [1, 1000, 400_000_000])
def test_no_slice_is_too_deep(spark, monkeypatch, burst_ns):
    monkeypatch.setattr(ordered, "SLICE_ROWS", 100)
    rows = busy(spark, burst_ns=burst_ns)
    sliced = ordered.with_slice(rows, ["k"], "ts")
    sizes = [r["count"] for r in sliced.groupBy("k", "__slice").count().collect()]
    assert sum(sizes) == 8000 and max(sizes) <= 100
    # Parts follow each other in time and do not overlap.
    spans = sorted((r.k, r.s, r.low, r.high) for r in sliced.groupBy("k", F.col("__slice").alias("s")).agg(
        F.min("ts").alias("low"), F.max("ts").alias("high")).collect())
    assert all(s <= low for _, s, low, _ in spans)
    assert all(a[3] < b[1] for a, b in zip(spans, spans[1:]) if a[0] == b[0])


@pytest.mark.parametrize("burst_ns", [1, 400_000_000])
def test_values_with_a_busy_hour(spark, monkeypatch, burst_ns):
    monkeypatch.setattr(ordered, "SLICE_ROWS", 100)
    rows = busy(spark, 4000, burst_ns)
    got = {r.seq: r["last"] for r in ordered.carry_forward(rows, ["k"], "ts", ["ts", "seq"], {"last": F.col("v")}).collect()}
    last, want = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.ts, r.seq)):
        last[r.k] = r.v if r.v is not None else last.get(r.k)
        want[r.seq] = last[r.k]
    assert got == want


def test_tasks_of_the_sort_are_even(spark, monkeypatch):
    """No partition of the sort holds more than twice the mean, though one hour holds 95 % of the rows."""
    monkeypatch.setattr(ordered, "SLICE_ROWS", 200)
    rows = busy(spark, 40_000, 80_000)
    sliced = ordered.with_slice(rows, ["k"], "ts").repartition(8, "k", "__slice")
    sizes = [r["count"] for r in sliced.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * sum(sizes) / 8


def test_equal_times_stay_together(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SLICE_ROWS", 10)
    rows = spark.range(100).select(F.lit("K").alias("k"), F.lit(5 * SEC).alias("ts"), F.col("id").alias("seq"))
    assert ordered.with_slice(rows, ["k"], "ts").select("__slice").distinct().count() == 1
    assert ordered.with_slice(rows.limit(0), ["k"], "ts").count() == 0


def test_asof_join_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SLICE_ROWS", 50)
    quotes = spark.range(900).select(F.lit("K").alias("instrument_id"), (F.col("id") * 3 * SEC).alias("quote_ts_ns"),
                                     F.col("id").cast("double").alias("bid"), F.col("id").alias("seq"))
    trades = spark.range(900).select(F.lit("K").alias("instrument_id"), (F.col("id") * 3 * SEC + F.col("id") % 5 * SEC - SEC)
                                     .alias("trade_ts_ns"), F.col("id").alias("seq"))
    for r in asof.asof_join(trades, quotes, columns=("bid",)).collect():
        assert r.nbbo_bid == (None if r.trade_ts_ns < 0 else min(899, r.trade_ts_ns // (3 * SEC)))
