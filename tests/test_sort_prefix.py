"""Sorts of look-backs and dedup end at a number; look-ups read no trades for the summary of quotes."""

import re

from pyspark.sql import functions as F

from tapewright.operators import asof, curves, hygiene
from tapewright.plans import views as V


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_summary_of_quotes_reads_no_trades(spark, sf_dir):
    joined = asof.asof_join(V.option_trades(spark, sf_dir), V.underlying_quotes(spark, sf_dir), "underlying")
    text = plan(joined)
    assert len(re.findall(r"FileScan[^\n]*lineitem", text)) == 1
    assert re.search(r"Sort \[__slice#\d+L ASC NULLS FIRST, __key#", text)


def test_quotes_of_earlier_slices(spark):
    """Slices with trades only, quotes only, both and neither, and a key without quotes."""
    hour = 3_600 * 10**9
    quotes = spark.createDataFrame([("K", 5, 1, 1.0), ("K", 2 * hour, 2, 2.0), ("K", 5 * hour + 9, 3, 3.0)],
                                   "instrument_id string, quote_ts_ns long, seq long, bid double")
    trades = [("K", 4), ("K", 6), ("K", hour + 1), ("K", 3 * hour), ("K", 5 * hour), ("K", 5 * hour + 9), ("K", 9 * hour), ("L", hour)]
    t = spark.createDataFrame([(k, ts, i) for i, (k, ts) in enumerate(trades)], "instrument_id string, trade_ts_ns long, seq long")
    got = {r.seq: r.nbbo_bid for r in asof.asof_join(t, quotes, columns=("bid",)).collect()}
    assert [got[i] for i in range(8)] == [None, 1.0, 1.0, 2.0, 2.0, 3.0, 3.0, None]


def test_dedup_sorts_by_a_hash_first(spark):
    rows = spark.range(100).select((F.col("id") % 10).cast("string").alias("k"), F.col("id").alias("seq"))
    first = hygiene.dedup_first(rows, ["k"], ["seq"])
    assert sorted((r.k, r.seq) for r in first.collect()) == [(str(i), i) for i in range(10)]
    assert re.search(r"Sort \[_groupingexpression#\d+L ASC NULLS FIRST, k#", plan(first))


def test_one_function_over_the_points(spark):
    points = "array(struct(0.5D as tenor, 0.01D as rate), struct(2D as tenor, 0.04D as rate)) as points"
    rows = spark.range(5).selectExpr("id", points, "element_at(array(null, 0.1D, 0.5D, 1D, 3D), cast(id + 1 as int)) as tau")
    out = curves.with_curve_rate(rows)
    assert len(re.findall(r"lambdafunction\(", out._jdf.queryExecution().analyzed().toString())) == 1
    got = [(r.rate and round(r.rate, 6), r.extrapolated) for r in out.orderBy("id").collect()]
    assert got == [(None, False), (0.01, False), (0.01, False), (0.03, False), (0.04, True)]
