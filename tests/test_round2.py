"""Regressions: calendars, mixed layouts, repeated runs, long rankings, shared look-backs."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tapewright.operators import asof, classify, universe
from tapewright.operators.ordered import carry_forward
from tapewright.plans import queries_trades as QT
from tapewright.plans import views as V
from tapewright.sinks import tables
from tapewright.sources import calendar, flatfiles


def test_days_of_any_year(spark):
    days = ["2019-12-30", "2019-12-31", "2020-01-01", "2031-01-06", "2031-01-07", "2031-07-04", "1999-05-31", "2031-01-05"]
    df = spark.createDataFrame([(date.fromisoformat(d),) for d in days] + [(None,)], "dt date")
    got = sorted(str(r.dt) for r in calendar.only_trading_days(df).collect())
    assert got == ["2019-12-30", "2019-12-31", "2031-01-06", "2031-01-07"]
    assert calendar.only_trading_days(df.limit(0)).count() == 0
    assert calendar.trading_days(spark, "2034-12-22", "2035-01-03").count() == 7
    with pytest.raises(ValueError):
        calendar.trading_days(spark, "2024-01-02", "2024-01-01")


@pytest.mark.parametrize("order", [(0, 1), (1, 0)])
def test_mixed_layouts_in_one_read(spark, tmp_path, order):
    short = ("ticker,ask_exchange,ask_price,ask_size,bid_exchange,bid_price,bid_size,sequence_number,sip_timestamp\n"
             "A,1,10.5,3,2,10.0,4,7,1000\n")
    long = ("ticker,ask_exchange,ask_price,ask_size,bid_exchange,bid_price,bid_size,conditions,indicators,"
            "participant_timestamp,sequence_number,sip_timestamp,tape,trf_timestamp\n"
            'B,1,20.5,3,2,20.0,4,"5,6",,999,8,2000,1,0\n')
    paths = []
    for name, text in (("s", short), ("l", long)):
        (tmp_path / f"{name}.csv").write_text(text)
        paths.append(str(tmp_path / f"{name}.csv"))
    rows = flatfiles.quotes(flatfiles.read_csv(spark, [paths[k] for k in order])).orderBy("instrument_id").collect()
    assert [(r.instrument_id, r.quote_ts_ns, r.bid, r.ask, r.condition) for r in rows] == \
        [("A", 1000, 10.0, 10.5, None), ("B", 2000, 20.0, 20.5, 5)]


def test_repeated_overlay_replaces_itself(spark, tmp_path):
    df = spark.createDataFrame([(1, "c", 86_400 * 10**9, "r1"), (2, "c", 3 * 86_400 * 10**9, "r1")],
                               "trade_uid long, contract string, trade_ts_ns long, run_id string")
    for _ in range(2):
        path = tables.write_greeks_overlay(df, str(tmp_path))
    tables.write_greeks_overlay(df.where("trade_uid = 1").withColumn("run_id", F.lit("r2")), str(tmp_path))
    got = sorted((r.trade_uid, r.run_id) for r in spark.read.parquet(path).collect())
    assert got == [(1, "r1"), (1, "r2"), (2, "r1")]


def test_two_thousand_contracts(spark):
    chain = spark.range(3000).select(F.col("id").cast("string").alias("contract"), F.lit(1.0).alias("open_interest"),
                                     F.lit(None).cast("double").alias("volume"))
    assert universe.top_contracts(chain, 2000).count() == 2000


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_look_backs_share_passes(spark, sf_dir):
    text = plan(QT._classified(spark, sf_dir))
    assert text.count("FileScan") <= 4 and text.count("Exchange hashpartitioning") <= 3
    lookups = asof.price_lookups(V.underlying_quotes(spark, sf_dir), V.underlying_trades(spark, sf_dir), 10**9)
    text = plan(asof.asof_join_all(V.option_trades(spark, sf_dir), lookups, trade_key="underlying"))
    assert text.count("FileScan") <= 6 and text.count("Exchange hashpartitioning") <= 3


def test_previous_and_quote_in_one_pass(spark):
    hour = 3_600 * 10**9
    trades = [("K", 10, 1, 5.0), ("K", 20, 2, 6.0), ("K", 3 * hour, 3, None), ("K", 9 * hour, 4, 7.0), ("L", 5, 5, 1.0)]
    quotes = [("K", 15, 1, 4.0), ("K", 15, 2, 4.5), ("K", 8 * hour, 3, 6.5)]
    t = spark.createDataFrame(trades, "instrument_id string, trade_ts_ns long, seq long, price double")
    q = spark.createDataFrame(quotes, "instrument_id string, quote_ts_ns long, seq long, bid double")
    got = asof.asof_join_all(t, [asof.Lookup(q, ("bid",))], previous={"prev": F.col("price")}).orderBy("seq").collect()
    assert [(r.seq, r.prev, r.nbbo_bid) for r in got] == \
        [(1, None, None), (2, 5.0, 4.5), (3, 6.0, 4.5), (4, 6.0, 6.5), (5, None, None)]


def test_one_busy_hour(spark):
    # 95 of 100 rows in one hour of one key.
    rows = spark.range(4000).select(
        F.when(F.col("id") % 20 == 0, F.col("id") * 10**12).otherwise(F.col("id")).alias("ts"), F.col("id").alias("seq"),
        F.lit("K").alias("k"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("v"))
    got = carry_forward(rows, ["k"], "ts", ["ts", "seq"], {"last": F.col("v")}).orderBy("ts", "seq").collect()
    last, want = None, []
    for r in sorted(rows.collect(), key=lambda r: (r.ts, r.seq)):
        last = r.v if r.v is not None else last
        want.append((r.seq, last))
    assert [(r.seq, r["last"]) for r in got] == want


def test_classify_parameters_without_fallback(spark, sf_dir):
    params = classify.ClassifyParams(use_tick_rule_fallback=False)
    out = classify.classify(V.trades(spark, sf_dir), QT.state_quotes(spark, sf_dir), params)
    assert out.where("class_method = 'TickRule'").count() == 0


def test_bootstrap_sample_in_slices():
    import numpy as np

    from tapewright.operators import dip as D

    n, size, seed = 5003, 500, (7, 5003, 1)
    sizes = np.full(11, size)
    sizes[-1] = 3
    spans = np.random.default_rng(seed).gamma(np.append(sizes, 1))
    bounds = np.concatenate(([0.0], np.cumsum(spans) / spans.sum()))
    sample = np.concatenate([D._uniform_slice(bounds, sizes, seed, k) for k in range(11)])
    assert len(sample) == n and (np.diff(sample) > 0).all() and 0 < sample[0] and sample[-1] < 1
    assert D.dip_of_uniform(n, seed, True, size) == D.dip_of(sample, True)
    in_slices = [D.dip_of_uniform(2000, (1, 2000, i), True, 100) for i in range(200)]
    at_once = [D.dip_of_uniform(2000, (2, 2000, i)) for i in range(200)]
    assert np.mean(in_slices) == pytest.approx(np.mean(at_once), rel=0.08)


def test_bootstrap_at_its_own_size(spark):
    from tapewright.operators import dip as D

    dips = spark.createDataFrame([("a", 80_000, 0.05), ("b", 80_000, 1e-5), ("c", 3, 0.1)], "k string, n long, dip double")
    got = {r.k: r.p_value for r in D.bootstrap_pvalues(dips, ["k"], 20, seed=3).collect()}
    assert got == {"a": 0.0, "b": 1.0, "c": 1.0}


def test_curves_dated_far_off_stay_bounded(spark):
    from tapewright.operators import curves as K

    rows = [("0001-01-01", 1.0), ("2020-01-02", 2.0), ("9999-12-31", 3.0)]
    curves = spark.createDataFrame([(date.fromisoformat(d), [r]) for d, r in rows], "curve_date date, points array<double>")
    assert K.curve_calendar(curves).count() <= 213_504
    days = spark.createDataFrame([(date(2019, 5, 1),), (date(2020, 1, 2),), (date(2100, 1, 1),)], "dt date")
    got = {str(r.dt): r.points[0] for r in K.with_day_curve(days, curves).collect()}
    assert got == {"2019-05-01": 1.0, "2020-01-02": 2.0, "2100-01-01": 2.0}


def test_first_record_of_a_date_wins(spark, tmp_path):
    from tapewright.operators import curves as K
    from tapewright.sources import landed

    page = '{"results":[{"date":"2024-01-02","yield_1_year":5.0},{"date":"2024-01-02","yield_1_year":4.0,"yield_2_year":3.0}]}'
    (tmp_path / "a.json").write_text(page + "\n")
    points = landed.read_yield_pages(spark, str(tmp_path), multi_line=False)
    first = K.build_curves(points, position="position").first().points
    lowest = K.build_curves(points).first().points
    assert [(p.tenor, p.rate) for p in first] == [(1.0, 0.05), (2.0, 0.03)]
    assert [(p.tenor, p.rate) for p in lowest] == [(1.0, 0.04), (2.0, 0.03)]


def test_expiry_cutoff(spark):
    from tapewright.functions import scalars as S

    df = spark.createDataFrame([("O:SPY230327P00390000",), ("x",)], "contract string")
    close = 20 * 3_600 * 10**9
    got = [r.e for r in df.select(S.contract_expiry_ns("contract", cutoff_ns=close).alias("e")).collect()]
    assert got == [(date(2023, 3, 27) - date(1970, 1, 1)).days * 86_400 * 10**9 + close, 0]


def test_finalize_rewrites_touched_partitions_only(spark, tmp_path):
    from pathlib import Path

    base = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "trade_uid long, dt string").withColumns(
        {**flatfiles.unclassified(), "quality": F.lit("Prelim")})
    path = str(tmp_path / "t")
    tables.write_partitioned(base, path, ["dt"])
    untouched = sorted(p.name for p in Path(path, "dt=b").glob("*.parquet"))
    delta = base.where("trade_uid = 2").withColumns({"aggressor_side": F.lit("Buyer"), "class_method": F.lit("TickRule")})
    for _ in range(2):
        tables.finalize_table(spark, path, ["dt"], delta)
        got = sorted((r.trade_uid, r.dt, r.aggressor_side, r.quality) for r in spark.read.parquet(path).collect())
        assert got == [(1, "a", "Unknown", "Prelim"), (2, "a", "Buyer", "Final"), (3, "b", "Unknown", "Prelim")]
    assert sorted(p.name for p in Path(path, "dt=b").glob("*.parquet")) == untouched


def test_odd_headers_lose_no_file(spark, tmp_path):
    texts = {"plain": "ticker,bid_price,ask_price\nA,1,2\n", "longer": "ticker,bid_price,ask_price,tape\nB,1,2,1\n",
             "quoted": '"ticker","ask_price","bid_price"\nC,2,1\n', "mark": "\ufeffticker,ask_price,bid_price\nD,2,1\n",
             "other": "\nask_price,ticker,bid_price\n2,E,1\n", "empty": ""}
    paths = {}
    for name, text in texts.items():
        paths[name] = str(tmp_path / f"{name}.csv")
        (tmp_path / f"{name}.csv").write_text(text)
    for names in (list(texts), ["plain", "quoted"], ["mark", "other"]):
        rows = flatfiles.read_csv(spark, [paths[n] for n in names]).select("ticker", "bid_price", "ask_price").collect()
        want = ["ABCDE"["plain longer quoted mark other".split().index(n)] for n in names if n != "empty"]
        assert sorted(map(tuple, rows)) == [(t, "1", "2") for t in sorted(want)]
    (tmp_path / "none.csv").write_text("A,1,2\nB,1,2\n")
    with pytest.raises(ValueError, match="none.csv"):
        flatfiles.read_csv(spark, [paths["plain"], str(tmp_path / "none.csv")])
