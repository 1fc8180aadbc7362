"""Golden values, properties, skew and plan shape of the batch operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.functions import normal
from tapewright.functions import scalars as S
from tapewright.operators import asof, classify as C, curves as K, greeks as G, hygiene as H, stats as ST
from tapewright.operators.windows import assign_windows, parse_window
from tapewright.sources import calendar

SEC = 1_000_000_000
DAY = 86_400 * SEC


def test_contract_parse(spark):
    rows = spark.createDataFrame([("O:SPY241220P00720000",), ("O:TSLA251219C00650000",), ("SPY241220P00720000",),
                                  ("O:SPY241399P00720000",)], "contract string").withColumn("hint", F.lit(5))
    got = [tuple(r) for r in S.parse_contract(rows, "contract", "hint").select(
        "contract_direction", "strike_price", "underlying", "expiry_ts_ns").collect()]
    day = (dt.date(2024, 12, 20) - dt.date(1970, 1, 1)).days * DAY
    assert got[0] == ("P", 720.0, "SPY", day)
    assert got[1][:3] == ("C", 650.0, "TSLA")
    assert got[2] == ("C", 0.0, "", 5)
    assert got[3] == ("P", 720.0, "SPY", 5)


def test_uid_separates_nulls_and_fields(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "~"), ("~", None)], "x string, y string")
    ids = [r[0] for r in df.select(S.uid_hex(S.uid("t", F.col("x"), F.col("y")))).collect()]
    assert len(set(ids)) == 4 and all(len(i) == 32 for i in ids)


def _quotes(spark, rows):
    return spark.createDataFrame(rows, "instrument_id string, quote_ts_ns bigint, bid double, ask double, "
                                 "bid_sz bigint, ask_sz bigint, state string, seq bigint")


def test_asof_limit_ties_and_slices(spark):
    hour = 3600 * SEC
    q = _quotes(spark, [
        ("M", SEC, 275.0, 276.0, 1, 1, "Normal", 1), ("M", int(1.4 * SEC), 275.3, 276.1, 1, 1, "Normal", 2),
        ("M", 50 * hour, 1.0, 2.0, 1, 1, "Normal", 3), ("M", 50 * hour, 3.0, 4.0, 1, 1, "Normal", 4)])
    t = spark.createDataFrame([
        ("M", int(1.5 * SEC), 1.0, 10), ("M", int(4 * SEC), 1.0, 11), ("M", 50 * hour, 1.0, 12),
        ("M", 90 * hour, 1.0, 13), ("X", SEC, 1.0, 14), ("M", 0, 1.0, 15)],
        "instrument_id string, trade_ts_ns bigint, price double, seq bigint")
    near = {r["seq"]: r["nbbo_bid"] for r in asof.asof_join(t, q, max_age_us=1_000_000).collect()}
    assert near == {10: 275.3, 11: None, 12: 3.0, 13: None, 14: None, 15: None}
    far = {r["seq"]: r["nbbo_bid"] for r in asof.asof_join(t, q).collect()}
    assert far == {10: 275.3, 11: 275.3, 12: 3.0, 13: 3.0, 14: None, 15: None}


def test_lookback_matches_brute_force_under_skew(spark):
    """One key with most rows, slices much shorter than the gaps between quotes."""
    rng = np.random.default_rng(0)
    rows = [("hot" if rng.random() < 0.8 else f"k{i % 5}", int(rng.integers(0, 10**6)), float(i), i)
            for i in range(2000)]
    t = spark.createDataFrame(rows, "instrument_id string, trade_ts_ns bigint, price double, seq bigint")
    from tapewright.operators.ordered import carry_forward
    got = {r["seq"]: r["p"] for r in carry_forward(
        t, ["instrument_id"], "trade_ts_ns", ["trade_ts_ns", "seq"], {"p": F.col("price")},
        include_current=False, slice_ns=500).collect()}
    last, want = {}, {}
    for k, _, p, s in sorted(rows, key=lambda r: (r[1], r[3])):
        want[s] = last.get(k)
        last[k] = p
    assert got == want


def test_asof_plan_has_no_product(spark, sf_dir):
    from tapewright.plans import views as V
    from tapewright.plans.queries_trades import state_quotes
    plan = asof.asof_join(V.trades(spark, sf_dir), state_quotes(spark, sf_dir))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_classification_rules(spark):
    rows = [  # price, bid, ask, state, previous price
        (276.0, 275.0, 276.0, "Normal", None, "Buyer", "NbboTouch", 1.0),
        (275.0, 275.0, 276.0, "Normal", None, "Seller", "NbboTouch", 1.0),
        (275.8, 275.0, 276.0, "Normal", None, "Buyer", "NbboAtOrBeyond", 0.7),
        (275.5, 275.0, 276.0, "Normal", None, "Buyer", "NbboAtOrBeyond", 0.7),
        (275.2, 275.0, 276.0, "Normal", None, "Seller", "NbboAtOrBeyond", 0.7),
        (275.2, 276.0, 275.0, "Crossed", 275.0, "Buyer", "TickRule", 0.5),
        (275.2, None, None, None, 275.4, "Seller", "TickRule", 0.5),
        (275.2, None, None, None, 275.2, "Unknown", "Unknown", 0.0),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "price double, nbbo_bid double, nbbo_ask double, "
                               "nbbo_state string, prev_price double")
    params = C.ClassifyParams()
    got = C.tick_rule(C.quote_rule(df, params), params).collect()
    for r, want in zip(got, rows):
        assert (r["aggressor_side"], r["class_method"], r["aggressor_confidence"]) == want[5:]


def test_curve_interpolation(spark):
    points = spark.createDataFrame([(dt.date(2024, 1, 5), t, r) for t, r in
                                    ((0.5, 0.01), (1.0, 0.02), (2.0, 0.03))],
                                   "curve_date date, tenor_years double, rate double")
    curves = K.build_curves(points)
    days = spark.createDataFrame([(dt.date(2024, 1, 6), t) for t in (0.25, 0.75, 5.0)], "dt date, tau double")
    got = {r["tau"]: (round(r["rate"], 7), r["extrapolated"], r["curve_date"]) for r in
           K.with_curve_rate(K.with_day_curve(days, curves)).collect()}
    friday = dt.date(2024, 1, 5)  # Friday's curve answers Saturday
    assert got == {0.25: (0.01, False, friday), 0.75: (0.0166667, False, friday), 5.0: (0.03, True, friday)}
    before = spark.createDataFrame([(dt.date(2024, 1, 4), 1.0)], "dt date, tau double")
    assert K.with_day_curve(before, curves).first()["points"] is None
    assert K.with_day_curve(before, curves.limit(0)).count() == 1


def test_normal_cdf():
    x = np.linspace(-9, 9, 2001)
    want = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    assert np.abs(normal.cdf_np(x) - want).max() < 1e-14


def test_volatility_round_trip_and_failures():
    rng = np.random.default_rng(1)
    n = 500
    call = rng.random(n) < 0.5
    spot, strike = rng.uniform(80, 120, n), rng.uniform(80, 120, n)
    tau, vol, rate = rng.uniform(0.1, 2, n), rng.uniform(0.1, 1.0, n), rng.uniform(0, 0.05, n)
    price, _ = G.O.price_and_vega_np(call, spot, strike, rate, 0.0, vol, tau)
    found, outcome = G._search(call, price, spot, strike, rate, tau, 0.0)
    ok = np.isin(outcome, (G.SOLVED, G.SOLVED_BY_BISECTION))
    again, _ = G.O.price_and_vega_np(call[ok], spot[ok], strike[ok], rate[ok], 0.0, found[ok], tau[ok])
    assert ok.mean() > 0.9 and np.abs(again - price[ok]).max() < 2e-4
    one = np.array([True])
    fail = lambda p, s, k: G._search(one, np.array([p]), np.array([s]), np.array([k]), np.array([0.01]),
                                     np.array([1.0]), 0.0)[1][0]
    assert fail(0.5, 420.5, 400.0) == G.BELOW_INTRINSIC
    assert fail(1000.0, 400.25, 400.0) == G.UNSOLVED


def test_put_call_parity(spark):
    df = spark.createDataFrame([("C", 100.0, 95.0, 0.03, 0.4, 0.7), ("P", 100.0, 95.0, 0.03, 0.4, 0.7)],
                               "d string, s double, k double, r double, v double, t double")
    c, p = (r["model_price"] for r in G.O.with_price_and_greeks(df, "d", "s", "k", "r", "v", "t", 0.01).collect())
    assert c - p == pytest.approx(100 * math.exp(-0.01 * 0.7) - 95 * math.exp(-0.03 * 0.7), abs=1e-9)


def test_statistics_against_numpy(spark):
    rng = np.random.default_rng(2)
    groups = {"wide": rng.lognormal(3, 2, 900), "signed": rng.normal(0, 50, 400).round(1), "same": np.full(30, 4.5),
              "zero": np.zeros(5), "lone": np.array([7.0]), "small": np.array([1.0, 2.0, 2.0, 3.0, 3.0])}
    values = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, x double")
    got = {r["g"]: r for r in ST.summarize(values, ["g"], "x").collect()}
    for g, v in groups.items():
        r = got[g]
        q1, med, q3 = np.quantile(v, (0.25, 0.5, 0.75))
        assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, med, q3))
        assert r["mad"] == pytest.approx(np.median(np.abs(v - med)))
        assert r["total"] == pytest.approx(v.sum()) and r["n"] == len(v)
    assert got["small"]["mode"] == 2.0 and got["lone"]["mode"] == 7.0 and got["same"]["mode"] == 4.5
    assert got["same"]["kde_peaks"] == 1.0 and got["lone"]["kde_peaks"] == 1.0
    assert got["signed"]["bc"] is None and got["wide"]["bc"] in (-0.25, 0.0, 0.25)
    m = groups["wide"] - groups["wide"].mean()
    assert got["wide"]["kurtosis"] == pytest.approx((m**4).mean() / (m**2).mean() ** 2)


def test_dedup_is_order_insensitive(spark):
    rows = [("A", 1, None, 5.0, 10, 3, 1), ("A", 1, None, 5.0, 10, 3, 2), ("A", 9, "t", 1.0, 1, 3, 3),
            ("A", 8, "t", 2.0, 1, 3, 4), ("A", 8, "t", 2.0, 1, 4, 5), ("A", 8, "", 2.0, 1, 4, 6)]
    df = spark.createDataFrame(rows, "symbol string, trade_ts_ns bigint, trade_id string, price double, "
                               "size bigint, exchange int, seq bigint")
    for d in (df, df.orderBy(F.desc("seq"))):
        assert sorted(r["seq"] for r in H.dedup_equity_trades(d).collect()) == [1, 4, 5, 6]


def test_windows(spark):
    assert parse_window("5M") == 300 * SEC
    for bad in ("", "5", "x5m", "5d", "0s"):
        with pytest.raises(ValueError):
            parse_window(bad)
    df = spark.createDataFrame([(-1,), (61 * SEC,)], "t bigint")
    assert {r["window_start_ns"] for r in assign_windows(df, "t", ["1m"]).collect()} == {-60 * SEC, 60 * SEC}


def test_calendar_holidays():
    # Official closings of 2024 and 2025 (fixed values).
    want = ["2024-01-01", "2024-01-15", "2024-02-19", "2024-03-29", "2024-05-27", "2024-06-19", "2024-07-04",
            "2024-09-02", "2024-11-28", "2024-12-25", "2025-01-01", "2025-01-09", "2025-01-20", "2025-02-17",
            "2025-04-18", "2025-05-26", "2025-06-19", "2025-07-04", "2025-09-01", "2025-11-27", "2025-12-25"]
    assert [str(h) for y in (2024, 2025) for h in calendar.holidays(y)] == want
