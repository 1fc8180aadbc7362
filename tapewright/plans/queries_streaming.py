"""Streaming operators, run to the end of the data so that batch results are their oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright import schemas
from tapewright.functions import scalars as S
from tapewright.operators import classify as C
from tapewright.operators.ordered import landed
from tapewright.plans import queries_features as QF
from tapewright.plans import queries_options as QO
from tapewright.plans import queries_trades as QT
from tapewright.plans import views as V
from tapewright.plans.registry import query
from tapewright.session import fresh_dir
from tapewright.streaming import enrich as E
from tapewright.streaming import features as LF
from tapewright.streaming import tape
from tapewright.streaming import windows as W

DELAY, DELAY_NS = "10 minutes", 600 * 10**9
DAY_NS = 86_400 * 10**9


def live_trades(spark, d):
    return V.trades(spark, d, read=V.stream_table)


def live_quotes(spark, d):
    return V.quotes(spark, d, read=V.stream_table)


@query("stream_windows", sql=V.with_views("fx_trades", f"""
  select * from (
    select instrument_id, '24h' as "window", trade_ts_ns // {DAY_NS} * {DAY_NS} as window_start_ns,
      trade_ts_ns // {DAY_NS} * {DAY_NS} + {DAY_NS} as window_end_ns, count(*) as trades,
      min(price) as low, max(price) as high, round(sum(abs(price * size)), 3) as total,
      round(avg(abs(price * size)), 6) as mean, round(stddev_samp(abs(price * size)), 4) as stddev,
      'Partial' as completeness
    from fx_trades group by all)
  where window_end_ns <= (select max(trade_ts_ns) from fx_trades) - {DELAY_NS}"""))
def stream_windows(spark, d):
    result, _ = W.run_to_files(spark, W.stream_windows(live_trades(spark, d), "24h", DELAY), "windows")
    return result.withColumns({"total": F.round("total", 3), "mean": F.round("mean", 6),
                               "stddev": F.round("stddev", 4)})


# Watermarks (ms) after the first nine tenths have arrived, and at the end.
V.define_view("marks", ("fx_trades",), f"""
  select (max(case when seq % 10 <> 0 then trade_ts_ns end) - {DELAY_NS}) // 1000000 as w1,
    (max(trade_ts_ns) - {DELAY_NS}) // 1000000 as w2 from fx_trades""")
V.define_view("arrivals", ("fx_trades", "marks"), f"""
  select instrument_id, (trade_ts_ns // {DAY_NS} + 1) * {DAY_NS} as window_end_ns, w2,
    seq % 10 = 0 and (trade_ts_ns // {DAY_NS} + 1) * {DAY_NS} <= w1 * 1000000 as late from fx_trades, marks""")


@query("late_events", sql=V.with_views("arrivals", """
  select count(distinct (instrument_id, window_end_ns)) filter (not late and window_end_ns <= w2 * 1000000) as windows,
    cast(count(*) filter (not late and window_end_ns <= w2 * 1000000) as bigint) as trades,
    cast(count(*) filter (late) as bigint) as late_rows
  from arrivals"""))
def late_events(spark, d):
    """A tenth of the trades arrives after the watermark: kept out of closed windows, and counted."""
    landed, out, state = (fresh_dir(spark, n) for n in ("late", "late-windows", "late-state"))
    trades = V.trades(spark, d)
    late = F.col("seq") % 10 == 0
    trades.where(~late).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(trades.schema).parquet(landed)
    _, _, watermark = W.run_windows(spark, stream, "24h", DELAY, out, state)
    trades.where(late).write.mode("append").parquet(landed)
    result, rows, _ = W.run_windows(spark, stream, "24h", DELAY, out, state, watermark)
    return result.agg(F.count(F.lit(1)).alias("windows"), F.sum("trades").alias("trades")).withColumn(
        "late_rows", F.lit(rows).cast("bigint"))


def _tape(spark, d):
    stream = tape.stream_asof(live_quotes(spark, d), live_trades(spark, d), QT.STALE_US, DELAY)
    return W.run_to_files(spark, stream, "tape")[0]


# Only events the watermark has passed (in whole milliseconds) are out.
_CLOSED = f"""trade_ts_ns // 1000000 < ((select max(ts) from (select max(trade_ts_ns) as ts from fx_trades
  union all select max(quote_ts_ns) from fx_quotes)) - {DELAY_NS}) // 1000000"""


@query("stream_asof", sql=V.with_views("snap", f"""
  select seq, instrument_id, trade_ts_ns, price, nbbo_bid, nbbo_ask, nbbo_ts_ns, nbbo_age_us from snap
  where {_CLOSED}"""))
def stream_asof(spark, d):
    return _tape(spark, d).drop("prev_price")


@query("stream_tick_rule", sql=V.with_views("ruled", f"""
  select seq, prev_price, case when price - prev_price > 0.0001e0 then 'Buyer'
      when price - prev_price < -0.0001e0 then 'Seller' else 'Unknown' end as aggressor_side
  from ruled where {_CLOSED}"""))
def stream_tick_rule(spark, d):
    blank = _tape(spark, d).withColumns({
        "aggressor_side": F.lit("Unknown"), "class_method": F.lit("Unknown"),
        "aggressor_confidence": F.lit(0.0)})
    return C.tick_rule(blank, QT.PARAMS).select("seq", "prev_price", "aggressor_side")


@query("stream_dedup", sql=V.with_views("fx_trades", """
  select distinct instrument_id, exchange, trade_id from fx_trades"""))
def stream_dedup(spark, d):
    keys = ["instrument_id", "exchange", "trade_id"]
    stream = W.stream_dedup(live_trades(spark, d), keys, "trade_ts_ns", "40 days")
    return W.run_to_files(spark, stream.select(*keys), "dedup")[0]


def _enriched_stream(spark, d, trades, curves_at, out=None, checkpoint=None):
    out, checkpoint = out or fresh_dir(spark, "live"), checkpoint or fresh_dir(spark, "live-state")
    E.enrich_stream(spark, trades, QO.rough_quotes(spark, d), curves_at, QO.STALE_US, out, checkpoint,
                    QO.DIVIDEND).awaitTermination()
    return spark.read.parquet(out)


@query("stream_enrich_sink")
def stream_enrich_sink(spark, d):
    curves = QO.curves(spark, d)
    live = _enriched_stream(spark, d, V.option_trades(spark, d, read=V.stream_table), lambda batch: curves)
    return live.select("seq", "contract", "trade_ts_ns", "iv", "delta", "gamma", "vega", "theta",
                       "greeks_flags", "source", "watermark_ts_ns", "batch_id")


@query("stream_curve_gate", sql="""
  select batch, priced, cast(sum(n) as bigint) as trades from (
    select case when l_orderkey % 2 = 0 then 0 else 1 end as batch, l_orderkey % 2 <> 0 as priced, 1 as n
    from lineitem) group by all""")
def stream_curve_gate(spark, d):
    """Half the trades arrive before any curve is known and stay unpriced."""
    landed, out, state = (fresh_dir(spark, n) for n in ("gate", "gate-live", "gate-state"))
    trades = V.option_trades(spark, d)
    curves = QO.curves(spark, d)
    even = S.floor_div("seq", 10_000_000) % 2 == 0
    for half in (even, ~even):   # the stream goes on from its checkpoint when the second half has landed
        trades.where(half).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(trades.schema).parquet(landed)
        live = _enriched_stream(spark, d, stream, lambda batch: curves.where(F.lit(batch > 0)), out, state)
    priced = F.col("greeks_flags").bitwiseAND(F.lit(QO.G.NO_TREASURY)) == 0
    return live.groupBy(F.col("batch_id").cast("int").alias("batch"), priced.alias("priced")).agg(
        F.count(F.lit(1)).alias("trades"))


@query("stream_watermark_meta", sql=V.with_views("fx_option_trades", """
  select 'Ws' as source, 'Prelim' as quality, 'Unknown' as completeness, max(trade_ts_ns) as watermark_ts_ns,
    count(*) as n from fx_option_trades"""))
def stream_watermark_meta(spark, d):
    stream = V.option_trades(spark, d, read=V.stream_table)
    out = fresh_dir(spark, "meta")

    def write(batch, batch_id):
        E.stamped(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    stream.writeStream.foreachBatch(write).trigger(availableNow=True).option(
        "checkpointLocation", fresh_dir(spark, "meta-state")).start().awaitTermination()
    return spark.read.parquet(out).groupBy("source", "quality", "completeness", "watermark_ts_ns").agg(
        F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------- feature rows
LENGTHS = {"720h": 720, "1440h": 1440, "4320h": 4320}
_LENGTHS = ", ".join(f"('{label}', {hours * 3600 * 10**9})" for label, hours in LENGTHS.items())
MIDDLE_NS = 1_592_179_200 * 10**9   # 2020-06-15: what comes before arrives first


def _closed(source: str, columns: str) -> str:
    """Rows of a relation in every length's windows that the watermark has passed at the end."""
    return f"""
  select * from (
    select {columns}, l as "window", trade_ts_ns // n * n as window_start_ns, trade_ts_ns // n * n + n as window_end_ns
    from {source}, (values {_LENGTHS}) as t(l, n)), live_mark where window_end_ns <= mark"""


V.define_view("live_mark", ("exposed", "month_stock"), f"""
  select greatest((select max(trade_ts_ns) from exposed), (select max(trade_ts_ns) from month_stock)) - {DELAY_NS} as mark""")
V.define_view("live_exposed", ("exposed", "live_mark"), _closed(
    "exposed", 'exposed.* exclude ("window", window_start_ns, window_end_ns)'))
V.define_view("live_stock", ("month_stock", "live_mark"), _closed("month_stock", "symbol, trade_ts_ns, seq, price, size"))
V.define_view("live_values", ("live_exposed", "live_stock"), f"""
  select {QF._K}, {QF._RIGHT} || e as series, x from live_exposed,
    lateral (values ('dadvv', dadvv), ('signed_dadvv', signed_dadvv), ('gadvv', gadvv),
      ('signed_gadvv', signed_gadvv)) as t(e, x)
  union all select {QF._K}, '{schemas.UNDERLYING_SERIES}', abs(price * size) from live_stock""", materialized=True)
V.define_view("live_moments", ("live_values",), QF.sql_moments("live_values"), materialized=True)


# A mean near zero leaves the cv fewer digits than the other columns.
_LIVE_DIGITS = {c: 4 if c.endswith("_cv") else QF._core_digits(c) for c in QF._CORE}
_LIVE_ROWS = QF._sql_feature_core("live_values", "live_moments", "live_stock", "live_exposed").replace(
    "round(cv, 6) as cv", "round(cv, 4) as cv")


@query("stream_feature_row", sql=V.with_views("live_values live_moments live_stock live_exposed", _LIVE_ROWS))
def stream_feature_row(spark, d):
    """Feature rows of three window lengths from live option and underlying trades. The stream
    ends in the middle and goes on from its checkpoint, with windows half full."""
    inputs = {
        "options": QF.enriched_options(spark, d, vol=F.lit(QO.TEST_VOL)).select(
            "symbol", "trade_ts_ns", "seq", "contract_direction", "strike_price", "price", "size", "underlying_price",
            "delta", "gamma", "aggressor_side", "aggressor_confidence", "class_method"),
        "stock": QF.stock(spark, d).select("symbol", "trade_ts_ns", "seq", "price", "size")}
    inputs = {name: landed(rows, name) for name, rows in inputs.items()}
    folders = {name: fresh_dir(spark, f"live-{name}") for name in inputs}
    out, state = fresh_dir(spark, "live-features"), fresh_dir(spark, "live-features-state")
    early = F.col("trade_ts_ns") < MIDDLE_NS
    for part in (early, ~early):
        for name, rows in inputs.items():
            rows.where(part).write.mode("append").parquet(folders[name])
        streams = [spark.readStream.schema(rows.schema).parquet(folders[name]) for name, rows in inputs.items()]
        LF.stream_feature_rows(*streams, list(LENGTHS), DELAY, out, state).awaitTermination()
    rows = spark.read.parquet(out)
    return rows.select(*QF.KEYS, *[F.round(c, k).alias(c) for c, k in _LIVE_DIGITS.items()])


# ------------------------------------------------------------------- live quotes
V.define_view("quote_mark", ("fx_option_trades", "fx_underlying_quotes"), f"""
  select (greatest((select max(trade_ts_ns) from fx_option_trades), (select max(quote_ts_ns) from fx_underlying_quotes))
    - {DELAY_NS}) // 1000000 as mark_ms""")
V.define_view("quoted_live", ("opt_mid", "curves", "quote_mark"), """
  select opt_mid.* exclude (points), (select arg_max(points, curve_date) from curves) as points
  from opt_mid, quote_mark where trade_ts_ns // 1000000 < mark_ms""")
V.define_view("inputs_live", ("quoted_live",), QO.sql_inputs("quoted_live"), materialized=True)
V.define_view("overlaid_live", ("inputs_live",), QO.sql_greeks("inputs_live", f"{QO.TEST_VOL}e0"), materialized=True)


@query("stream_enrich_live", sql=V.with_views("overlaid_live", f"""
  select seq, contract, trade_ts_ns, nbbo_bid, nbbo_ask, nbbo_ts_ns, nbbo_age_us, iv, {QO._ROUNDED}, flags as greeks_flags
  from overlaid_live"""))
def stream_enrich_live(spark, d):
    """Quotes and option trades as two streams. Both end in the middle and go on from the checkpoint."""
    inputs = {"trades": V.option_trades(spark, d), "quotes": QO.rough_quotes(spark, d)}
    times = {"trades": "trade_ts_ns", "quotes": "quote_ts_ns"}
    folders = {name: fresh_dir(spark, f"live-{name}") for name in inputs}
    out, state = fresh_dir(spark, "live-greeks"), fresh_dir(spark, "live-greeks-state")
    curves = QO.curves(spark, d)
    for early in (True, False):
        for name, rows in inputs.items():
            rows.where((F.col(times[name]) < MIDDLE_NS) == early).write.mode("append").parquet(folders[name])
        trades, quotes = (spark.readStream.schema(inputs[n].schema).parquet(folders[n]) for n in ("trades", "quotes"))
        E.enrich_live(trades, quotes, lambda batch: curves, QO.STALE_US, DELAY, out, state, QO.DIVIDEND,
                      vol=F.lit(QO.TEST_VOL)).awaitTermination()
    return spark.read.parquet(out).select(
        "seq", "contract", "trade_ts_ns", "nbbo_bid", "nbbo_ask", "nbbo_ts_ns", "nbbo_age_us", "iv",
        F.round("delta", 7).alias("delta"), F.round("gamma", 7).alias("gamma"), F.round("vega", 6).alias("vega"),
        F.round("theta", 6).alias("theta"), "greeks_flags")
