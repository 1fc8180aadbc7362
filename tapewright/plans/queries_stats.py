"""Window assignment, price bars and distribution statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.operators import hygiene as H
from tapewright.operators import stats as ST
from tapewright.operators.ordered import landed
from tapewright.operators.windows import assign_windows, price_bars
from tapewright.plans import queries_trades as QT
from tapewright.plans import views as V
from tapewright.plans.registry import query

WEEK = "168h"
WEEK_NS = 168 * 3600 * 10**9
KEYS = ["instrument_id", "window_start_ns"]

V.define_view("dv", ("fx_trades",), f"""
  select instrument_id, (trade_ts_ns // {WEEK_NS}) * {WEEK_NS} as window_start_ns, seq,
    trade_ts_ns, price, abs(price * size) as x from fx_trades""")
V.define_view("dv_moments", ("dv",), """
  select instrument_id, window_start_ns, count(*) as n, sum(x) as total, min(x) as minimum,
    max(x) as maximum, avg(x) as mean, stddev_samp(x) as stddev,
    quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.5) as median, quantile_cont(x, 0.75) as q3,
    quantile_cont(x, 0.75) - quantile_cont(x, 0.25) as iqr
  from dv group by all""")


def weekly_values(spark, d):
    trades = assign_windows(V.trades(spark, d), "trade_ts_ns", [WEEK])
    return trades.withColumn("x", F.abs(F.col("price") * F.col("size")))


@query("window_assign", sql=V.with_views("fx_trades", """
  select seq, w as "window", (trade_ts_ns // n) * n as window_start_ns,
    (trade_ts_ns // n) * n + n as window_end_ns
  from fx_trades, (values ('30s', 30000000000), ('5m', 300000000000), ('1H', 3600000000000),
    ('24h', 86400000000000)) as t(w, n)"""))
def window_assign(spark, d):
    return assign_windows(V.trades(spark, d), "trade_ts_ns", ["30s", "5m", "1H", "24h"]).select(
        "seq", "window", "window_start_ns", "window_end_ns")


@query("ohlc", sql=V.with_views("dv", """
  select instrument_id, window_start_ns, min_by(price, row(trade_ts_ns, seq)) as open,
    max(price) as high, min(price) as low, max_by(price, row(trade_ts_ns, seq)) as close
  from dv group by all"""))
def ohlc(spark, d):
    return price_bars(weekly_values(spark, d), KEYS)


@query("dollar_value", sql=V.with_views("dv", """
  select instrument_id, window_start_ns, count(*) as n, round(sum(x), 3) as total
  from dv group by all"""))
def dollar_value(spark, d):
    return weekly_values(spark, d).groupBy(*KEYS).agg(
        F.count("x").alias("n"), F.round(F.sum("x"), 3).alias("total"))


@query("moments", sql=V.with_views("dv", """
  select instrument_id, window_start_ns, count(*) as n, round(sum(x), 3) as total,
    min(x) as minimum, max(x) as maximum, round(avg(x), 6) as mean,
    round(stddev_samp(x), 6) as stddev,
    round(case when stddev_samp(x) > 0 then
      sqrt(n0) * sum(pow(x - m, 3)) / pow(sum(pow(x - m, 2)), 1.5) end, 6) as skew,
    round(case when stddev_samp(x) > 0 then
      n0 * sum(pow(x - m, 4)) / pow(sum(pow(x - m, 2)), 2) end, 6) as kurtosis,
    round(case when stddev_samp(x) > 0 then stddev_samp(x) / greatest(abs(avg(x)), 1e-9) end, 6) as cv
  from (select *, avg(x) over w as m, count(*) over w as n0 from dv
    window w as (partition by instrument_id, window_start_ns))
  group by instrument_id, window_start_ns, n0"""))
def moments(spark, d):
    m = ST.moments(weekly_values(spark, d), KEYS, "x", box_cox=False)
    return m.select(
        *KEYS, "n", F.round("total", 3).alias("total"), "minimum", "maximum",
        *[F.round(c, 6).alias(c) for c in ("mean", "stddev", "skew", "kurtosis", "cv")])


@query("quartiles", sql=V.with_views("dv_moments", """
  select instrument_id, window_start_ns, n, round(q1, 6) as q1, round(median, 6) as median,
    round(q3, 6) as q3, round(iqr, 6) as iqr from dv_moments"""))
def quartiles(spark, d):
    q = ST.quartiles(landed(ST.runs(weekly_values(spark, d), KEYS, "x"), "runs"), KEYS)
    return q.select(*KEYS, "n", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "iqr")])


@query("mad", sql=V.with_views("dv dv_moments", """
  select instrument_id, window_start_ns, round(quantile_cont(abs(x - median), 0.5), 6) as mad
  from dv join dv_moments using (instrument_id, window_start_ns) group by all"""))
def mad(spark, d):
    runs = landed(ST.runs(weekly_values(spark, d), KEYS, "x"), "runs")
    out = ST.mad(runs, ST.quartiles(runs, KEYS), KEYS)
    return out.select(*KEYS, F.round("mad", 6).alias("mad"))


# Histogram and density steps over any (keys, x) table and its spread table, as SQL.
def sql_mode(values: str, spread: str, keys: str) -> str:
    return f"""
  select {keys}, coalesce(max_by(v, row(c, -v)) filter (v is not null),
      any_value(minimum) + any_value(w) * max_by(i, row(c, i)) filter (v is null)
        + any_value(w) / 2) as mode
  from (
    select {keys}, minimum, w, case when w is null then x end as v,
      case when w is not null then least(floor((x - minimum) / w),
        greatest(ceil((maximum - minimum) / w), 1) - 1) end as i, count(*) as c
    from (select v.*, s.minimum, s.maximum, case when n > 16 then case
        when iqr > 0 then 2 * iqr / pow(n, 1e0 / 3) when stddev > 0 then 3.5e0 * stddev / pow(n, 1e0 / 3)
        end end as w from {values} v join {spread} s using ({keys}))
    group by all)
  group by {keys}"""


def sql_kde(values: str, spread: str, keys: str) -> str:
    return f"""
  select {keys}, cast(case when n < 3 then n when not coalesce(stddev > 0, false) then 1
      else greatest(coalesce(turns, 1), 1) end as double) as kde_peaks
  from {spread} left join (
    select {keys}, count(*) filter (before > 0 and slope < 0) as turns from (
      select *, lag(slope) over (partition by {keys} order by g) as before from (
        select {keys}, g, dens - lag(dens) over (partition by {keys} order by g) as slope from (
          select {keys}, g, sum(exp(-0.5e0 * pow((minimum + step * g - x) / h, 2))) as dens
          from (select v.*, minimum, 1.06e0 * stddev * pow(n, -0.2e0) as h,
              (maximum - minimum) / 128e0 as step
            from {values} v join {spread} s using ({keys}) where n >= 3 and stddev > 0),
            range(0, 129) as t(g)
          group by {keys}, g)))
    group by {keys}) using ({keys})"""


def sql_box_cox(values: str, keys: str) -> str:
    lambdas = ", ".join(f"({lam!r}e0)" for lam in ST.BOX_COX_LAMBDAS)
    return f"""
  select {keys}, max_by(lam, row(ll, -lam)) filter (ll is not null) as bc from (
    select {keys}, lam, case when bool_and(x > 0) and count(*) > 1 and v > 0 and isfinite(v) then
        (lam - 1) * sum(lx) - 0.5e0 * count(*) * ln(v) end as ll
    from (select *, var_pop(case when lam = 0 then lx else (exp(lam * lx) - 1) / lam end)
          over (partition by {keys}, lam) as v
        from (select *, case when x > 0 then ln(x) end as lx from {values}),
          (values {lambdas}) as t(lam))
    group by {keys}, lam, v)
  group by {keys}"""


_K = "instrument_id, window_start_ns"


@query("mode_estimate", sql=V.with_views("dv dv_moments", f"""
  select {_K}, round(mode, 6) as mode from ({sql_mode('dv', 'dv_moments', _K)})"""))
def mode_estimate(spark, d):
    values = weekly_values(spark, d)
    runs = landed(ST.runs(values, KEYS, "x"), "runs")
    spread = ST.moments(values, KEYS, "x", box_cox=False).join(
        ST.quartiles(runs, KEYS).drop("n"), KEYS)
    return ST.mode_estimate(runs, spread, KEYS).select(*KEYS, F.round("mode", 6).alias("mode"))


@query("box_cox_lambda", sql=V.with_views("dv", sql_box_cox("dv", _K)))
def box_cox_lambda(spark, d):
    return ST.moments(weekly_values(spark, d), KEYS, "x").select(*KEYS, "bc")


@query("kde_peaks", sql=V.with_views("dv dv_moments", sql_kde("dv", "dv_moments", _K)))
def kde_peaks(spark, d):
    values = weekly_values(spark, d)
    spread = ST.moments(values, KEYS, "x", box_cox=False)
    return ST.kde_peaks(ST.runs(values, KEYS, "x"), spread, KEYS)


# ------------------------------------------------------------- classification mixes
@query("dedup_trades", sql=V.with_views("fx_trades", """
  select seq, instrument_id, trade_ts_ns, price, size, exchange, trade_id from fx_trades
  qualify row_number() over (partition by instrument_id, exchange, trade_id
    order by trade_ts_ns, seq) = 1"""))
def dedup_trades(spark, d):
    return H.dedup_equity_trades(V.trades(spark, d), "instrument_id").select(
        "seq", "instrument_id", "trade_ts_ns", "price", "size", "exchange", "trade_id")


@query("dedup_option_trades", sql=V.with_views("fx_option_trades", """
  select contract, trade_ts_ns, price, size, min(seq) as seq from fx_option_trades group by all"""))
def dedup_option_trades(spark, d):
    return H.dedup_option_trades(V.option_trades(spark, d)).select(
        "contract", "trade_ts_ns", "price", "size", "seq")


@query("adaptive_staleness", sql=V.with_views("raw", """
  select instrument_id, cast(floor(greatest(least(quantile_cont(q_age, 0.99), 28800000000),
    3600000000)) as bigint) as staleness_us from raw where q_age is not null group by 1"""))
def adaptive_staleness(spark, d):
    aged = QT.asof.asof_join(V.trades(spark, d), QT.state_quotes(spark, d))
    return H.adaptive_staleness(aged, "instrument_id", 3_600_000_000, 28_800_000_000)


@query("ingest_metrics", sql=V.with_views("fx_trades", """
  select strftime(p.dt, '%Y-%m-%d') as dt, coalesce(r.n, 0) as rows,
    (coalesce(r.n, 0) + 99) // 100 as batches, coalesce(r.n, 0) > 0 as completed
  from (select cast(unnest(generate_series(timestamp '2024-01-01', timestamp '2024-02-03',
      interval 1 day)) as date) as dt) p
  left join (select cast(make_timestamp(trade_ts_ns // 1000) as date) as dt, count(*) as n
    from fx_trades group by 1) r on p.dt = r.dt"""))
def ingest_metrics(spark, d):
    from tapewright.sources.calendar import date_range
    planned = date_range(spark, "2024-01-01", "2024-02-03")
    return H.ingest_metrics(V.trades(spark, d), "trade_ts_ns", 100, planned).withColumn(
        "dt", F.col("dt").cast("string"))
