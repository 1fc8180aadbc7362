"""Rate curves, Greeks and implied volatility."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions import options as O
from tapewright.functions.scalars import utc_date
from tapewright.operators import curves as K
from tapewright.operators import greeks as G
from tapewright.plans import queries_trades as QT
from tapewright.plans import views as V
from tapewright.plans.queries_scalars import sql_tail
from tapewright.plans.registry import query

STALE_US = QT.OPTION_STALE_US
TEST_VOL = 0.3
DIVIDEND = 0.01


def curves(spark, d):
    return K.build_curves(K.curve_points(V.yields(spark, d)))


def gapped_curves(spark, d):
    """Every eleventh curve day is missing, so that some days fall back."""
    return curves(spark, d).where(F.unix_date("curve_date") % 11 != 0)


def rough_quotes(spark, d, read=V.table):
    """Underlying quotes with crossed, locked and empty ones mixed in."""
    seq, bid, ask = F.col("seq"), F.col("bid"), F.col("ask")
    return V.underlying_quotes(spark, d, read).withColumns({
        "ask": F.when(seq % 29 == 0, bid - 0.5).when((seq % 31 == 0) | (seq % 37 == 0), bid)
        .when(seq % 43 == 0, F.lit(0.0)).otherwise(ask),
        "bid": F.when((seq % 41 == 0) | (seq % 43 == 0), F.lit(0.0)).otherwise(bid),
        "state": F.when(seq % 37 == 0, F.lit("Locked")).otherwise(F.lit("Normal")),
    })


V.define_view("curve_pts", ("fx_yields",), """
  select curve_date, tenor_years, yield_pct / 100e0 as rate from fx_yields
  where yield_pct is not null""")
V.define_view("curves", ("curve_pts",), """
  select curve_date, list({'tenor': tenor_years, 'rate': rate} order by tenor_years) as points
  from curve_pts group by 1""")
V.define_view("day_curves", ("curves", "fx_option_trades"), """
  select dt, curve_date, points from (
    select distinct cast(make_timestamp(trade_ts_ns // 1000) as date) as dt from fx_option_trades)
  asof left join curves on dt >= curve_date""")
V.define_view("gapped_days", ("curves", "fx_option_trades"), """
  select dt, curve_date from (
    select distinct cast(make_timestamp(trade_ts_ns // 1000) as date) as dt from fx_option_trades)
  asof left join (select * from curves where date_diff('day', date '1970-01-01', curve_date) % 11 <> 0)
    on dt >= curve_date""")
V.define_view("rough_q", ("fx_underlying_quotes",), """
  select instrument_id, quote_ts_ns, bid_sz, ask_sz, seq,
    case when seq % 29 = 0 then bid - 0.5e0 when seq % 31 = 0 or seq % 37 = 0 then bid
      when seq % 43 = 0 then 0e0 else ask end as ask,
    case when seq % 41 = 0 or seq % 43 = 0 then 0e0 else bid end as bid,
    case when seq % 37 = 0 then 'Locked' else 'Normal' end as state
  from fx_underlying_quotes""")
V.define_view("opt_rough", ("fx_option_trades", "rough_q", "day_curves"), f"""
  select t.*, q.bid as nbbo_bid, q.ask as nbbo_ask, q.bid_sz as nbbo_bid_sz,
    q.ask_sz as nbbo_ask_sz, q.state as nbbo_state, q.quote_ts_ns as nbbo_ts_ns,
    (t.trade_ts_ns - q.quote_ts_ns) // 1000 as nbbo_age_us,
    coalesce((t.trade_ts_ns - q.quote_ts_ns) // 1000 > {STALE_US} + 1, false) as nbbo_stale,
    c.dt, c.curve_date, c.points
  from fx_option_trades t asof left join (
    select instrument_id, quote_ts_ns, unnest(max_by({{'bid': bid, 'ask': ask, 'bid_sz': bid_sz,
      'ask_sz': ask_sz, 'state': state}}, seq)) from rough_q group by 1, 2) q
    on t.underlying = q.instrument_id and t.trade_ts_ns >= q.quote_ts_ns
  left join day_curves c on c.dt = cast(make_timestamp(t.trade_ts_ns // 1000) as date)""")
V.define_view("opt_mid", ("opt_rough",), f"""
  select *, case when mid_flags = 0 then case when bid_ok and ask_ok then 0.5e0 * (nbbo_bid + nbbo_ask)
      when bid_ok then nbbo_bid else nbbo_ask end end as mid
  from (select *, case when nbbo_ts_ns is null then 1 when nbbo_stale then 257
      when bid_ok and ask_ok and nbbo_ask <= nbbo_bid then
        case when abs(nbbo_ask - nbbo_bid) <= 1e-6 then
          case when nbbo_state <> 'Locked' then 33 else 0 end else 17 end
      when not bid_ok and not ask_ok then 129 else 0 end as mid_flags
    from (select *, coalesce(nbbo_bid > 0, false) as bid_ok, coalesce(nbbo_ask > 0, false) as ask_ok
      from opt_rough))""", materialized=True)


def sql_rate(points: str, tau: str) -> tuple[str, str]:
    below = f"len(list_filter({points}, lambda p: p.tenor < {tau}))"
    low, high = f"{points}[{below}]", f"{points}[{below} + 1]"
    rate = f"""case when {below} = 0 then {points}[1].rate
      when {below} = len({points}) then {points}[len({points})].rate
      else ({low}.rate * {low}.tenor + ({high}.rate * {high}.tenor - {low}.rate * {low}.tenor)
        * (({tau} - {low}.tenor) / ({high}.tenor - {low}.tenor))) / {tau} end"""
    return rate, f"coalesce({below} = len({points}), false)"


_RATE, _EXTRA = sql_rate("points", "tau")


def sql_inputs(source: str) -> str:
    return f"""
  select *, case when stop = 0 then any_rate end as rate, stop = 0 and late = 0 as priced,
    cast(case when stop <> 0 then stop else late + case when extra then 2048 else 0 end end as bigint)
      as flags
  from (select *, case when points is null then 8 when mid_flags <> 0 then mid_flags
        when tau is null then 4 else 0 end as stop,
      case when price < greatest(case when contract_direction = 'C' then mid - strike_price
        else strike_price - mid end, 0) - 1e-4 then 1026 else 0 end as late,
      {_RATE} as any_rate, {_EXTRA} as extra
    from (select *, case when expiry_ts_ns > trade_ts_ns then
        (expiry_ts_ns - trade_ts_ns) / 1e9 / 31536000e0 end as tau from {source}))"""


V.define_view("opt_inputs", ("opt_mid",), sql_inputs("opt_mid"), materialized=True)


def sql_greeks(source: str, vol: str) -> str:
    """Closed-form Greeks over a relation with mid, strike_price, rate, tau; null unless priced.

    Each tail of the normal distribution is one column; its four uses are taken from it."""
    q = f"{DIVIDEND}e0"
    return f"""
  select * exclude (spot, root, spread, dr, dq, d1, d2, a1, a2, t1, t2, dens, n1, n2, m1, m2),
    case when contract_direction = 'C' then spot * dq * n1 - strike_price * dr * n2
      else strike_price * dr * m2 - spot * dq * m1 end as model_price,
    case when contract_direction = 'C' then dq * n1 else dq * (n1 - 1e0) end as delta,
    dq * dens / (spot * spread) as gamma, spot * dq * dens * root as vega,
    -spot * dq * dens * iv / (2e0 * root) + case when contract_direction = 'C'
      then {q} * spot * dq * n1 - rate * strike_price * dr * n2
      else -{q} * spot * dq * m1 + rate * strike_price * dr * m2 end as theta
  from (select *, 0.3989422804014327e0 * exp(-0.5e0 * d1 * d1) as dens,
      case when d1 > 0 then 1e0 - t1 else t1 end as n1, case when d2 > 0 then 1e0 - t2 else t2 end as n2,
      case when d1 < 0 then 1e0 - t1 else t1 end as m1, case when d2 < 0 then 1e0 - t2 else t2 end as m2
    from (select *, {sql_tail('a1')} as t1, {sql_tail('a2')} as t2
      from (select *, d1 - spread as d2, abs(d1) as a1, abs(d1 - spread) as a2 from (
        select *, (ln(spot / strike_price) + (rate - {q} + 0.5e0 * iv * iv) * tau) / spread as d1
        from (select *, sqrt(tau) as root, iv * sqrt(tau) as spread, exp(-rate * tau) as dr, exp(-{q} * tau) as dq
          from (select *, case when priced then mid end as spot, case when priced then {vol} end as iv
            from {source}))))))"""


V.define_view("overlaid", ("opt_inputs",), sql_greeks("opt_inputs", "0.3e0"), materialized=True)


def _quoted(spark, d):
    return QT.asof.asof_underlying(V.option_trades(spark, d), rough_quotes(spark, d), STALE_US)


def _day_curves(spark, d):
    days = V.option_trades(spark, d).select(utc_date("trade_ts_ns").alias("dt")).distinct()
    return K.with_day_curve(days, gapped_curves(spark, d))


def _inputs(spark, d):
    return G.pricing_inputs(_quoted(spark, d), curves(spark, d))


def known_vol_greeks(spark, d):
    return G.enrich_greeks(V.option_trades(spark, d), rough_quotes(spark, d), curves(spark, d),
                           STALE_US, DIVIDEND, vol=F.lit(TEST_VOL))


# ----------------------------------------------------------------------- curves
@query("build_curve", sql=V.with_views("curves", """
  select strftime(curve_date, '%Y-%m-%d') as curve_date, len(points) as n,
    array_to_string(list_transform(points, lambda p: cast(cast(round(p.rate * 1e6) as bigint) as varchar)),
      ',') as micro_rates from curves"""))
def build_curve(spark, d):
    micro = F.transform("points", lambda p: F.round(p["rate"] * 1e6).cast("bigint").cast("string"))
    return curves(spark, d).select(
        F.col("curve_date").cast("string").alias("curve_date"),
        F.size("points").cast("bigint").alias("n"), F.array_join(micro, ",").alias("micro_rates"))


@query("asof_curve", sql=V.with_views("gapped_days", """
  select strftime(dt, '%Y-%m-%d') as dt, strftime(curve_date, '%Y-%m-%d') as curve_date
  from gapped_days"""))
def asof_curve(spark, d):
    return _day_curves(spark, d).select(F.col("dt").cast("string"), F.col("curve_date").cast("string"))


@query("latest_curve", sql=V.with_views("curves", """
  select strftime(curve_date, '%Y-%m-%d') as curve_date, cast(len(points) as integer) as n
  from curves where curve_date = (select max(curve_date) from curves)"""))
def latest_curve(spark, d):
    return K.latest_curve(curves(spark, d)).select(
        F.col("curve_date").cast("string"), F.size("points").alias("n"))


@query("curve_rate", sql=V.with_views("opt_inputs", """
  select seq, trade_ts_ns, contract, round(any_rate, 9) as rate, extra as extrapolated
  from opt_inputs where tau is not null and points is not null"""))
def curve_rate(spark, d):
    raw = O.tau_raw("expiry_ts_ns", "trade_ts_ns")
    dated = V.option_trades(spark, d).withColumns({
        "dt": utc_date("trade_ts_ns"), "tau": O.tau_years(raw),
    })
    dated = K.with_day_curve(dated, curves(spark, d))
    rated = K.with_curve_rate(dated.where(F.col("points").isNotNull() & F.col("tau").isNotNull()))
    return rated.select("seq", "trade_ts_ns", "contract", F.round("rate", 9).alias("rate"),
                        "extrapolated")


# ----------------------------------------------------------------------- options
@query("time_to_expiry", sql=V.with_views("fx_option_trades", """
  select seq, contract, trade_ts_ns, left_ns > 0 as alive,
    round(case when left_ns > 0 then greatest(left_ns / 1e9 / 31536000e0, 1 / 31536000e0) end, 10) as tau,
    coalesce(left_ns > 0 and left_ns / 1e9 / 31536000e0 < 1 / 31536000e0 - 2.220446049250313e-16, false)
      as clamped
  from (select *, expiry_ts_ns - 604800000000000 - trade_ts_ns + 52200000000000 + seq % 5 * 300000000
      as left_ns from fx_option_trades)"""))
def time_to_expiry(spark, d):
    # Expiry moved to around the trade time, so that some have expired and some are clamped.
    moved = V.option_trades(spark, d).withColumn(
        "moved_ns", F.col("expiry_ts_ns") - 604_800_000_000_000 + 52_200_000_000_000
        + F.col("seq") % 5 * 300_000_000)
    raw = O.tau_raw("moved_ns", "trade_ts_ns")
    return moved.select("seq", "contract", "trade_ts_ns", raw.isNotNull().alias("alive"),
                        F.round(O.tau_years(raw), 10).alias("tau"), O.tau_clamped(raw).alias("clamped"))


@query("underlying_mid", sql=V.with_views("opt_mid", """
  select seq, contract, trade_ts_ns, mid, cast(mid_flags as integer) as mid_flags from opt_mid"""))
def underlying_mid(spark, d):
    return G.underlying_mid(_quoted(spark, d)).select("seq", "contract", "trade_ts_ns", "mid",
                                                      "mid_flags")


_ROUNDED = "round(delta, 7) as delta, round(gamma, 7) as gamma, round(vega, 6) as vega, round(theta, 6) as theta"


@query("bs_price_greeks", sql=V.with_views("overlaid", f"""
  select seq, contract, trade_ts_ns, round(model_price, 6) as model_price, {_ROUNDED} from overlaid"""))
def bs_price_greeks(spark, d):
    inputs = _inputs(spark, d).withColumn("vol", F.when(F.col("priced"), F.lit(TEST_VOL)))
    priced = O.with_price_and_greeks(inputs, "contract_direction",
                                     "mid", "strike_price", "rate", "vol", "tau", DIVIDEND)
    digits = {"model_price": 6, "delta": 7, "gamma": 7, "vega": 6, "theta": 6}
    return priced.select("seq", "contract", "trade_ts_ns",
                         *[F.round(k, n).alias(k) for k, n in digits.items()])


@query("greeks_flags", sql=V.with_views("opt_inputs", """
  select flags as greeks_flags, priced, count(*) as n from opt_inputs group by 1, 2"""))
def greeks_flags(spark, d):
    return known_vol_greeks(spark, d).groupBy("greeks_flags", "priced").agg(
        F.count(F.lit(1)).alias("n"))


@query("enrich_known_vol", sql=V.with_views("overlaid", f"""
  select seq, contract, trade_ts_ns, size, nbbo_bid, nbbo_ask, nbbo_ts_ns, nbbo_age_us, nbbo_state, iv,
    {_ROUNDED}, flags as greeks_flags, strftime(curve_date, '%Y-%m-%d') as curve_date from overlaid"""))
def enrich_known_vol(spark, d):
    e = known_vol_greeks(spark, d)
    return e.select(
        "seq", "contract", "trade_ts_ns", "size", "nbbo_bid", "nbbo_ask", "nbbo_ts_ns", "nbbo_age_us",
        "nbbo_state", "iv", F.round("delta", 7).alias("delta"), F.round("gamma", 7).alias("gamma"),
        F.round("vega", 6).alias("vega"), F.round("theta", 6).alias("theta"), "greeks_flags",
        F.col("curve_date").cast("string").alias("curve_date"))


@query("overlay_projection", sql=V.with_views("overlaid", """
  select seq as trade_uid, trade_ts_ns, contract, underlying, round(delta, 7) as delta,
    round(gamma, 7) as gamma, round(vega, 6) as vega, round(theta, 6) as theta, iv,
    flags as greeks_flags, nbbo_bid, nbbo_ask, nbbo_bid_sz, nbbo_ask_sz, nbbo_ts_ns, nbbo_age_us,
    nbbo_state, 'v1' as engine_version,
    strftime(make_timestamp(trade_ts_ns // 1000), '%Y-%m-%d') as treasury_curve_date,
    strftime(curve_date, '%Y-%m-%d') as treasury_curve_source_date,
    cast(0 as bigint) as enriched_at_ns, 'run-1' as run_id from overlaid"""))
def overlay_projection(spark, d):
    o = G.overlay(known_vol_greeks(spark, d), "v1", "run-1", F.lit(0), uid="seq")
    return o.withColumns({"delta": F.round("delta", 7), "gamma": F.round("gamma", 7),
                          "vega": F.round("vega", 6), "theta": F.round("theta", 6)})
