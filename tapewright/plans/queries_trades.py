"""As-of joins, look-backs and aggressor classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions import scalars as S
from tapewright.operators import asof, classify as C
from tapewright.operators.ordered import landed
from tapewright.operators.windows import assign_windows
from tapewright.plans import views as V
from tapewright.plans.registry import query

HOUR_US = 3_600_000_000
STALE_US = 6 * HOUR_US  # event quotes are minutes to hours apart
OPTION_STALE_US = 5 * 24 * HOUR_US  # underlying quotes are days apart
PARAMS = C.ClassifyParams(epsilon_price=1e-4, allowed_lateness_ms=STALE_US // 1000)


def state_quotes(spark, d):
    return V.quotes(spark, d).withColumn("state", S.quote_state("bid", "ask"))


STATE_SQL = """case when bid > ask then 'Crossed' when abs(bid - ask) < 2.220446049250313e-16
  then 'Locked' else 'Normal' end"""
V.define_view("sq", ("fx_quotes",), f"select *, {STATE_SQL} as state from fx_quotes")

# Trades with their last quote, unlimited (raw) and within the staleness limit (snap).
V.define_view("raw", ("fx_trades", "sq"), """
  select t.*, q.bid as q_bid, q.ask as q_ask, q.bid_sz as q_bid_sz, q.ask_sz as q_ask_sz,
    q.state as q_state, q.quote_ts_ns as q_ts, (t.trade_ts_ns - q.quote_ts_ns) // 1000 as q_age
  from fx_trades t asof left join sq q
    on t.instrument_id = q.instrument_id and t.trade_ts_ns >= q.quote_ts_ns""")
V.define_view("snap", ("raw",), f"""
  select * exclude (q_bid, q_ask, q_bid_sz, q_ask_sz, q_state, q_ts, q_age),
    case when q_age <= {STALE_US} then q_bid end as nbbo_bid,
    case when q_age <= {STALE_US} then q_ask end as nbbo_ask,
    case when q_age <= {STALE_US} then q_bid_sz end as nbbo_bid_sz,
    case when q_age <= {STALE_US} then q_ask_sz end as nbbo_ask_sz,
    case when q_age <= {STALE_US} then q_ts end as nbbo_ts_ns,
    case when q_age <= {STALE_US} then q_age end as nbbo_age_us,
    case when q_age <= {STALE_US} then q_state end as nbbo_state
  from raw""")
_EPS = PARAMS.epsilon
_USABLE = "coalesce(nbbo_state = 'Normal' and nbbo_ask > nbbo_bid, false)"
_MID = "(0.5e0 * (nbbo_bid + nbbo_ask))"
V.define_view("ruled", ("snap",), f"""
  select *,
    case when {_USABLE} and price >= nbbo_ask - {_EPS}e0 then 'Buyer'
      when {_USABLE} and price <= nbbo_bid + {_EPS}e0 then 'Seller'
      when not {_USABLE} then 'Unknown'
      when nbbo_ask - price < price - nbbo_bid and price >= {_MID} then 'Buyer'
      when price - nbbo_bid < nbbo_ask - price and price <= {_MID} then 'Seller'
      when price >= {_MID} then 'Buyer' else 'Seller' end as rule_side,
    case when {_USABLE} and (price >= nbbo_ask - {_EPS}e0 or price <= nbbo_bid + {_EPS}e0)
      then 'NbboTouch' when {_USABLE} then 'NbboAtOrBeyond' else 'Unknown' end as rule_method,
    case when {_USABLE} and (price >= nbbo_ask - {_EPS}e0 or price <= nbbo_bid + {_EPS}e0)
      then 1e0 when {_USABLE} then 0.7e0 else 0e0 end as rule_confidence,
    lag(price) over (partition by instrument_id order by trade_ts_ns, seq) as prev_price
  from snap""".replace(f"{_EPS}e0", "0.0001e0"))
V.define_view("classified", ("ruled",), """
  select * exclude (rule_side, rule_method, rule_confidence),
    case when rule_side <> 'Unknown' then rule_side
      when price - prev_price > 0.0001e0 then 'Buyer'
      when price - prev_price < -0.0001e0 then 'Seller' else 'Unknown' end as aggressor_side,
    case when rule_side <> 'Unknown' then rule_method
      when abs(price - prev_price) > 0.0001e0 then 'TickRule' else 'Unknown' end as class_method,
    case when rule_side <> 'Unknown' then rule_confidence
      when abs(price - prev_price) > 0.0001e0 then 0.5e0 else 0e0 end as aggressor_confidence,
    case when nbbo_ask > 0 then cast(
        sign((price - {m}) / {m} * 10000e0) * floor(abs((price - {m}) / {m} * 10000e0) + 0.5e0)
      as integer) end as aggressor_offset_mid_bp
  from ruled""".replace("{m}", _MID))


def _snapped(spark, d):
    return asof.asof_join(V.trades(spark, d), state_quotes(spark, d), max_age_us=STALE_US)


def _classified(spark, d):
    return C.classify(V.trades(spark, d), state_quotes(spark, d), PARAMS)


# --------------------------------------------------------------------- flagship
@query("touch_share", sql=V.with_views("classified", """
  select instrument_id, (trade_ts_ns // 3600000000000) * 3600000000000 as window_start_ns,
    count(*) as trades,
    round(avg(case when class_method = 'NbboTouch' then 1e0 else 0e0 end), 6) as touch_share,
    min_by(price, row(trade_ts_ns, seq)) as open, max(price) as high, min(price) as low,
    max_by(price, row(trade_ts_ns, seq)) as close
  from classified group by all"""))
def touch_share(spark, d):
    hourly = assign_windows(_classified(spark, d), "trade_ts_ns", ["1h"])
    order = F.struct("trade_ts_ns", "seq")
    return hourly.groupBy("instrument_id", "window_start_ns").agg(
        F.count(F.lit(1)).alias("trades"),
        F.round(F.avg(F.when(F.col("class_method") == "NbboTouch", 1.0).otherwise(0.0)), 6)
        .alias("touch_share"),
        F.min_by("price", order).alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", order).alias("close"),
    )


# ------------------------------------------------------------------------ joins
@query("asof_quote", sql=V.with_views("snap", """
  select seq, nbbo_bid, nbbo_ask, nbbo_ts_ns from snap"""))
def asof_quote(spark, d):
    return _snapped(spark, d).select("seq", "nbbo_bid", "nbbo_ask", "nbbo_ts_ns")


@query("asof_state", sql=V.with_views("raw", "select seq, q_state as before_state from raw"))
def asof_state(spark, d):
    return asof.asof_state(V.trades(spark, d), state_quotes(spark, d)).select("seq", "before_state")


_SNAPSHOT = ("nbbo_bid", "nbbo_ask", "nbbo_bid_sz", "nbbo_ask_sz", "nbbo_ts_ns", "nbbo_age_us",
             "nbbo_state")


@query("nbbo_snapshot", sql=V.with_views("snap", f"""
  select instrument_id, trade_ts_ns, seq, price, size, {', '.join(_SNAPSHOT)} from snap"""))
def nbbo_snapshot(spark, d):
    return _snapped(spark, d).select("instrument_id", "trade_ts_ns", "seq", "price", "size",
                                     *_SNAPSHOT)


V.define_view("opt_q", ("fx_option_trades", "fx_underlying_quotes"), f"""
  select t.*, q.bid as nbbo_bid, q.ask as nbbo_ask, q.bid_sz as nbbo_bid_sz,
    q.ask_sz as nbbo_ask_sz, q.state as nbbo_state, q.quote_ts_ns as nbbo_ts_ns,
    (t.trade_ts_ns - q.quote_ts_ns) // 1000 as nbbo_age_us,
    coalesce((t.trade_ts_ns - q.quote_ts_ns) // 1000 > {OPTION_STALE_US} + 1, false) as nbbo_stale
  from fx_option_trades t asof left join (
    select instrument_id, quote_ts_ns, max_by(bid, seq) as bid, max_by(ask, seq) as ask,
      max_by(bid_sz, seq) as bid_sz, max_by(ask_sz, seq) as ask_sz, max_by(state, seq) as state
    from fx_underlying_quotes group by all) q
    on t.underlying = q.instrument_id and t.trade_ts_ns >= q.quote_ts_ns""")


@query("asof_underlying", sql=V.with_views("opt_q", """
  select seq, contract, underlying, trade_ts_ns, nbbo_bid, nbbo_ask, nbbo_ts_ns, nbbo_age_us,
    nbbo_stale from opt_q"""))
def asof_underlying(spark, d):
    joined = asof.asof_underlying(V.option_trades(spark, d), V.underlying_quotes(spark, d),
                                  OPTION_STALE_US)
    return joined.select("seq", "contract", "underlying", "trade_ts_ns", "nbbo_bid", "nbbo_ask",
                         "nbbo_ts_ns", "nbbo_age_us", "nbbo_stale")


V.define_view("u_trades", ("fx_underlying_trades",), """
  select instrument_id, trade_ts_ns, max_by(price, seq) as price
  from fx_underlying_trades group by all""")
V.define_view("opt_priced", ("opt_q", "u_trades"), f"""
  select o.*, u.price as last_underlying_price,
    coalesce(case when o.nbbo_age_us <= {OPTION_STALE_US} then 0.5e0 * (o.nbbo_bid + o.nbbo_ask) end,
      u.price) as underlying_price
  from opt_q o asof left join u_trades u
    on o.underlying = u.instrument_id and o.trade_ts_ns >= u.trade_ts_ns""")


@query("resolve_underlying_price", sql=V.with_views("opt_priced", """
  select seq, contract, trade_ts_ns, underlying_price from opt_priced
  where underlying_price > 0"""))
def resolve_underlying_price(spark, d):
    return asof.resolve_underlying_price(
        V.option_trades(spark, d), V.underlying_quotes(spark, d), V.underlying_trades(spark, d),
        OPTION_STALE_US,
    ).select("seq", "contract", "trade_ts_ns", "underlying_price")


# -------------------------------------------------------------------- look-backs
@query("prev_price", sql=V.with_views("ruled", "select seq, price, prev_price from ruled"))
def prev_price(spark, d):
    return asof.prev_price(V.trades(spark, d)).select("seq", "price", "prev_price")


@query("last_underlying_trade", sql=V.with_views("opt_priced", """
  select seq, contract, trade_ts_ns, last_underlying_price from opt_priced"""))
def last_underlying_trade(spark, d):
    return asof.last_underlying_trade(
        V.option_trades(spark, d), V.underlying_trades(spark, d)
    ).select("seq", "contract", "trade_ts_ns", "last_underlying_price")


@query("horizon_prune", sql=V.with_views("fx_quotes", """
  select instrument_id, quote_ts_ns, seq from fx_quotes
  qualify quote_ts_ns >= max(quote_ts_ns) over (partition by instrument_id) - 86400000000000"""))
def horizon_prune(spark, d):
    return asof.prune_horizon(V.quotes(spark, d), "instrument_id", "quote_ts_ns",
                              86_400_000_000_000).select("instrument_id", "quote_ts_ns", "seq")


# ----------------------------------------------------------------- classification
@query("classify_quote_rule", sql=V.with_views("ruled", """
  select seq, rule_side as aggressor_side, rule_method as class_method,
    rule_confidence as aggressor_confidence from ruled"""))
def classify_quote_rule(spark, d):
    return C.quote_rule(_snapped(spark, d), PARAMS).select(
        "seq", "aggressor_side", "class_method", "aggressor_confidence")


@query("classify_tick_rule", sql=V.with_views("classified", """
  select seq, prev_price, aggressor_side, class_method, aggressor_confidence from classified
  where class_method in ('TickRule', 'Unknown')"""))
def classify_tick_rule(spark, d):
    joined = C.quoted_with_previous(V.trades(spark, d), state_quotes(spark, d), PARAMS)
    ruled = C.quote_rule(joined, PARAMS)
    return C.tick_rule(ruled, PARAMS).where(
        F.col("class_method").isin("TickRule", "Unknown")
    ).select("seq", "prev_price", "aggressor_side", "class_method", "aggressor_confidence")


@query("offset_mid_bp", sql=V.with_views("classified", """
  select seq, aggressor_offset_mid_bp from classified"""))
def offset_mid_bp(spark, d):
    return C.with_offset_bp(_snapped(spark, d), PARAMS).select("seq", "aggressor_offset_mid_bp")


@query("classify", sql=V.with_views("classified", f"""
  select seq, instrument_id, trade_ts_ns, price, {', '.join(_SNAPSHOT)}, aggressor_side,
    class_method, aggressor_confidence, aggressor_offset_mid_bp, 0.0001e0 as tick_size_used,
    cast(null as integer) as aggressor_offset_touch_ticks from classified"""))
def classify(spark, d):
    return _classified(spark, d).select(
        "seq", "instrument_id", "trade_ts_ns", "price", *_SNAPSHOT, "aggressor_side",
        "class_method", "aggressor_confidence", "aggressor_offset_mid_bp", "tick_size_used",
        "aggressor_offset_touch_ticks")


# Options by the tick rule only (no option quotes), confirmed by the underlying's move. The
# option delta is a stand-in made from the strike, signed by right.
OPTION_PARAMS = C.ClassifyParams(allowed_lateness_ms=OPTION_STALE_US // 1000)
OPTION_COLUMNS = C.TradeColumns(instrument="root", delta="delta", underlying="underlying")


def _aligned_input(spark, d):
    trades = V.option_trades(spark, d).withColumns({
        "root": F.concat("underlying", F.lit(":"), "contract_direction"),
        "delta": F.when(F.col("contract_direction") == "C", (F.col("strike_price") - 79.0) / 50.0)
        .otherwise((79.0 - F.col("strike_price")) / 50.0),
    })
    no_quote = trades.withColumns({
        "nbbo_bid": F.lit(None).cast("double"), "nbbo_ask": F.lit(None).cast("double"),
        "nbbo_state": F.lit(None).cast("string"),
    })
    ticked = asof.prev_price(no_quote, "root")
    return C.tick_rule(C.quote_rule(ticked, OPTION_PARAMS), OPTION_PARAMS)


V.define_view("ticked_options", ("opt_q",), f"""
  select *, case when contract_direction = 'C' then (strike_price - 79e0) / 50e0
      else (79e0 - strike_price) / 50e0 end as delta,
    price - lag(price) over (partition by underlying || ':' || contract_direction
      order by trade_ts_ns, seq) as change,
    case when nbbo_age_us <= {OPTION_STALE_US} then 0.5e0 * (nbbo_bid + nbbo_ask) end as mid
  from opt_q""")
V.define_view("eligible", ("ticked_options",), """
  select seq, trade_ts_ns, contract, mid,
    lag(mid) over (partition by underlying order by trade_ts_ns, seq) as prev_underlying_mid,
    delta, change
  from ticked_options
  where abs(change) > 0.0001e0 and mid is not null and abs(delta) > 2.220446049250313e-16""")


@query("prev_underlying_mid", sql=V.with_views("eligible", """
  select seq, trade_ts_ns, contract, mid, prev_underlying_mid from eligible"""))
def prev_underlying_mid(spark, d):
    joined = asof.asof_join(
        landed(_aligned_input(spark, d), "ticked"), V.underlying_quotes(spark, d), trade_key="underlying",
        columns=("bid", "ask"), prefix="u_", max_age_us=OPTION_STALE_US,
    ).withColumn("mid", S.classifier_mid("u_bid", "u_ask"))
    eligible = C.alignment_eligible(OPTION_COLUMNS, "mid")
    return C.prev_underlying_mid(landed(joined, "mids"), OPTION_COLUMNS, eligible, "mid").where(eligible).select(
        "seq", "trade_ts_ns", "contract", "mid", "prev_underlying_mid")


@query("delta_alignment", sql=V.with_views("ticked_options eligible", """
  select t.seq, t.trade_ts_ns, t.contract,
    case when abs(e.mid - e.prev_underlying_mid) > 2.220446049250313e-16 then
        case when sign(e.delta) * sign(e.mid - e.prev_underlying_mid) = sign(e.change)
          then 0.7e0 else 0e0 end
      when abs(t.change) > 0.0001e0 then 0.5e0 else 0e0 end as aggressor_confidence
  from ticked_options t left join eligible e using (seq, trade_ts_ns, contract)"""))
def delta_alignment(spark, d):
    return C.delta_alignment(
        _aligned_input(spark, d), V.underlying_quotes(spark, d), OPTION_PARAMS, OPTION_COLUMNS
    ).select("seq", "trade_ts_ns", "contract", "aggressor_confidence")
