"""Exposures, mixes, feature rows and the dip test."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright import schemas
from tapewright.functions import scalars as S
from tapewright.operators import asof
from tapewright.operators import classify as C
from tapewright.operators import dip as D
from tapewright.operators import features as X
from tapewright.operators import greeks as G
from tapewright.operators.windows import assign_windows
from tapewright.plans import queries_options as QO
from tapewright.plans import queries_stats as QS
from tapewright.plans import queries_trades as QT
from tapewright.plans import views as V
from tapewright.plans.registry import query

MONTH = "720h"
MONTH_NS = 720 * 3600 * 10**9
KEYS = X.KEYS
DRAWS = 2_000


def labelled_options(spark, d):
    """Option trades classified against a quote made from the trade itself."""
    size = F.col("size")
    t = V.option_trades(spark, d).withColumns({
        "nbbo_bid": F.round(F.col("price") - size % 3 * 0.05, 2),
        "nbbo_ask": F.round(F.col("price") + S.floor_div(size, 3) % 3 * 0.05, 2),
    }).withColumn("nbbo_state", S.quote_state("nbbo_bid", "nbbo_ask"))
    return C.quote_rule(t, C.ClassifyParams()).drop("nbbo_bid", "nbbo_ask", "nbbo_state")


def enriched_options(spark, d, vol=None):
    """Labelled, priced option trades with Greeks, keyed by symbol. Quotes for the price, trades
    and quotes for the Greeks are looked up in one pass, as all belong to the underlying."""
    lookups = asof.price_lookups(V.underlying_quotes(spark, d), V.underlying_trades(spark, d),
                                 QT.OPTION_STALE_US)
    looked_up = asof.asof_join_all(
        labelled_options(spark, d), [*lookups, asof.Lookup(QO.rough_quotes(spark, d))], trade_key="underlying")
    quoted = asof.mark_stale(asof.with_underlying_price(looked_up), QO.STALE_US)
    e = G.enrich_quoted(quoted, QO.curves(spark, d), QO.DIVIDEND, vol=vol)
    return e.withColumnRenamed("underlying", "symbol")


def stock(spark, d):
    return V.underlying_trades(spark, d).withColumnRenamed("instrument_id", "symbol")


def known_vol_exposures(spark, d):
    e = X.exposures(enriched_options(spark, d, vol=F.lit(QO.TEST_VOL)))
    return assign_windows(e, "trade_ts_ns", [MONTH])


_EPS = "0.0001e0"
V.define_view("labelled", ("fx_option_trades",), f"""
  select * exclude (b, a), case when a > b and price >= a - {_EPS} then 'Buyer'
      when a > b and price <= b + {_EPS} then 'Seller' when not a > b then 'Unknown'
      when price < 0.5e0 * (a + b) or (price = 0.5e0 * (a + b) and price - b < a - price) then 'Seller'
      else 'Buyer' end as side,
    case when not a > b then 'Unknown' when price >= a - {_EPS} or price <= b + {_EPS} then 'NbboTouch'
      else 'NbboAtOrBeyond' end as method,
    case when not a > b then 0e0 when price >= a - {_EPS} or price <= b + {_EPS} then 1e0 else 0.7e0 end as conf
  from (select *, round(price - size % 3 * 0.05e0, 2) as b, round(price + size // 3 % 3 * 0.05e0, 2) as a
    from fx_option_trades)""")
V.define_view("exposed", ("labelled", "opt_priced", "overlaid"), f"""
  select *, sgn * dadvv as signed_dadvv, sgn * gadvv as signed_gadvv from (
    select l.underlying as symbol, '{MONTH}' as "window",
      l.trade_ts_ns // {MONTH_NS} * {MONTH_NS} as window_start_ns,
      l.trade_ts_ns // {MONTH_NS} * {MONTH_NS} + {MONTH_NS} as window_end_ns,
      l.seq, l.contract, l.contract_direction, l.trade_ts_ns, l.price, l.size, l.side, l.method, p.underlying_price as s,
      case when l.contract_direction = 'C' then greatest(p.underlying_price - l.strike_price, 0)
        else greatest(l.strike_price - p.underlying_price, 0) end as intrinsic,
      abs(coalesce(o.delta, 0)) * p.underlying_price * (l.size * 100e0) as dadvv,
      abs(coalesce(o.gamma, 0)) * p.underlying_price * p.underlying_price * (l.size * 100e0) as gadvv,
      l.price * (l.size * 100e0) as notional,
      2 * case l.side when 'Buyer' then l.conf when 'Seller' then 1 - l.conf else 0.5e0 end - 1 as sgn
    from labelled l join opt_priced p using (seq, trade_ts_ns, contract, size)
      join overlaid o using (seq, trade_ts_ns, contract, size)
    where p.underlying_price > 0)""")
_K = 'symbol, "window", window_start_ns, window_end_ns'
_RIGHT = "case when contract_direction = 'C' then 'calls_' else 'puts_' end"
V.define_view("long_values", ("exposed", "fx_underlying_trades"), f"""
  select {_K}, {_RIGHT} || e as series, x from exposed,
    lateral (values ('dadvv', dadvv), ('signed_dadvv', signed_dadvv), ('gadvv', gadvv),
      ('signed_gadvv', signed_gadvv)) as t(e, x)
  union all select instrument_id, '{MONTH}', trade_ts_ns // {MONTH_NS} * {MONTH_NS},
    trade_ts_ns // {MONTH_NS} * {MONTH_NS} + {MONTH_NS}, '{schemas.UNDERLYING_SERIES}', abs(price * size)
  from fx_underlying_trades""")
_SK = f"{_K}, series"


def sql_moments(values: str) -> str:
    return f"""
  select *, q3 - q1 as iqr, case when stddev > 0 then stddev / greatest(abs(mean), 1e-9) end as cv
  from (select {_SK}, count(*) as n, sum(x) as total, min(x) as minimum, max(x) as maximum, avg(x) as mean,
    stddev_samp(x) as stddev, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.5) as median,
    quantile_cont(x, 0.75) as q3
  from {values} group by {_SK})"""


V.define_view("long_moments", ("long_values",), sql_moments("long_values"))


@query("dollar_exposure", sql=V.with_views("exposed", """
  select seq, contract, trade_ts_ns, round(dadvv, 3) as dadvv, round(signed_dadvv, 3) as signed_dadvv,
    round(gadvv, 3) as gadvv, round(signed_gadvv, 3) as signed_gadvv, round(notional, 3) as notional
  from exposed"""))
def dollar_exposure(spark, d):
    e = known_vol_exposures(spark, d)
    return e.select("seq", "contract", "trade_ts_ns", *[
        F.round(c, 3).alias(c) for c in ("dadvv", "signed_dadvv", "gadvv", "signed_gadvv", "notional")])


def _sql_share(right: str, condition: str) -> str:
    hit = f"case when {condition} then 1e0 else 0e0 end"
    return f"round(avg({hit}) filter (contract_direction = '{right}'), 6)"


def _sql_mix() -> str:
    columns = []
    for right, letter in (("puts", "P"), ("calls", "C")):
        for name, method in X.METHOD_SHARES:
            columns.append(f"{_sql_share(letter, f'method = {method!r}')} as {right}_classifier_{name}_pct")
    return ", ".join(columns)


def _mixes(spark, d):
    return X.option_mixes(known_vol_exposures(spark, d), KEYS)


@query("method_mix", sql=V.with_views("exposed", f"select {_K}, {_sql_mix()} from exposed group by all"))
def method_mix(spark, d):
    names = [f"{r}_classifier_{n}_pct" for r in ("puts", "calls") for n, _ in X.METHOD_SHARES]
    return _mixes(spark, d).select(*KEYS, *[F.round(n, 6).alias(n) for n in names])


@query("intrinsic_mix", sql=V.with_views("exposed", f"""
  select {_K}, {_sql_share('P', 'price < intrinsic')} as puts_below_intrinsic_pct,
    {_sql_share('P', 'price > intrinsic')} as puts_above_intrinsic_pct,
    {_sql_share('C', 'price > intrinsic')} as calls_above_intrinsic_pct from exposed group by all"""))
def intrinsic_mix(spark, d):
    names = ["puts_below_intrinsic_pct", "puts_above_intrinsic_pct", "calls_above_intrinsic_pct"]
    return _mixes(spark, d).select(*KEYS, *[F.round(n, 6).alias(n) for n in names])


@query("unknown_share", sql=V.with_views("exposed", f"""
  select {_K}, {_sql_share('P', "side = 'Unknown'")} as puts_aggressor_unknown_pct,
    {_sql_share('C', "side = 'Unknown'")} as calls_aggressor_unknown_pct from exposed group by all"""))
def unknown_share(spark, d):
    names = ["puts_aggressor_unknown_pct", "calls_aggressor_unknown_pct"]
    return _mixes(spark, d).select(*KEYS, *[F.round(n, 6).alias(n) for n in names])


@query("calls_dollar_value", sql=V.with_views("exposed", f"""
  select {_K}, case when v > 0 then round(v, 2) end as calls_dollar_value from (
    select {_K}, sum(notional) filter (contract_direction = 'C') as v from exposed group by all)"""))
def calls_dollar_value(spark, d):
    return _mixes(spark, d).select(*KEYS, F.round("calls_dollar_value", 2).alias("calls_dollar_value"))


_DIGITS = {"total": 2, "minimum": 4, "maximum": 4, "mean": 4, "stddev": 4, "skew": 5, "kurtosis": 5, "q1": 4,
           "median": 4, "q3": 4, "iqr": 4, "mad": 4, "cv": 6, "mode": 4, "bc": 2, "kde_peaks": 0}


def _sql_summary(values: str = "long_values", base: str = "long_moments") -> str:
    moments = f"""
      select {_SK}, round(case when s2 > 0 then sqrt(n0) * s3 / pow(s2, 1.5) end, 5) as skew,
        round(case when s2 > 0 then n0 * s4 / (s2 * s2) end, 5) as kurtosis
      from (select {_SK}, count(*) as n0, sum(pow(x - mean, 2)) as s2, sum(pow(x - mean, 3)) as s3,
          sum(pow(x - mean, 4)) as s4
        from {values} join {base} using ({_SK}) group by {_SK})"""
    mad = f"""
      select {_SK}, quantile_cont(abs(x - median), 0.5) as mad
      from {values} join {base} using ({_SK}) group by {_SK}"""
    plain = ", ".join(f"round({c}, {_DIGITS[c]}) as {c}" for c in (
        "total", "minimum", "maximum", "mean", "stddev", "q1", "median", "q3", "iqr", "mad", "cv", "mode"))
    return f"""
  select {_SK}, n, {plain}, skew, kurtosis, bc, kde_peaks from {base}
    left join ({moments}) using ({_SK}) left join ({mad}) using ({_SK})
    left join ({QS.sql_mode(values, base, _SK)}) using ({_SK})
    left join ({QS.sql_box_cox(values, _SK)}) using ({_SK})
    left join ({QS.sql_kde(values, base, _SK)}) using ({_SK})"""


def _values(spark, d):
    exposed = X.write_exposures(X.exposures(enriched_options(spark, d, vol=F.lit(QO.TEST_VOL))), [MONTH])
    traded = X.write_dollar_values(stock(spark, d), [MONTH])
    return X.option_series(exposed, KEYS).unionByName(X.underlying_series(traded, KEYS))


@query("exposure_stats", sql=V.with_views("long_values long_moments", _sql_summary()))
def exposure_stats(spark, d):
    s = X.series_stats(_values(spark, d), KEYS).drop("dip_pval")
    return s.select(*KEYS, "series", "n", *[F.round(c, k).alias(c) for c, k in _DIGITS.items()])


@query("feature_row")
def feature_row(spark, d):
    """All 154 columns with solved volatilities and dip p-values."""
    return X.feature_rows(spark, enriched_options(spark, d), stock(spark, d), [MONTH], dip_draws=DRAWS)


_CORE = [c for c in schemas.feature_metric_columns() if not c.endswith("dip_pval")]


def _core_digits(column: str) -> int:
    for name, digits in (("_total", 2), ("dollar_value", 2), ("_skew", 5), ("_kurtosis", 5), ("_cv", 6),
                         ("_pct", 6), ("_bc", 2), ("kde_peaks", 0)):
        if column.endswith(name):
            return digits
    return 4


V.define_view("month_stock", ("fx_underlying_trades",), f"""
  select instrument_id as symbol, '{MONTH}' as "window", trade_ts_ns // {MONTH_NS} * {MONTH_NS} as window_start_ns,
    trade_ts_ns // {MONTH_NS} * {MONTH_NS} + {MONTH_NS} as window_end_ns, trade_ts_ns, seq, price, size
  from fx_underlying_trades""")


def _sql_feature_core(values: str = "long_values", base: str = "long_moments", stock: str = "month_stock",
                      exposed: str = "exposed") -> str:
    picks = []
    for series in schemas.SERIES:
        for column in _CORE:
            name = column[len(series) + 1:]
            if column.startswith(series + "_") and name in (*schemas.STAT_NAMES, "q1", "q2", "q3"):
                source = {"q2": "median"}.get(name, name)
                picks.append(f"max({source}) filter (series = '{series}') as {column}")
    stock_bars = f"""
      select {_K},
        min_by(price, row(trade_ts_ns, seq)) as underlying_price_open, max(price) as underlying_price_high,
        min(price) as underlying_price_low, max_by(price, row(trade_ts_ns, seq)) as underlying_price_close
      from {stock} group by all"""
    mixes = f"""
      select {_K}, {_sql_mix()}, {_sql_share('P', 'price < intrinsic')} as puts_below_intrinsic_pct,
        {_sql_share('P', 'price > intrinsic')} as puts_above_intrinsic_pct,
        {_sql_share('C', 'price > intrinsic')} as calls_above_intrinsic_pct,
        {_sql_share('P', "side = 'Unknown'")} as puts_aggressor_unknown_pct,
        {_sql_share('C', "side = 'Unknown'")} as calls_aggressor_unknown_pct,
        round(nullif(sum(notional) filter (contract_direction = 'C'), 0), 2) as calls_dollar_value
      from {exposed} group by all"""
    return f"""
  select {_K}, {', '.join(_CORE)} from (
    select {_K}, {', '.join(picks)} from ({_sql_summary(values, base)}) group by {_K}) w
  left join ({stock_bars}) using ({_K}) left join ({mixes}) using ({_K})"""


@query("feature_row_core", sql=V.with_views("long_values long_moments month_stock", _sql_feature_core()))
def feature_row_core(spark, d):
    """The feature row at a known volatility, the dip columns left out."""
    rows = X.feature_rows(spark, enriched_options(spark, d, vol=F.lit(QO.TEST_VOL)), stock(spark, d), [MONTH])
    return rows.select(*KEYS, *[F.round(c, _core_digits(c)).alias(c) for c in _CORE])


# ------------------------------------------------------------------------ dip test
@query("dip_statistic")
def dip_statistic(spark, d):
    return D.dip_statistic(QS.weekly_values(spark, d), QS.KEYS, "x")


@query("dip_pvalue_table")
def dip_pvalue_table(spark, d):
    dips = D.dip_statistic(QS.weekly_values(spark, d), QS.KEYS, "x", allow_zero=False)
    table = D.null_table(spark, dips.agg(F.max("n").alias("max_n")), DRAWS, seed=7)
    return D.table_pvalues(dips, table, QS.KEYS)


@query("dip_pvalue_bootstrap")
def dip_pvalue_bootstrap(spark, d):
    dips = D.dip_statistic(QS.weekly_values(spark, d), QS.KEYS, "x")
    return D.bootstrap_pvalues(dips, QS.KEYS, DRAWS, seed=7)


@query("implied_vol")
def implied_vol(spark, d):
    """Volatility, outcome flags and the price it gives back."""
    out = G.with_greeks(QO._inputs(spark, d), QO.DIVIDEND)
    return out.select("seq", "contract", "trade_ts_ns", "price", "iv", "delta", "greeks_flags")


@query("enrich_greeks")
def enrich_greeks(spark, d):
    e = G.enrich_greeks(V.option_trades(spark, d), QO.rough_quotes(spark, d), QO.curves(spark, d), QO.STALE_US,
                        QO.DIVIDEND)
    return e.select("seq", "contract", "trade_ts_ns", "iv", "delta", "gamma", "vega", "theta", "greeks_flags",
                    "nbbo_bid", "nbbo_ask", "curve_date")
