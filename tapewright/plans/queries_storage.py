"""Scans and sinks: data derived from the tables is landed, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions import scalars as S
from tapewright.operators import hygiene as H
from tapewright.operators import universe as U
from tapewright.operators.windows import assign_windows, price_bars
from tapewright.plans import enrich
from tapewright.plans import queries_options as QO
from tapewright.plans import queries_trades as QT
from tapewright.plans import views as V
from tapewright.plans.queries_scalars import (
    SQL_OPTION_PREFIX, sql_alnum, sql_price_text, sql_uid,
)
from tapewright.plans.registry import query
from tapewright.session import fresh_dir
from tapewright.sinks import tables as T
from tapewright.sources import calendar, flatfiles, landed, messages, stored

NOW_NS = 1_700_000_000_000_000_000  # a fixed clock keeps results repeatable


def _land_csv(spark, df, label):
    path = fresh_dir(spark, label)
    df.write.option("header", True).option("compression", "gzip").csv(path)
    return path


def _equity_csv(trades):
    e = F.col("seq")
    return trades.select(
        F.col("instrument_id").alias("ticker"),
        F.when(e % 3 == 0, F.lit("12,37")).when(e % 3 == 1, F.lit("x,12")).alias("conditions"),
        F.when(e % 5 == 0, F.lit("1")).alias("correction"), "exchange",
        F.when(e % 7 != 0, F.col("trade_id")).alias("id"),
        (F.col("trade_ts_ns") - 1000).alias("participant_timestamp"), "price",
        e.alias("sequence_number"), F.col("trade_ts_ns").alias("sip_timestamp"),
        F.when(e % 97 == 0, F.lit("n/a")).otherwise(F.col("size").cast("string")).alias("size"),
        F.lit("3").alias("tape"), F.lit(None).cast("string").alias("trf_id"),
        F.lit(0).alias("trf_timestamp"),
    )


@query("scan_equity_trades", sql=V.with_views("fx_trades", """
  select instrument_id as symbol, trade_ts_ns, price, case when seq % 97 = 0 then 0 else size end as size,
    case seq % 3 when 0 then '12,37' when 1 then '12' else '' end as conditions, exchange,
    case when seq % 7 <> 0 then trade_id end as trade_id, seq, trade_ts_ns - 1000 as participant_ts_ns,
    '3' as tape, case when seq % 5 = 0 then 1 else 0 end as correction,
    cast(0 as bigint) as trf_ts_ns, 'Flatfile' as source from fx_trades"""))
def scan_equity_trades(spark, d):
    path = _land_csv(spark, _equity_csv(V.trades(spark, d)), "equity-csv")
    t = flatfiles.equity_trades(flatfiles.read_csv(spark, path))
    return t.select("symbol", "trade_ts_ns", "price", "size",
                    S.conditions_text("conditions").alias("conditions"), "exchange", "trade_id", "seq",
                    "participant_ts_ns", "tape", "correction", "trf_ts_ns", "source")


# Stored option trades are folded onto fifteen days: all rows, but a realistic number of
# rows per date and root.
FOLD_DAY, FOLD_DAYS = 19_723, 15


def _folded_ts(ts="trade_ts_ns"):
    day = S.floor_div(ts, S.DAY_NS)
    return (F.lit(FOLD_DAY) + day % FOLD_DAYS) * F.lit(S.DAY_NS) + F.pmod(F.col(ts), F.lit(S.DAY_NS))


V.define_view("folded", ("fx_option_trades",), f"""
  select * replace (({FOLD_DAY} + trade_ts_ns // {S.DAY_NS} % {FOLD_DAYS}) * {S.DAY_NS}
    + trade_ts_ns % {S.DAY_NS} as trade_ts_ns) from fx_option_trades""")


def folded_options(spark, d):
    return V.option_trades(spark, d).withColumn("trade_ts_ns", _folded_ts())


def _option_csv(trades):
    return trades.select(
        F.col("contract").alias("ticker"), F.lit("232").alias("conditions"), F.lit("").alias("correction"),
        "exchange", F.col("trade_ts_ns").alias("participant_timestamp"), "price",
        F.col("trade_ts_ns").alias("sip_timestamp"), "size")


def _scanned(spark, trades):
    path = _land_csv(spark, _option_csv(trades), "option-csv")
    return flatfiles.option_trades(flatfiles.read_csv(spark, path))


_OPTION_UID = sql_uid(S.OPTION_UID_TAG, "contract", "trade_ts_ns", "trade_ts_ns",
                      sql_price_text("price"), "size", "exchange", "'232'")
V.define_view("scanned_options", ("fx_option_trades",), f"""
  select *, {_OPTION_UID} as trade_uid from fx_option_trades""")


@query("scan_option_trades", sql=V.with_views("scanned_options", """
  select contract, trade_uid, contract_direction, strike_price, underlying, trade_ts_ns, price, size,
    '232' as conditions, exchange, expiry_ts_ns, 'Unknown' as aggressor_side from scanned_options"""))
def scan_option_trades(spark, d):
    return _scanned(spark, V.option_trades(spark, d)).select(
        "contract", S.uid_hex("trade_uid").alias("trade_uid"), "contract_direction", "strike_price",
        "underlying", "trade_ts_ns", "price", "size", S.conditions_text("conditions").alias("conditions"),
        "exchange", "expiry_ts_ns", "aggressor_side")


@query("scan_quotes", sql=V.with_views("sq", """
  select instrument_id, quote_ts_ns, bid, ask, bid_sz, ask_sz, state,
    cast(case when seq % 2 = 0 then case when seq % 4 = 0 then 5 end end as integer) as condition,
    cast(seq % 12 as integer) as best_bid_venue, cast(seq % 11 as integer) as best_ask_venue from sq"""))
def scan_quotes(spark, d):
    # Half the rows in the nine-column layout, half with the longer one.
    q, e = V.quotes(spark, d), F.col("seq")
    base = [
        F.col("instrument_id").alias("ticker"), (e % 11).alias("ask_exchange"),
        F.col("ask").alias("ask_price"), F.col("ask_sz").alias("ask_size"),
        (e % 12).alias("bid_exchange"), F.col("bid").alias("bid_price"), F.col("bid_sz").alias("bid_size"),
        e.alias("sequence_number"), F.col("quote_ts_ns").alias("sip_timestamp"),
    ]
    extra = [
        F.when(e % 4 == 0, F.lit("5")).otherwise(F.lit("")).alias("conditions"),
        F.lit("").alias("indicators"), F.col("quote_ts_ns").alias("participant_timestamp"),
        F.lit("1").alias("tape"), F.lit(0).alias("trf_timestamp"),
    ]
    short = _land_csv(spark, q.where(e % 2 == 1).select(*base), "quotes-short")
    long = _land_csv(spark, q.where(e % 2 == 0).select(*base, *extra), "quotes-long")
    both = flatfiles.quotes(flatfiles.read_csv(spark, [short, long]))
    return both.select("instrument_id", "quote_ts_ns", "bid", "ask", "bid_sz", "ask_sz", "state",
                       "condition", "best_bid_venue", "best_ask_venue")


def _land_days(spark, d, keep):
    """Daily files in the ``yyyy/mm/yyyy-mm-dd.csv.gz`` layout."""
    staging, root = fresh_dir(spark, "staging"), fresh_dir(spark, "daily")
    trades = V.trades(spark, d).withColumn("dt", S.utc_date("trade_ts_ns")).where(keep)
    csv = _equity_csv(trades).withColumn("dt", S.utc_date("sip_timestamp"))
    csv.write.option("header", True).option("compression", "gzip").partitionBy("dt").csv(staging)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(staging).getFileSystem(conf)
    for status in fs.listStatus(path(staging)):  # one rename per day
        name = status.getPath().getName()
        if name.startswith("dt="):
            y, m, _ = name[3:].split("-")
            fs.mkdirs(path(f"{root}/{y}/{m}"))
            fs.rename(status.getPath(), path(f"{root}/{y}/{m}/{name[3:]}.csv.gz"))
    return root


_HOLIDAYS = ", ".join(f"date '{h}'" for h in calendar.all_holidays(2020, 2030))  # the years of the derived data
_SQL_OPEN = f"isodow(dt) < 6 and dt not in ({_HOLIDAYS})"


@query("scan_date_range", sql=V.with_views("fx_trades", f"""
  select strftime(dt, '%Y-%m-%d') as dt, instrument_id as symbol, trade_ts_ns, price, seq
  from (select *, cast(make_timestamp(trade_ts_ns // 1000) as date) as dt from fx_trades)
  where dt between date '2024-01-10' and date '2024-01-22' and {_SQL_OPEN}"""))
def scan_date_range(spark, d):
    root = _land_days(spark, d, F.lit(True))
    raw = flatfiles.read_days(spark, root, calendar.trading_days(spark, "2024-01-10", "2024-01-22"))
    trades = flatfiles.equity_trades(raw)
    return trades.select(S.utc_date("trade_ts_ns").cast("string").alias("dt"), "symbol", "trade_ts_ns",
                         "price", "seq")


@query("trading_days", sql=f"""
  select strftime(dt, '%Y-%m-%d') as dt from (select distinct
    date '1970-01-01' + cast({V._sql_days('o_orderdate')} as integer) as dt from orders) where {_SQL_OPEN}""")
def trading_days(spark, d):
    days = V.yields(spark, d).select(F.col("curve_date").alias("dt")).distinct()
    return calendar.only_trading_days(days).select(F.col("dt").cast("string").alias("dt"))


@query("missing_days", sql=V.with_views("fx_trades", f"""
  select strftime(dt, '%Y-%m-%d') as dt from (select cast(unnest(generate_series(timestamp '2024-01-01',
      timestamp '2024-02-10', interval 1 day)) as date) as dt)
  where {_SQL_OPEN} and dt < date '2024-02-02' and dt not in (
    select dt from (select cast(make_timestamp(trade_ts_ns // 1000) as date) as dt from fx_trades)
    where day(dt) % 9 <> 0)"""))
def missing_days(spark, d):
    root = _land_days(spark, d, F.dayofmonth("dt") % 9 != 0)
    expected = calendar.trading_days(spark, "2024-01-01", "2024-02-10")
    return H.missing_days(expected, flatfiles.observed_days(spark, root), "2024-02-02").select(
        F.col("dt").cast("string").alias("dt"))


# --------------------------------------------------------------------- messages
def _texts(df, message):
    """Message texts: arrays of two, one of them of no interest; every fifth row an object."""
    e = F.col("seq")
    other = F.struct(F.lit("status").alias("ev"), F.lit("hello").alias("message"))
    return df.select(F.when(e % 5 == 0, F.to_json(message)).otherwise(
        F.concat(F.lit("["), F.to_json(other), F.lit(","), F.to_json(message), F.lit("]"))
    ).alias("value"))


def quote_messages(spark, d, nameless=False):
    """Quote messages; nameless leaves every seventh without a symbol."""
    e = F.col("seq")
    named = (e % 7 != 0) | ~F.lit(nameless)
    message = F.struct(
        F.lit("Q").alias("ev"), F.when(named, F.col("instrument_id")).alias("sym"),
        F.col("bid").alias("bp"), F.col("ask").alias("ap"),
        F.when(e % 3 != 0, F.col("bid_sz")).alias("bs"), F.col("ask_sz").alias("as"),
        (e % 12).alias("bx"), (e % 11).alias("ax"), F.lit(1).alias("c"),
        S.floor_div("quote_ts_ns", 1_000_000).alias("t"), e.alias("q"))
    return _texts(V.quotes(spark, d), message)


@query("decode_quote_msgs", sql=V.with_views("sq", """
  select instrument_id, quote_ts_ns // 1000000 * 1000000 as quote_ts_ns, bid, ask,
    case when seq % 3 <> 0 then bid_sz else 0 end as bid_sz, ask_sz, state, 'Ws' as source,
    cast(seq % 12 as integer) as best_bid_venue from sq where seq % 7 <> 0"""))
def decode_quote_msgs(spark, d):
    return messages.decode_quotes(quote_messages(spark, d, nameless=True)).select(
        "instrument_id", "quote_ts_ns", "bid", "ask", "bid_sz", "ask_sz", "state", "source",
        "best_bid_venue")


def equity_messages(spark, d):
    e = F.col("seq")
    message = F.struct(
        F.lit("T").alias("ev"), F.col("instrument_id").alias("sym"), F.col("price").alias("p"),
        F.col("size").alias("s"), F.array((e % 40).cast("int")).alias("c"), F.col("exchange").alias("x"),
        S.floor_div("trade_ts_ns", 1_000_000).alias("t"), e.alias("q"), F.col("trade_id").alias("i"),
        F.lit(3).alias("z"))
    return _texts(V.trades(spark, d), message)


@query("decode_equity_trade_msgs", sql=V.with_views("fx_trades", """
  select instrument_id as symbol, trade_ts_ns // 1000000 * 1000000 as trade_ts_ns, price, size,
    cast(seq % 40 as varchar) as conditions, exchange, trade_id, seq, '3' as tape from fx_trades"""))
def decode_equity_trade_msgs(spark, d):
    return messages.decode_equity_trades(equity_messages(spark, d)).select(
        "symbol", "trade_ts_ns", "price", "size", S.conditions_text("conditions").alias("conditions"),
        "exchange", "trade_id", "seq", "tape")


def option_messages(spark, d):
    e = F.col("seq")
    contract = F.when(F.col("size") % 6 == 0, F.substring("contract", 3, 30)) \
        .when(F.col("size") % 6 == 1, F.lit("O:SHORT")).otherwise(F.col("contract"))
    message = F.struct(
        F.lit("T").alias("ev"), contract.alias("sym"), F.col("price").alias("p"),
        F.col("size").alias("s"), F.col("exchange").alias("x"),
        S.floor_div("trade_ts_ns", 1_000_000).alias("t"), e.alias("q"))
    return _texts(V.option_trades(spark, d), message)


@query("decode_option_trade_msgs", sql=V.with_views("fx_option_trades", """
  select case when size % 6 = 1 then 'O:SHORT' else contract end as contract, trade_ts_ns, price, size,
    case when size % 6 = 1 then 'C' else contract_direction end as contract_direction,
    case when size % 6 = 1 then 0 else strike_price end as strike_price,
    case when size % 6 = 1 then trade_ts_ns else expiry_ts_ns end as expiry_ts_ns,
    case when size % 6 = 1 then '' else underlying end as underlying, exchange
  from fx_option_trades where size % 6 <> 0"""))
def decode_option_trade_msgs(spark, d):
    return messages.decode_option_trades(option_messages(spark, d)).select(
        "contract", "trade_ts_ns", "price", "size", "contract_direction", "strike_price", "expiry_ts_ns",
        "underlying", "exchange")


# ------------------------------------------------------------------ landed pages
@query("load_yield_curves", sql=V.with_views("fx_yields", """
  select strftime(curve_date, '%Y-%m-%d') as curve_date, round(tenor_years, 9) as tenor_years,
    round(yield_pct / 100e0, 9) as rate from fx_yields
  where yield_pct is not null and date_diff('day', date '1970-01-01', curve_date) % 50 <> 0"""))
def load_yield_curves(spark, d):
    wide = V.yields(spark, d).groupBy("curve_date").agg(*[
        F.max(F.when(F.col("tenor_index") == i, F.col("yield_pct"))).alias(name)
        for i, name in enumerate(V.TENOR_FIELDS)])
    day = F.when(F.unix_date("curve_date") % 50 == 0, F.lit("soon")).otherwise(
        F.col("curve_date").cast("string"))
    record = F.struct(day.alias("date"), *V.TENOR_FIELDS)
    # A page is a calendar month of records.
    pages = wide.groupBy(F.trunc("curve_date", "month").alias("m")).agg(
        F.collect_list(record).alias("results")).select("results")
    path = fresh_dir(spark, "yields")
    pages.write.json(path)
    return landed.read_yield_pages(spark, path, multi_line=False).select(
        F.col("curve_date").cast("string").alias("curve_date"),
        F.round("tenor_years", 9).alias("tenor_years"), F.round("rate", 9).alias("rate"))


def _chain(spark, d, nameless=False):
    """Chain pages; nameless leaves every tenth contract without a ticker."""
    k, q = F.col("l_orderkey"), F.col("l_quantity")
    lines = V.table(spark, d, "lineitem")
    contract = F.concat(F.lit("O:"), k.cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"),
                        F.lit("-"), F.col("l_partkey").cast("string"))
    item = F.struct(
        F.when(k % 4 != 0, F.round(q * 3, 2)).alias("open_interest"),
        F.struct(F.when(k % 3 != 0, q).alias("volume")).alias("day"),
        F.struct(F.when((k % 10 != 0) | ~F.lit(nameless), contract).alias("ticker")).alias("details"))
    return lines.select(F.array(item).alias("results"))


V.define_view("chain", (), """
  select 'O:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey as contract,
    case when l_orderkey % 4 <> 0 then round(l_quantity * 3, 2) end as open_interest,
    case when l_orderkey % 3 <> 0 then l_quantity end as volume
  from lineitem""")


@query("load_option_chain", sql=V.with_views("chain", """
  select * from chain where cast(split_part(substr(contract, 3), '-', 1) as bigint) % 10 <> 0"""))
def load_option_chain(spark, d):
    path = fresh_dir(spark, "chain")
    _chain(spark, d, nameless=True).write.json(path)
    return landed.read_option_chain(spark, path, multi_line=False)


@query("top_contracts", sql=V.with_views("chain", """
  select contract, greatest(coalesce(open_interest, 0), coalesce(volume, 0)) as score from chain
  order by score desc, contract limit 2000"""))
def top_contracts(spark, d):
    path = fresh_dir(spark, "chain")
    _chain(spark, d).write.json(path)
    return U.top_contracts(landed.read_option_chain(spark, path, multi_line=False), 2000)


@query("universe_delta", sql=V.with_views("fx_option_trades", """
  select contract, case when n then 'add' else 'remove' end as change from (
    select contract, bool_or(contract_direction = 'C' or size % 2 = 0) as o,
      bool_or(contract_direction = 'P' or size % 3 = 0) as n from fx_option_trades group by 1)
  where o <> n"""))
def universe_delta(spark, d):
    t = V.option_trades(spark, d)
    old = t.where((F.col("contract_direction") == "C") | (F.col("size") % 2 == 0))
    new = t.where((F.col("contract_direction") == "P") | (F.col("size") % 3 == 0))
    return U.universe_delta(old, new)


@query("event_union", sql=V.with_views("fx_underlying_trades fx_option_trades", """
  select 'underlying' as kind, instrument_id as symbol, trade_ts_ns, price, size, seq,
    cast(null as varchar) as contract from fx_underlying_trades
  union all select 'option', underlying, trade_ts_ns, price, size, seq, contract from fx_option_trades"""))
def event_union(spark, d):
    return U.event_union(V.underlying_trades(spark, d), V.option_trades(spark, d)).select(
        "kind", "symbol", "trade_ts_ns", "price", "size", "seq", "contract")


@query("range_envelope", sql=V.with_views("fx_underlying_quotes", f"""
  select min(quote_ts_ns) as start_ns, max(coalesce(case when seq % 3 <> 0 then quote_ts_ns + 1 end,
    {NOW_NS})) as end_ns from fx_underlying_quotes"""))
def range_envelope(spark, d):
    q = V.underlying_quotes(spark, d)
    ranges = q.select(F.col("quote_ts_ns").alias("start_ns"),
                      F.when(F.col("seq") % 3 != 0, F.col("quote_ts_ns") + 1).alias("end_ns"))
    return H.range_envelope(ranges, NOW_NS)


@query("dependency_lag", sql=V.with_views("gapped_days", """
  select dataset, strftime(dt, '%Y-%m-%d') as dt, strftime(curve_date, '%Y-%m-%d') as dependency_dt,
    curve_date is null as missing, cast(date_diff('day', curve_date, dt) as integer) as lag_days
  from gapped_days, (values ('equities'), ('options')) as t(dataset)
  where curve_date is null or curve_date < dt"""))
def dependency_lag(spark, d):
    days = QO._day_curves(spark, d).select(
        F.explode(F.array(F.lit("equities"), F.lit("options"))).alias("dataset"), "dt",
        F.col("curve_date").alias("dependency_dt"))
    lag = H.dependency_lag(days)
    return lag.withColumns({
        "dt": F.col("dt").cast("string"), "dependency_dt": F.col("dependency_dt").cast("string"),
        "lag_days": F.when(~F.col("missing"), F.col("lag_days"))})


# ------------------------------------------------------------------------- sinks
@query("write_option_trades", sql=V.with_views("folded", f"""
  select contract, trade_ts_ns, price, size,
    strftime(make_timestamp(trade_ts_ns // 1000), '%Y-%m-%d') as dt,
    {SQL_OPTION_PREFIX.replace('name', 'contract')} as root
  from (select distinct contract, trade_ts_ns, price, size from folded)"""))
def write_option_trades(spark, d):
    path = T.write_option_trades(_scanned(spark, folded_options(spark, d)), fresh_dir(spark, "store"))
    return spark.read.parquet(path).select("contract", "trade_ts_ns", "price", "size",
                                           F.col("dt").cast("string").alias("dt"), "root")


@query("write_equity_trades", sql=V.with_views("fx_trades", f"""
  select instrument_id as symbol, trade_ts_ns, price, seq, strftime(make_timestamp(trade_ts_ns // 1000),
    '%Y-%m-%d') as dt, {sql_alnum('instrument_id', 2)} as symbol_prefix from fx_trades
  qualify row_number() over (partition by instrument_id, exchange,
    case when seq % 7 <> 0 then trade_id else 'x' || trade_ts_ns || '/' || price || '/'
      || case when seq % 97 = 0 then 0 else size end end order by trade_ts_ns, seq) = 1"""))
def write_equity_trades(spark, d):
    csv = _land_csv(spark, _equity_csv(V.trades(spark, d)), "equity-csv")
    trades = flatfiles.equity_trades(flatfiles.read_csv(spark, csv))
    path = T.write_equity_trades(trades, fresh_dir(spark, "store"))
    return spark.read.parquet(path).select("symbol", "trade_ts_ns", "price", "seq",
                                           F.col("dt").cast("string").alias("dt"), "symbol_prefix")


@query("write_quotes", sql=V.with_views("sq", f"""
  select instrument_id, quote_ts_ns // 1000000 * 1000000 as quote_ts_ns, bid, ask, state,
    strftime(make_timestamp(quote_ts_ns // 1000), '%Y-%m-%d') as dt, {sql_alnum('instrument_id', 2)} as prefix
  from sq"""))
def write_quotes(spark, d):
    path = T.write_quotes(messages.decode_quotes(quote_messages(spark, d)), fresh_dir(spark, "store"))
    return spark.read.parquet(path).select("instrument_id", "quote_ts_ns", "bid", "ask", "state",
                                           F.col("dt").cast("string").alias("dt"), "prefix")


@query("write_aggregations", sql=V.with_views("fx_trades", """
  select instrument_id as symbol, '168h' as "window", (trade_ts_ns // 604800000000000) * 604800000000000
      as window_start_ns,
    strftime(make_timestamp((trade_ts_ns // 604800000000000) * 604800000000), '%Y-%m-%d') as dt,
    min_by(price, row(trade_ts_ns, seq)) as open, max_by(price, row(trade_ts_ns, seq)) as close
  from fx_trades group by all"""))
def write_aggregations(spark, d):
    t = assign_windows(V.trades(spark, d).withColumnRenamed("instrument_id", "symbol"), "trade_ts_ns", ["168h"])
    bars = price_bars(t, ["symbol", "window", "window_start_ns", "window_end_ns"])
    path = T.write_aggregations(bars, fresh_dir(spark, "store"))
    return spark.read.parquet(path).select("symbol", "window", "window_start_ns",
                                           F.col("dt").cast("string").alias("dt"), "open", "close")


@query("write_greeks_overlay", sql=V.with_views("overlaid", """
  select strftime(make_timestamp(trade_ts_ns // 1000), '%Y-%m-%d') as dt, 'run-1' as run_id, seq as trade_uid,
    contract, round(delta, 7) as delta, flags as greeks_flags from overlaid"""))
def write_greeks_overlay(spark, d):
    overlay = QO.G.overlay(QO.known_vol_greeks(spark, d), "v1", "run-1", F.lit(NOW_NS), uid="seq")
    path = T.write_greeks_overlay(overlay, fresh_dir(spark, "store"))
    return spark.read.parquet(path).select(
        F.col("dt").cast("string").alias("dt"), "run_id", "trade_uid", "contract",
        F.round("delta", 7).alias("delta"), "greeks_flags")


def _stored_run(spark, d):
    root = fresh_dir(spark, "store")
    table = T.write_option_trades(_scanned(spark, folded_options(spark, d)), root)
    return root, T.write_manifest(spark, table, root, "options", "run-1", 2, NOW_NS)


V.define_view("stored_options", ("folded",), f"""
  select *, strftime(make_timestamp(trade_ts_ns // 1000), '%Y-%m-%d') as date
  from (select *, {_OPTION_UID} as trade_uid from folded)
  qualify row_number() over (partition by contract, trade_ts_ns, price, size order by trade_uid) = 1""")


_PLANNED = [f"2024-01-{day:02d}" for day in range(1, 31)]


@query("observed_ingest", sql=V.with_views("fx_trades", """
  select strftime(p.dt, '%Y-%m-%d') as dt, coalesce(r.n, 0)::bigint as rows, w.all_rows as run_rows,
    w.lo as min_ts_ns, w.hi as max_ts_ns
  from (select cast(unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-30', interval 1 day)) as date) as dt) p
  left join (select cast(make_timestamp(trade_ts_ns // 1000) as date) as dt, count(*) as n from fx_trades group by 1) r
    on p.dt = r.dt
  cross join (select count(*) as all_rows, min(trade_ts_ns) as lo, max(trade_ts_ns) as hi from fx_trades) w"""))
def observed_ingest(spark, d):
    """Counters of a run per planned day, taken while it is written: no second pass over the table."""
    trades = V.trades(spark, d).withColumn("dt", S.utc_date("trade_ts_ns"))
    seen = T.write_partitioned(trades, f"{fresh_dir(spark, 'store')}/trades", ["dt"], observed="trade_ts_ns", days=_PLANNED)
    rows = [(day, seen[f"day_{day}"], seen["rows"], seen["min_ts_ns"], seen["max_ts_ns"]) for day in _PLANNED]
    return spark.createDataFrame(rows, "dt string, rows long, run_rows long, min_ts_ns long, max_ts_ns long")


@query("run_manifest", sql=V.with_views("stored_options", """
  select 'options' as dataset, date, 'run-1' as run_id, sum(1)::bigint as rows,
    min(trade_ts_ns) as min_ts_ns, max(trade_ts_ns) as max_ts_ns, min(trade_uid) as min_trade_uid,
    max(trade_uid) as max_trade_uid from stored_options group by date"""))
def run_manifest(spark, d):
    _, path = _stored_run(spark, d)
    # Grouped by date, because file names differ between runs.
    return stored.read_manifest(spark, path).groupBy("dataset", "date", "run_id").agg(
        F.sum("rows").alias("rows"), F.min("min_ts_ns").alias("min_ts_ns"),
        F.max("max_ts_ns").alias("max_ts_ns"), F.min("min_trade_uid").alias("min_trade_uid"),
        F.max("max_trade_uid").alias("max_trade_uid"))


@query("scan_manifest", sql=V.with_views("stored_options", """
  select trade_uid, contract, trade_ts_ns, price, size, 'Unknown' as aggressor_side,
    cast(null as varchar) as nbbo_state, cast(null as double) as delta, cast(0 as bigint) as greeks_flags
  from stored_options"""))
def scan_manifest(spark, d):
    root, path = _stored_run(spark, d)
    return stored.scan_run(spark, root, path).select(
        S.uid_hex("trade_uid").alias("trade_uid"), "contract", "trade_ts_ns", "price", "size",
        "aggressor_side", "nbbo_state", "delta", "greeks_flags")


# A day from 18:00 on, in the middle of the fifteen dates that the folded trades lie on.
_LATE_NS = 7 * S.DAY_NS + 18 * 3_600 * 10**9
_SINCE_SQL = f"((select min(trade_ts_ns) from stored_options) // {S.DAY_NS} * {S.DAY_NS} + {_LATE_NS})"


@query("scan_manifest_range", sql=V.with_views("stored_options", f"""
  select trade_uid, contract, trade_ts_ns, price, size, 'Unknown' as aggressor_side
  from stored_options where trade_ts_ns >= {_SINCE_SQL} and trade_ts_ns < {_SINCE_SQL} + {S.DAY_NS}"""))
def scan_manifest_range(spark, d):
    """Part of a run: partitions by the manifest's dates, files by its time bounds."""
    root, path = _stored_run(spark, d)
    first = stored.read_manifest(spark, path).agg(F.min("min_ts_ns")).first()[0] or 0
    since = first // S.DAY_NS * S.DAY_NS + _LATE_NS
    return stored.scan_run(spark, root, path, since_ns=since, until_ns=since + S.DAY_NS).select(
        S.uid_hex("trade_uid").alias("trade_uid"), "contract", "trade_ts_ns", "price", "size", "aggressor_side")


_NEW_PROGRESS = V.with_views("fx_trades", f"""
  select instrument_id as symbol, cast(max(hour(make_timestamp(trade_ts_ns // 1000))) as smallint) as max_hour,
    {NOW_NS} as updated_ns from fx_trades group by 1""")


def _saved_progress(spark, d):
    root = fresh_dir(spark, "store")
    empty = stored.load_progress(spark, root, "equities", "2024-01-05")
    progress = H.advance_progress(V.trades(spark, d), empty, "instrument_id")
    T.save_progress(progress, root, "equities", "2024-01-05", NOW_NS)
    return root


@query("save_progress", sql=_NEW_PROGRESS)
def save_progress(spark, d):
    return spark.read.parquet(f"{_saved_progress(spark, d)}/progress/equities/2024-01-05")


@query("load_progress", sql=_NEW_PROGRESS)
def load_progress(spark, d):
    return stored.load_progress(spark, _saved_progress(spark, d), "equities", "2024-01-05")


@query("run_log", sql="""
  select dataset, run_date, run_id, state, reason, updated_ns from (
    select case when o_custkey % 2 = 0 then 'options' else 'equities' end as dataset,
      strftime(o_orderdate, '%Y-%m-%d') as run_date, 'run-' || (o_orderkey % 3) as run_id,
      case o_orderkey % 4 when 0 then 'Pending' when 1 then 'InFlight' when 2 then 'Blocked'
        else 'Published' end as state,
      case when o_orderkey % 4 = 2 then repeat('r', 256) || '…' end as reason,
      o_orderkey as updated_ns from orders)
  qualify row_number() over (partition by dataset, run_date order by updated_ns desc) = 1""")
def run_log(spark, d):
    k = F.col("o_orderkey")
    states = V.table(spark, d, "orders").select(
        F.when(F.col("o_custkey") % 2 == 0, F.lit("options")).otherwise(F.lit("equities")).alias("dataset"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("run_date"),
        F.concat(F.lit("run-"), (k % 3).cast("string")).alias("run_id"),
        F.when(k % 4 == 0, F.lit("Pending")).when(k % 4 == 1, F.lit("InFlight"))
        .when(k % 4 == 2, F.lit("Blocked")).otherwise(F.lit("Published")).alias("state"),
        F.when(k % 4 == 2, F.repeat(F.lit("r"), F.lit(300))).alias("reason"), k.alias("updated_ns"))
    root = fresh_dir(spark, "store")
    T.log_run_states(states, root)
    return H.latest_run_state(stored.load_run_log(spark, root))


@query("finalize_trades", sql=V.with_views("classified", """
  select seq as trade_uid, case when size % 2 = 0 then aggressor_side else 'Unknown' end as aggressor_side,
    case when size % 2 = 0 then class_method else 'Unknown' end as class_method,
    case when size % 2 = 0 then aggressor_confidence end as aggressor_confidence,
    case when size % 2 = 0 then 'Final' else 'Prelim' end as quality from classified"""))
def finalize_trades(spark, d):
    """Stored trades, finalised in place; the second, equal update changes nothing."""
    base = V.trades(spark, d).withColumn("trade_uid", F.col("seq")).withColumns(
        {**flatfiles.unclassified(), "quality": F.lit("Prelim"), "dt": S.utc_date("trade_ts_ns")})
    delta = QT._classified(spark, d).where(F.col("size") % 2 == 0).withColumn("trade_uid", F.col("seq"))
    path = f"{fresh_dir(spark, 'store')}/equity_trades"
    T.write_partitioned(base, path, ["dt"])
    for _ in range(2):
        T.finalize_table(spark, path, ["dt"], delta)
    return spark.read.parquet(path).select("trade_uid", "aggressor_side", "class_method",
                                           "aggressor_confidence", "quality")


@query("trades_with_greeks", sql=V.with_views("overlaid", """
  select seq, contract, trade_ts_ns, price, size, round(delta, 7) as delta, round(gamma, 7) as gamma,
    flags as greeks_flags from overlaid"""))
def trades_with_greeks(spark, d):
    uid = S.option_trade_uid("contract", "trade_ts_ns", F.col("seq"), "price", "size", "exchange",
                             F.array().cast("array<int>"))
    trades = V.option_trades(spark, d).withColumn("trade_uid", uid)
    overlay = QO.G.overlay(QO.known_vol_greeks(spark, d).withColumn("trade_uid", uid), "v1", "run-1",
                           F.lit(NOW_NS))
    joined = enrich.trades_with_greeks(trades, overlay, "run-1")
    return joined.select("seq", "contract", "trade_ts_ns", "price", "size", F.round("delta", 7).alias("delta"),
                         F.round("gamma", 7).alias("gamma"), "greeks_flags")


@query("enrich_run")
def enrich_run(spark, d):
    root, manifest = _stored_run(spark, d)
    path = enrich.enrich_run(spark, root, manifest, "run-1", QO.rough_quotes(spark, d), QO.curves(spark, d),
                             QO.STALE_US, "v1", NOW_NS)
    return spark.read.parquet(path)
