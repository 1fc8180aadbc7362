"""Scalar functions, predicates and projections over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright import schemas
from tapewright.functions import normal
from tapewright.functions import scalars as S
from tapewright.operators import hygiene as H
from tapewright.plans import queries_trades as QT
from tapewright.plans import views as V
from tapewright.plans.registry import query

# Contract texts, some of them malformed: every eleventh loses its prefix, every
# thirteenth is cut short, every seventeenth has an impossible date.
V.define_view("texts", ("fx_option_trades",), """
  select seq, trade_ts_ns, contract as original, case
      when seq // 1000000 % 11 = 0 then substr(contract, 3)
      when seq // 1000000 % 13 = 0 then substr(contract, 1, 12)
      when seq // 1000000 % 17 = 0 then substr(contract, 1, 6) || '99' || substr(contract, 9)
      else contract end as contract
  from fx_option_trades""")


def _texts(spark, d):
    t = V.option_trades(spark, d).withColumnRenamed("contract", "original")
    k, c = S.floor_div("seq", 1_000_000), F.col("original")
    return t.select(
        "seq", "trade_ts_ns", "original",
        F.when(k % 11 == 0, F.substring(c, F.lit(3), F.length(c)))
        .when(k % 13 == 0, F.substring(c, 1, 12))
        .when(k % 17 == 0, F.concat(F.substring(c, 1, 6), F.lit("99"),
                                    F.substring(c, F.lit(9), F.length(c))))
        .otherwise(c).alias("contract"),
    )


@query("parse_contract", sql=V.with_views("texts", """
  select seq, contract,
    case when ok then substr(contract, length(contract) - 8, 1) else 'C' end as contract_direction,
    case when ok then coalesce(try_cast(substr(contract, length(contract) - 7) as double) / 1000, 0)
      else 0e0 end as strike_price,
    case when ok then coalesce(date_diff('day', date '1970-01-01', try_cast('20'
        || substr(contract, length(contract) - 14, 2) || '-'
        || substr(contract, length(contract) - 12, 2) || '-'
        || substr(contract, length(contract) - 10, 2) as date)) * 86400000000000, trade_ts_ns)
      else trade_ts_ns end as expiry_ts_ns,
    case when ok then substr(contract, 3, length(contract) - 17) else '' end as underlying
  from (select *, contract like 'O:%' and length(contract) >= 17 as ok from texts)"""))
def parse_contract(spark, d):
    return S.parse_contract(_texts(spark, d), "contract", "trade_ts_ns").select(
        "seq", "contract", "contract_direction", "strike_price", "expiry_ts_ns", "underlying")


def sql_uid(tag: str, *parts: str) -> str:
    texts = [f"'{len(tag)}:{tag}'"] + [
        f"coalesce(cast(length(cast({p} as varchar)) as varchar) || ':' || cast({p} as varchar), '~')"
        for p in parts
    ]
    return f"substr(sha256({' || '.join(texts)}), 1, 32)"


def sql_price_text(price: str) -> str:
    return f"cast(cast(round({price} * 1e9) as bigint) as varchar)"


@query("trade_uid", sql=V.with_views("fx_trades fx_option_trades fx_quotes", f"""
  select 'equity' as kind, seq, {sql_uid(S.EQUITY_UID_TAG, 'instrument_id', 'trade_ts_ns',
      'cast(null as bigint)', 'seq', sql_price_text('price'), 'size', 'exchange', 'trade_id',
      'cast(null as integer)', "'1,2'")} as uid from fx_trades
  union all
  select 'option', seq, {sql_uid(S.OPTION_UID_TAG, 'contract', 'trade_ts_ns',
      'cast(null as bigint)', sql_price_text('price'), 'size', 'exchange', "''")}
    from fx_option_trades
  union all
  select 'quote', seq, {sql_uid(S.QUOTE_UID_TAG, 'instrument_id', 'quote_ts_ns', 'seq',
      sql_price_text('bid'), sql_price_text('ask'), 'bid_sz', 'ask_sz', 'cast(null as integer)',
      'cast(null as integer)', 'cast(null as integer)')} from fx_quotes"""))
def trade_uid(spark, d):
    no_long, no_int = F.lit(None).cast("bigint"), F.lit(None).cast("int")
    none, some = F.array().cast("array<int>"), F.array(F.lit(1), F.lit(2))
    equity = V.trades(spark, d).select(F.lit("equity").alias("kind"), "seq", S.uid_hex(
        S.equity_trade_uid("instrument_id", "trade_ts_ns", no_long, "seq", "price", "size",
                           "exchange", "trade_id", no_int, some)).alias("uid"))
    option = V.option_trades(spark, d).select(F.lit("option").alias("kind"), "seq", S.uid_hex(
        S.option_trade_uid("contract", "trade_ts_ns", no_long, "price", "size", "exchange",
                           none)).alias("uid"))
    quote = V.quotes(spark, d).select(F.lit("quote").alias("kind"), "seq", S.uid_hex(
        S.quote_uid("instrument_id", "quote_ts_ns", "seq", "bid", "ask", "bid_sz", "ask_sz",
                    no_int, no_int, no_int)).alias("uid"))
    return equity.unionByName(option).unionByName(quote)


@query("uid_hex", sql=V.with_views("fx_quotes", """
  select seq, substr(sha256(cast(seq as varchar)), 1, 32) as hex from fx_quotes"""))
def uid_hex(spark, d):
    return V.quotes(spark, d).select(
        "seq", S.uid_hex(F.unhex(F.substring(F.sha2(F.col("seq").cast("string"), 256), 1, 32)))
        .alias("hex"))


@query("quote_state", sql=V.with_views("fx_quotes", f"""
  select seq, {QT.STATE_SQL} as state, case when ask - 21 > 0 then
      case when bid - 21 > ask - 21 then 'Crossed'
        when abs((bid - 21) - (ask - 21)) < 2.220446049250313e-16 then 'Locked'
        else 'Normal' end else 'Normal' end as file_state
  from fx_quotes"""))
def quote_state(spark, d):
    return V.quotes(spark, d).select(
        "seq", S.quote_state("bid", "ask").alias("state"),
        S.file_quote_state(F.col("bid") - 21, F.col("ask") - 21).alias("file_state"))


@query("parse_conditions", sql="""
  select event_id, array_to_string(list_filter(list_transform(string_split(text, ','),
      lambda x: try_cast(trim(x) as integer)), lambda x: x is not null), ',') as conditions
  from (select event_id, (event_id % 40) || case when event_id % 3 = 0 then ', 37,x,'
      when event_id % 3 = 1 then '' else ',bad' end as text from events)""")
def parse_conditions(spark, d):
    k = F.col("event_id") % 3
    text = F.concat((F.col("event_id") % 40).cast("string"), F.when(k == 0, F.lit(", 37,x,"))
                    .when(k == 1, F.lit("")).otherwise(F.lit(",bad")))
    return V.table(spark, d, "events").select(
        "event_id", S.conditions_text(S.parse_conditions(text)).alias("conditions"))


@query("lenient_cast", sql="""
  select event_id, coalesce(try_cast(case when event_id % 4 = 0 then 'n/a'
      when event_id % 4 = 1 then '' else cast(event_id as varchar) end as bigint), 0) as parsed
  from events""")
def lenient_cast(spark, d):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.lit("n/a")).when(k == 1, F.lit("")) \
        .otherwise(F.col("event_id").cast("string"))
    return V.table(spark, d, "events").select(
        "event_id", S.lenient(text, "bigint").alias("parsed"))


@query("ms_to_ns", sql="""
  select event_id, cast(greatest(least(cast(ms as hugeint) * 1000000, 9223372036854775807),
      -9223372036854775808) as bigint) as ns
  from (select event_id, case event_id % 5 when 0 then 9000000000000000000
      when 1 then -9000000000000000000 else epoch_us(ts) // 1000 end as ms from events)""")
def ms_to_ns(spark, d):
    k = F.col("event_id") % 5
    ms = F.when(k == 0, F.lit(9_000_000_000_000_000_000)) \
        .when(k == 1, F.lit(-9_000_000_000_000_000_000)) \
        .otherwise(S.floor_div(F.unix_micros(F.col("ts").cast("timestamp")), 1_000))
    return V.table(spark, d, "events").select("event_id", S.ms_to_ns(ms).alias("ns"))


@query("utc_date_hour", sql=V.with_views("fx_trades", """
  select seq, strftime(make_timestamp(trade_ts_ns // 1000), '%Y-%m-%d') as trade_date,
    cast(hour(make_timestamp(trade_ts_ns // 1000)) as integer) as trade_hour from fx_trades"""))
def utc_date_hour(spark, d):
    return V.trades(spark, d).select(
        "seq", S.utc_date("trade_ts_ns").cast("string").alias("trade_date"),
        S.utc_hour("trade_ts_ns").alias("trade_hour"))


def sql_alnum(text: str, length: int) -> str:
    return (f"upper(coalesce(nullif(substr(regexp_replace({text}, '[^A-Za-z0-9]', '', 'g'), 1, "
            f"{length}), ''), 'X'))")


SQL_OPTION_PREFIX = f"""case when regexp_extract(name, '^O:([A-Za-z]+)', 1) <> ''
  then {sql_alnum("regexp_extract(name, '^O:([A-Za-z]+)', 1)", 3)} else {sql_alnum('name', 3)} end"""
_NAMES = """(select p_partkey, case p_partkey % 5 when 0 then 'O:' || p_name when 1 then '--'
  when 2 then 'O:7' || p_name when 3 then lower(p_brand) else p_name end as name from part)"""


@query("partition_prefix", sql=f"""
  select p_partkey, {SQL_OPTION_PREFIX} as option_prefix, {sql_alnum('name', 2)} as equity_prefix,
    case when name like 'O:%' then {SQL_OPTION_PREFIX} else {sql_alnum('name', 2)} end
      as instrument_prefix
  from {_NAMES}""")
def partition_prefix(spark, d):
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, F.concat(F.lit("O:"), "p_name")).when(k == 1, F.lit("--")) \
        .when(k == 2, F.concat(F.lit("O:7"), "p_name")).when(k == 3, F.lower("p_brand")) \
        .otherwise(F.col("p_name"))
    return V.table(spark, d, "part").select("p_partkey", name.alias("name")).select(
        "p_partkey", S.option_prefix("name").alias("option_prefix"),
        S.equity_prefix("name").alias("equity_prefix"),
        S.instrument_prefix("name").alias("instrument_prefix"))


@query("mid_price", sql=V.with_views("fx_quotes", """
  select seq, case when ask - 21 > 0 then 0.5e0 * ((bid - 21) + (ask - 21))
      when bid - 21 > 0 then bid - 21 end as classifier_mid,
    case when ask - 21 > 0 then 0.5e0 * ((bid - 21) + (ask - 21)) else bid - 21 end as live_mid
  from fx_quotes"""))
def mid_price(spark, d):
    b, a = F.col("bid") - 21, F.col("ask") - 21
    return V.quotes(spark, d).select(
        "seq", S.classifier_mid(b, a).alias("classifier_mid"), S.live_mid(b, a).alias("live_mid"))


@query("intrinsic", sql=V.with_views("fx_option_trades", """
  select seq, contract, trade_ts_ns, case when contract_direction = 'C'
      then greatest(100e0 - strike_price, 0) else greatest(strike_price - 100e0, 0) end as intrinsic
  from fx_option_trades"""))
def intrinsic(spark, d):
    return V.option_trades(spark, d).select(
        "seq", "contract", "trade_ts_ns",
        S.intrinsic("contract_direction", F.lit(100.0), "strike_price").alias("intrinsic"))


@query("buy_probability", sql=V.with_views("classified", """
  select seq, case aggressor_side when 'Buyer' then c when 'Seller' then 1 - c else 0.5e0 end as p_buy,
    2 * case aggressor_side when 'Buyer' then c when 'Seller' then 1 - c else 0.5e0 end - 1
      as signed_factor
  from (select *, least(greatest(aggressor_confidence, 0), 1) as c from classified)"""))
def buy_probability(spark, d):
    p = S.buy_probability("aggressor_side", "aggressor_confidence")
    return QT._classified(spark, d).select("seq", p.alias("p_buy"),
                                           (p * 2.0 - 1.0).alias("signed_factor"))


# Hart's formula once more, as SQL text over the name of a column that is not negative.
def sql_tail(z: str) -> str:
    def horner(cs):
        acc = f"({cs[0]!r} * {z} + {cs[1]!r})"
        for c in cs[2:]:
            acc = f"({acc} * {z} + {c!r})"
        return acc

    def dbl(text):
        import re
        return re.sub(r"(?<![\w.])(\d+\.\d+)(?!\d|e)", r"\1e0", text)

    e = f"exp({z} * {z} * -0.5)"
    tail = f"({z} + 0.65)"
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = f"({z} + {k} / {tail})"
    near = f"{e} * {horner(normal.NUMERATOR)} / {horner(normal.DENOMINATOR)}"
    far = f"{e} / {tail} / {normal.SQRT_2PI!r}"
    return dbl(f"(case when {z} > 37.0 then 0.0 when {z} < {normal.SPLIT!r} then {near} else {far} end)")


@query("norm_pdf_cdf", sql=f"""
  select event_id, round(0.3989422804014327e0 * exp(-0.5e0 * x * x), 10) as pdf,
    round(case when x > 0 then 1e0 - t else t end, 10) as cdf
  from (select *, {sql_tail('z')} as t
    from (select event_id, (value - 100e0) / 25e0 as x, abs((value - 100e0) / 25e0) as z from events))""")
def norm_pdf_cdf(spark, d):
    x = (F.col("value") - 100.0) / 25.0
    return V.table(spark, d, "events").select(
        "event_id", F.round(normal.pdf(x), 10).alias("pdf"), F.round(normal.cdf(x), 10).alias("cdf"))


# ------------------------------------------------------------ filters, projections
@query("filter_scope", sql=V.with_views("fx_trades", """
  select instrument_id, trade_ts_ns, price, size from fx_trades
  where instrument_id in ('U03', 'U07', 'U11')
    and make_timestamp(trade_ts_ns // 1000) >= timestamp '2024-01-05'
    and make_timestamp(trade_ts_ns // 1000) < timestamp '2024-01-20'"""))
def filter_scope(spark, d):
    return H.filter_scope(V.trades(spark, d), ["U03", "U07", "U11"], "2024-01-05", "2024-01-19",
                          "instrument_id", "trade_ts_ns").select(
        "instrument_id", "trade_ts_ns", "price", "size")


@query("filter_underlying", sql=V.with_views("fx_option_trades", """
  select contract, trade_ts_ns, price, size, seq from fx_option_trades where underlying = 'SC'"""))
def filter_underlying(spark, d):
    return H.filter_symbol(V.option_trades(spark, d), "SC", "underlying").select(
        "contract", "trade_ts_ns", "price", "size", "seq")


@query("filter_actionable", sql=V.with_views("sq", """
  select seq, instrument_id, bid, ask from sq where state = 'Normal' and ask > bid
    and isfinite(ask) and isfinite(bid)"""))
def filter_actionable(spark, d):
    return QT.state_quotes(spark, d).where(S.is_actionable("bid", "ask", "state")).select(
        "seq", "instrument_id", "bid", "ask")


# Progress so far: instruments ending in an odd digit are done up to some hour.
_PROGRESS_SQL = """(select distinct instrument_id as symbol,
  cast(cast(substr(instrument_id, 2) as integer) % 20 as smallint) as max_hour from fx_trades
  where cast(substr(instrument_id, 2) as integer) % 2 = 1)"""


def _progress(spark, d):
    number = F.substring("instrument_id", 2, 2).cast("int")
    return V.trades(spark, d).where(number % 2 == 1).select(
        F.col("instrument_id").alias("symbol"), (number % 20).cast("smallint").alias("max_hour"),
    ).distinct()


@query("incremental_filter", sql=V.with_views("fx_trades", f"""
  select seq, instrument_id, trade_ts_ns from fx_trades left join {_PROGRESS_SQL} p
    on instrument_id = symbol
  where hour(make_timestamp(trade_ts_ns // 1000)) > coalesce(max_hour, -1)"""))
def incremental_filter(spark, d):
    return H.incremental_filter(V.trades(spark, d), _progress(spark, d), "instrument_id").select(
        "seq", "instrument_id", "trade_ts_ns")


@query("advance_progress", sql=V.with_views("fx_trades", f"""
  select coalesce(instrument_id, symbol) as symbol,
    cast(greatest(coalesce(h, -1), coalesce(max_hour, -1)) as smallint) as max_hour
  from (select instrument_id, max(hour(make_timestamp(trade_ts_ns // 1000))) as h from fx_trades
    group by 1) full join {_PROGRESS_SQL} p on instrument_id = symbol"""))
def advance_progress(spark, d):
    return H.advance_progress(V.trades(spark, d), _progress(spark, d), "instrument_id")


@query("metadata_columns", sql=V.with_views("fx_trades", """
  select seq, 'Flatfile' as source, 'Prelim' as quality, m as watermark_ts_ns,
    cast(2 as integer) as schema_version, 'run-1' as run_id
  from fx_trades, (select max(trade_ts_ns) as m from fx_trades)"""))
def metadata_columns(spark, d):
    return H.with_metadata(V.trades(spark, d), "Flatfile", "Prelim", 2, "run-1", "trade_ts_ns") \
        .select("seq", "source", "quality", "watermark_ts_ns", "schema_version", "run_id")


_ENUM_TEXT = """(select event_id, case event_id % 7 when 0 then 'Buyer' when 1 then 'Seller'
  when 2 then 'NbboTouch' when 3 then 'Locked' when 4 then 'Rest' when 5 then 'Final'
  else 'Some(Normal)' end as text from events)"""


@query("enum_round_trip", sql=f"""
  select event_id, case when text in ('Buyer', 'Seller', 'Unknown') then text else 'Unknown' end as side,
    case when text in ('NbboTouch', 'NbboAtOrBeyond', 'TickRule', 'Unknown') then text
      else 'Unknown' end as method,
    case when text in ('Normal', 'Locked', 'Crossed') then text end as state,
    case when text in ('Flatfile', 'Rest', 'Ws') then text else 'Flatfile' end as source,
    case when text in ('Prelim', 'Enriched', 'Final') then text else 'Prelim' end as quality
  from {_ENUM_TEXT}""")
def enum_round_trip(spark, d):
    values = ["Buyer", "Seller", "NbboTouch", "Locked", "Rest", "Final", "Some(Normal)"]
    text = F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % 7 + 1).cast("int"))
    return V.table(spark, d, "events").select("event_id", text.alias("text")).select(
        "event_id",
        S.enum_or("text", schemas.AGGRESSOR_SIDES, "Unknown").alias("side"),
        S.enum_or("text", schemas.CLASS_METHODS, "Unknown").alias("method"),
        S.enum_or("text", schemas.NBBO_STATES, None).alias("state"),
        S.enum_or("text", schemas.SOURCES, "Flatfile").alias("source"),
        S.enum_or("text", schemas.QUALITIES, "Prelim").alias("quality"))
