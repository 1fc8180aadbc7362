"""Trades, quotes and yields derived from the star-schema tables.

Each view exists twice with one meaning: as a DataFrame and as SQL text. Decimal
literals are doubles in both. Order and ship dates are moved 9131 days ahead, into
the span of the trading calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_SHIFT = 9131
OPEN_SECOND, SESSION_SECONDS = 52_200, 23_400
TENORS = (1 / 12, 0.25, 0.5, 1.0, 2.0, 3.0, 5.0, 7.0, 10.0, 20.0, 30.0)
TENOR_FIELDS = (
    "yield_1_month", "yield_3_month", "yield_6_month", "yield_1_year", "yield_2_year",
    "yield_3_year", "yield_5_year", "yield_7_year", "yield_10_year", "yield_20_year",
    "yield_30_year",
)
LETTERS = "ABCDEFGHIJKLMNOPQRST"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a file stream."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _letter(key: str) -> Column:
    return F.concat(F.lit("S"), F.substring(F.lit(LETTERS), (F.col(key) % 20 + 1).cast("int"), F.lit(1)))


def _days(column: str) -> Column:
    return F.unix_date(F.col(column).cast("date")).cast("bigint") + F.lit(DAY_SHIFT)


def _event_base(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...], read=table) -> DataFrame:
    bucket = F.col("user_id") % 20
    return (
        read(spark, sf_dir, "events")
        .where(F.col("event_type").isin(*kinds))
        .select(
            F.concat(F.lit("U"), F.lpad(bucket.cast("string"), 2, "0")).alias("instrument_id"),
            (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
            (bucket + 20).cast("double").alias("base"),
            "event_id",
        )
    )


def quotes(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    e = F.col("event_id")
    return _event_base(spark, sf_dir, ("view", "signup", "error"), read).select(
        "instrument_id", F.col("ts_ns").alias("quote_ts_ns"),
        F.round(F.col("base") - (e % 5) * 0.05, 2).alias("bid"),
        F.round(F.col("base") + (e % 6 - 1) * 0.05, 2).alias("ask"),
        (e % 9 + 1).alias("bid_sz"), (e % 7 + 1).alias("ask_sz"), e.alias("seq"),
    )


def trades(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    e = F.col("event_id")
    return _event_base(spark, sf_dir, ("purchase", "click"), read).select(
        "instrument_id", F.col("ts_ns").alias("trade_ts_ns"),
        F.round(F.col("base") + (e % 9 - 4) * 0.05, 2).alias("price"),
        (e % 50 + 1).alias("size"), (e % 12).cast("int").alias("exchange"),
        (e % 1500).cast("string").alias("trade_id"), e.alias("seq"),
    )


def option_trades(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    day = _days("l_shipdate")
    second = F.lit(OPEN_SECOND) + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) \
        % SESSION_SECONDS
    expiry = F.date_from_unix_date((day + 7 + F.col("l_partkey") % 700).cast("int"))
    right = F.when(F.col("l_linenumber") % 2 == 0, F.lit("P")).otherwise(F.lit("C"))
    strike = F.col("l_partkey") % 41 + 80
    return line.select(
        F.concat(
            F.lit("O:"), _letter("l_partkey"), F.date_format(expiry, "yyMMdd"), right,
            F.lpad((strike * 1000).cast("string"), 8, "0"),
        ).alias("contract"),
        _letter("l_partkey").alias("underlying"),
        ((day * 86_400 + second) * 1_000_000_000).alias("trade_ts_ns"),
        right.alias("contract_direction"),
        strike.cast("double").alias("strike_price"),
        (F.unix_date(expiry).cast("bigint") * 86_400_000_000_000).alias("expiry_ts_ns"),
        F.round((F.col("l_orderkey") % 400) / 20.0 + 0.5, 2).alias("price"),
        F.col("l_quantity").cast("bigint").alias("size"),
        (F.col("l_orderkey") % 12).cast("int").alias("exchange"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000
         + (F.col("l_partkey") * 101 + F.col("l_suppkey")) % 1_000_000).alias("seq"),
    )


def underlying_quotes(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    key = F.col("o_orderkey")
    mid = (key % 21) / 2.0 + 95.0
    return read(spark, sf_dir, "orders").select(
        _letter("o_custkey").alias("instrument_id"),
        ((_days("o_orderdate") * 86_400 + OPEN_SECOND + key % SESSION_SECONDS)
         * 1_000_000_000).alias("quote_ts_ns"),
        (mid - 0.05).alias("bid"), (mid + 0.05).alias("ask"),
        F.lit(10).cast("bigint").alias("bid_sz"), F.lit(12).cast("bigint").alias("ask_sz"),
        F.lit("Normal").alias("state"), key.alias("seq"),
    )


def underlying_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        _letter("o_custkey").alias("instrument_id"),
        ((_days("o_orderdate") * 86_400 + OPEN_SECOND + key % SESSION_SECONDS + 1)
         * 1_000_000_000).alias("trade_ts_ns"),
        ((key % 23) / 2.0 + 95.0).alias("price"),
        (F.col("o_custkey") % 300 + 1).alias("size"), key.alias("seq"),
    )


def yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: one row per date and tenor, percent, some of them null."""
    dates = table(spark, sf_dir, "orders").select(_days("o_orderdate").alias("day")).distinct()
    points = F.array(*[
        F.struct(F.lit(i).alias("tenor_index"), F.lit(t).alias("tenor_years"))
        for i, t in enumerate(TENORS)
    ])
    value = F.round((F.col("day") % 200) / 100.0 + 1.0 + F.col("tenor_years") * 0.03, 4)
    return (
        dates.select("day", F.inline(points))
        .select(
            F.date_from_unix_date(F.col("day").cast("int")).alias("curve_date"),
            "tenor_index", "tenor_years",
            F.when((F.col("day") + F.col("tenor_index")) % 17 != 0, value).alias("yield_pct"),
        )
    )


# ------------------------------------------------------------------- SQL twins
def _sql_letter(key: str) -> str:
    return f"'S' || substr('{LETTERS}', cast({key} % 20 + 1 as integer), 1)"


def _sql_days(column: str) -> str:
    return f"(date_diff('day', date '1970-01-01', cast({column} as date)) + {DAY_SHIFT})"


_EVENT_KEY = "'U' || lpad(cast(user_id % 20 as varchar), 2, '0')"
_ORDER_NS = f"({_sql_days('o_orderdate')} * 86400 + {OPEN_SECOND} + o_orderkey % {SESSION_SECONDS})"
_LINE_EXPIRY = f"({_sql_days('l_shipdate')} + 7 + l_partkey % 700)"
_LINE_RIGHT = "case when l_linenumber % 2 = 0 then 'P' else 'C' end"

VIEW_SQL = {
    "fx_quotes": f"""
      select {_EVENT_KEY} as instrument_id, epoch_us(ts) * 1000 as quote_ts_ns,
        round(cast(20 + user_id % 20 as double) - (event_id % 5) * 0.05e0, 2) as bid,
        round(cast(20 + user_id % 20 as double) + (event_id % 6 - 1) * 0.05e0, 2) as ask,
        1 + event_id % 9 as bid_sz, 1 + event_id % 7 as ask_sz, event_id as seq
      from events where event_type in ('view', 'signup', 'error')""",
    "fx_trades": f"""
      select {_EVENT_KEY} as instrument_id, epoch_us(ts) * 1000 as trade_ts_ns,
        round(cast(20 + user_id % 20 as double) + (event_id % 9 - 4) * 0.05e0, 2) as price,
        1 + event_id % 50 as size, cast(event_id % 12 as integer) as exchange,
        cast(event_id % 1500 as varchar) as trade_id, event_id as seq
      from events where event_type in ('purchase', 'click')""",
    "fx_option_trades": f"""
      select 'O:' || {_sql_letter('l_partkey')}
          || strftime(date '1970-01-01' + cast({_LINE_EXPIRY} as integer), '%y%m%d')
          || {_LINE_RIGHT} || lpad(cast((80 + l_partkey % 41) * 1000 as varchar), 8, '0') as contract,
        {_sql_letter('l_partkey')} as underlying,
        ({_sql_days('l_shipdate')} * 86400 + {OPEN_SECOND}
          + (l_orderkey * 7 + l_linenumber * 13) % {SESSION_SECONDS}) * 1000000000 as trade_ts_ns,
        {_LINE_RIGHT} as contract_direction, cast(80 + l_partkey % 41 as double) as strike_price,
        {_LINE_EXPIRY} * 86400000000000 as expiry_ts_ns,
        round((l_orderkey % 400) / 20e0 + 0.5e0, 2) as price,
        cast(l_quantity as bigint) as size, cast(l_orderkey % 12 as integer) as exchange,
        (l_orderkey * 10 + l_linenumber) * 1000000 + (l_partkey * 101 + l_suppkey) % 1000000 as seq
      from lineitem""",
    "fx_underlying_quotes": f"""
      select {_sql_letter('o_custkey')} as instrument_id, {_ORDER_NS} * 1000000000 as quote_ts_ns,
        95e0 + (o_orderkey % 21) / 2e0 - 0.05e0 as bid,
        95e0 + (o_orderkey % 21) / 2e0 + 0.05e0 as ask,
        cast(10 as bigint) as bid_sz, cast(12 as bigint) as ask_sz, 'Normal' as state,
        o_orderkey as seq
      from orders""",
    "fx_underlying_trades": f"""
      select {_sql_letter('o_custkey')} as instrument_id,
        ({_ORDER_NS} + 1) * 1000000000 as trade_ts_ns,
        95e0 + (o_orderkey % 23) / 2e0 as price, 1 + o_custkey % 300 as size, o_orderkey as seq
      from orders""",
    "fx_yields": f"""
      select date '1970-01-01' + cast(day as integer) as curve_date, tenor_index, tenor_years,
        case when (day + tenor_index) % 17 <> 0
          then round((day % 200) / 100e0 + 1e0 + tenor_years * 0.03e0, 4) end as yield_pct
      from (select distinct {_sql_days('o_orderdate')} as day from orders),
        (values {', '.join(f'({i}, {t!r}e0)' if 'e' not in repr(t) else f'({i}, {t!r})'
                           for i, t in enumerate(TENORS))}) as t(tenor_index, tenor_years)""",
}
# Views that read other views.
VIEW_DEPS: dict[str, tuple[str, ...]] = {}
MATERIALIZED: set[str] = set()


def define_view(name: str, deps: tuple[str, ...], sql: str, materialized: bool = False) -> None:
    """A view; materialized ones are computed once, which keeps deep expressions from nesting."""
    VIEW_SQL[name] = sql
    VIEW_DEPS[name] = deps
    if materialized:
        MATERIALIZED.add(name)


def with_views(names, body: str) -> str:
    """``WITH`` clause for the named views and what they depend on, then the body."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEW_DEPS.get(name, ()):
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names.split() if isinstance(names, str) else names:
        visit(name)
    clauses = ",\n".join(f"{n} as {'materialized ' if n in MATERIALIZED else ''}({VIEW_SQL[n]})" for n in ordered)
    return f"with {clauses}\n{body}"
