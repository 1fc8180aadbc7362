"""Live JSON messages: text with one object or an array of objects.

The decoders are plain projections and work alike on batch and streaming tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright import schemas
from tapewright.functions import scalars as S
from tapewright.sources.flatfiles import unclassified

QUOTE_MESSAGE = ("array<struct<ev:string,sym:string,bp:double,ap:double,bs:bigint,`as`:bigint,"
                 "bx:int,ax:int,c:int,t:bigint,q:bigint>>")
EQUITY_MESSAGE = ("array<struct<ev:string,sym:string,p:double,s:bigint,c:array<int>,x:int,t:bigint,"
                  "q:bigint,i:string,z:int,trfi:string,trft:bigint>>")
OPTION_MESSAGE = ("array<struct<ev:string,sym:string,p:double,s:bigint,c:array<int>,x:int,t:bigint,"
                  "q:bigint>>")


def _decode(df: DataFrame, schema: str, kind: str, required: tuple[str, ...], text: str) -> DataFrame:
    """Messages of one kind as rows; an array schema also accepts a single object."""
    # The array is parsed once: inline reads its fields from one generated row.
    rows = df.select(F.inline(F.from_json(F.col(text), schema)))
    keep = F.col("ev") == kind
    for name in required:
        keep = keep & F.col(name).isNotNull()
    return rows.where(keep)


def _live_meta(ts: str) -> dict[str, Column]:
    return {"source": F.lit("Ws"), "quality": F.lit("Prelim"), "watermark_ts_ns": F.col(ts)}


def decode_quotes(df: DataFrame, text: str = "value") -> DataFrame:
    m = _decode(df, QUOTE_MESSAGE, "Q", ("sym", "bp", "ap", "t"), text)
    zero = F.lit(0).cast("bigint")
    out = m.select(
        F.col("sym").alias("instrument_id"), S.ms_to_ns("t").alias("quote_ts_ns"),
        F.col("bp").alias("bid"), F.col("ap").alias("ask"),
        F.coalesce("bs", zero).alias("bid_sz"), F.coalesce("as", zero).alias("ask_sz"),
        F.col("c").alias("condition"), F.col("bx").alias("best_bid_venue"),
        F.col("ax").alias("best_ask_venue"),
    )
    uid = S.quote_uid("instrument_id", "quote_ts_ns", F.lit(None), "bid", "ask", "bid_sz", "ask_sz",
                      "best_bid_venue", "best_ask_venue", "condition")
    out = out.withColumns({"quote_uid": uid, "state": S.quote_state("bid", "ask"),
                           **_live_meta("quote_ts_ns")})
    return out.select(*schemas.QUOTES.fieldNames())


def _trade_fields(symbol: str) -> list[Column]:
    return [
        F.col("sym").alias(symbol), S.ms_to_ns("t").alias("trade_ts_ns"), F.col("p").alias("price"),
        F.coalesce("s", F.lit(0).cast("bigint")).alias("size"),
        F.coalesce("c", F.array().cast("array<int>")).alias("conditions"),
        F.coalesce("x", F.lit(0)).alias("exchange"),
    ]


def decode_equity_trades(df: DataFrame, text: str = "value") -> DataFrame:
    """Stock trades; size comes from ``s`` and the sequence number from ``q``."""
    m = _decode(df, EQUITY_MESSAGE, "T", ("sym", "p", "t"), text)
    no_long, no_int = F.lit(None).cast("bigint"), F.lit(None).cast("int")
    out = m.select(
        *_trade_fields("symbol"), F.col("i").alias("trade_id"), F.col("q").alias("seq"),
        F.col("z").cast("string").alias("tape"), F.col("trfi").alias("trf_id"),
        S.ms_to_ns("trft").alias("trf_ts_ns"),
    ).withColumns({"participant_ts_ns": no_long, "correction": no_int})
    uid = S.equity_trade_uid("symbol", "trade_ts_ns", "participant_ts_ns", "seq", "price", "size",
                             "exchange", "trade_id", "correction", "conditions")
    out = out.withColumns({"trade_uid": uid, **unclassified(), **_live_meta("trade_ts_ns")})
    return out.select(*schemas.EQUITY_TRADES.fieldNames())


def decode_option_trades(df: DataFrame, text: str = "value") -> DataFrame:
    """Option trades; the trade time stands in for an unreadable expiry."""
    m = _decode(df, OPTION_MESSAGE, "T", ("sym", "p", "t"), text)
    out = m.where(F.col("sym").startswith(S.OPTION_TAG)).select(*_trade_fields("contract"))
    uid = S.option_trade_uid("contract", "trade_ts_ns", F.lit(None), "price", "size", "exchange",
                             "conditions")
    out = S.parse_contract(out, "contract", "trade_ts_ns").withColumns(
        {"trade_uid": uid, **unclassified(), **_live_meta("trade_ts_ns")})
    return out.select(*schemas.OPTION_TRADES.fieldNames())
