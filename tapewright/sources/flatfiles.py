"""Daily gzip CSV files of trades and quotes.

Columns are bound by header name, so layouts with more or fewer columns both load;
numbers parse leniently (text that is no number becomes 0).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions import scalars as S

KEY_COLUMN = "ticker"   # a column of every layout


HEAD = 1 << 16          # bytes read at a time from the head of a file
# Endings of compressed files that any reader opens alike; others are left to Spark's reader.
COMPRESSED = (".gz", ".bz2", ".zst")
OTHER_CODECS = (".snappy", ".lz4", ".deflate", ".lzo")


def _head(uri: str) -> str | None:
    """The first line of a file that is not blank; empty if there is none. Null: cannot be opened here."""
    if uri.lower().endswith(OTHER_CODECS):
        return None
    try:
        store, path = fs.FileSystem.from_uri(uri)
        kind = "detect" if uri.lower().endswith(COMPRESSED) else None
        stream = store.open_input_stream(path, compression=kind, buffer_size=HEAD)
    except (pa.ArrowException, OSError, ImportError):
        return None
    with stream:
        rest = b""
        while block := stream.read(HEAD):
            *lines, rest = re.split(rb"[\r\n]", rest + block)
            for line in lines:
                if line.strip():
                    return line.decode("utf-8", "replace")
    return rest.decode("utf-8", "replace")


def _heads(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "value": pa.array(
            [_head(uri) for uri in batch.column("uri").to_pylist()], pa.string())})


def _scanned_heads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and first line of files that only Spark's reader opens; one pass over them."""
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    # Rows of a block keep their order, so the smallest number in the first block is the first line.
    return (lines.where("block = 0 and trim(value) <> ''").groupBy("path")
            .agg(F.min_by("value", "at").alias("value")))


def _headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Header line -> the files that begin with it.

    The header is the first line of a file that is not blank, whatever it looks like; what
    reaches the driver is that line and the name of each file. A file whose first line does not
    name the ticker has no header, and an error says so.

    Tasks over the listing open each file and read its head alone, so the bytes of the data are
    read once, by the scan. Only files in a store or codec that tasks cannot open themselves are
    scanned as text for their first lines."""
    listing = spark.read.format("binaryFile").load(paths).select("path", F.col("_metadata.file_path").alias("uri"))
    rows = listing.mapInArrow(_heads, "path string, value string").collect()
    unopened = [row["path"] for row in rows if row["value"] is None]
    if unopened:
        rows = [row for row in rows if row["value"] is not None] + _scanned_heads(spark, unopened).collect()
    found: dict[str, list[str]] = {}
    for row in rows:
        header = row["value"].removeprefix("\ufeff")
        if not header.strip():
            continue
        if KEY_COLUMN not in (name.strip().strip('"').strip().lower() for name in header.split(",")):
            raise ValueError(f"no header with a column {KEY_COLUMN} in {row['path']}")
        found.setdefault(header, []).append(row["path"])
    return found


def read_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All columns as text, named by the header, plus the file each row came from.

    One CSV scan binds all its files by the header of one of them. Files are therefore
    grouped by header, each group is scanned by itself, and the groups are united by name;
    columns that a layout lacks are null."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    groups = _headers(spark, paths)
    layouts = list(groups.values()) if len(groups) > 1 else [paths]
    parts = [spark.read.option("header", True).csv(files).withColumn("__path", F.col("_metadata.file_path"))
             for files in layouts]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _text(df: DataFrame, name: str) -> Column:
    """A column by name; null where the layout lacks it or the text is empty."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    return F.when(F.trim(F.col(name)) != "", F.trim(F.col(name)))


def _number(df: DataFrame, name: str, kind: str = "bigint") -> Column:
    return S.lenient(_text(df, name), kind)


def unclassified() -> dict[str, Column]:
    """Classification and quote columns of a trade that has not been classified."""
    def null(kind: str) -> Column:
        return F.lit(None).cast(kind)

    return {
        "aggressor_side": F.lit("Unknown"), "class_method": F.lit("Unknown"),
        "aggressor_offset_mid_bp": null("int"), "aggressor_offset_touch_ticks": null("int"),
        "aggressor_confidence": null("double"), "nbbo_bid": null("double"),
        "nbbo_ask": null("double"), "nbbo_bid_sz": null("bigint"), "nbbo_ask_sz": null("bigint"),
        "nbbo_ts_ns": null("bigint"), "nbbo_age_us": null("bigint"), "nbbo_state": null("string"),
        "tick_size_used": null("double"),
    }


def _batch_meta(ts: str) -> dict[str, Column]:
    return {"source": F.lit("Flatfile"), "quality": F.lit("Prelim"), "watermark_ts_ns": F.col(ts)}


def equity_trades(raw: DataFrame) -> DataFrame:
    """Equity trades; event time is the SIP clock."""
    from tapewright.schemas import EQUITY_TRADES

    df = raw.select(
        _text(raw, "ticker").alias("symbol"),
        _number(raw, "sip_timestamp").alias("trade_ts_ns"),
        _number(raw, "price", "double").alias("price"), _number(raw, "size").alias("size"),
        S.parse_conditions(_text(raw, "conditions")).alias("conditions"),
        _number(raw, "exchange", "int").alias("exchange"),
        _text(raw, "id").alias("trade_id"), _number(raw, "sequence_number").alias("seq"),
        _number(raw, "participant_timestamp").alias("participant_ts_ns"),
        _text(raw, "tape").alias("tape"), _number(raw, "correction", "int").alias("correction"),
        _text(raw, "trf_id").alias("trf_id"), _number(raw, "trf_timestamp").alias("trf_ts_ns"),
    ).where(F.col("symbol").isNotNull())
    uid = S.equity_trade_uid("symbol", "trade_ts_ns", "participant_ts_ns", "seq", "price", "size",
                             "exchange", "trade_id", "correction", "conditions")
    out = df.withColumns({"trade_uid": uid, **unclassified(), **_batch_meta("trade_ts_ns")})
    return out.select(*EQUITY_TRADES.fieldNames())


def option_trades(raw: DataFrame) -> DataFrame:
    """Option trades with direction, strike, expiry and underlying from the contract."""
    from tapewright.schemas import OPTION_TRADES

    df = raw.select(
        _text(raw, "ticker").alias("contract"),
        _number(raw, "sip_timestamp").alias("trade_ts_ns"),
        _number(raw, "participant_timestamp").alias("__participant"),
        _number(raw, "price", "double").alias("price"), _number(raw, "size").alias("size"),
        S.parse_conditions(_text(raw, "conditions")).alias("conditions"),
        _number(raw, "exchange", "int").alias("exchange"),
    ).where(F.col("contract").isNotNull())
    uid = S.option_trade_uid("contract", "trade_ts_ns", "__participant", "price", "size", "exchange",
                             "conditions")
    out = S.parse_contract(df, "contract", "trade_ts_ns").withColumns(
        {"trade_uid": uid, **unclassified(), **_batch_meta("trade_ts_ns")})
    return out.select(*OPTION_TRADES.fieldNames())


def quotes(raw: DataFrame) -> DataFrame:
    """Quotes of equities or options with their state."""
    from tapewright.schemas import QUOTES

    df = raw.select(
        _text(raw, "ticker").alias("instrument_id"),
        _number(raw, "sip_timestamp").alias("quote_ts_ns"),
        _number(raw, "bid_price", "double").alias("bid"),
        _number(raw, "ask_price", "double").alias("ask"),
        _number(raw, "bid_size").alias("bid_sz"), _number(raw, "ask_size").alias("ask_sz"),
        F.split(_text(raw, "conditions"), ",")[0].try_cast("int").alias("condition"),
        _text(raw, "bid_exchange").try_cast("int").alias("best_bid_venue"),
        _text(raw, "ask_exchange").try_cast("int").alias("best_ask_venue"),
        _number(raw, "sequence_number").alias("__seq"),
    ).where(F.col("instrument_id").isNotNull())
    uid = S.quote_uid("instrument_id", "quote_ts_ns", "__seq", "bid", "ask", "bid_sz", "ask_sz",
                      "best_bid_venue", "best_ask_venue", "condition")
    out = df.withColumns({"quote_uid": uid, "state": S.file_quote_state("bid", "ask"),
                          **_batch_meta("quote_ts_ns")})
    return out.select(*QUOTES.fieldNames())


# ------------------------------------------------------------------- daily files
def daily_path(root: str, day) -> str:
    return f"{root}/{day:%Y}/{day:%m}/{day:%Y-%m-%d}.csv.gz"


def file_day(path: str = "__path") -> Column:
    """The date in a daily file's name."""
    return F.regexp_extract(F.col(path), r"/(\d{4}-\d{2}-\d{2})\.csv", 1).try_cast("date")


def observed_days(spark: SparkSession, root: str) -> DataFrame:
    """Dates for which a daily file exists; lists names only, reads no content."""
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv.gz").load(root).select(F.col("path").alias("__path"))
    )
    return listing.select(file_day().alias("dt")).where(F.col("dt").isNotNull()).distinct()


def read_days(spark: SparkSession, root: str, days: DataFrame) -> DataFrame:
    """Rows of the daily files of given days (a ``dt`` column), with their ``dt``.

    Days without a file are left out. Paths are planning metadata: a few thousand names.
    """
    present = days.join(observed_days(spark, root), "dt").orderBy("dt").collect()
    if not present:
        raise FileNotFoundError(f"no daily file under {root} in the given days")
    raw = read_csv(spark, [daily_path(root, row["dt"]) for row in present])
    return raw.withColumn("dt", file_day())
