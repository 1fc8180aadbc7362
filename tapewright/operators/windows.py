"""Tumbling windows labelled like ``30s``, ``5m``, ``1h``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions.scalars import NANOS, floor_div

_UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600}


def parse_window(label: str) -> int:
    """Window length in nanoseconds."""
    match = re.fullmatch(r"([+-]?\d+)([smhSMH])", label)
    if not match or int(match[1]) <= 0:
        raise ValueError(f"invalid window: {label!r}")
    return int(match[1]) * _UNIT_SECONDS[match[2].lower()] * NANOS


def assign_windows(df: DataFrame, ts: str, labels: list[str]) -> DataFrame:
    """One row per input row and window label, with the window's bounds."""
    specs = sorted({label: parse_window(label) for label in labels}.items(), key=lambda s: s[1])
    if len(specs) == 1:
        label, length = specs[0]
        out = df.withColumns({"window": F.lit(label), "__length": F.lit(length).cast("bigint")})
    else:
        rows = F.array(*[
            F.struct(F.lit(label).alias("window"), F.lit(length).cast("bigint").alias("__length"))
            for label, length in specs
        ])
        out = df.select("*", F.inline(rows))
    start = floor_div(ts, F.col("__length")) * F.col("__length")
    return out.withColumn("window_start_ns", start).withColumn(
        "window_end_ns", F.col("window_start_ns") + F.col("__length")
    ).drop("__length")


def price_bars(trades: DataFrame, keys: list[str], ts: str = "trade_ts_ns", seq: str = "seq",
               price: str = "price") -> DataFrame:
    """Open, high, low and close in event order."""
    order = F.struct(ts, seq)
    return trades.groupBy(*keys).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"),
        F.min(price).alias("low"), F.max_by(price, order).alias("close"),
    )
