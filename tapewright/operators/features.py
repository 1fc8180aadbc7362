"""Feature rows: per symbol and window, everything the trades of the window say."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright import schemas
from tapewright.functions import scalars as S
from tapewright.operators import dip as D
from tapewright.operators import stats
from tapewright.operators.ordered import landed
from tapewright.operators.windows import assign_windows, parse_window, price_bars

KEYS = list(schemas.FEATURE_KEYS)
# Share names and the method each one counts.
METHOD_SHARES = (("touch", "NbboTouch"), ("at_or_beyond", "NbboAtOrBeyond"),
                 ("tick_rule", "TickRule"), ("unknown", "Unknown"))
BARS = {p: f"underlying_price_{p}" for p in ("open", "high", "low", "close")}
# What the mixes need besides the right of an option.
MIXED = ("price", "intrinsic", "notional", "aggressor_side", "class_method")


def exposures(option_trades: DataFrame, contract_size: float = 100.0) -> DataFrame:
    """Dollar delta and gamma per trade, signed by the probability of a buy.

    Needs ``underlying_price``, ``delta``, ``gamma`` and the classification; missing Greeks
    count as zero.
    """
    spot = F.col("underlying_price")
    df = option_trades.withColumns({
        "__qty": F.col("size") * float(contract_size),
        "buy_sign": S.buy_probability("aggressor_side", "aggressor_confidence") * 2.0 - 1.0,
        "__delta": F.abs(F.coalesce("delta", F.lit(0.0))),
        "__gamma": F.abs(F.coalesce("gamma", F.lit(0.0))),
    })
    df = df.withColumns({"dadvv": F.col("__delta") * spot * F.col("__qty"),
                         "gadvv": F.col("__gamma") * spot * spot * F.col("__qty")})
    df = with_signed(df).withColumns({
        "notional": F.col("price") * F.col("__qty"),
        "intrinsic": S.intrinsic("contract_direction", spot, "strike_price"),
    })
    return df.drop("__qty", "__delta", "__gamma")


def with_signed(df: DataFrame) -> DataFrame:
    """Signed exposures, from the sign and the exposures."""
    return df.withColumns({f"signed_{e}": F.col("buy_sign") * F.col(e) for e in ("dadvv", "gadvv")})


def option_mixes(windowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shares of classification methods, intrinsic relations and unknown sides; call volume."""
    call = S.is_call("contract_direction")
    price, intrinsic = F.col("price"), F.col("intrinsic")

    def share(right, condition):
        hit = F.when(F.coalesce(condition, F.lit(False)), 1.0).otherwise(0.0)
        return F.avg(F.when(right, hit))

    columns = [
        share(~call, price < intrinsic).alias("puts_below_intrinsic_pct"),
        share(~call, price > intrinsic).alias("puts_above_intrinsic_pct"),
        share(call, price > intrinsic).alias("calls_above_intrinsic_pct"),
        F.sum(F.when(call, F.col("notional"))).alias("__calls_notional"),
    ]
    for right, is_right in (("puts", ~call), ("calls", call)):
        unknown = F.col("aggressor_side") == "Unknown"
        columns.append(share(is_right, unknown).alias(f"{right}_aggressor_unknown_pct"))
        for name, method in METHOD_SHARES:
            columns.append(share(is_right, F.col("class_method") == method)
                           .alias(f"{right}_classifier_{name}_pct"))
    out = windowed.groupBy(*keys).agg(*columns)
    notional = F.col("__calls_notional")
    return out.withColumn("calls_dollar_value", F.when(notional > 0, notional)).drop("__calls_notional")


def option_series(windowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The four exposures of each right in long form: ``keys, series, x``."""
    call = S.is_call("contract_direction")
    pairs = F.array(*[
        F.struct(F.when(call, F.lit(f"calls_{e}")).otherwise(F.lit(f"puts_{e}")).alias("series"), F.col(e).alias("x"))
        for e in schemas.EXPOSURES
    ])
    return stats.finite_values(windowed.select(*keys, F.inline(pairs)), "x")


def underlying_series(windowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dollar value of underlying trades in long form."""
    value = F.abs(F.col("price") * F.col("size"))
    return stats.finite_values(
        windowed.select(*keys, F.lit(schemas.UNDERLYING_SERIES).alias("series"), value.alias("x")), "x")


def side_by_side(rows: DataFrame, windows: Sequence[str], columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``symbol``, ``slot_ns`` and the named columns of rows with ``trade_ts_ns``, written once, however many statistics
    and window lengths read them. Rows of one symbol and one shortest window (and of equal ``by``) lie side by
    side, so that whoever groups them combines most rows before a shuffle; Spark splits partitions that get too much.
    A slot is what all windows are multiples of, in place of the time."""
    lengths = [parse_window(label) for label in windows]
    step = math.gcd(*lengths)
    kept = rows.select("symbol", (S.floor_div("trade_ts_ns", step) * F.lit(step).cast("bigint")).alias("slot_ns"), *columns)
    dealt = kept.withColumn("__short", S.floor_div("slot_ns", min(lengths))).hint("rebalance", "symbol", "__short", *by)
    # Sorted by a number, as text would be compared row by row.
    return landed(dealt.sortWithinPartitions(F.xxhash64("symbol", "__short", *by)).drop("__short"), "events")


def write_exposures(exposed: DataFrame, windows: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """Option trades with ``exposures``, windowed: KEYS, right, exposures and ``columns``."""
    own = ("contract_direction", "buy_sign", "dadvv", "gadvv")
    stored = side_by_side(exposed, windows, [*own, *columns], ["contract_direction"])
    return assign_windows(with_signed(stored), "slot_ns", list(windows))


def write_dollar_values(trades: DataFrame, windows: Sequence[str]) -> DataFrame:
    """Underlying trades, windowed: KEYS, price, size."""
    return assign_windows(side_by_side(trades, windows, ["price", "size"]), "slot_ns", list(windows))


def series_stats(values: DataFrame, keys: Sequence[str], dip_draws: int = 0, seed: int = 7) -> DataFrame:
    """All statistics per series; ``dip_pval`` from the simulated null table."""
    groups = [*keys, "series"]
    out = stats.summarize(values, groups, "x")
    if dip_draws <= 0:
        return out.withColumn("dip_pval", F.lit(None).cast("double"))
    spark = values.sparkSession
    dips = D.dip_statistic(values, groups, "x")
    table = D.null_table(spark, out.agg(F.max("n").alias("max_n")), dip_draws, seed)
    p = D.table_pvalues(dips, table, groups).where(F.col("n") >= 3)
    return out.join(p.select(*groups, F.col("p_value").alias("dip_pval")), groups, "left")


def pivot_series(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per window: every statistic of every series as its own column."""
    renamed = {"q2": "median"}
    wanted = [c for c in schemas.feature_metric_columns()]
    columns = []
    for series in schemas.SERIES:
        for name in ("q1", "q2", "q3") + schemas.STAT_NAMES:
            column = f"{series}_{name}"
            if column in wanted:
                value = F.col(renamed.get(name, name))
                columns.append(F.max(F.when(F.col("series") == series, value)).alias(column))
    return long.groupBy(*keys).agg(*columns)


def feature_rows(
    spark: SparkSession, option_trades: DataFrame, underlying_trades: DataFrame, windows: list[str],
    contract_size: float = 100.0, dip_draws: int = 0,
) -> DataFrame:
    """The 154-column feature row per symbol and window with any event.

    ``option_trades`` are classified, priced and carry Greeks and ``symbol``;
    ``underlying_trades`` have ``symbol``. Windows without events give no row.
    """
    options = write_exposures(exposures(option_trades, contract_size), windows, MIXED)
    stock = assign_windows(underlying_trades, "trade_ts_ns", windows)
    values = option_series(options, KEYS).unionByName(
        underlying_series(write_dollar_values(underlying_trades, windows), KEYS))
    wide = pivot_series(series_stats(values, KEYS, dip_draws), KEYS)
    bars = price_bars(stock, KEYS).withColumnsRenamed(BARS)
    rows = wide.join(bars, KEYS, "left").join(option_mixes(options, KEYS), KEYS, "left")
    return rows.select(*KEYS, *schemas.feature_metric_columns())
