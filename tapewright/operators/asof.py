"""Backward as-of joins between trades and quotes, and look-backs built on them.

Quotes and trades are unioned and the last quote is carried forward per
instrument: one exchange and one sort of the data, no range join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.scalars import floor_div, live_mid
from tapewright.operators.ordered import SLICE_NS, carry_forward

NBBO_COLUMNS = ("bid", "ask", "bid_sz", "ask_sz", "state")


@dataclass(frozen=True)
class Lookup:
    """A right-hand side of an as-of join: what to look up, and under which names."""

    rows: DataFrame
    columns: tuple[str, ...] = NBBO_COLUMNS
    prefix: str = "nbbo_"
    key: str = "instrument_id"
    ts: str = "quote_ts_ns"
    seq: str = "seq"
    max_age_us: int | None = None


def asof_join_all(
    trades: DataFrame, lookups: list[Lookup], trade_key: str = "instrument_id",
    trade_ts: str = "trade_ts_ns", trade_seq: str = "seq", slice_ns: int = SLICE_NS,
    previous: dict[str, Column] | None = None,
) -> DataFrame:
    """Attach to each trade the latest row of every lookup at or before it, in one pass.

    ``previous`` adds, per name, the last value that earlier trades of the same key hold.

    At equal times looked-up rows come before trades and, among them, the highest ``seq``
    wins. Adds ``<prefix><column>``, ``<prefix>ts_ns`` and ``<prefix>age_us``; all are
    null without a match, or when the match is older than ``max_age_us``.
    """
    previous = previous or {}
    both = trades.withColumns({
        "__key": F.col(trade_key), "__ts": F.col(trade_ts),
        "__side": F.lit(len(lookups)), "__seq": F.col(trade_seq),
        **{f"__own_{n}": v for n, v in previous.items()},
    })
    for i, look in enumerate(lookups):
        both = both.unionByName(look.rows.select(
            F.col(look.key).alias("__key"), F.col(look.ts).alias("__ts"),
            F.lit(i).alias("__side"), F.col(look.seq).alias("__seq"),
            F.struct(*[F.col(c) for c in look.columns], F.col(look.ts).alias("ts_ns"))
            .alias(f"__row{i}"),
        ), allowMissingColumns=True)
    carried = carry_forward(
        both, ["__key"], "__ts", ["__ts", "__side", "__seq"],
        {f"__match{i}": F.col(f"__row{i}") for i in range(len(lookups))}
        | {n: F.col(f"__own_{n}") for n in previous},
        keep=F.col("__side") == len(lookups), slice_ns=slice_ns, earlier_only=set(previous),
        sparse=not previous,
    )
    # Freshness is decided once for a match, not once for each of its columns.
    found, added = {}, {}
    for i, look in enumerate(lookups):
        match = F.col(f"__match{i}")
        age = floor_div(F.col("__ts") - match["ts_ns"], 1_000)
        fresh = match.isNotNull()
        if look.max_age_us is not None:
            fresh = fresh & (age <= F.lit(look.max_age_us).cast("bigint"))
        found[f"__found{i}"] = F.when(fresh, match)
        row = F.col(f"__found{i}")
        added |= {f"{look.prefix}{c}": row[c] for c in look.columns}
        added[f"{look.prefix}ts_ns"] = row["ts_ns"]
        added[f"{look.prefix}age_us"] = F.greatest(
            floor_div(F.col("__ts") - row["ts_ns"], 1_000), F.when(row.isNotNull(), F.lit(0).cast("bigint")))
    return carried.withColumns(found).withColumns(added).select(*trades.columns, *previous, *added)


def asof_join(
    trades: DataFrame, quotes: DataFrame, trade_key: str = "instrument_id",
    quote_key: str = "instrument_id", trade_ts: str = "trade_ts_ns", quote_ts: str = "quote_ts_ns",
    trade_seq: str = "seq", quote_seq: str = "seq", columns: tuple[str, ...] = NBBO_COLUMNS,
    prefix: str = "nbbo_", max_age_us: int | None = None, slice_ns: int = SLICE_NS,
) -> DataFrame:
    """As-of join with a single lookup."""
    look = Lookup(quotes, columns, prefix, quote_key, quote_ts, quote_seq, max_age_us)
    return asof_join_all(trades, [look], trade_key, trade_ts, trade_seq, slice_ns)


def asof_state(trades: DataFrame, quotes: DataFrame, **names) -> DataFrame:
    """Quote state before each trade, however old."""
    joined = asof_join(trades, quotes, columns=("state",), prefix="before_", **names)
    return joined.drop("before_ts_ns", "before_age_us")


def asof_underlying(
    option_trades: DataFrame, underlying_quotes: DataFrame, staleness_us: int,
    slice_ns: int = SLICE_NS,
) -> DataFrame:
    """Attach the underlying's quote without a limit; ``nbbo_stale`` marks old ones.

    The limit has one microsecond of slack, except that a limit of 0 means 0.
    """
    joined = asof_join(option_trades, underlying_quotes, trade_key="underlying",
                       slice_ns=slice_ns)
    return mark_stale(joined, staleness_us)


def mark_stale(quoted: DataFrame, staleness_us: int) -> DataFrame:
    """Add ``nbbo_stale`` from ``nbbo_age_us``."""
    limit = staleness_us + 1 if staleness_us > 0 else 0
    return quoted.withColumn(
        "nbbo_stale",
        F.coalesce(F.col("nbbo_age_us") > F.lit(limit).cast("bigint"), F.lit(False)),
    )


def prev_price(trades: DataFrame, key: str = "instrument_id", ts: str = "trade_ts_ns",
               seq: str = "seq", price: str = "price", name: str = "prev_price") -> DataFrame:
    """Price of the previous trade of the same instrument, in event order."""
    return carry_forward(trades, [key], ts, [ts, seq], {name: F.col(price)}, include_current=False)


def last_underlying_trade(option_trades: DataFrame, underlying_trades: DataFrame,
                          slice_ns: int = SLICE_NS) -> DataFrame:
    """Most recent underlying trade price at each option trade."""
    joined = asof_join(
        option_trades, underlying_trades, trade_key="underlying", quote_ts="trade_ts_ns",
        columns=("price",), prefix="last_underlying_", slice_ns=slice_ns,
    )
    return joined.drop("last_underlying_ts_ns", "last_underlying_age_us")


def resolve_underlying_price(
    option_trades: DataFrame, underlying_quotes: DataFrame, underlying_trades: DataFrame,
    max_age_us: int, drop_unpriced: bool = True,
) -> DataFrame:
    """Add ``underlying_price``: fresh quote mid, else the last underlying trade.

    A price that is not finite and positive leaves the trade out.
    """
    priced = asof_join_all(option_trades, price_lookups(underlying_quotes, underlying_trades, max_age_us),
                           trade_key="underlying")
    return with_underlying_price(priced, drop_unpriced).select(*option_trades.columns, "underlying_price")


def price_lookups(underlying_quotes: DataFrame, underlying_trades: DataFrame, max_age_us: int) -> list[Lookup]:
    """What ``with_underlying_price`` needs, to share a pass with other lookups."""
    return [Lookup(underlying_quotes, ("bid", "ask"), "__u_", max_age_us=max_age_us),
            Lookup(underlying_trades, ("price",), "__t_", ts="trade_ts_ns")]


def with_underlying_price(looked_up: DataFrame, drop_unpriced: bool = True) -> DataFrame:
    priced = looked_up.withColumn(
        "underlying_price", F.coalesce(live_mid("__u_bid", "__u_ask"), F.col("__t_price")))
    if drop_unpriced:
        # Finite and positive (NaN is above infinity), naming the price once: the condition is moved
        # ahead of the look-up's columns, and each mention would repeat them in generated code.
        priced = priced.where(F.exists(F.array("underlying_price"), lambda p: (p > 0) & (p < float("inf"))))
    return priced.drop(*[f"__{p}_{c}" for p in "ut" for c in ("bid", "ask", "price", "ts_ns", "age_us")])


def prune_horizon(df: DataFrame, key: str, ts: str, horizon_ns: int) -> DataFrame:
    """Rows of each key no older than the key's newest row minus the horizon."""
    newest = df.groupBy(key).agg(F.max(ts).alias("__newest"))
    return (
        df.join(newest, key)
        .where(F.col(ts) >= F.col("__newest") - F.lit(horizon_ns).cast("bigint"))
        .drop("__newest")
    )


def prune_before(df: DataFrame, ts: str, cutoff: Column) -> DataFrame:
    """Rows at or after a cutoff time."""
    return df.where(F.col(ts) >= cutoff)
