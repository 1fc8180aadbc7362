"""Aggressor classification: quote rule, tick rule, delta alignment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions.scalars import classifier_mid, is_actionable, offset_bp
from tapewright.operators.asof import Lookup, asof_join, asof_join_all
from tapewright.operators.ordered import carry_forward, landed

MIN_EPSILON = 1e-6
TOUCH_CONFIDENCE, INSIDE_CONFIDENCE, TICK_CONFIDENCE = 1.0, 0.7, 0.5
ALIGNED_CONFIDENCE, OPPOSED_CONFIDENCE = 0.7, 0.0
DOUBLE_EPS = 2.220446049250313e-16


@dataclass(frozen=True)
class ClassifyParams:
    epsilon_price: float = 1e-4
    allowed_lateness_ms: int = 1_000
    use_tick_rule_fallback: bool = True

    @property
    def epsilon(self) -> float:
        return max(self.epsilon_price, MIN_EPSILON)

    @property
    def staleness_us(self) -> int:
        return self.allowed_lateness_ms * 1_000


@dataclass(frozen=True)
class TradeColumns:
    """Which columns play which part, so that one function serves both trade kinds."""

    instrument: str = "instrument_id"
    ts: str = "trade_ts_ns"
    seq: str = "seq"
    price: str = "price"
    delta: str | None = None
    underlying: str | None = None


def quote_rule(df: DataFrame, params: ClassifyParams, price: str = "price") -> DataFrame:
    """Side, method and confidence from the attached quote (``nbbo_*`` columns)."""
    eps = F.lit(params.epsilon)
    p, bid, ask = F.col(price), F.col("nbbo_bid"), F.col("nbbo_ask")
    usable = is_actionable(bid, ask, "nbbo_state")
    lift, hit = usable & (p >= ask - eps), usable & (p <= bid + eps)
    # Inside the quote the side of mid decides; exactly at mid the nearer touch does, and
    # a full tie is a buy.
    mid = classifier_mid(bid, ask)
    sold = (p < mid) | ((p == mid) & (p - bid < ask - p))
    inside = F.when(sold, F.lit("Seller")).otherwise(F.lit("Buyer"))
    return df.withColumns({
        "aggressor_side": F.when(lift, F.lit("Buyer")).when(hit, F.lit("Seller"))
        .when(usable, inside).otherwise(F.lit("Unknown")),
        "class_method": F.when(lift | hit, F.lit("NbboTouch"))
        .when(usable, F.lit("NbboAtOrBeyond")).otherwise(F.lit("Unknown")),
        "aggressor_confidence": F.when(lift | hit, F.lit(TOUCH_CONFIDENCE))
        .when(usable, F.lit(INSIDE_CONFIDENCE)).otherwise(F.lit(0.0)),
    })


def tick_rule(df: DataFrame, params: ClassifyParams, price: str = "price",
              prev: str = "prev_price") -> DataFrame:
    """Fill rows that are still Unknown from the sign of the price change."""
    if not params.use_tick_rule_fallback:
        return df
    change = F.col(price) - F.col(prev)
    side = (
        F.when(change > params.epsilon, F.lit("Buyer"))
        .when(change < -params.epsilon, F.lit("Seller"))
        .otherwise(F.lit("Unknown"))
    )
    open_row = F.col("aggressor_side") == "Unknown"
    ticked = open_row & (side != "Unknown")
    return df.withColumns({
        "class_method": F.when(ticked, F.lit("TickRule")).otherwise(F.col("class_method")),
        "aggressor_confidence": F.when(ticked, F.lit(TICK_CONFIDENCE))
        .otherwise(F.col("aggressor_confidence")),
        "aggressor_side": F.when(open_row, side).otherwise(F.col("aggressor_side")),
    })


def with_offset_bp(df: DataFrame, params: ClassifyParams, price: str = "price") -> DataFrame:
    """Distance from mid: for usable quotes, and in the fallback wherever a mid exists."""
    bid, ask = F.col("nbbo_bid"), F.col("nbbo_ask")
    bp = offset_bp(price, classifier_mid(bid, ask))
    if not params.use_tick_rule_fallback:
        bp = F.when(is_actionable(bid, ask, "nbbo_state"), bp)
    return df.withColumn("aggressor_offset_mid_bp", bp)


def prev_underlying_mid(df: DataFrame, cols: TradeColumns, eligible, mid: str,
                        name: str = "prev_underlying_mid") -> DataFrame:
    """Previous underlying mid recorded for the same underlying, over eligible rows only."""
    value = F.when(eligible, F.col(mid))
    out = carry_forward(df, [cols.underlying], cols.ts, [cols.ts, cols.seq], {name: value},
                        include_current=False)
    return out.withColumn(name, F.when(eligible, F.col(name)))


def alignment_eligible(cols: TradeColumns, mid: str):
    """Rows whose underlying mid is recorded: tick rule, non-zero delta and price change."""
    change = F.col(cols.price) - F.col("prev_price")
    return F.coalesce(
        (F.col("class_method") == "TickRule")
        & (F.abs(F.col(cols.delta)) > DOUBLE_EPS)
        & (F.abs(change) > DOUBLE_EPS)
        & F.col(mid).isNotNull(),
        F.lit(False),
    )


def delta_alignment(df: DataFrame, underlying_quotes: DataFrame, params: ClassifyParams,
                    cols: TradeColumns) -> DataFrame:
    """Confirm or reject tick-rule options by the move of the underlying.

    Three look-backs depend on one another here; each starts from the written result of the
    one before, so nothing below is run again."""
    joined = asof_join(
        landed(df, "ticked"), underlying_quotes, trade_key=cols.underlying, trade_ts=cols.ts, trade_seq=cols.seq,
        columns=("bid", "ask"), prefix="__u_", max_age_us=params.staleness_us,
    ).withColumn("__mid", classifier_mid("__u_bid", "__u_ask"))
    moved = prev_underlying_mid(landed(joined, "underlying-mids"), cols, alignment_eligible(cols, "__mid"), "__mid",
                                "__prev_mid")
    d_s = F.col("__mid") - F.col("__prev_mid")
    change = F.col(cols.price) - F.col("prev_price")
    agree = F.signum(F.col(cols.delta)) * F.signum(d_s) == F.signum(change)
    decided = F.coalesce(F.abs(d_s) > DOUBLE_EPS, F.lit(False))
    return moved.withColumn(
        "aggressor_confidence",
        F.when(decided, F.when(agree, F.lit(ALIGNED_CONFIDENCE))
               .otherwise(F.lit(OPPOSED_CONFIDENCE)))
        .otherwise(F.col("aggressor_confidence")),
    ).drop("__u_bid", "__u_ask", "__u_ts_ns", "__u_age_us", "__mid", "__prev_mid")


def quoted_with_previous(trades: DataFrame, quotes: DataFrame, params: ClassifyParams,
                         cols: TradeColumns = TradeColumns()) -> DataFrame:
    """The quote before each trade and the previous price, of one instrument and so in one pass."""
    look = Lookup(quotes, max_age_us=params.staleness_us)
    return asof_join_all(trades, [look], cols.instrument, cols.ts, cols.seq,
                         previous={"prev_price": F.col(cols.price)})


def classify(
    trades: DataFrame, quotes: DataFrame, params: ClassifyParams = ClassifyParams(),
    cols: TradeColumns = TradeColumns(), underlying_quotes: DataFrame | None = None,
) -> DataFrame:
    """Full classification; adds the ``nbbo_*`` snapshot and the ``aggressor_*`` columns."""
    joined = quoted_with_previous(trades, quotes, params, cols)
    out = tick_rule(quote_rule(joined, params, cols.price), params, cols.price)
    if cols.delta is not None and underlying_quotes is not None and params.use_tick_rule_fallback:
        out = delta_alignment(out, underlying_quotes, params, cols)
    out = with_offset_bp(out, params, cols.price)
    return out.withColumns({
        "tick_size_used": F.lit(params.epsilon),
        "aggressor_offset_touch_ticks": F.lit(None).cast("int"),
    }).drop("prev_price")
