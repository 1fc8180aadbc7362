"""Option enrichment: underlying mid, rate, implied volatility, Greeks, reason flags."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions import options as O
from tapewright.functions.scalars import intrinsic, is_call, is_finite, utc_date
from tapewright.operators.asof import asof_underlying
from tapewright.operators.curves import with_curve_rate, with_day_curve
from tapewright.operators.ordered import SLICE_NS

# Reason flags (fixed values), one bit each.
NO_UNDERLYING = 1
NO_IV = 2
TIME_EXPIRED = 4
NO_TREASURY = 8
CROSSED_MARKET = 16
LOCKED_MARKET = 32
BAD_RATIO = 64
MID_NONPOS = 128
NBBO_STALE = 256
IV_NEWTON_FAIL = 512
PRICE_BELOW_INTRINSIC = 1024
RATE_EXTRAP = 2048
TAU_CLAMPED = 4096
IV_BISECT_FAIL = 8192
VEGA_TINY = 16384

# Numeric limits (fixed values).
RATIO_MIN, RATIO_MAX = 1e-6, 1e6
LOCK_TOLERANCE = 1e-6
MIN_VOL, MAX_VOL, START_VOL = 1e-4, 5.0, 0.3
PRICE_TOLERANCE, RELATIVE_TOLERANCE = 1e-4, 1e-6
NEWTON_STEPS, BISECT_STEPS = 50, 150
VEGA_MIN = 1e-8

# Outcomes of the volatility search.
SOLVED, SOLVED_BY_BISECTION, TINY_VEGA, UNSOLVED, INVALID, BELOW_INTRINSIC = range(6)


def underlying_mid(df: DataFrame) -> DataFrame:
    """Add ``mid`` and ``mid_flags`` from the underlying's quote (``nbbo_*``)."""
    bid, ask = F.col("nbbo_bid"), F.col("nbbo_ask")
    df = df.withColumns({
        "__bid_ok": F.coalesce(is_finite(bid) & (bid > 0), F.lit(False)),
        "__ask_ok": F.coalesce(is_finite(ask) & (ask > 0), F.lit(False)),
    })
    bid_ok, ask_ok = F.col("__bid_ok"), F.col("__ask_ok")
    near = F.abs(ask - bid) <= LOCK_TOLERANCE
    df = df.withColumns({
        "__inverted": bid_ok & ask_ok & (ask <= bid),
        "mid": F.when(bid_ok & ask_ok, (bid + ask) * 0.5).when(bid_ok, bid).when(ask_ok, ask),
    })
    inverted, mid = F.col("__inverted"), F.col("mid")
    flags = (
        F.when(F.col("nbbo_ts_ns").isNull(), F.lit(NO_UNDERLYING))
        .when(F.col("nbbo_stale"), F.lit(NBBO_STALE | NO_UNDERLYING))
        .when(inverted & near & (F.col("nbbo_state") != "Locked"),
              F.lit(LOCKED_MARKET | NO_UNDERLYING))
        .when(inverted & ~near, F.lit(CROSSED_MARKET | NO_UNDERLYING))
        .when(mid.isNull() | ~is_finite(mid), F.lit(MID_NONPOS | NO_UNDERLYING))
        .otherwise(F.lit(0))
    )
    df = df.withColumn("mid_flags", flags).withColumn("mid", F.when(F.col("mid_flags") == 0, mid))
    return df.drop("__bid_ok", "__ask_ok", "__inverted")


def _search(call, target, spot, strike, rate, tau, dividend) -> tuple[np.ndarray, np.ndarray]:
    """Newton from a fixed start, then bisection for what is left; arrays of one batch."""
    vol = np.full(len(target), np.nan)
    outcome = np.full(len(target), INVALID, dtype=np.int32)
    valid = np.isfinite(target) & (target > 0) & (spot > 0) & (strike > 0) & (tau > 0) \
        & np.isfinite(rate)
    floor = np.maximum(np.where(call, spot - strike, strike - spot), 0.0)
    under = valid & (target < floor - PRICE_TOLERANCE)
    outcome[under] = BELOW_INTRINSIC
    args = (call, spot, strike, rate, tau)

    def close(diff, want):
        return (np.abs(diff) < PRICE_TOLERANCE) | (np.abs(diff / want) < RELATIVE_TOLERANCE)

    def value(rows, sigma):
        c, s, k, r, t = (a[rows] for a in args)
        return O.price_and_vega_np(c, s, k, r, dividend, sigma, t)

    active = np.flatnonzero(valid & ~under)
    sigma = np.full(len(active), START_VOL)
    leftover = [np.empty(0, dtype=np.int64)]
    for _ in range(NEWTON_STEPS):
        if not len(active):
            break
        price, vega = value(active, sigma)
        diff = price - target[active]
        broken = ~np.isfinite(vega)  # no usable price here: on to bisection
        done = ~broken & close(diff, target[active])
        vol[active[done]], outcome[active[done]] = sigma[done], SOLVED
        tiny = ~broken & ~done & (np.abs(vega) < VEGA_MIN)
        outcome[active[tiny]] = TINY_VEGA
        leftover.append(active[broken])
        go = ~(done | tiny | broken)
        moved = sigma[go] - diff[go] / vega[go]
        finite = np.isfinite(moved)
        leftover.append(active[go][~finite])
        active, sigma = active[go][finite], np.clip(moved[finite], MIN_VOL, MAX_VOL)
    rest = np.concatenate([*leftover, active])
    if not len(rest):
        return vol, outcome

    want = target[rest]
    lowest = value(rest, np.full(len(rest), MIN_VOL))[0]
    highest = value(rest, np.full(len(rest), MAX_VOL))[0]
    outcome[rest] = UNSOLVED
    at_floor = want <= lowest
    vol[rest[at_floor]], outcome[rest[at_floor]] = MIN_VOL, SOLVED_BY_BISECTION
    keep = ~at_floor & (want <= highest)
    rest = rest[keep]
    low, high = np.full(len(rest), MIN_VOL), np.full(len(rest), MAX_VOL)
    for _ in range(BISECT_STEPS):
        if not len(rest):
            break
        middle = 0.5 * (low + high)
        diff = value(rest, middle)[0] - target[rest]
        done = close(diff, target[rest])
        vol[rest[done]], outcome[rest[done]] = middle[done], SOLVED_BY_BISECTION
        above = diff > 0
        high, low = np.where(above, middle, high)[~done], np.where(above, low, middle)[~done]
        rest = rest[~done]
    return vol, outcome


def implied_vol(direction, price: Column, spot: Column, strike: Column, rate: Column,
                tau: Column, dividend: float = 0.0) -> Column:
    """``struct<vol double, outcome int>``, solved batch-wise; null inputs give INVALID."""

    @F.pandas_udf("vol double, outcome int")
    def solve(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for call, *numbers in batches:
            with np.errstate(all="ignore"):
                vol, outcome = _search(
                    call.fillna(False).to_numpy(bool),
                    *(n.to_numpy(np.float64, na_value=np.nan) for n in numbers), dividend)
            yield pd.DataFrame({"vol": pd.Series(vol).where(~np.isnan(vol)), "outcome": outcome})

    return solve(is_call(direction), price, spot, strike, rate, tau)


_SOLVER_FLAGS = {
    SOLVED: 0,
    SOLVED_BY_BISECTION: IV_NEWTON_FAIL,
    TINY_VEGA: VEGA_TINY | IV_NEWTON_FAIL | NO_IV,
    UNSOLVED: IV_BISECT_FAIL | IV_NEWTON_FAIL | NO_IV,
    INVALID: NO_IV,
    BELOW_INTRINSIC: PRICE_BELOW_INTRINSIC | NO_IV,
}


def pricing_inputs(quoted: DataFrame, curves: DataFrame) -> DataFrame:
    """Everything up to the volatility: curve, mid, time, rate, and the flags so far.

    ``quoted`` carries ``nbbo_*`` of the underlying. Adds ``curve_date``, ``mid``, ``tau``,
    ``rate``, ``priced`` (the row goes on to a volatility) and ``greeks_flags``.
    """
    dated = with_day_curve(quoted.withColumn("__day", utc_date("trade_ts_ns")), curves, "__day")
    raw = O.tau_raw("expiry_ts_ns", "trade_ts_ns")
    staged = underlying_mid(dated).withColumn("__raw", raw).withColumn(
        "tau", O.tau_years(F.col("__raw")))
    staged = with_curve_rate(staged).withColumnsRenamed(
        {"rate": "__rate", "extrapolated": "__extrapolated"})

    strike, mid, price = F.col("strike_price"), F.col("mid"), F.col("price")
    ratio = mid / F.when(strike > 0, strike)
    bad_ratio = ~is_finite(strike) | (strike <= 0) | ~F.coalesce(
        ratio.between(RATIO_MIN, RATIO_MAX), F.lit(False))
    stop = (
        F.when(F.col("points").isNull(), F.lit(NO_TREASURY))
        .when(F.col("mid_flags") != 0, F.col("mid_flags"))
        .when(bad_ratio, F.lit(BAD_RATIO))
        .when(F.col("tau").isNull(), F.lit(TIME_EXPIRED))
        .otherwise(F.lit(0))
    )
    soft = (
        F.when(O.tau_clamped(F.col("__raw")), F.lit(TAU_CLAMPED)).otherwise(F.lit(0))
        .bitwiseOR(F.when(F.col("__extrapolated"), F.lit(RATE_EXTRAP)).otherwise(F.lit(0)))
    )
    floor = intrinsic("contract_direction", mid, strike)
    late = (
        F.when(~is_finite(price) | (price <= 0), F.lit(NO_IV))
        .when(price < floor - PRICE_TOLERANCE, F.lit(PRICE_BELOW_INTRINSIC | NO_IV))
        .otherwise(F.lit(0))
    )
    out = staged.withColumns({"__stop": stop, "__late": late}).withColumns({
        "rate": F.when(F.col("__stop") == 0, F.col("__rate")),
        "priced": (F.col("__stop") == 0) & (F.col("__late") == 0),
        "greeks_flags": F.when(F.col("__stop") != 0, F.col("__stop"))
        .otherwise(soft.bitwiseOR(F.col("__late"))),
    })
    return out.drop("__day", "__raw", "__rate", "__extrapolated", "__stop", "__late", "points")


def with_greeks(inputs: DataFrame, dividend: float = 0.0, iv: str | None = None) -> DataFrame:
    """Add iv, delta, gamma, vega, theta to priced rows and complete the flags.

    ``iv`` names a column of known volatilities; rows without a usable one are solved.
    """
    ready = F.col("priced")
    df = inputs
    spot, strike = F.col("mid"), F.col("strike_price")
    known = F.lit(None).cast("double")
    if iv is not None:
        usable = is_finite(iv) & F.col(iv).between(MIN_VOL, MAX_VOL)
        known = F.when(usable, F.col(iv))
    df = df.withColumn("__known", known)
    search = ready & F.col("__known").isNull()
    df = df.withColumn("__solved", implied_vol(
        "contract_direction", F.when(search, F.col("price")), spot, strike, F.col("rate"),
        F.col("tau"), dividend,
    ))
    outcome_flags = F.lit(0)
    for outcome, flag in _SOLVER_FLAGS.items():
        if flag:
            outcome_flags = F.when(F.col("__solved.outcome") == outcome, F.lit(flag)) \
                .otherwise(outcome_flags)
    df = df.withColumns({
        "__vol": F.when(ready, F.coalesce(F.col("__known"), F.col("__solved.vol"))),
        "greeks_flags": F.col("greeks_flags").bitwiseOR(
            F.when(search, outcome_flags).otherwise(F.lit(0))),
    })
    return _apply_greeks(df, dividend)


def with_known_vol(inputs: DataFrame, vol: Column, dividend: float = 0.0) -> DataFrame:
    """The closed-form part alone, every row at a given volatility; no Python worker."""
    return _apply_greeks(inputs.withColumn("__vol", F.when(F.col("priced"), vol)), dividend)


def _apply_greeks(df: DataFrame, dividend: float) -> DataFrame:
    df = O.with_price_and_greeks(df, "contract_direction", "mid", "strike_price", "rate",
                                 "__vol", "tau", dividend)
    failed = F.col("__vol").isNotNull() & F.col("gamma").isNull()
    return df.withColumns({
        "iv": F.when(F.col("gamma").isNotNull(), F.col("__vol")),
        "greeks_flags": F.col("greeks_flags").bitwiseOR(
            F.when(failed, F.lit(NO_IV)).otherwise(F.lit(0))).cast("bigint"),
    }).drop("__vol", "__known", "__solved", "model_price")


def enrich_greeks(
    option_trades: DataFrame, underlying_quotes: DataFrame, curves: DataFrame,
    staleness_us: int, dividend: float = 0.0, iv: str | None = None,
    vol: Column | None = None, slice_ns: int = SLICE_NS,
) -> DataFrame:
    """Whole enrichment: quote, curve, mid, volatility, Greeks and flags per option trade.

    With ``vol`` all rows use that volatility instead of solving for one.
    """
    quoted = asof_underlying(option_trades, underlying_quotes, staleness_us, slice_ns)
    return enrich_quoted(quoted, curves, dividend, iv, vol)


def enrich_quoted(quoted: DataFrame, curves: DataFrame, dividend: float = 0.0, iv: str | None = None,
                  vol: Column | None = None) -> DataFrame:
    """The enrichment from an attached underlying quote on."""
    inputs = pricing_inputs(quoted, curves)
    return with_known_vol(inputs, vol, dividend) if vol is not None \
        else with_greeks(inputs, dividend, iv)


def overlay(enriched: DataFrame, engine_version: str, run_id: str, enriched_at_ns: Column,
            uid: str = "trade_uid") -> DataFrame:
    """The 22-column overlay; the curve's own date and the requested date keep their names."""
    return enriched.select(
        F.col(uid).alias("trade_uid"), "trade_ts_ns", "contract", "underlying", "delta", "gamma",
        "vega", "theta", "iv", "greeks_flags", "nbbo_bid", "nbbo_ask", "nbbo_bid_sz",
        "nbbo_ask_sz", "nbbo_ts_ns", "nbbo_age_us", "nbbo_state",
        F.lit(engine_version).alias("engine_version"),
        utc_date("trade_ts_ns").cast("string").alias("treasury_curve_date"),
        F.col("curve_date").cast("string").alias("treasury_curve_source_date"),
        enriched_at_ns.cast("bigint").alias("enriched_at_ns"), F.lit(run_id).alias("run_id"),
    )
