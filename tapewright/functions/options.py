"""Option pricing as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions import normal
from tapewright.functions.scalars import NANOS, is_call, is_finite

SECONDS_PER_YEAR = 31_536_000.0
MIN_TAU_YEARS = 1.0 / SECONDS_PER_YEAR


def tau_raw(expiry_ts_ns, trade_ts_ns) -> Column:
    """Years to expiry; null when expired."""
    left = F.col(expiry_ts_ns) - F.col(trade_ts_ns)
    return F.when(left > 0, left.cast("double") / float(NANOS) / SECONDS_PER_YEAR)


def tau_years(raw: Column) -> Column:
    """Years to expiry with a floor of one second."""
    return F.when(raw.isNotNull(), F.greatest(raw, F.lit(MIN_TAU_YEARS)))


def tau_clamped(raw: Column) -> Column:
    return F.coalesce(raw < MIN_TAU_YEARS - 2.220446049250313e-16, F.lit(False))


GREEK_COLUMNS = ("model_price", "delta", "gamma", "vega", "theta")


def with_price_and_greeks(df: DataFrame, direction: str, spot: str, strike: str, rate: str,
                          vol: str, tau: str, dividend: float) -> DataFrame:
    """Black-Scholes-Merton price, delta, gamma, vega and theta (per year) of each row.

    All five are null for non-positive inputs or a non-finite gamma or vega. The formula
    is laid out in small projections so that shared terms are computed once, and both tails
    come from one formula over an array: written out twice, the generated method is too long
    for the JVM to compile and runs interpreted.
    """
    c = F.col
    valid = F.coalesce((c(spot) > 0) & (c(strike) > 0) & (c(vol) > 0) & (c(tau) > 0), F.lit(False))
    df = df.withColumns({
        "__s": F.when(valid, c(spot)), "__k": F.when(valid, c(strike)),
        "__v": F.when(valid, c(vol)), "__t": F.when(valid, c(tau)),
    })
    df = df.withColumns({
        "__root": F.sqrt("__t"), "__dr": F.exp(-c(rate) * c("__t")),
        "__dq": F.exp(c("__t") * -dividend),
    })
    df = df.withColumn("__spread", c("__v") * c("__root"))
    drift = (c(rate) - dividend + c("__v") * c("__v") * 0.5) * c("__t")
    df = df.withColumn("__d1", (F.ln(c("__s") / c("__k")) + drift) / c("__spread"))
    df = df.withColumn("__d2", c("__d1") - c("__spread"))
    tails = F.transform(F.array(F.abs("__d1"), F.abs("__d2")), normal.upper_tail)
    df = df.withColumns({"__u": tails, "__dens": normal.pdf(c("__d1"))})
    df = df.withColumns({"__u1": F.get("__u", F.lit(0)), "__u2": F.get("__u", F.lit(1))})
    df = df.withColumns({
        "__n1": F.when(c("__d1") > 0, 1.0 - c("__u1")).otherwise(c("__u1")),
        "__m1": F.when(c("__d1") > 0, c("__u1")).otherwise(1.0 - c("__u1")),
        "__n2": F.when(c("__d2") > 0, 1.0 - c("__u2")).otherwise(c("__u2")),
        "__m2": F.when(c("__d2") > 0, c("__u2")).otherwise(1.0 - c("__u2")),
        "__sq": c("__s") * c("__dq"), "__kr": c("__k") * c("__dr"), "__call": is_call(direction),
    })
    df = df.withColumns({
        "gamma": c("__dq") * c("__dens") / (c("__s") * c("__spread")),
        "vega": c("__sq") * c("__dens") * c("__root"),
    })
    usable = is_finite("gamma") & is_finite("vega")
    decay = -c("__sq") * c("__dens") * c("__v") / (c("__root") * 2.0)
    call_theta = decay + c("__sq") * c("__n1") * dividend - c(rate) * c("__kr") * c("__n2")
    put_theta = decay - c("__sq") * c("__m1") * dividend + c(rate) * c("__kr") * c("__m2")
    call = c("__call")
    df = df.withColumns({
        "model_price": F.when(usable, F.when(
            call, c("__sq") * c("__n1") - c("__kr") * c("__n2"),
        ).otherwise(c("__kr") * c("__m2") - c("__sq") * c("__m1"))),
        "delta": F.when(usable, c("__dq") * F.when(call, c("__n1")).otherwise(c("__n1") - 1.0)),
        "theta": F.when(usable, F.when(call, call_theta).otherwise(put_theta)),
        "gamma": F.when(usable, c("gamma")), "vega": F.when(usable, c("vega")),
    })
    return df.drop("__s", "__k", "__v", "__t", "__root", "__dr", "__dq", "__spread", "__d1", "__d2",
                   "__u", "__u1", "__u2", "__dens", "__n1", "__m1", "__n2", "__m2",
                   "__sq", "__kr", "__call")


def price_and_vega_np(call, spot, strike, rate, dividend, vol, tau):
    """Batch price and vega for the implied-volatility search."""
    root = np.sqrt(tau)
    spread = vol * root
    d1 = (np.log(spot / strike) + (rate - dividend + 0.5 * vol * vol) * tau) / spread
    d2 = d1 - spread
    sign = np.where(call, 1.0, -1.0)
    forward, bond = spot * np.exp(-dividend * tau), strike * np.exp(-rate * tau)
    price = sign * (forward * normal.cdf_np(sign * d1) - bond * normal.cdf_np(sign * d2))
    return price, forward * normal.pdf_np(d1) * root
