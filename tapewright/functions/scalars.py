"""Scalar column functions for trades and quotes. All of them stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS = 1_000_000_000
DAY_NS = 86_400 * NANOS
LONG_MAX = 9_223_372_036_854_775_807
INT_MIN, INT_MAX = -2_147_483_648, 2_147_483_647
LOCK_EPS = 2.220446049250313e-16  # spacing of doubles at 1.0

OPTION_TAG = "O:"
CONTRACT_TAIL = 15  # yymmdd + right + eight strike digits


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_finite(value) -> Column:
    """True for ordinary doubles; false for null, NaN and infinities."""
    x = _c(value)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def lenient(value, kind: str, default=0) -> Column:
    """Parse text as ``kind``; text that does not parse gives ``default``."""
    return F.coalesce(F.trim(_c(value)).try_cast(kind), F.lit(default).cast(kind))


def parse_conditions(value) -> Column:
    """Comma text to ``array<int>``; items that are not integers are dropped."""
    items = F.transform(F.split(_c(value), ","), lambda t: F.trim(t).try_cast("int"))
    return F.coalesce(F.filter(items, lambda i: i.isNotNull()), F.array().cast("array<int>"))


def ms_to_ns(value) -> Column:
    """Milliseconds to nanoseconds, saturating at the ends of ``bigint``."""
    ms = _c(value).cast("bigint")
    edge = F.when(ms < 0, F.lit(-LONG_MAX - 1)).otherwise(F.lit(LONG_MAX))
    return F.when(ms.isNotNull(),
                  F.coalesce(F.try_multiply(ms, F.lit(1_000_000).cast("bigint")), edge))


def floor_div(value, width) -> Column:
    """Floor division within ``bigint``, for negative times too."""
    x = _c(value)
    w = F.lit(width).cast("bigint") if isinstance(width, int) else _c(width)
    return _exact_div(x - F.pmod(x, w), w)


def _exact_div(x: Column, w: Column) -> Column:
    return F.call_function("div", x, w)


def ts_from_ns(value) -> Column:
    """Nanoseconds to a (microsecond) timestamp, rounding down."""
    return F.timestamp_micros(floor_div(value, 1_000))


def utc_date(value) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), floor_div(value, DAY_NS).cast("int"))


def utc_hour(value) -> Column:
    x = _c(value)
    return _exact_div(F.pmod(x, F.lit(DAY_NS)), F.lit(3_600 * NANOS)).cast("int")


def quote_state(bid, ask) -> Column:
    b, a = _c(bid), _c(ask)
    return (
        F.when(b > a, F.lit("Crossed"))
        .when(F.abs(b - a) < F.lit(LOCK_EPS), F.lit("Locked"))
        .otherwise(F.lit("Normal"))
    )


def file_quote_state(bid, ask) -> Column:
    """Quote state of the file feed: a quote without an ask is never crossed or locked."""
    return F.when(_c(ask) > 0, quote_state(bid, ask)).otherwise(F.lit("Normal"))


def classifier_mid(bid, ask) -> Column:
    """Average when there is an ask; else a positive bid; else null."""
    b, a = _c(bid), _c(ask)
    return F.when(is_finite(a) & (a > 0), (b + a) * 0.5).when(is_finite(b) & (b > 0), b)


def live_mid(bid, ask) -> Column:
    b, a = _c(bid), _c(ask)
    return F.when(a > 0, (b + a) * 0.5).otherwise(b)


def is_actionable(bid, ask, state) -> Column:
    """Quote usable for classification."""
    b, a = _c(bid), _c(ask)
    return F.coalesce((_c(state) == "Normal") & is_finite(a) & is_finite(b) & (a > b), F.lit(False))


def offset_bp(price, mid) -> Column:
    """Signed distance from mid in basis points, half away from zero, clamped to int."""
    p, m = _c(price), _c(mid)
    raw = F.try_divide(p - m, m) * 10_000.0
    # floor(|x| + 0.5) avoids the decimal detour of round() on doubles.
    rounded = F.signum(raw) * F.floor(F.abs(raw) + 0.5).cast("double")
    clamped = F.greatest(F.least(rounded, F.lit(float(INT_MAX))), F.lit(float(INT_MIN)))
    return F.when(is_finite(raw), clamped.cast("int"))


def is_call(direction) -> Column:
    return _c(direction).isin("C", "c")


def intrinsic(direction, spot, strike) -> Column:
    s, k = _c(spot), _c(strike)
    return F.greatest(F.when(is_call(direction), s - k).otherwise(k - s), F.lit(0.0))


def buy_probability(side, confidence) -> Column:
    c = F.greatest(F.least(F.coalesce(_c(confidence), F.lit(1.0)), F.lit(1.0)), F.lit(0.0))
    s = _c(side)
    return F.when(s == "Buyer", c).when(s == "Seller", 1.0 - c).otherwise(F.lit(0.5))


# --------------------------------------------------------------- contract text
def _well_formed(contract: Column) -> Column:
    return contract.startswith(OPTION_TAG) & (F.length(contract) >= len(OPTION_TAG) + CONTRACT_TAIL)


def _from_right(contract: Column, back: int, length: int) -> Column:
    return F.substring(contract, F.length(contract) - F.lit(back - 1), F.lit(length))


def contract_direction(contract) -> Column:
    c = _c(contract)
    return F.when(_well_formed(c), _from_right(c, 9, 1)).otherwise(F.lit("C"))


def contract_strike(contract) -> Column:
    c = _c(contract)
    digits = _from_right(c, 8, 8)
    value = F.when(digits.rlike("^[0-9]{8}$"), digits.try_cast("double") / 1000.0)
    return F.when(_well_formed(c), F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0))


def contract_expiry_ns(contract, hint=None, cutoff_ns: int = 0) -> Column:
    """``cutoff_ns`` after midnight UTC of the expiry date; a malformed contract or date gives
    the hint (or 0). At the default of midnight an option of the same day counts as expired."""
    c = _c(contract)
    fallback = F.coalesce(_c(hint), F.lit(0)).cast("bigint") if hint is not None \
        else F.lit(0).cast("bigint")
    text = F.concat(F.lit("20"), _from_right(c, 15, 2), F.lit("-"), _from_right(c, 13, 2),
                    F.lit("-"), _from_right(c, 11, 2))
    day = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))
    ns = F.unix_date(day).cast("bigint") * F.lit(DAY_NS) + F.lit(cutoff_ns).cast("bigint")
    return F.when(_well_formed(c), F.coalesce(ns, fallback)).otherwise(fallback)


def contract_underlying(contract) -> Column:
    c = _c(contract)
    root = F.substring(c, F.lit(3), F.length(c) - F.lit(len(OPTION_TAG) + CONTRACT_TAIL))
    return F.when(_well_formed(c), root).otherwise(F.lit(""))


def parse_contract(df, contract: str = "contract", hint: str | None = None, cutoff_ns: int = 0):
    """Add direction, strike, expiry and underlying columns parsed from the contract text."""
    return df.withColumns({
        "contract_direction": contract_direction(contract),
        "strike_price": contract_strike(contract),
        "expiry_ts_ns": contract_expiry_ns(contract, hint, cutoff_ns),
        "underlying": contract_underlying(contract),
    })


# ----------------------------------------------------------- partition prefixes
def _prefix(text: Column, length: int) -> Column:
    kept = F.substring(F.regexp_replace(text, "[^A-Za-z0-9]", ""), 1, length)
    return F.upper(F.when(kept == "", F.lit("X")).otherwise(kept))


def option_prefix(contract) -> Column:
    c = _c(contract)
    root = F.regexp_extract(c, "^O:([A-Za-z]+)", 1)
    return F.when(root != "", _prefix(root, 3)).otherwise(_prefix(c, 3))


def equity_prefix(symbol) -> Column:
    return _prefix(_c(symbol), 2)


def instrument_prefix(instrument) -> Column:
    i = _c(instrument)
    return F.when(i.startswith(OPTION_TAG), option_prefix(i)).otherwise(_prefix(i, 2))


# ----------------------------------------------------------------- identifiers
# Domain tags (fixed values).
OPTION_UID_TAG = "tapewright/trade/option"
EQUITY_UID_TAG = "tapewright/trade/equity"
QUOTE_UID_TAG = "tapewright/quote"


def _uid_part(value: Column) -> Column:
    """``length:text`` for a value and ``~`` for null, so that no two field lists collide."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))


def price_text(price) -> Column:
    """Price in integer nano-units, the same text on every engine; null when not finite."""
    p = _c(price)
    return F.when(is_finite(p), F.round(p * 1e9).try_cast("bigint")).cast("string")


def conditions_text(conditions) -> Column:
    return F.array_join(F.coalesce(_c(conditions), F.array().cast("array<int>")), ",")


def uid(tag: str, *fields: Column) -> Column:
    """128-bit id: the first half of SHA-256 over the domain tag and the fields."""
    text = F.concat(_uid_part(F.lit(tag)), *[_uid_part(f) for f in fields])
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def option_trade_uid(contract, trade_ts_ns, participant_ts_ns, price, size, exchange,
                     conditions) -> Column:
    return uid(OPTION_UID_TAG, _c(contract), _c(trade_ts_ns), _c(participant_ts_ns),
               price_text(price), _c(size), _c(exchange), conditions_text(conditions))


def equity_trade_uid(symbol, trade_ts_ns, participant_ts_ns, seq, price, size, exchange,
                     trade_id, correction, conditions) -> Column:
    return uid(EQUITY_UID_TAG, _c(symbol), _c(trade_ts_ns), _c(participant_ts_ns), _c(seq),
               price_text(price), _c(size), _c(exchange), _c(trade_id), _c(correction),
               conditions_text(conditions))


def quote_uid(instrument, quote_ts_ns, seq, bid, ask, bid_sz, ask_sz, bid_venue, ask_venue,
              condition) -> Column:
    return uid(QUOTE_UID_TAG, _c(instrument), _c(quote_ts_ns), _c(seq), price_text(bid),
               price_text(ask), _c(bid_sz), _c(ask_sz), _c(bid_venue), _c(ask_venue),
               _c(condition))


def uid_hex(value) -> Column:
    return F.lower(F.hex(_c(value)))


# ---------------------------------------------------------------- enumerations
def enum_or(value, allowed, default) -> Column:
    """Keep a value of the closed list; anything else becomes the default (or null)."""
    v = _c(value)
    return F.when(v.isin(*allowed), v).otherwise(
        F.lit(default) if default is not None else F.lit(None).cast("string"))
