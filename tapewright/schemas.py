"""Fixed table schemas, bound by name.

Times are epoch nanoseconds held as ``bigint`` (``*_ts_ns``); unsigned 32-bit
counters are ``bigint``; ids are 16-byte ``binary``.
"""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(),
    "bigint": T.LongType(), "smallint": T.ShortType(), "binary": T.BinaryType(),
    "date": T.DateType(), "array<int>": T.ArrayType(T.IntegerType()),
}


def _struct(columns: str) -> T.StructType:
    """Build a StructType from ``name type [NOT NULL], ...``; needs no session."""
    fields = []
    for column in columns.split(","):
        name, kind, *rest = column.split()
        fields.append(T.StructField(name, _TYPES[kind], nullable=not rest))
    return T.StructType(fields)


_NBBO_ON_TRADE = """
  nbbo_bid double, nbbo_ask double, nbbo_bid_sz bigint, nbbo_ask_sz bigint,
  nbbo_ts_ns bigint, nbbo_age_us bigint, nbbo_state string
"""
_CLASS_ON_TRADE = """
  aggressor_side string NOT NULL, class_method string NOT NULL,
  aggressor_offset_mid_bp int, aggressor_offset_touch_ticks int, aggressor_confidence double
"""
_BATCH_META = """
  source string NOT NULL, quality string NOT NULL, watermark_ts_ns bigint NOT NULL
"""

OPTION_TRADES = _struct(f"""
  contract string NOT NULL, trade_uid binary NOT NULL, contract_direction string NOT NULL,
  strike_price double NOT NULL, underlying string NOT NULL, trade_ts_ns bigint NOT NULL,
  price double NOT NULL, size bigint NOT NULL, conditions array<int>, exchange int NOT NULL,
  expiry_ts_ns bigint NOT NULL, {_CLASS_ON_TRADE}, {_NBBO_ON_TRADE},
  tick_size_used double, {_BATCH_META}
""")

EQUITY_TRADES = _struct(f"""
  symbol string NOT NULL, trade_uid binary NOT NULL, trade_ts_ns bigint NOT NULL,
  price double NOT NULL, size bigint NOT NULL, conditions array<int>, exchange int NOT NULL,
  {_CLASS_ON_TRADE}, {_NBBO_ON_TRADE}, tick_size_used double, {_BATCH_META},
  trade_id string, seq bigint, participant_ts_ns bigint, tape string, correction int,
  trf_id string, trf_ts_ns bigint
""")

QUOTES = _struct(f"""
  instrument_id string NOT NULL, quote_uid binary NOT NULL, quote_ts_ns bigint NOT NULL,
  bid double NOT NULL, ask double NOT NULL, bid_sz bigint NOT NULL, ask_sz bigint NOT NULL,
  state string NOT NULL, condition int, best_bid_venue int, best_ask_venue int, {_BATCH_META}
""")

GREEKS_OVERLAY = _struct(f"""
  trade_uid binary NOT NULL, trade_ts_ns bigint NOT NULL, contract string NOT NULL,
  underlying string NOT NULL, delta double, gamma double, vega double, theta double, iv double,
  greeks_flags bigint NOT NULL, {_NBBO_ON_TRADE}, engine_version string NOT NULL,
  treasury_curve_date string, treasury_curve_source_date string,
  enriched_at_ns bigint NOT NULL, run_id string NOT NULL
""")

PROGRESS = _struct("symbol string NOT NULL, max_hour smallint NOT NULL, updated_ns bigint NOT NULL")

RUN_LOG = _struct("""
  dataset string NOT NULL, run_date string NOT NULL, run_id string NOT NULL,
  state string NOT NULL, reason string, updated_ns bigint NOT NULL
""")

# One line per file of a run, so that a manifest of any length is written in parallel.
MANIFEST = _struct("""
  dataset string, date string, run_id string, schema_version int, generated_ns bigint,
  relative_path string, rows bigint, min_ts_ns bigint, max_ts_ns bigint,
  min_trade_uid string, max_trade_uid string
""")

CURVE_POINTS = _struct("curve_date date, tenor_years double, rate double")

# Closed value lists of the string-typed enumerations (fixed values).
SOURCES = ("Flatfile", "Rest", "Ws")
QUALITIES = ("Prelim", "Enriched", "Final")
COMPLETENESS = ("Complete", "Partial", "Unknown")
AGGRESSOR_SIDES = ("Buyer", "Seller", "Unknown")
CLASS_METHODS = ("NbboTouch", "NbboAtOrBeyond", "TickRule", "Unknown")
NBBO_STATES = ("Normal", "Locked", "Crossed")
RUN_STATES = ("Pending", "InFlight", "Blocked", "Published")

# ---------------------------------------------------------------- feature row
# The nine value series of a window and the statistics each one exports.
UNDERLYING_SERIES = "underlying_dollar_value"
EXPOSURES = ("dadvv", "signed_dadvv", "gadvv", "signed_gadvv")
SERIES = (UNDERLYING_SERIES,) + tuple(f"{r}_{e}" for r in ("puts", "calls") for e in EXPOSURES)
STAT_NAMES = (
    "total", "minimum", "maximum", "mean", "stddev", "skew", "kurtosis",
    "iqr", "mad", "cv", "mode", "bc", "dip_pval", "kde_peaks",
)
_METHOD_COLUMNS = ("touch", "at_or_beyond", "tick_rule", "unknown")


def _series_columns(series: str) -> list[str]:
    names = list(STAT_NAMES)
    if series in ("calls_gadvv", "calls_signed_gadvv"):
        names[2:2] = ["q1", "q2", "q3"]
    return [f"{series}_{name}" for name in names]


def _right_head(right: str) -> list[str]:
    return [f"{right}_aggressor_unknown_pct"] + [
        f"{right}_classifier_{m}_pct" for m in _METHOD_COLUMNS
    ]


def feature_metric_columns() -> list[str]:
    """The 150 metric columns of a feature row, in schema order."""
    columns = [f"underlying_price_{p}" for p in ("open", "high", "low", "close")]
    columns += _series_columns(UNDERLYING_SERIES)
    columns += ["puts_below_intrinsic_pct", "puts_above_intrinsic_pct"] + _right_head("puts")
    for exposure in EXPOSURES:
        columns += _series_columns(f"puts_{exposure}")
    columns += ["calls_dollar_value", "calls_above_intrinsic_pct"] + _right_head("calls")
    for exposure in EXPOSURES:
        columns += _series_columns(f"calls_{exposure}")
    return columns


FEATURE_KEYS = ("symbol", "window", "window_start_ns", "window_end_ns")

AGGREGATIONS = T.StructType(
    [T.StructField(k, T.LongType() if k.endswith("_ns") else T.StringType(), False)
     for k in FEATURE_KEYS]
    + [T.StructField(c, T.DoubleType(), True) for c in feature_metric_columns()]
)
