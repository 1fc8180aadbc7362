"""Generated methods stay short enough for the JVM to compile (8 000 bytes)."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from tapewright.operators import features as X
from tapewright.operators import greeks as G
from tapewright.operators.ordered import landed
from tapewright.plans import queries_features as QF
from tapewright.plans import queries_options as QO


def longest_method(spark, frame) -> int:
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            frame().explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())))


def test_greeks(spark, sf_dir):
    quoted, curves = landed(QO._quoted(spark, sf_dir), "q"), landed(QO.curves(spark, sf_dir), "c")
    assert longest_method(spark, lambda: G.enrich_quoted(quoted, curves, vol=F.lit(0.3))) < 8_000


def test_exposures(spark, sf_dir):
    assert longest_method(spark, lambda: X.exposures(QF.enriched_options(spark, sf_dir, vol=F.lit(0.3)))) < 8_000


def test_underlying_price_is_finite_and_positive(spark):
    from tapewright.operators import asof
    rows = [(1.0, None), (float("nan"), 2.0), (None, 3.0), (None, None), (0.0, 4.0), (float("inf"), 5.0), (-1.0, 6.0)]
    looked = spark.createDataFrame([(a, a, p) for a, p in rows], "__u_bid double, __u_ask double, __t_price double")
    looked = looked.withColumns({f"__{p}_{c}": F.lit(None).cast("bigint") for p in "ut" for c in ("ts_ns", "age_us")})
    assert sorted(r[0] for r in asof.with_underlying_price(looked).collect()) == [1.0, 3.0]
