"""Interest-rate curves: build, choose for a date, interpolate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.scalars import is_finite


def curve_points(yields: DataFrame) -> DataFrame:
    """Percent yields in long form to decimal rates; missing tenors and dates drop out."""
    return yields.where(F.col("curve_date").isNotNull() & F.col("yield_pct").isNotNull()).select(
        "curve_date", "tenor_years", (F.col("yield_pct") / 100.0).alias("rate"))


def build_curves(points: DataFrame, position: str | None = None) -> DataFrame:
    """One row per date: points sorted by tenor, one per tenor.

    ``position`` orders repeated tenors (the first is kept); without it the lowest rate
    is. A date without a usable point has no row.
    """
    usable = points.where((F.col("tenor_years") >= 0) & is_finite("rate"))
    rate = F.min_by("rate", position) if position else F.min("rate")
    single = usable.groupBy("curve_date", F.col("tenor_years").alias("tenor")).agg(
        rate.alias("rate"))
    return single.groupBy("curve_date").agg(
        F.array_sort(F.collect_list(F.struct("tenor", "rate"))).alias("points"))


def with_curve_rate(df: DataFrame, points: str = "points", tau: str = "tau") -> DataFrame:
    """Add ``rate`` and ``extrapolated`` at a tenor.

    Between two points ``rate * tenor`` runs along a straight line, so forwards are flat
    there: the rate leaves the longer point's as the shorter one pulls. Outside of all points the nearest
    rate holds.

    Points are sorted, so the number of shorter ones gives both neighbours. It is counted over the bare
    tenors and once: a lambda is interpreted for every point of every row.
    """
    t = F.col(tau)
    shorter = F.filter(F.col(points)["tenor"], lambda tenor: tenor < t)
    df = df.withColumn("__below", F.when(t.isNotNull(), F.size(shorter)))
    df = df.withColumns({"__short": F.get(points, F.col("__below") - 1), "__long": F.get(points, F.col("__below"))})
    a, b = F.col("__short"), F.col("__long")
    # t lies strictly above the shorter tenor, so nothing divides by zero.
    pull = a["tenor"] * (b["tenor"] - t) / (t * (b["tenor"] - a["tenor"]))
    between = b["rate"] + (a["rate"] - b["rate"]) * pull
    return df.withColumns({
        "rate": F.when(a.isNull(), b["rate"]).when(b.isNull(), a["rate"]).otherwise(between),
        "extrapolated": a.isNotNull() & b.isNull(),
    }).drop("__short", "__long", "__below")


# Days that a time in nanoseconds can fall on.
FIRST_DAY, LAST_DAY = "1677-09-21", "2262-04-11"


def curve_calendar(curves: DataFrame) -> DataFrame:
    """``dt, curve_date, points`` for every calendar day from the first to the last curve.

    A day without its own curve has the latest earlier one. Only days that a nanosecond time
    can fall on are listed, whatever dates the curves carry: at most 213 504 rows, small
    enough for one ordered window and for a broadcast.
    """
    following = F.lead("curve_date").over(Window.orderBy("curve_date"))
    until = F.coalesce(F.date_sub(following, 1), F.col("curve_date"))
    first, last = F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date")
    ranged = curves.withColumns({"__until": F.least(until, last)}).withColumn(
        "__from", F.greatest("curve_date", first)).where("__from <= __until")
    return ranged.select(
        F.explode(F.sequence("__from", "__until")).alias("dt"), "curve_date", "points")


def with_day_curve(df: DataFrame, curves: DataFrame, day: str = "dt") -> DataFrame:
    """Add ``curve_date`` and ``points``: the curve of the day, or the latest before it."""
    last = curves.agg(F.max("curve_date").alias("__last"))  # one row
    calendar = curve_calendar(curves).withColumnRenamed("dt", "__dt")
    keyed = df.crossJoin(F.broadcast(last)).withColumn("__dt", F.least(day, "__last"))
    return keyed.join(F.broadcast(calendar), "__dt", "left").drop("__dt", "__last")


def latest_curve(curves: DataFrame) -> DataFrame:
    """The newest curve."""
    return curves.orderBy(F.col("curve_date").desc()).limit(1)
