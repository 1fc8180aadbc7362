"""Ordered look-back within a key, without ever putting a whole key in one task.

An instrument may hold a third of all rows, so a plain
``Window.partitionBy(instrument)`` would sort that third in one task. Here time is
cut into slices: the window runs inside (key, slice), and what a slice needs from
earlier slices is a single value, carried forward over the slice summary.

Slices are an hour long. Hours that hold too many rows of a key are found by counting first and
cut into parts, crowded parts again (``crowded_slices``), so a busy hour, or a burst
within it, spreads over tasks as quiet hours do. The summary has one row per key and slice
that has rows.
"""

from __future__ import annotations

import functools
from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.scalars import NANOS, floor_div
from tapewright.session import fresh_dir

# One hour: a symbol with 10^11 rows a month spreads over 720 tasks, and ten years of
# slices are under 90 000 summary rows per key.
SLICE_NS = 3_600 * NANOS
# A slice is crowded above this many rows, or above one part in PARTS of all rows if that is
# more: so fewer than PARTS are, which is small enough to broadcast. Crowded slices are cut into FAN.
SLICE_ROWS = 1_000_000
PARTS = 65_536
FAN = 256


def crowded_slices(
    df: DataFrame, keys: Sequence[str], ts: str, slice_ns: int = SLICE_NS,
) -> tuple[list[tuple[int, DataFrame]], DataFrame]:
    """Per round: a slice length, and the slices of this length that are too crowded, as
    ``keys, __slice``; none where no slice is crowded. Then all slices that result, in the same
    form. Reads keys and times only."""
    inside, length, depth, rounds, calm = df.select(*keys, F.col(ts).alias("__ts")), slice_ns, 0, [], []
    inside = inside.withColumn("__slice", floor_div("__ts", length) * F.lit(length).cast("bigint"))
    while True:
        sizes = landed(inside.groupBy("__slice", *keys).agg(F.count(F.lit(1)).alias("__rows")), "slice-sizes")
        total, most = sizes.agg(F.sum("__rows"), F.max("__rows")).first()
        depth = depth or max(SLICE_ROWS, (total or 0) // PARTS)
        if (most or 0) <= depth or length == 1:
            return rounds, functools.reduce(DataFrame.unionByName, [*calm, sizes.select(*keys, "__slice")])
        calm.append(sizes.where(F.col("__rows") <= depth).select(*keys, "__slice"))
        crowded = sizes.where(F.col("__rows") > depth).select(*keys, "__slice")
        rounds.append((length, crowded))
        length = max(1, length // FAN)
        inside = inside.join(F.broadcast(crowded), [*keys, "__slice"]).withColumn("__slice", _part("__ts", length))


def _part(ts: str, length: int) -> Column:
    """First time of the part of ``__slice`` that a time falls into."""
    return F.col("__slice") + floor_div(F.col(ts) - F.col("__slice"), length) * F.lit(length).cast("bigint")


def with_slice(df: DataFrame, keys: Sequence[str], ts: str, slice_ns: int = SLICE_NS) -> DataFrame:
    """df with ``__slice``, the first time of the slice that a row belongs to: an hour, or a part
    of a crowded one. A key has at most FAN slices more for each crowded one."""
    return _sliced(df, keys, ts, slice_ns)[0]


def _sliced(df: DataFrame, keys: Sequence[str], ts: str, slice_ns: int) -> tuple[DataFrame, DataFrame]:
    """``with_slice``, and all its slices as ``keys, __slice``."""
    out = df.withColumn("__slice", floor_div(ts, slice_ns) * F.lit(slice_ns).cast("bigint"))
    rounds, slices = crowded_slices(df, keys, ts, slice_ns)
    for length, crowded in rounds:
        marked = F.broadcast(crowded.withColumn("__crowded", F.lit(True)))   # fewer than PARTS rows
        out = out.join(marked, [*keys, "__slice"], "left").withColumn(
            "__slice", F.when(F.col("__crowded"), _part(ts, max(1, length // FAN))).otherwise(F.col("__slice"))
        ).drop("__crowded")
    return out, slices


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    values: dict[str, Column],
    include_current: bool = True,
    keep: Column | None = None,
    slice_ns: int = SLICE_NS,
    earlier_only: Collection[str] = (),
    sparse: bool = False,
) -> DataFrame:
    """Add, per name, the last non-null value at or before each row of its key.

    ``order`` must start with ``ts`` and be total. ``include_current=False``, or for single
    names ``earlier_only``, looks at earlier rows only. ``keep`` drops rows after the
    look-back (quotes, say). ``df`` is read twice, once for the rows and once for the slice
    summary, after a count of its keys and times: look-backs with one key belong in one call, and a look-back that needs the
    result of another should read it from a table (``landed``). ``sparse`` says that many rows hold no
    value (trades among quotes, say): the summary is then made of rows with one, and the other slices come
    from the count; inputs of a union that hold none are not read again.

    The slice comes before the keys wherever rows are sorted: it is a number, so most comparisons end at
    the sort's prefix, while keys of equal text would be compared row by row.
    """
    names = list(values)
    based, slices = _sliced(df, keys, ts, slice_ns)
    based = based.withColumns({f"__v_{n}": v for n, v in values.items()})
    place = ["__slice", *keys]

    def within(name):
        end = 0 if include_current and name not in earlier_only else -1
        return (Window.partitionBy(*place).orderBy(*order)
                .rowsBetween(Window.unboundedPreceding, end))

    near = based.withColumns({
        f"__near_{n}": F.last(f"__v_{n}", ignorenulls=True).over(within(n)) for n in names})
    if keep is not None:
        near = near.where(keep)

    # One row per key and slice, combined in the tasks first; an empty slice has null tails.
    held = functools.reduce(Column.__or__, [F.col(f"__v_{n}").isNotNull() for n in names])
    summary = (based.where(held) if sparse else based).groupBy(*place).agg(*[
        F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.struct(*order)))
        .alias(f"__tail_{n}") for n in names])
    summary = summary.withColumn("__asked", F.lit(not sparse))
    if sparse:
        summary = summary.unionByName(slices.withColumn("__asked", F.lit(True)), allowMissingColumns=True)
    # A range, as a slice is here twice where it was asked for and has a value of its own.
    before = (
        Window.partitionBy(*keys).orderBy("__slice").rangeBetween(Window.unboundedPreceding, -1)
    )
    carry = summary.select(*place, "__asked", *[
        F.last(f"__tail_{n}", ignorenulls=True).over(before).alias(f"__carry_{n}") for n in names]
    ).where("__asked").drop("__asked")
    out = near.join(carry, place, "left").withColumns({
        n: F.coalesce(f"__near_{n}", f"__carry_{n}") for n in names})
    scratch = [f"__{part}_{n}" for part in ("v", "near", "carry") for n in names]
    return out.drop("__slice", *scratch)


def landed(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared work folder and read back: the end of one pass, and the
    start of the next that depends on it."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
