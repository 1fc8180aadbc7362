"""Hartigan's dip statistic and its p-values.

The statistic follows Hartigan & Hartigan (1985): the distance between the empirical
distribution and the closest unimodal one, found by shrinking a modal interval between
the greatest convex minorant and the least concave majorant. It works on distinct
values with counts. P-values come from uniform samples simulated as a Spark job, since
the null distribution depends on the sample size alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.operators.ordered import landed
from tapewright.operators.stats import finite_values, runs, value_bin
from tapewright.session import fresh_dir

# Distinct values one task handles at a time.
SLICE_POINTS = 200_000
# Points of a simulated sample drawn at a time.
SAMPLE_POINTS = 100_000
# Tasks of a simulation. A number must be named: draws are few bytes, so run-time re-planning
# would otherwise merge them into a task or two, however long they take.
DRAW_TASKS = 256

# Sizes at which the null distribution is tabulated, and its levels (fixed values).
TABLE_SIZES = (4, 5, 6, 7, 8, 9, 10, 15, 20, 30, 50, 100, 200, 500, 1000, 2000, 5000, 10000,
               20000, 40000, 72000)
TABLE_LEVELS = (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98,
                0.99, 0.995, 0.998, 0.999, 0.9995, 0.9998, 0.9999, 0.99995, 0.99998, 0.99999, 1.0)
MAX_TABLE_SIZE = 72_000


def _lower_hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions of the lower convex hull, by dropping points on or above a chord of their
    neighbours until none is left to drop."""
    kept = np.arange(len(x))
    while len(kept) > 2:
        slope = np.diff(y[kept]) / np.diff(x[kept])
        convex = slope[:-1] < slope[1:]
        if convex.all():
            break
        kept = kept[np.concatenate(([True], convex, [True]))]
    return kept


def dip(x: np.ndarray, counts: np.ndarray, allow_zero: bool = True) -> dict:
    """Dip of sorted distinct values with counts: statistic and modal interval."""
    after = np.cumsum(counts).astype(float)
    return dip_of_limits(x, after - counts, after, allow_zero)


def dip_of_limits(x: np.ndarray, before: np.ndarray, after: np.ndarray, allow_zero: bool = True) -> dict:
    """Dip from the distribution's left and right limits (as counts) at sorted points.

    ``lo``/``hi`` are positions of the modal interval among the points, ``gcm`` and ``lcm``
    the hull positions within it, ``trail`` every position that bounded the interval.
    """
    total = int(after[-1])
    counts = after - before
    floor = 0.0 if allow_zero else 1.0
    low, high = 0, len(x) - 1
    trail = []
    best = floor
    gcm = lcm = np.array([low, high]) if high else np.array([0])
    while high > low:
        span = slice(low, high + 1)
        gcm = low + _lower_hull(x[span], before[span])
        lcm = low + _lower_hull(x[span], -after[span])
        # Knots at which the two hulls are compared; an end counts only when it is tied.
        g_in = gcm[1:] if counts[high] > 1 else gcm[1:-1]
        l_in = lcm[:-1] if counts[low] > 1 else lcm[1:-1]
        gaps = [floor]
        bounds = [(low, high)]
        if len(g_in):
            gap = np.interp(x[g_in], x[lcm], after[lcm]) - before[g_in]
            at = len(gap) - 1 - int(np.argmax(gap[::-1]))
            gaps.append(gap[at])
            bounds.append((g_in[at], lcm[np.searchsorted(lcm, g_in[at])]))
        if len(l_in):
            gap = after[l_in] - np.interp(x[l_in], x[gcm], before[gcm])
            at = len(gap) - 1 - int(np.argmax(gap[::-1]))
            gaps.append(gap[at])
            bounds.append((gcm[np.searchsorted(gcm, l_in[at], side="right") - 1], l_in[at]))
        pick = int(np.argmax(gaps[1:])) + 1 if len(gaps) > 1 else 0
        left, right = bounds[pick]
        if gaps[pick] < best:
            break
        outer = 0.0
        if left > low:
            rows = np.arange(low, left)
            outer = max(1.0, (after[rows] - np.interp(x[rows], x[gcm], before[gcm])).max())
        if right < high:
            rows = np.arange(right + 1, high + 1)
            outer = max(1.0, outer, (np.interp(x[rows], x[lcm], after[lcm]) - before[rows]).max())
        best = max(best, outer)
        trail += [int(left), int(right)]
        if (left, right) == (low, high):
            break
        low, high = int(left), int(right)
    return {"dip": best / (2 * total), "lo": low, "hi": high, "gcm": gcm, "lcm": lcm, "trail": trail}


def skeleton(x: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Positions of a slice that decide hulls and distances while the modal interval's ends
    lie in other slices: both hulls and, between neighbouring vertices of the one, the
    vertices of the opposite hull."""
    kept = []
    for hull, opposite in ((_lower_hull(x, before), -after), (_lower_hull(x, -after), before)):
        kept.append(hull)
        for i, j in zip(hull[:-1], hull[1:]):
            if j - i > 1:
                kept.append(i + _lower_hull(x[i:j + 1], opposite[i:j + 1]))
    return np.unique(np.concatenate(kept))


def dip_of(sample: Sequence[float], allow_zero: bool = False, sort: bool = True) -> float:
    """Dip of one local sample; empty, non-finite or (unless ``sort``) unsorted data is an error."""
    data = np.asarray(sample, dtype=float)
    if not len(data):
        raise ValueError("empty sample")
    if not np.isfinite(data).all():
        raise ValueError("sample has non-finite values")
    if not sort and (np.diff(data) < 0).any():
        raise ValueError("sample is not sorted")
    values, counts = np.unique(data, return_counts=True)
    return dip(values, counts, allow_zero)["dip"]


def _sliced(values: DataFrame, keys: list[str], x: str, slice_points: int) -> DataFrame:
    """Values of each group in slices of neighbouring values: those of a group of at most ``slice_points`` values as they
    come (``c`` is null), distinct ones as sorted arrays with counts for others. ``values`` is read twice or more."""
    rows = finite_values(values, x).select(*keys, (F.col(x) + 0.0).alias("x"))
    sizes = landed(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), "dip-sizes")
    large = sizes.where(F.col("__n") > slice_points).select(*keys)   # fewer than one in slice_points rows
    split = not large.isEmpty()
    few = rows.join(large, keys, "left_anti") if split else rows
    whole = few.groupBy(*keys).agg(F.collect_list("x").alias("x")).select(
        *keys, F.lit(0).alias("slice"), F.lit(0).cast("bigint").alias("start"), "x", F.lit(None).cast("array<bigint>").alias("c"))
    return whole.unionByName(_cut(rows.join(large, keys, "left_semi"), keys, slice_points)) if split else whole


def _cut(values: DataFrame, keys: list[str], slice_points: int) -> DataFrame:
    """Slices of large groups. Slice bounds come from counts per value bin, so no task sees more than a slice."""
    counted = landed(runs(values, keys, "x"), "dip-runs").withColumn("__bin", value_bin(F.col("x")))
    bins = counted.groupBy(*keys, "__bin").agg(
        F.sum("c").alias("__in"), F.count(F.lit(1)).alias("__k"))
    up_to = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    points_before = F.sum("__k").over(up_to) - F.col("__k")
    bins = bins.select(
        *keys, "__bin", F.floor(points_before / F.lit(slice_points)).cast("int").alias("slice"),
        (F.sum("__in").over(up_to) - F.col("__in")).alias("__before"))
    placed = counted.join(bins, [*keys, "__bin"])
    return placed.groupBy(*keys, "slice").agg(
        F.min("__before").alias("start"), F.sort_array(F.collect_list(F.struct("x", "c"))).alias("p")
    ).select(*keys, "slice", "start", F.col("p.x").alias("x"), F.col("p.c").alias("c"))


def _limits(start: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    after = start + np.cumsum(counts).astype(float)
    return after - counts, after


def dip_statistic(values: DataFrame, keys: Sequence[str], x: str, allow_zero: bool = True,
                  slice_points: int = SLICE_POINTS) -> DataFrame:
    """Dip and modal interval per group, exact for groups of any size.

    A group of one slice is solved as it is. In a larger group every slice is reduced to its
    skeleton, which gives the exact result as long as the modal interval's ends stay out of
    reduced slices; slices the ends fall into are taken whole in another round.
    """
    keys = list(keys)
    spark = values.sparkSession
    path = fresh_dir(spark, "dip-slices")
    _sliced(values, keys, x, slice_points).write.option("compression", "zstd").parquet(path)
    sliced = spark.read.parquet(path)
    key_fields = [sliced.schema[k] for k in keys]
    part_schema = T.StructType(key_fields + [
        T.StructField("slice", T.IntegerType()), T.StructField("whole", T.BooleanType()),
    ] + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("x", "before", "after")])
    out_schema = T.StructType(key_fields + [
        T.StructField("n", T.LongType()), T.StructField("dip", T.DoubleType()),
        T.StructField("modal_low", T.DoubleType()), T.StructField("modal_high", T.DoubleType()),
        T.StructField("needed", T.ArrayType(T.IntegerType())),
    ])

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            xs, befores, afters = [], [], []
            for start, v, c, whole in zip(batch["start"], batch["x"], batch["c"], batch["whole"]):
                v = np.asarray(v)
                v, c = np.unique(v, return_counts=True) if c is None else (v, np.asarray(c))
                before, after = _limits(start, c)
                rows = np.arange(len(v)) if whole else skeleton(v, before, after)
                xs.append(v[rows]), befores.append(before[rows]), afters.append(after[rows])
            yield batch[keys + ["slice", "whole"]].assign(x=xs, before=befores, after=afters)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for parts in batch["parts"]:
                v, before, after = (np.concatenate([np.asarray(p[n]) for p in parts])
                                    for n in ("x", "before", "after"))
                owner = np.repeat(np.arange(len(parts)), [len(p["x"]) for p in parts])
                found = dip_of_limits(v, before, after, allow_zero)
                reached = {int(owner[i]) for i in found["trail"]}
                needed = [int(parts[i]["slice"]) for i in sorted(reached) if not parts[i]["whole"]]
                rows.append((int(after[-1]), found["dip"], v[found["lo"]], v[found["hi"]], needed))
            yield pd.concat([batch[keys].reset_index(drop=True), pd.DataFrame(
                rows, columns=["n", "dip", "modal_low", "modal_high", "needed"])], axis=1)

    def round_of(slices: DataFrame) -> DataFrame:
        parts = slices.mapInPandas(reduce, part_schema)
        gathered = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(
            F.struct("slice", "whole", "x", "before", "after"))).alias("parts"))
        return gathered.mapInPandas(solve, out_schema)

    single = sliced.groupBy(*keys).agg((F.count(F.lit(1)) == 1).alias("whole"))
    marked = sliced.join(single, keys)
    results = round_of(marked)
    # Groups of one slice are always solved; rounds are only for larger ones, if any.
    if sliced.where(F.col("slice") > 0).isEmpty():
        return results.drop("needed")
    solved = []
    while True:
        done = fresh_dir(spark, "dip-round")
        results.write.parquet(done)
        results = spark.read.parquet(done)
        solved.append(results.where(F.size("needed") == 0))
        open_groups = results.where(F.size("needed") > 0).select(*keys, F.col("needed").alias("__more"))
        if open_groups.isEmpty():
            break
        marked = marked.join(open_groups, keys).withColumn(
            "whole", F.col("whole") | F.array_contains("__more", F.col("slice"))).drop("__more")
        results = round_of(marked)
    whole = solved[0]
    for more in solved[1:]:
        whole = whole.unionByName(more)
    return whole.drop("needed")


# --------------------------------------------------------------- null distribution
def _uniform_slice(bounds: np.ndarray, sizes: np.ndarray, seed: tuple, k: int) -> np.ndarray:
    """Slice k of a sorted uniform sample. Its last point is its upper bound; given that, the
    others are independent and uniform between the bounds."""
    inner = np.random.default_rng((*seed, k)).random(sizes[k] - 1)
    inner.sort()
    low, high = bounds[k], bounds[k + 1]
    return np.append(low + inner * (high - low), high)


def _spread_of(x: np.ndarray, start: int, n: int) -> tuple[float, float]:
    """How far the distribution of n points lies above and below the diagonal, at sorted points."""
    place = np.arange(start, start + len(x)) / n - x
    return float(place.max()) + 1.0 / n, float(-place.min())


def dip_of_uniform(n: int, seed: tuple, allow_zero: bool = True, slice_points: int = SAMPLE_POINTS,
                   least: float = 0.0) -> float:
    """Dip of a seeded uniform sample of n points, never holding more than some slices of it.

    Where the dip is certainly below ``least``, an upper bound below ``least`` is given in its
    place: a shifted uniform distribution is unimodal, and the best one is half the sum of both
    spreads away.

    The bounds of the slices come from sums of exponential spacings, which are gamma
    distributed. Slices are reduced to skeletons; those that the result rests on are drawn
    again, whole, as in ``dip_statistic``."""
    if n <= slice_points:
        drawn = np.random.default_rng(seed).random(n)
        if least > 0.0:
            drawn.sort()
            bound = sum(_spread_of(drawn, 0, n)) / 2 + 1e-12   # more than rounding can take
            if bound < least:
                return bound
        return dip_of(drawn, allow_zero)
    n_slices = -(-n // slice_points)
    sizes = np.full(n_slices, slice_points)
    sizes[-1] = n - slice_points * (n_slices - 1)
    spans = np.random.default_rng(seed).gamma(np.append(sizes, 1))   # the last gap lies above all points
    bounds = np.concatenate(([0.0], np.cumsum(spans) / spans.sum()))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    if least > 0.0:
        spreads = [_spread_of(_uniform_slice(bounds, sizes, seed, k), int(starts[k]), n) for k in range(n_slices)]
        bound = sum(np.max(spreads, axis=0)) / 2 + 1e-12
        if bound < least:
            return float(bound)
    parts: list = [None] * n_slices
    whole: set[int] = set()
    needed = set(range(n_slices))
    while needed:
        for k in needed:
            v, c = np.unique(_uniform_slice(bounds, sizes, seed, k), return_counts=True)
            before, after = _limits(int(starts[k]), c)
            rows = np.arange(len(v)) if k in whole else skeleton(v, before, after)
            parts[k] = (v[rows], before[rows], after[rows])
        v, before, after = (np.concatenate([p[j] for p in parts]) for j in range(3))
        owner = np.repeat(np.arange(n_slices), [len(p[0]) for p in parts])
        found = dip_of_limits(v, before, after, allow_zero)
        needed = {int(owner[i]) for i in found["trail"]} - whole
        whole |= needed
    return found["dip"]


def simulate_null(sizes: DataFrame, draws: int, seed: int, allow_zero: bool = True) -> DataFrame:
    """Dips of ``draws`` uniform samples per sample size: ``n, draw, dip``.

    ``sizes`` has one distinct ``n`` per row. Every sample has its own seed, so the result
    does not depend on how the work is split. With a column ``least``, dips below it may be
    given as an upper bound that is below it too (see ``dip_of_uniform``).
    """
    least = F.col("least") if "least" in sizes.columns else F.lit(0.0)
    tasks = sizes.select(F.col("n").cast("bigint").alias("n"), least.alias("least"),
                         F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    spread = tasks.repartition(DRAW_TASKS, "n", "draw")

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dips = [dip_of_uniform(int(n), (seed, int(n), int(i)), allow_zero, least=float(low))
                    for n, i, low in zip(batch["n"], batch["draw"], batch["least"])]
            yield batch[["n", "draw"]].assign(dip=dips)

    return spread.mapInPandas(sample, "n bigint, draw int, dip double")


def bootstrap_pvalues(dips: DataFrame, keys: Sequence[str], draws: int, seed: int) -> DataFrame:
    """Share of uniform samples of the same size with a dip at least as large, at any size."""
    sized = dips.withColumn("__n", F.col("n").cast("bigint")).withColumn("__scaled", F.col("dip"))
    tested = sized.where((F.col("n") > 3) & F.lit(draws > 0))
    # A draw counts where it reaches a group's dip: below the least of its size it needs no exact one.
    null = simulate_null(tested.groupBy(F.col("__n").alias("n")).agg(F.min("__scaled").alias("least")), draws, seed)
    # Draws of one size, sorted: a group then needs one binary count instead of all pairs.
    sorted_null = null.groupBy(F.col("n").alias("__n")).agg(F.sort_array(F.collect_list("dip")).alias("__null"))
    joined = sized.join(sorted_null, "__n", "left")
    above = F.size(F.filter("__null", lambda v: v >= F.col("__scaled")))
    p = F.when(F.lit(draws <= 0), F.lit(0.0)).when(F.col("n") <= 3, F.lit(1.0)).otherwise(above / float(draws))
    return joined.select(*keys, "n", "dip", p.alias("p_value"))


def null_table(spark: SparkSession, max_n, draws: int, seed: int) -> DataFrame:
    """Quantiles of sqrt(n)·dip at the tabulated sizes: ``n, levels`` (21 rows of 26 numbers).

    ``max_n`` is a one-row table: sizes beyond the first one that covers it are skipped.
    """
    sizes = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in TABLE_SIZES])).alias("n"))
    needed = sizes.crossJoin(F.broadcast(max_n)).withColumn(  # one row
        "__below", F.lag("n", 1, 0).over(Window.orderBy("n"))
    ).where(F.col("__below") < F.greatest("max_n", F.lit(5)))
    null = simulate_null(needed.select("n"), draws, seed, allow_zero=False)
    scaled = F.sqrt(F.col("n").cast("double")) * F.col("dip")
    return null.groupBy("n").agg(F.percentile(scaled, F.array(*[F.lit(a) for a in TABLE_LEVELS])).alias("levels"))


def table_pvalues(dips: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """P-values by interpolation in the table: between sizes, then between levels."""
    rows = table.select("n", "levels").withColumn("next_n", F.lead("n").over(Window.orderBy("n"))) \
        .withColumn("next_levels", F.lead("levels").over(Window.orderBy("n")))
    entries = F.broadcast(rows.agg(  # at most 21 entries
        F.array_sort(F.collect_list(F.struct("n", "levels", "next_n", "next_levels"))).alias("__rows")))
    capped = F.least(F.col("n"), F.lit(MAX_TABLE_SIZE).cast("bigint"))
    df = dips.crossJoin(entries).withColumn("__n", F.greatest(capped, F.lit(4).cast("bigint")))
    df = df.withColumn("__row", F.element_at(F.filter("__rows", lambda r: r["n"] <= F.col("__n")), -1))
    df = df.withColumn("__f", F.when(
        F.col("__row.next_n").isNotNull(),
        (F.col("__n") - F.col("__row.n")) / (F.col("__row.next_n") - F.col("__row.n"))).otherwise(F.lit(0.0)))
    df = df.withColumn("__xp", F.when(
        F.col("__f") == 0, F.col("__row.levels")).otherwise(F.zip_with(
            "__row.levels", "__row.next_levels", lambda a, b: a + (b - a) * F.col("__f"))))
    df = df.withColumn("__x", F.sqrt(F.col("n").cast("double")) * F.col("dip"))
    df = df.withColumn("__i", F.size(F.filter("__xp", lambda v: v < F.col("__x"))))
    levels = F.array(*[F.lit(a) for a in TABLE_LEVELS])
    x0, x1 = F.element_at("__xp", F.greatest("__i", F.lit(1))), F.try_element_at("__xp", F.col("__i") + 1)
    a0, a1 = F.element_at(levels, F.greatest("__i", F.lit(1))), F.try_element_at(levels, F.col("__i") + 1)
    between = a0 + F.try_divide(F.col("__x") - x0, x1 - x0) * (a1 - a0)
    alpha = F.when(F.col("__i") == 0, F.lit(0.0)).when(F.col("__i") >= len(TABLE_LEVELS), F.lit(1.0)) \
        .otherwise(between)
    p = F.when(F.col("n") <= 3, F.lit(1.0)).otherwise(F.greatest(1.0 - alpha, F.lit(0.0)))
    return df.select(*keys, "n", "dip", p.alias("p_value"))
