"""Distribution statistics per group, for groups of any size.

Input is a table of values: grouping columns and one double column. Nothing here
gathers a group's values in one task. Moments are partial aggregates. Order
statistics and histograms run over values with counts: *runs* (one row per distinct value,
hashed by group and value) or the rows of a written table as they lie; group-level numbers are
joined back with hot groups salted, and exact quantiles count cells of values until the cell that
holds a rank is small enough to sort. Density and power transform are summed by numpy
inside tasks, one row for each group and task.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.scalars import is_finite
from tapewright.operators.ordered import landed

# A group is hot when it holds more than one part in HOT_PARTS of all rows, so there are
# fewer than HOT_PARTS hot groups. Their runs are split into SALTS pieces.
HOT_PARTS = 1_000
SALTS = 256
# Bins per factor e, coarse near zero (``value_bin``).
BINS_PER_EFOLD = 256
# Cells per factor e in the first round of a selection, cells that a crowded one is split
# into, and values that are sorted together at most. A group should fill far fewer cells than
# it has values: then tasks combine the counts before the shuffle.
CELLS_PER_EFOLD = 16
SPLIT = 65_536
SMALL = 65_536
# Above the cell number of any finite size, so that signed numbers never meet zero (fixed value).
OFFSET = 200_000

# Grid of the power transform (fixed values).
BOX_COX_LAMBDAS = tuple(-2.0 + 0.25 * i for i in range(17))
BOX_COX_ZERO = 1e-6
CV_FLOOR = 1e-9
SMALL_MODE_N = 16
KDE_STEPS = 128
# Groups whose curves a task holds at most.
CURVE_GROUPS = 4_096
# Values per group of a batch from which on densities are built from ratios.
CURVE_DENSE = 32


def finite_values(df: DataFrame, x: str) -> DataFrame:
    return df.where(is_finite(x))


def moments(values: DataFrame, keys: Sequence[str], x: str, box_cox: bool = True) -> DataFrame:
    """n, total, min, max, mean, sample stddev, skew, non-excess kurtosis, cv (and bc)."""
    v = F.col(x)
    aggregates = [
        F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("minimum"),
        F.max(v).alias("maximum"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("stddev"),
        F.skewness(v).alias("__skew"), (F.kurtosis(v) + 3.0).alias("__kurt"),
    ]
    if box_cox:
        log_x = F.ln(F.when(v > 0, v))
        aggregates += [F.min(v > 0).alias("__positive"), F.sum(log_x).alias("__sum_log")]
        aggregates += [
            F.var_pop(log_x if abs(lam) < BOX_COX_ZERO else F.exp(log_x * lam)).alias(f"__var{i}")
            for i, lam in enumerate(BOX_COX_LAMBDAS)
        ]
    spread = F.col("stddev") > 0
    out = finite_values(values, x).groupBy(*keys).agg(*aggregates)
    columns = [
        *keys, "n", "total", "minimum", "maximum", "mean", "stddev",
        F.when(spread, F.col("__skew")).alias("skew"),
        F.when(spread, F.col("__kurt")).alias("kurtosis"),
        F.when(spread, F.col("stddev") / F.greatest(F.abs("mean"), F.lit(CV_FLOOR))).alias("cv"),
    ]
    if box_cox:
        columns.append(_best_lambda().alias("bc"))
    return out.select(*columns)


def _best_lambda() -> Column:
    """The exponent with the highest profile likelihood; ties go to the smallest."""
    n = F.col("n").cast("double")
    scored = []
    for i, lam in enumerate(BOX_COX_LAMBDAS):
        variance = F.col(f"__var{i}") / (1.0 if abs(lam) < BOX_COX_ZERO else lam * lam)
        score = F.col("__sum_log") * (lam - 1.0) - n * 0.5 * F.ln(variance)
        usable = is_finite(variance) & (variance > 0)
        scored.append(F.when(usable, F.struct(score.alias("ll"), F.lit(-lam).alias("neg"))))
    best = F.array_max(F.array(*scored))
    return F.when(F.col("__positive") & (F.col("n") > 1), -best["neg"] + 0.0)


def runs(values: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Distinct values of each group with their counts, as ``x`` and ``c``."""
    # Adding 0.0 makes -0.0 and 0.0 one value.
    return (
        finite_values(values, x)
        .groupBy(*keys, (F.col(x) + 0.0).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    )


def hot_groups(run_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the groups with more than one part in HOT_PARTS of all rows."""
    sizes = run_table.groupBy(*keys).agg(F.sum("c").alias("__n"))
    total = sizes.agg(F.sum("__n").alias("__total"))  # one row
    return sizes.crossJoin(F.broadcast(total)).where(
        F.col("__n") * HOT_PARTS > F.col("__total")).select(*keys)


def join_group(run_table: DataFrame, small: DataFrame, keys: Sequence[str],
               hot: DataFrame | None = None) -> DataFrame:
    """Join one row per group onto its runs. Hot groups are split over SALTS tasks; the
    others stay together, so that sums over them combine before the shuffle. A ``small`` that says itself
    which groups are ``__hot`` needs no join for it, and the planner then sees how small it is."""
    if "__hot" in small.columns:
        known = small
    else:
        hot = hot_groups(run_table, keys) if hot is None else hot
        known = small.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), list(keys), "left")
    # Fewer than HOT_PARTS rows.
    marked = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    pieces = F.when(F.col("__hot"), F.lit(SALTS - 1)).otherwise(F.lit(0))
    piece = F.when(F.col("__hot"), _salt()).otherwise(F.lit(0))
    spread = known.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), pieces))).drop("__hot")
    salted = run_table.join(marked, list(keys), "left").withColumn("__salt", piece).drop("__hot")
    return salted.join(spread, [*keys, "__salt"]).drop("__salt")


def _salt() -> Column:
    """A piece for each value and input task, so that copies of one value are spread too."""
    return F.pmod(F.xxhash64("x", F.spark_partition_id()), F.lit(SALTS)).cast("int")


def value_bin(x: Column) -> Column:
    """A bin number that never decreases with x, coarse near zero."""
    return F.floor(F.signum(x) * F.log1p(F.abs(x)) * float(BINS_PER_EFOLD))


def value_cell(x: Column) -> Column:
    """A cell number that never decreases with x: sign, then CELLS_PER_EFOLD cells for each factor e."""
    size = F.floor(F.ln(F.abs(x)) * float(CELLS_PER_EFOLD)) + OFFSET
    return F.when(x > 0, size).when(x < 0, -size).otherwise(0).cast("bigint")


def order_statistics(run_table: DataFrame, keys: Sequence[str],
                     ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Exact values at zero-based ranks; each rank is a function of the group size.

    Selection by counting: values are dealt into cells, cells are counted, and only the
    cells that hold a rank go on. A cell of at most SMALL values is sorted; a more crowded one is
    dealt into SPLIT cells between its own least and greatest value, its rows spread over
    SALTS pieces. A logarithmic cell has 2^49 doubles at most, so four such rounds end.
    ``run_table`` is read twice: pass a written table where it is costly.
    """
    keys = list(keys)
    cell = [*keys, "__at", "__cell"]
    rows = run_table.select(*keys, "x", "c", F.lit(0).alias("__at"), value_cell(F.col("x")).alias("__cell"))
    total = Window.partitionBy(*keys)
    cells = _counted(rows, cell).withColumns(
        {"n": F.sum("__in").over(total), "__below": F.lit(0).cast("bigint")})
    wanted = {f"__r_{name}": rank(F.col("n")).cast("bigint") for name, rank in ranks.items()}
    cells = cells.withColumns(wanted)
    picked = []
    while True:
        up_to = Window.partitionBy(*keys, "__at").orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)
        placed = cells.withColumn("__before", F.col("__below") + F.sum("__in").over(up_to) - F.col("__in"))
        held = reduce(Column.__or__, (_holds(r, "__before", "__in") for r in wanted))
        located = landed(placed.where(held).drop("__below"), "cells")   # at most one cell for each group and rank
        crowded = (F.col("__rows") > SMALL) & (F.col("__low") < F.col("__high"))
        picked.append(_picked(rows, located.where(~crowded), keys, wanted))
        # Groups may have several crowded cells: these are numbered anew.
        following = located.where(crowded).withColumn(
            "__next", F.row_number().over(Window.partitionBy(*keys).orderBy("__at", "__cell")))
        if following.isEmpty():
            break
        spread = following.select(*cell, "__next", "__low", "__high").withColumn(
            "__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("__salt", _salt())
        within = (F.col("x") - F.col("__low")) / (F.col("__high") - F.col("__low"))
        rows = landed(salted.join(spread, [*cell, "__salt"]).select(
            *keys, "x", "c", F.col("__next").alias("__at"), F.floor(within * float(SPLIT)).alias("__cell")), "crowded")
        open_cells = following.select(
            *keys, F.col("__next").alias("__at"), "n", F.col("__before").alias("__below"), *wanted)
        cells = _counted(rows, cell).join(open_cells, [*keys, "__at"])
    whole = picked[0]
    for part in picked[1:]:
        whole = whole.unionByName(part)
    if len(picked) > 1:
        whole = whole.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(r).alias(r) for r in wanted])
    return whole.withColumnsRenamed({r: name for r, name in zip(wanted, ranks)})


def _counted(rows: DataFrame, cell: list[str]) -> DataFrame:
    return rows.groupBy(*cell).agg(F.sum("c").alias("__in"), F.count(F.lit(1)).alias("__rows"),
                                   F.min("x").alias("__low"), F.max("x").alias("__high"))


def _holds(rank: str, below: str, count: str) -> Column:
    return (F.col(rank) >= F.col(below)) & (F.col(rank) < F.col(below) + F.col(count))


def _picked(rows: DataFrame, located: DataFrame, keys: list[str], wanted: Collection[str]) -> DataFrame:
    """The values at the wanted ranks that the located cells hold: keys, n, one column for each rank.
    A cell of one value, however often it occurs, needs no rows."""
    within = Window.partitionBy(*keys, "__at", "__cell").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    place = [*keys, "__at", "__cell"]
    carried = [*place, "x", "c", "__before", "n", *wanted]
    single = F.col("__low") == F.col("__high")
    few = rows.join(located.where(~single).select(*place, "__before", "n", *wanted), place).select(*carried).unionByName(
        located.where(single).withColumns({"x": F.col("__low"), "c": F.col("__in")}).select(*carried))
    # One exchange serves the sort and the grouping.
    ranked = few.repartition(*keys).withColumn("__lower", F.col("__before") + F.sum("c").over(within) - F.col("c"))
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *[
        F.max(F.when(_holds(r, "__lower", "c"), F.col("x"))).alias(r) for r in wanted])


def quantiles(run_table: DataFrame, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Exact quantiles, linear between the order statistics around ``p (n - 1)``."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in probs.items():
        ranks[f"__lo_{name}"] = lambda n, p=p: F.floor((n - 1) * F.lit(p))
        ranks[f"__hi_{name}"] = lambda n, p=p: F.ceil((n - 1) * F.lit(p))
    found = order_statistics(run_table, keys, ranks)

    def between(name: str, p: float) -> Column:
        position = (F.col("n") - 1) * F.lit(p)
        weight = position - F.floor(position)
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        return F.when(weight == 0, low).otherwise(low * (1.0 - weight) + high * weight)

    return found.select(*keys, "n", *[between(k, p).alias(k) for k, p in probs.items()])


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def quartiles(run_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return quantiles(run_table, keys, QUARTILES).withColumn("iqr", F.col("q3") - F.col("q1"))


def mad(run_table: DataFrame, medians: DataFrame, keys: Sequence[str],
        hot: DataFrame | None = None) -> DataFrame:
    """Median absolute deviation from the group's median."""
    return mad_of(landed(join_group(run_table, medians.select(*keys, "median"), keys, hot), "centred"), keys)


def mad_of(planned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same from runs that carry their group's ``median``. Deviations need no merging: a
    value occurs twice at most."""
    deviations = planned.select(*keys, F.abs(F.col("x") - F.col("median")).alias("x"), "c")
    return quantiles(deviations, keys, {"mad": 0.5}).drop("n")


def mode_estimate(run_table: DataFrame, spread: DataFrame, keys: Sequence[str],
                  hot: DataFrame | None = None) -> DataFrame:
    """Most frequent value of small groups, densest histogram bin of larger ones.

    ``spread`` has n, minimum, maximum, stddev and iqr per group. Small groups: ties go
    to the smallest value. Others: bin width from the iqr, else from the stddev; ties go
    to the last bin; a group without spread gives its single value.
    """
    spread = spread.withColumns(_bins())
    return mode_of(join_group(run_table, spread.select(*keys, "minimum", *_bins()), keys, hot), spread, keys)


def _bins() -> dict[str, Column]:
    """Width and number of a group's histogram bins, null where single values are counted."""
    root = F.pow(F.col("n").cast("double"), F.lit(1.0 / 3.0))
    width = F.when(F.col("n") > SMALL_MODE_N, F.when(F.col("iqr") > 0, F.col("iqr") * 2.0 / root).when(
        F.col("stddev") > 0, F.col("stddev") * 3.5 / root))
    return {"__w": width, "__bins": F.greatest(F.ceil((F.col("maximum") - F.col("minimum")) / width), F.lit(1))}


def mode_of(planned: DataFrame, spread: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same from values that carry ``minimum`` and ``_bins``, as ``spread`` does."""
    index = F.least(F.floor((F.col("x") - F.col("minimum")) / F.col("__w")), F.col("__bins") - 1)
    histogram = planned.groupBy(
        *keys, index.alias("__i"), F.when(F.col("__w").isNull(), F.col("x")).alias("__v"),
    ).agg(F.sum("c").alias("c"))
    best = F.max_by(
        F.struct("__i", "__v"),
        F.struct(F.col("c"), F.coalesce(F.col("__i"), F.lit(0)), -F.col("__v")),
    )
    picked = histogram.groupBy(*keys).agg(best.alias("__b")).join(spread.select(*keys, "minimum", "__w"), list(keys))
    mid_bin = F.col("minimum") + F.col("__w") * F.col("__b.__i") + F.col("__w") / 2.0
    return picked.select(*keys, F.coalesce(F.col("__b.__v"), mid_bin).alias("mode"))


def kde_peaks(run_table: DataFrame, spread: DataFrame, keys: Sequence[str],
              hot: DataFrame | None = None) -> DataFrame:
    """Number of peaks of a Gaussian density on a fixed grid between minimum and maximum.

    ``spread`` has n, minimum, maximum and stddev per group. A task ships one row per group,
    a sum for each grid point.
    """
    numbered = spread.select(*keys, "n", "minimum", "maximum", "stddev").withColumns(_grid())
    numbered = landed(numbered.withColumn("__id", F.monotonically_increasing_id()), "groups")
    planned = join_group(run_table, numbered.select(*keys, *CURVE).where(F.col("__h").isNotNull()), keys, hot)
    sums = curve_sums(planned, moments=False)
    return numbered.join(sums, "__id", "left").select(*keys, _peaks().alias("kde_peaks"))


def _flat() -> Column:
    return ~F.coalesce(F.col("stddev") > 0, F.lit(False))


def _grid() -> dict[str, Column]:
    """Bandwidth (null where no density is asked for) and step of a group's density grid."""
    curved = (F.col("n") >= 3) & ~_flat()
    return {
        "__h": F.when(curved, F.col("stddev") * 1.06 * F.pow(F.col("n").cast("double"), F.lit(-0.2))),
        "__step": (F.col("maximum") - F.col("minimum")) / float(KDE_STEPS),
    }


# What the sums of a group's curves need to know of the group.
CURVE = ("__id", "minimum", "__h", "__step")


def _peaks() -> Column:
    """Peaks of the summed density ``__d``."""
    along = F.col("__d")
    peaked = F.filter(F.sequence(F.lit(1), F.lit(KDE_STEPS - 1)), lambda i: (
        F.get(along, i) - F.get(along, i - 1) > 0) & (F.get(along, i + 1) - F.get(along, i) < 0))
    turns = F.coalesce(F.size(peaked), F.lit(0)).cast("bigint")
    return F.when(F.col("n") < 3, F.col("n")).when(_flat(), F.lit(1)).otherwise(
        F.greatest(turns, F.lit(1))).cast("double")


def curve_sums(planned: DataFrame, moments: bool = True) -> DataFrame:
    """Per group ``__id`` the density ``__d`` at its grid points and, with ``moments``, the sums ``__s1`` to ``__s4`` of
    powers of the distance from the mean, the sum of logarithms
    ``__sum_log`` and the sums ``__y<i>``, ``__yy<i>`` of each power of the grid less the mean's, and of the square
    of that (of no use unless all values are positive).

    ``planned`` are values with counts that carry CURVE and, with ``moments``, ``mean``. A task gives one
    row of sums for each of its groups.
    """
    names = [f"__d{g}" for g in range(KDE_STEPS + 1)]
    if moments:
        names += ["__s1", "__s2", "__s3", "__s4", "__sum_log", *(f"__{y}{i}" for y in ("y", "yy") for i in range(len(BOX_COX_LAMBDAS)))]
    carried = [*CURVE, "x", "c", *(["mean"] if moments else [])]
    fields = ", ".join(["__id bigint", *(f"{name} double" for name in names)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sums in _summed(batches, moments):
            yield pa.RecordBatch.from_arrays([pa.array(ids), *map(pa.array, sums.T)], names=["__id", *names])

    parts = planned.select(*carried).mapInArrow(add, fields)
    summed = parts.groupBy("__id").agg(*[F.sum(name).alias(name) for name in names])
    return summed.select("__id", F.array(*names[:KDE_STEPS + 1]).alias("__d"), *names[KDE_STEPS + 1:])


def _summed(batches: Iterator[pa.RecordBatch], moments: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Group numbers with their sums, at most CURVE_GROUPS and a batch of them held at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
        order = np.argsort(columns["__id"], kind="stable")
        rows = {name: values[order] for name, values in columns.items()}
        ids, starts = np.unique(rows["__id"], return_index=True)
        with np.errstate(all="ignore"):
            sums = [_densities(rows, starts), *([_distances(rows, starts), _powers(rows, starts)] if moments else [])]
        held.append((ids, np.concatenate(sums, axis=1)))
        if sum(len(part[0]) for part in held) > CURVE_GROUPS:
            held = [_gathered(held)]
            if len(held[0][0]) > CURVE_GROUPS:
                yield held.pop()
    if held:
        yield _gathered(held)


def _gathered(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([part[0] for part in parts])
    order = np.argsort(ids, kind="stable")
    found, starts = np.unique(ids[order], return_index=True)
    return found, np.add.reduceat(np.concatenate([part[1] for part in parts])[order], starts, axis=0)


def _densities(rows: dict[str, np.ndarray], starts: np.ndarray) -> np.ndarray:
    """Density sums at the grid points, per group of rows sorted by group.

    From the grid point nearest to a value outwards on both sides, one point is the one before times a
    ratio, and the ratio shrinks by a constant factor: all stay within 0 and 1, and no exponential is needed for each
    value and point."""
    points = KDE_STEPS + 1
    out = np.zeros((len(starts), points))
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows["x"]))))
    curved = rows["__h"] > 0
    if not curved.any():
        return out
    x, c, low, h, step = (rows[n][curved] for n in ("x", "c", "minimum", "__h", "__step"))
    if len(x) < CURVE_DENSE * len(starts):
        # Groups of few values: room for each group would cost more than the exponentials.
        along = low[:, None] + step[:, None] * np.arange(points)
        found, first = np.unique(group[curved], return_index=True)
        out[found] = np.add.reduceat(np.exp(((along - x[:, None]) / h[:, None]) ** 2 * -0.5) * c[:, None], first, axis=0)
        return out
    nearest = np.nan_to_num(np.clip(np.rint((x - low) / step), 0, KDE_STEPS))
    # Sorted by grid point, so that values with points left on a side are a run of rows.
    many = len(starts)
    place = nearest.astype(np.intp) * many + group[curved]
    order = np.argsort(place, kind="stable")
    place, first = np.unique(place[order], return_index=True)
    offset, width = (((low + step * nearest - x) / h)[order], (step / h)[order])
    peak, shrink = np.exp(-0.5 * offset * offset) * c[order], np.exp(-width * width)
    # Beyond 39 bandwidths a double is zero.
    reach = int(min(KDE_STEPS, np.ceil(39.0 / width.min()) + 1))
    sums = np.zeros(points * many)
    sums[place] = np.add.reduceat(peak, first)
    ends = np.append(first, len(x))
    for side in (1, -1):
        term, ratio = peak.copy(), np.exp(-side * offset * width - 0.5 * width * width)
        for away in range(1, reach + 1):
            cut = np.searchsorted(place, (points - away if side > 0 else away) * many)
            bins = slice(0, cut) if side > 0 else slice(cut, None)
            if not len(place[bins]):
                break
            rows_in = slice(0, ends[cut]) if side > 0 else slice(ends[cut], None)
            term[rows_in] *= ratio[rows_in]
            ratio[rows_in] *= shrink[rows_in]
            sums[place[bins] + side * away * many] += np.add.reduceat(term[rows_in], first[bins] - (rows_in.start or 0))
    return sums.reshape(points, many).T


def _distances(rows: dict[str, np.ndarray], starts: np.ndarray) -> np.ndarray:
    """Per group the sums of the first four powers of the distance from the mean."""
    distance = rows["x"] - rows["mean"]
    powers, term = [], rows["c"].astype(float)
    for _ in range(4):
        term = term * distance
        powers.append(np.add.reduceat(term, starts))
    return np.stack(powers, axis=1)


def _powers(rows: dict[str, np.ndarray], starts: np.ndarray) -> np.ndarray:
    """Per group of positive values the sum of logarithms, and of each power less the mean's and its square:
    a variance from plain squares would lose digits."""
    positive = rows["minimum"] > 0
    out = np.zeros((len(starts), 1 + 2 * len(BOX_COX_LAMBDAS)))
    kept = positive[starts]
    if not kept.any():
        return out
    x, c, mean = (rows[n][positive] for n in ("x", "c", "mean"))
    first = np.cumsum(np.append(0, np.diff(np.append(starts, len(positive)))[kept]))[:-1]
    sizes = np.diff(np.append(first, len(x)))
    log_x, centre = np.log(x), mean[first]
    out[kept, 0] = np.add.reduceat(log_x * c, first)
    for i, lam in enumerate(BOX_COX_LAMBDAS):
        y = log_x - np.repeat(np.log(centre), sizes) if abs(lam) < BOX_COX_ZERO else \
            x ** lam - np.repeat(centre ** lam, sizes)
        weighted = y * c
        out[kept, 1 + i] = np.add.reduceat(weighted, first)
        out[kept, 1 + len(BOX_COX_LAMBDAS) + i] = np.add.reduceat(weighted * y, first)
    return out


def summarize(values: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """All statistics of a group in one row (the dip test apart). ``values`` is read twice: pass a
    written table, if possible one whose tasks hold few groups each."""
    counted = finite_values(values, x).select(*keys, (F.col(x) + 0.0).alias("x"), F.lit(1).cast("bigint").alias("c"))
    return _summary(counted, moments(values, keys, x, box_cox=False), keys)


def summarize_runs(run_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same where only distinct values ``x`` and their counts ``c`` are known. The table is
    read several times: pass a written one."""
    return _summary(run_table, moments_of_runs(run_table, keys).drop("bc"), keys)


def _summary(counted: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups are numbered first, so that values carry one number in place of the keys."""
    keys, number = list(keys), ["__id"]
    base = base.select(*keys, "n", "total", "minimum", "maximum", "mean", "stddev")
    # The numbers hold for one reading, hence written.
    groups = landed(base.withColumn("__id", F.monotonically_increasing_id()), "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    groups = groups.withColumn("__hot", F.col("n") * HOT_PARTS > F.lit(total))
    hot = groups.where("__hot")   # fewer than HOT_PARTS
    rows = join_group(counted, groups.select(*keys, "__id", "__hot"), keys, hot.select(*keys)).select("__id", "x", "c")
    rows = landed(rows, "numbered")
    spread = groups.join(quartiles(rows, number).drop("n"), number)
    spread = landed(spread.withColumns({**_bins(), **_grid()}), "spread")

    def planned(*names: str) -> DataFrame:
        return join_group(rows, spread.select("__id", "__hot", *names), number, hot.select("__id"))

    found = spread.join(curve_sums(planned("minimum", "__h", "__step", "mean")), number)
    spreads = {f"__var{i}": F.when(F.col("minimum") < F.col("maximum"), _variance(i)).otherwise(0.0)
               for i in range(len(BOX_COX_LAMBDAS))}
    found = found.withColumns({**spreads, "__positive": F.col("minimum") > 0}).withColumns(
        {"bc": _best_lambda(), "kde_peaks": _peaks()}).withColumns(_shape())
    return (
        found.select(*base.columns, *_shape(), "bc", "kde_peaks", *QUARTILES, "iqr", "__id")
        .join(mad_of(planned("median"), number), number)
        .join(mode_of(planned("minimum", *_bins()), spread, number), number).drop("__id")
    )


def _shape() -> dict[str, Column]:
    """Skew, non-excess kurtosis and cv from distances to the mean (fewer roundings than a running update)."""
    n, s2 = F.col("n").cast("double"), F.col("__s2")
    deviation = F.sqrt((s2 - F.col("__s1") * F.col("__s1") / n) / (n - 1.0))
    spread = (F.col("n") > 1) & (F.col("minimum") < F.col("maximum"))
    return {
        "skew": F.when(spread, F.sqrt(n) * F.col("__s3") / F.pow(s2, F.lit(1.5))),
        "kurtosis": F.when(spread, n * F.col("__s4") / (s2 * s2)),
        "cv": F.when(spread, deviation / F.greatest(F.abs("mean"), F.lit(CV_FLOOR))),
    }


def _variance(i: int) -> Column:
    """Of a power of the grid, from sums about the mean's power."""
    n, y, yy = F.col("n").cast("double"), F.col(f"__y{i}"), F.col(f"__yy{i}")
    return (yy - y * y / n) / n


def moments_of_runs(run_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``moments`` from runs: sums first, then weighted powers of the distance from the mean."""
    keys = list(keys)
    x, c = F.col("x"), F.col("c")
    sums = landed(run_table.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.sum(x * c).alias("total"), F.min("x").alias("minimum"), F.max("x").alias("maximum"),
    ).withColumn("mean", F.when(F.col("minimum") == F.col("maximum"), F.col("minimum"))
                 .otherwise(F.col("total") / F.col("n"))), "sums")
    total = sums.agg(F.sum("n").alias("__total"))  # one row
    hot = sums.crossJoin(F.broadcast(total)).where(F.col("n") * HOT_PARTS > F.col("__total")).select(*keys)
    centred = join_group(run_table, sums.select(*keys, "mean"), keys, hot).withColumn("__d", x - F.col("mean"))
    d = F.col("__d")
    aggregates = [F.sum(d * d * c).alias("__s2"), F.sum(d * d * d * c).alias("__s3"), F.sum(d * d * d * d * c).alias("__s4"),
                  F.min(x > 0).alias("__positive"), F.sum(F.ln(F.when(x > 0, x)) * c).alias("__sum_log")]
    for i, lam in enumerate(BOX_COX_LAMBDAS):
        # Only used where all values, hence their mean, are positive.
        log_x, log_mean = F.ln(F.when(x > 0, x)), F.ln(F.when(F.col("mean") > 0, F.col("mean")))
        y = log_x - log_mean if abs(lam) < BOX_COX_ZERO else F.exp(log_x * lam) - F.exp(log_mean * lam)
        aggregates += [F.sum(y * c).alias(f"__y{i}"), F.sum(y * y * c).alias(f"__yy{i}")]
    n = F.col("n").cast("double")
    s2, one_value = F.col("__s2"), F.col("minimum") == F.col("maximum")
    out = sums.join(centred.groupBy(*keys).agg(*aggregates), keys)
    out = out.withColumns({
        f"__var{i}": F.when(one_value, 0.0).otherwise(_variance(i))
        for i in range(len(BOX_COX_LAMBDAS))})
    out = out.withColumn("stddev", F.when(one_value & (F.col("n") > 1), 0.0).when(F.col("n") > 1, F.sqrt(s2 / (n - 1.0))))
    spread = F.col("stddev") > 0
    return out.select(
        *keys, "n", "total", "minimum", "maximum", "mean", "stddev",
        F.when(spread, F.sqrt(n) * F.col("__s3") / F.pow(s2, F.lit(1.5))).alias("skew"),
        F.when(spread, n * F.col("__s4") / (s2 * s2)).alias("kurtosis"),
        F.when(spread, F.col("stddev") / F.greatest(F.abs("mean"), F.lit(CV_FLOOR))).alias("cv"),
        _best_lambda().alias("bc"))
