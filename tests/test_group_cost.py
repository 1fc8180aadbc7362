"""Statistics of many groups: what is shuffled stays far below one row for each value."""

import numpy as np
from pyspark.sql import functions as F

from tapewright.operators import stats


def _values(spark):
    rng = np.random.default_rng(2)
    both = [("a", v) for v in np.r_[rng.normal(-4, 1, 800), rng.normal(4, 1, 800)]] + [("b", v) for v in rng.normal(9, 1, 900)]
    return spark.createDataFrame([(g, float(v)) for g, v in both], "g string, x double")


def _peaks(x):
    grid = x.min() + (x.max() - x.min()) / stats.KDE_STEPS * np.arange(stats.KDE_STEPS + 1)
    h = x.std(ddof=1) * 1.06 * len(x) ** -0.2
    slope = np.diff(np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1))
    return max(int(((slope[:-1] > 0) & (slope[1:] < 0)).sum()), 1)


def test_density_groups_each_value_once(spark):
    values = _values(spark)
    peaks = stats.kde_peaks(stats.runs(values, ["g"], "x"), stats.moments(values, ["g"], "x"), ["g"])
    plan = peaks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") <= 1   # salts of hot groups, no row for each value and grid point
    x = {g: np.array([r["x"] for r in values.where(F.col("g") == g).collect()]) for g in "ab"}
    assert {r["g"]: r["kde_peaks"] for r in peaks.collect()} == {g: float(_peaks(v)) for g, v in x.items()}


def test_first_cells_are_far_fewer_than_values(spark):
    values = spark.range(20_000).select(F.exp(F.randn(5)).alias("x"))
    assert values.select(stats.value_cell(F.col("x"))).distinct().count() < 300
