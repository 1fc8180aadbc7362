"""Distributed selection and statistics of counted values, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.operators import stats


@pytest.mark.parametrize("small", [1, 16, stats.SMALL])
def test_selection_in_crowded_cells(spark, monkeypatch, small):
    """Values crowded into one cell, mixed signs, tiny and huge sizes, ties: exact at every cell bound."""
    monkeypatch.setattr(stats, "SMALL", small)
    rng = np.random.default_rng(5)
    groups = {
        "crowded": 0.001 + rng.random(3000) * 1e-9, "signs": rng.normal(size=501), "ties": np.repeat([1.0, 2.0, 2.5], [40, 3, 7]),
        "tiny": np.concatenate([rng.random(300) * 5e-324 * 1e9, [0.0], -rng.random(200) * 1e-300]),
        "huge": np.concatenate([rng.random(99) * 1e308, -rng.random(100) * 1e308]), "one": np.array([3.5]),
        "steps": np.nextafter(1.0, 2.0) + np.arange(2000) * 2.0 ** -52, "zero": np.zeros(9),
    }
    values = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.77, "e": 1.0}
    got = {r.g: [r.a, r.b, r.c, r.d, r.e] for r in stats.quantiles(stats.runs(values, ["g"], "v"), ["g"], probs).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        ordered = np.sort(vs)
        for p, value in zip(probs.values(), got[g]):
            position = (len(ordered) - 1) * p
            low, high = ordered[int(np.floor(position))], ordered[int(np.ceil(position))]
            w = position - np.floor(position)
            assert value == pytest.approx(low if w == 0 else low * (1 - w) + high * w, rel=1e-15, abs=0)


def test_selection_sorts_small_cells_only(spark, monkeypatch):
    """50 000 values of one logarithmic cell: no sorted cell is above the bound."""
    monkeypatch.setattr(stats, "SMALL", 256)
    seen = []
    picked = stats._picked

    def spy(rows, located, keys, wanted):
        few = rows.join(located.select(*keys, "__at", "__cell"), [*keys, "__at", "__cell"])
        seen.extend(r[0] for r in few.groupBy(*keys, "__at", "__cell").count().select("count").collect())
        return picked(rows, located, keys, wanted)

    monkeypatch.setattr(stats, "_picked", spy)
    values = spark.range(50_000).select(F.lit("g").alias("g"), (F.lit(0.003) + F.col("id") / 1e12).alias("v"))
    row = stats.quartiles(stats.runs(values, ["g"], "v"), ["g"]).first()
    assert row.median == pytest.approx(0.003 + 24_999.5 / 1e12, rel=1e-12)
    assert seen and max(seen) <= 256


def test_mad_reads_and_exchanges(spark, tmp_path):
    """The median absolute deviation with its medians: few exchanges, values read once."""
    path = str(tmp_path / "values")
    spark.range(5000).select((F.col("id") % 7).alias("g"), (F.col("id") % 97 / 3.0).alias("v")).write.parquet(path)
    exchanges = []
    landed = stats.landed

    def spy(df, label):
        exchanges.append(_exchanges(df))
        return landed(df, label)

    stats.landed = spy
    try:
        counted = spy(stats.runs(spark.read.parquet(path), ["g"], "v"), "runs")
        out = stats.mad(counted, stats.quartiles(counted, ["g"]), ["g"])
    finally:
        stats.landed = landed
    exchanges.append(_exchanges(out))
    assert sum(exchanges) <= 12 and max(exchanges) <= 8
    got = {r.g: r["mad"] for r in out.collect()}
    for g, v in spark.read.parquet(path).toPandas().groupby("g")["v"]:
        assert got[g] == pytest.approx(np.median(np.abs(v - np.median(v))))


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_statistics_of_runs(spark):
    """Counts of values say the same as the values."""
    rng = np.random.default_rng(8)
    rows = [("a", float(v)) for v in np.round(rng.gamma(2, 3, 400), 1)] + [("b", 0.1)] * 3 + [("c", -4.0), ("c", 7.0)] + [("d", 2.0)]
    values = spark.createDataFrame(rows, "g string, v double")
    want = {r.g: r.asDict() for r in stats.summarize(values, ["g"], "v").collect()}
    got = {r.g: r.asDict() for r in stats.summarize_runs(stats.landed(stats.runs(values, ["g"], "v"), "runs"), ["g"]).collect()}
    assert set(got) == set(want) == set("abcd")
    for g in want:
        for name, value in want[g].items():
            assert got[g][name] == (value if value is None or isinstance(value, str) else pytest.approx(value, rel=1e-9)), (g, name)
