"""Values of groups that fit a slice are shuffled once, as lists; larger groups are cut as before."""

import numpy as np
from pyspark.sql import functions as F

from tapewright.operators import dip as D


def test_small_groups_are_shuffled_once(spark, monkeypatch, tmp_path):
    labels, landed = [], D.landed
    monkeypatch.setattr(D, "landed", lambda df, label: labels.append(label) or landed(df, label))
    path = str(tmp_path / "v")
    spark.range(3_000).select((F.col("id") % 3).alias("g"), F.round(F.randn(4), 1).alias("x")).write.parquet(path)
    values = spark.read.parquet(path)
    plan = D._sliced(values, ["g"], "x", 200_000)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange") == 1 and labels == ["dip-sizes"]


def test_both_paths_agree(spark, tmp_path):
    """One group fits a slice, the other does not; copies, and zeros of both signs."""
    rng = np.random.default_rng(6)
    groups = {"a": np.r_[np.round(rng.normal(0, 1, 300), 1), -0.0, 0.0], "b": np.r_[rng.normal(-3, 1, 900), rng.normal(3, 1, 900), [0.5] * 50]}
    path = str(tmp_path / "v")
    spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, x double").write.parquet(path)
    values = spark.read.parquet(path)
    whole = {r.g: (r.n, r.dip) for r in D.dip_statistic(values, ["g"], "x").collect()}
    mixed = {r.g: (r.n, r.dip) for r in D.dip_statistic(values, ["g"], "x", slice_points=400).collect()}
    assert set(whole) == set(groups)
    for g, v in groups.items():
        want = D.dip_of(v + 0.0, allow_zero=True)
        assert whole[g] == mixed[g] == (len(v), want)
