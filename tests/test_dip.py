"""Dip statistic: known values, invariances, slicing, null distribution."""

import numpy as np
import pytest

from tapewright.operators import dip as D


def test_known_values():
    assert D.dip_of([0, 0, 0, 0, 1, 1, 1, 1]) == pytest.approx(0.25)
    assert D.dip_of(range(10)) == pytest.approx(1 / 20)
    assert D.dip_of(range(10), allow_zero=True) == 0.0
    assert D.dip_of([3.0, 3.0, 3.0], allow_zero=True) == 0.0


def test_bad_samples():
    for bad, sort in (([], True), ([1.0, float("nan")], True), ([2.0, 1.0], False)):
        with pytest.raises(ValueError):
            D.dip_of(bad, sort=sort)


def test_affine_invariance_and_range():
    rng = np.random.default_rng(3)
    for n in (5, 17, 200):
        x = rng.normal(size=n).round(2)
        d = D.dip_of(x)
        assert 1 / (2 * n) - 1e-12 <= d <= 0.25 + 1e-12
        assert D.dip_of(3 * x + 7) == pytest.approx(d)
        assert D.dip_of(-x) == pytest.approx(d)


def test_slices_give_the_exact_dip(spark):
    rng = np.random.default_rng(5)
    samples = {
        "one": rng.normal(size=3000), "two": np.r_[rng.normal(0, 1, 1500), rng.normal(6, 1, 1500)],
        "three": np.r_[rng.normal(-9, 1, 900), rng.normal(0, 3, 900), rng.normal(40, 1, 900)],
        "ties": rng.integers(0, 60, 3000).astype(float), "flat": rng.random(2500),
    }
    rows = [(k, float(v)) for k, s in samples.items() for v in s]
    values = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: (r["n"], r["dip"]) for r in
           D.dip_statistic(values, ["g"], "x", slice_points=100).collect()}
    for name, sample in samples.items():
        assert got[name][0] == len(sample)
        assert got[name][1] == pytest.approx(D.dip_of(sample, allow_zero=True), abs=1e-12)


def test_null_is_seeded_and_pvalues_are_in_range(spark):
    sizes = spark.createDataFrame([(10,), (25,)], "n bigint")
    first = sorted(map(tuple, D.simulate_null(sizes, 20, seed=1).collect()))
    again = sorted(map(tuple, D.simulate_null(sizes.repartition(3), 20, seed=1).collect()))
    assert first == again and len(first) == 40
    dips = spark.createDataFrame([("u", 50, 0.03), ("b", 50, 0.2), ("s", 3, 0.1)], "g string, n bigint, dip double")
    table = D.null_table(spark, dips.selectExpr("max(n) as max_n"), 200, seed=2)
    by_table = {r["g"]: r["p_value"] for r in D.table_pvalues(dips, table, ["g"]).collect()}
    by_draws = {r["g"]: r["p_value"] for r in D.bootstrap_pvalues(dips, ["g"], 200, seed=2).collect()}
    for p in (by_table, by_draws):
        assert p["s"] == 1.0 and p["b"] < 0.02 and p["u"] > 0.8
