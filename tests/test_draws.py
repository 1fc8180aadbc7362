"""Simulated dips: spread over tasks, and cut short only where no p-value can tell."""

import numpy as np

from tapewright.operators import dip as D


def test_draws_are_not_merged_into_a_task(spark):
    sizes = spark.createDataFrame([(10,), (25,)], "n bigint")
    assert D.simulate_null(sizes, 20, seed=1).rdd.getNumPartitions() == D.DRAW_TASKS


def test_bounds_replace_only_dips_below_the_least():
    for n in (4, 7, 50, 900):
        for draw in range(40):
            exact = D.dip_of_uniform(n, (7, n, draw), slice_points=300)
            bound = D.dip_of_uniform(n, (7, n, draw), slice_points=300, least=9.0)
            assert exact <= bound < 1.0
            assert D.dip_of_uniform(n, (7, n, draw), slice_points=300, least=exact) == exact


def test_p_values_are_those_of_all_exact_draws(spark):
    sizes = spark.createDataFrame([(40,)], "n bigint")
    null = np.array([r["dip"] for r in D.simulate_null(sizes, 50, seed=3).collect()])
    dips = spark.createDataFrame([(str(v), 40, v) for v in (0.04, 0.06, 0.08, 0.12)], "g string, n bigint, dip double")
    for row in D.bootstrap_pvalues(dips, ["g"], 50, seed=3).collect():
        assert row["p_value"] == (null >= row["dip"]).mean()
