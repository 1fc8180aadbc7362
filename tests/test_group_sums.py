"""Statistics of many large groups: events written once, sums by numpy, numbers in place of keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.operators import features as X
from tapewright.operators import stats

HOUR = 3_600 * 10**9


def test_events_lie_side_by_side_and_once(spark):
    """Whatever the number of window lengths: one row for each event, a symbol's window in one file."""
    rows = spark.range(4_000).selectExpr(
        "concat('S', id % 5) as symbol", f"id * 7919 % 4000 * {HOUR // 500} + 3 as trade_ts_ns", "id as seq", "1D as price", "1L as size")
    kept = X.side_by_side(rows, ["1h", "2h", "4h"], ["price", "size"])
    assert kept.count() == 4_000
    files = kept.withColumn("file", F.input_file_name()).groupBy("symbol", "slot_ns").agg(F.count_distinct("file").alias("files"))
    assert {r["files"] for r in files.collect()} == {1}
    windowed = X.write_dollar_values(rows, ["1h", "2h", "4h"])
    assert windowed.count() == 12_000 and windowed.select(*X.KEYS).distinct().count() == 5 * (8 + 4 + 2)


@pytest.mark.parametrize("dense", [1, 10**9])
def test_curves_equal_plain_sums(dense, monkeypatch):
    """Densities from ratios, and from exponentials, on smooth, far-flung, tied, huge and tiny groups."""
    monkeypatch.setattr(stats, "CURVE_DENSE", dense)
    rng = np.random.default_rng(3)
    groups = [rng.gamma(2, 3, 900), np.r_[rng.normal(0, 1, 300), 5e4], np.repeat([1.0, 2.0, 9.0], 40), rng.random(200) * 1e150,
              rng.random(50) * 1e-150, rng.normal(0, 1, 700)]
    ids = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    of = [(g.min(), g.std(ddof=1) * 1.06 * len(g) ** -0.2, (g.max() - g.min()) / stats.KDE_STEPS, g.mean()) for g in groups]
    x = np.concatenate(groups)
    rows = {"__id": ids, "x": x, "c": np.ones(len(x)), **{
        name: np.array([o[k] for o in of])[ids] for k, name in enumerate(("minimum", "__h", "__step", "mean"))}}
    starts = np.unique(ids, return_index=True)[1]
    with np.errstate(all="ignore"):
        densities, powers = stats._densities(rows, starts), stats._powers(rows, starts)
    for k, g in enumerate(groups):
        low, h, step, mean = of[k]
        want = np.exp(-0.5 * ((low + step * np.arange(stats.KDE_STEPS + 1)[:, None] - g) / h) ** 2).sum(axis=1)
        assert densities[k] == pytest.approx(want, rel=1e-11, abs=1e-300)
        if k in (0, 2):
            y, yy = (powers[k][1 + j * len(stats.BOX_COX_LAMBDAS):][:len(stats.BOX_COX_LAMBDAS)] for j in (0, 1))
            var = (yy - y * y / len(g)) / len(g)
            assert powers[k][0] == pytest.approx(np.log(g).sum())
            for lam, v in zip(stats.BOX_COX_LAMBDAS, var):
                assert v == pytest.approx(np.var(np.log(g) if lam == 0 else g ** lam), rel=1e-9)


def test_copies_of_one_value_need_no_rows(spark, monkeypatch):
    """A cell of one value is picked from its count, however many rows it has; no further rounds."""
    monkeypatch.setattr(stats, "SMALL", 100)
    labels, landed = [], stats.landed
    monkeypatch.setattr(stats, "landed", lambda df, label: labels.append(label) or landed(df, label))
    values = spark.range(6_000).selectExpr("id % 2 as g", "if(id < 5000, 7D, id / 10) as v")
    got = {r.g: r for r in stats.summarize(values, ["g"], "v").collect()}
    assert "crowded" not in labels and "runs" not in labels
    for g in (0, 1):
        v = np.array([7.0 if i < 5000 else i / 10 for i in range(6_000) if i % 2 == g])
        assert got[g].median == 7.0 and got[g]["mad"] == 0.0 and got[g].n == 3_000
        assert got[g]["mean"] == pytest.approx(v.mean()) and got[g]["stddev"] == pytest.approx(v.std(ddof=1))


def test_groups_beyond_what_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(stats, "CURVE_GROUPS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        values = spark.range(2_000).selectExpr("id % 40 as g", "exp(id * 37 % 101 / 20D) as v")
        few = {r.g: r for r in stats.summarize(values, ["g"], "v").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.undo()
    many = {r.g: r for r in stats.summarize(values, ["g"], "v").collect()}
    assert len(few) == 40 and all(few[g].kde_peaks == many[g].kde_peaks and few[g].bc == many[g].bc for g in many)
