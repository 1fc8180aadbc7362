"""What dedup and the enrichment run shuffle: each column once, and no trades for a join with their days."""

from tapewright.operators import hygiene
from tapewright.plans import catalog, enrich


def test_dedup_shuffles_each_column_once(spark):
    rows = spark.createDataFrame([(i % 50, float(i % 3), 900 - i, f"note{i}") for i in range(300)],
                                 "k bigint, p double, seq bigint, note string")
    first = hygiene.dedup_first(rows, ["k", "p"], ["k", "seq"])
    assert "min_by" not in first._jdf.queryExecution().executedPlan().toString()   # it ships row and order
    wanted = {(r.k, r.p): r for r in sorted(rows.collect(), key=lambda r: -r.seq)}
    got = first.collect()
    assert first.columns == rows.columns and len(got) == len(wanted) and all(wanted[(r.k, r.p)] == r for r in got)
    assert hygiene.dedup_first(rows.select("k"), ["k"], []).count() == 50


def test_trades_are_not_shuffled_to_find_their_curve(spark, sf_dir, monkeypatch):
    plans, write = [], enrich.tables.write_greeks_overlay
    monkeypatch.setattr(enrich.tables, "write_greeks_overlay", lambda df, *rest: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or write(df, *rest))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # no luck with small tables
    try:
        assert catalog.queries()["enrich_run"](spark, sf_dir).count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plans[0].splitlines() if "LeftSemi" in line and "__day" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)
