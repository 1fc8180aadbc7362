"""Runs are read by their manifest: stray files are left out, missing ones are errors, ranges prune."""

import pytest
from pyspark.sql import functions as F

from tapewright.plans import queries_storage as Q
from tapewright.sources import stored

DAY = 86_400 * 10**9


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    return Q._stored_run(spark, sf_dir)


def test_stray_and_missing_files(spark, run):
    root, path = run
    before = stored.scan_run(spark, root, path).count()
    assert before == stored.read_manifest(spark, path).agg(F.sum("rows")).first()[0] > 0
    # A writer that appends later, to the same partitions.
    table = spark.read.parquet(f"{root}/option_trades")
    extra = spark.createDataFrame(table.limit(50).collect(), table.schema)
    extra.write.mode("append").partitionBy("dt", "root").parquet(f"{root}/option_trades")
    assert stored.scan_run(spark, root, path).count() == before
    assert table.sparkSession.read.parquet(f"{root}/option_trades").count() == before + 50

    broken = f"{root}/broken"
    stored.read_manifest(spark, path).withColumn(
        "relative_path", F.regexp_replace("relative_path", "part-", "gone-")).write.json(broken)
    with pytest.raises(FileNotFoundError):
        stored.scan_run(spark, root, broken)


def test_ranges(spark, run):
    root, path = run
    days = stored.read_manifest(spark, path).agg(F.min("date"), F.min("min_ts_ns"), F.max("max_ts_ns")).first()
    day = stored.scan_run(spark, root, path, date=days[0])
    assert {str(r.dt) for r in day.select("dt").distinct().collect()} == {days[0]}
    since = days[1] // DAY * DAY + 3 * DAY // 4
    part = stored.scan_run(spark, root, path, since_ns=since, until_ns=since + DAY)
    rows = [r[0] for r in part.select("trade_ts_ns").collect()]
    whole = [r[0] for r in stored.scan_run(spark, root, path).select("trade_ts_ns").collect()]
    assert rows and sorted(rows) == sorted(t for t in whole if since <= t < since + DAY)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan.replace("IsNotNull", "isnotnull") and "GreaterThanOrEqual(trade_ts_ns" in plan
    assert stored.scan_run(spark, root, path, date="1970-01-01").count() == 0
