"""Counters of a write come from the write itself."""

from tapewright.plans import views as V
from tapewright.functions import scalars as S
from tapewright.session import fresh_dir
from tapewright.sinks import tables as T


def test_counters_of_a_write(spark, sf_dir):
    trades = V.trades(spark, sf_dir).withColumn("dt", S.utc_date("trade_ts_ns"))
    path = f"{fresh_dir(spark, 'observed')}/trades"
    seen = T.write_partitioned(trades, path, ["dt"], observed="trade_ts_ns", days=["2024-01-02", "1999-01-01"])
    written = spark.read.parquet(path)
    assert seen["rows"] == written.count() > 0
    assert seen["day_2024-01-02"] == written.where("dt = '2024-01-02'").count()
    assert seen["day_1999-01-01"] == 0
    assert (seen["min_ts_ns"], seen["max_ts_ns"]) == written.selectExpr("min(trade_ts_ns)", "max(trade_ts_ns)").first()


def test_an_empty_write(spark, sf_dir):
    trades = V.trades(spark, sf_dir).withColumn("dt", S.utc_date("trade_ts_ns")).where("price < 0 and price > 0")
    seen = T.write_partitioned(trades, f"{fresh_dir(spark, 'observed')}/trades", ["dt"], observed="trade_ts_ns")
    assert seen == {"rows": 0, "min_ts_ns": None, "max_ts_ns": None}
    assert T.write_partitioned(trades, f"{fresh_dir(spark, 'observed')}/trades", ["dt"]) is None
