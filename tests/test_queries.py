"""Registry contract, storage round trips and a sample of queries against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from tapewright import schemas
from tapewright.plans import views as V
from tapewright.sources import flatfiles

SAMPLE = ("touch_share", "classify", "trade_uid", "moments", "quartiles", "mode_estimate", "kde_peaks",
          "box_cox_lambda", "scan_equity_trades", "decode_quote_msgs", "incremental_filter", "run_log",
          "stream_asof", "stream_windows")


def test_schema_sizes():
    sizes = {"OPTION_TRADES": 27, "EQUITY_TRADES": 30, "QUOTES": 14, "GREEKS_OVERLAY": 22, "AGGREGATIONS": 154}
    assert {n: len(getattr(schemas, n).fields) for n in sizes} == sizes


def test_registry():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) > 100


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in ("events", "lineitem", "orders", "part"):
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = entry_module.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rel = duck.sql(entry_module.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    key = lambda row: tuple(str(v) for v in row)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=key)
    assert got == want


def test_documented_sample_rows(spark, tmp_path):
    text = ("ticker,conditions,correction,exchange,id,participant_timestamp,price,sequence_number,sip_timestamp,"
            "size,tape,trf_id,trf_timestamp\n"
            'MSFT,"12,37",,11,1,1679990400018025984,276.16,1550,1679990400018381329,55,3,,0\n')
    path = tmp_path / "trades.csv"
    path.write_text(text)
    row = flatfiles.equity_trades(flatfiles.read_csv(spark, str(path))).first()
    assert (row["symbol"], row["price"], row["size"], row["conditions"], row["exchange"]) == \
        ("MSFT", 276.16, 55, [12, 37], 11)
    assert row["trade_ts_ns"] == 1679990400018381329 and row["seq"] == 1550


def test_views_have_unique_order(spark, sf_dir):
    t = V.option_trades(spark, sf_dir)
    assert t.select("underlying", "trade_ts_ns", "seq").distinct().count() == t.count()
