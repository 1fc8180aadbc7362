"""The header index of CSV files opens the head of every file only."""

import bz2
import gzip
import zlib

import pytest

from tapewright.sources import flatfiles


def test_headers_read_the_head_of_each_file(spark, tmp_path):
    # Files whose tails are damaged: whoever read past the head would fail.
    rows = "".join(f"A,{i * 2654435761 % 2 ** 32},{i * 40503 % 65521}\n" for i in range(200_000))
    for name, header in (("a", "ticker,price,size"), ("b", "ticker,price,size"), ("c", "ticker,size,price")):
        packed = gzip.compress(f"\n \r\n{header}\r\n{rows}".encode(), 1)
        (tmp_path / f"{name}.csv.gz").write_bytes(packed[:len(packed) // 2] + bytes(len(packed) // 2))
    (tmp_path / "d e.csv.bz2").write_bytes(bz2.compress(f"ticker,price,size\n{rows}".encode()))
    (tmp_path / "empty.csv").write_text("")
    groups = flatfiles._headers(spark, [str(tmp_path)])
    assert {h: sorted(p.rsplit("/", 1)[1] for p in files) for h, files in groups.items()} == {
        "ticker,price,size": ["a.csv.gz", "b.csv.gz", "d e.csv.bz2"], "ticker,size,price": ["c.csv.gz"]}
    with pytest.raises(Exception):
        flatfiles._scanned_heads(spark, [str(tmp_path)]).collect()


def test_head_across_blocks(tmp_path):
    path = tmp_path / "x.csv"
    for text, want in (("\n" * 200_000 + "ticker,p\nA,1\n", "ticker,p"), ("ticker", "ticker"), ("", ""), ("\n\n", ""),
                       ("ticker," + "p" * 150_000 + "\r\nA", "ticker," + "p" * 150_000)):
        path.write_text(text, newline="")
        assert flatfiles._head(path.as_uri()) == want
    assert flatfiles._head("nosuchstore://host/x.csv") is None
    assert flatfiles._head(path.as_uri() + ".snappy") is None


def test_files_that_tasks_cannot_open(spark, tmp_path):
    for i in range(40):
        text = b"ticker,price\nA,1\n" if i % 2 else b"\nprice,ticker\n1,A\n"
        (tmp_path / (f"{i}.csv.deflate" if i < 20 else f"{i} x.csv")).write_bytes(zlib.compress(text) if i < 20 else text)
    rows = flatfiles.read_csv(spark, str(tmp_path)).select("ticker", "price").collect()
    assert [tuple(r) for r in rows] == [("A", "1")] * 40
