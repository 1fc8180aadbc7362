"""Lexical search against a plain scoring of every document."""

import math
import random
import re

import duckdb
import pytest

from tapewright.llm import mask_search
from tapewright.llm.queries import ORACLES, op13

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    found = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    found = [(d, t) for d, t in found if t]
    n, total = len(found), sum(len(t) for _, t in found)
    df = {}
    for _, t in found:
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    out = []
    for item, text in items:
        own = set(TERM.findall((text or "").translate(LOWER))) & set(df)
        scored = []
        for d, t in found:
            m = 10 + 90 * len(t) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                        * (1_000_000_000 * t.count(w) // (1000 * t.count(w) + 8 * m)) for w in own)
            if score > 0:
                scored.append((-score, d is None, d, score))
        out += [(item, i + 1, d, s) for i, (_, _, d, s) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:k])]
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"DOCS": 7, "FIRST": 1}, {"ITEMS": 3}, {"POSTINGS": 1, "SALTS": 1, "ITEM_CHARS": 1}])
def test_random_tables(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(mask_search, name, value)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(30)] + ["The", "the", "ÉÉ", "éé", "x-y", "a_b"]
    def text(n):
        return rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary[:rng.choice([4, 36])]) for _ in range(n))

    docs = [(rng.choice([None, i, i]), rng.choice([None, "", "...", *[text(rng.randrange(1, 40)) for _ in range(9)]]))
            for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(30)]   # ties
    items = [(i, text(rng.randrange(1, 90))) for i in range(6)] + [(90, None), (91, "!!"), (92, "nowhere")]
    got = mask_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                             spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    # Rows without an id are interchangeable among equal scores.
    assert rows(got) == sorted(plain(docs, items), key=str)


def test_names_types_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "one two", 1), ("a", "two one", 2), ("c", "three", 3)], "id string, body string, score int")
    items = spark.createDataFrame([("q", "ONE"), ("q", "One")], "rank string, terms string")
    got = mask_search.search(docs, items, doc_id="id", text="body", item_id="rank", item_text="terms")
    assert [r[:3] for r in rows(got)] == [("q", 1, "a")] * 2 + [("q", 2, "b")] * 2
    wanted = dict(doc_id="id", text="body", item_id="rank", item_text="terms")
    assert mask_search.search(docs.limit(0), items, **wanted).count() == 0
    assert mask_search.search(docs, items.limit(0), **wanted).count() == 0


def test_stops_before_all_masks(spark):
    """Bounds end the evaluation early without changing the result."""
    import numpy as np

    rng = np.random.default_rng(2)
    n, terms = 2000, 12
    held = rng.random((n, terms)) < 0.3
    n_terms = held.sum(axis=1)
    block = mask_search.Block(list(range(n)), np.full(n, 40), n_terms, np.nonzero(held)[1].astype(np.int32),
                              np.ones(n_terms.sum(), np.int32), n, 40 * n)
    weight = np.arange(1, terms + 1) * 100
    items = mask_search.Items(None, ["q"], [np.arange(terms)])
    best, seen = mask_search.Best(items, weight, 10), []
    monkey = block.scores
    block.scores = lambda docs, weight_of: (seen.append(len(docs)), monkey(docs, weight_of))[1]
    best.add(block)
    every = monkey(np.flatnonzero(n_terms), weight)
    want = sorted(zip((-every).tolist(), np.flatnonzero(n_terms).tolist()))[:10]
    assert best.found[0] == [(-s, d) for s, d in want]
    assert sum(seen) < n / 2


def test_query(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    got = rows(op13(spark, sf_dir).select("item_id", "rank", "doc_id", "score"))
    assert got == sorted(con.sql(ORACLES["op13_mask_search"]).fetchall(), key=str)
