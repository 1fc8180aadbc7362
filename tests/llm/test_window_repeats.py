"""Substring dedup against a plain version, with a small window to meet odd cases."""

import random

import pytest

from tapewright.llm import window_repeats


def plain(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    key = [window_repeats.LAST if i is None else i for i, _ in rows]
    first = {}
    for k, w in zip(key, words):
        for s in range(len(w) - window + 1):
            gram = tuple(w[s:s + window])
            first[gram] = min(first.get(gram, k), k)
    out = []
    for (i, _), k, w in zip(rows, key, words):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < k:
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), b" ".join(x for n, x in enumerate(w) if n not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [10_000, 2])
def test_against_plain(spark, monkeypatch, hot):
    monkeypatch.setattr(window_repeats, "HOT", hot)
    rng = random.Random(11)
    pool = [[f"p{k}w{i}" for i in range(rng.randrange(5, 40))] for k in range(6)]
    rows = [(1, None), (2, ""), (3, "one two"), (None, " ".join(pool[0])), (None, " ".join(pool[0] + pool[1]))]
    for i in range(10, 60):
        text = []
        for _ in range(rng.randrange(1, 5)):
            text += rng.choice(pool) if rng.random() < 0.6 else [f"x{rng.randrange(9)}" for _ in range(rng.randrange(20))]
        rows.append((i, " ".join(text)))
    rows += [(20, " ".join(pool[2])), (20, " ".join(pool[2])), (70, "same " * 300), (71, "é same " + "same " * 20)]
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, tid string, starts int")
    got = window_repeats.remove_repeats(df, window=8, gram=3).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, 8)


def test_empty(spark):
    assert window_repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
