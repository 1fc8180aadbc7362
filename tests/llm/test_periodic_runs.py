"""Periodic runs against a plain scan of every period."""

import random
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa

from tapewright.llm import periodic_runs
from tapewright.llm.queries import op12


def plain_runs(words, min_length=24, min_exponent=3):
    n, found = len(words), {}
    for p in range(1, n // min_exponent + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(min_length, min_exponent * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((start, length, p) for (start, length), p in found.items())


def plain_kept(words, runs):
    gone = {i for start, length, p in runs for i in range(start + p, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def random_words(rng):
    n = rng.choice([0, 1, 5, 23, 24, 30, 60, 200, 500])
    words = [rng.choice("abcdefgh"[:rng.choice([1, 2, 3, 8])]) for _ in range(n)]
    for _ in range(rng.choice([0, 1, 2, 3]) if n > 30 else 0):
        a, p = rng.randrange(n), rng.randrange(1, max(2, n // 3))
        for i in range(a + p, min(n, a + rng.randrange(1, 6 * p))):
            words[i] = words[i - p]
    return words


def test_random_documents():
    rng, total = random.Random(3), 0
    for _ in range(120):
        docs = [random_words(rng) for _ in range(rng.choice([1, 4, 20]))]
        docs += docs[:rng.choice([0, 3])]   # copies side by side share no runs
        texts = [rng.choice(["", " "]) + rng.choice([" ", "\n", " \t"]).join(d) for d in docs]
        sizes, runs, collapsed = periodic_runs.block_runs(pa.array(texts))
        for i, words in enumerate(docs):
            want = plain_runs(words)
            total += len(want)
            assert sizes[i].as_py() == len(words)
            assert [(r["start"], r["length"], r["period"]) for r in runs[i].as_py()] == want
            assert collapsed[i].as_py() == " ".join(plain_kept(words, want))
    assert total > 60


def test_other_limits_and_small_slices(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS", 50)
    rng = random.Random(4)
    for _ in range(60):
        words = random_words(rng)
        _, runs, _ = periodic_runs.block_runs(pa.array([" ".join(words)]), 6, 2)
        assert [(r["start"], r["length"], r["period"]) for r in runs[0].as_py()] == plain_runs(words, 6, 2)


def test_extensions():
    rng = np.random.default_rng(5)
    for letters, n in ((2, 400), (1, 300), (40, 200), (3, 31), (3, 2)):
        sequence = np.append(rng.integers(0, letters, n), 99)
        lce = periodic_runs.Extension(sequence)
        a = rng.integers(0, n, 200)
        b = rng.integers(0, n, 200)
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        for x, y, got in zip(a, b, lce.of(a, b)):
            want = 0
            while y + want < len(sequence) and sequence[x + want] == sequence[y + want]:
                want += 1
            assert got == want


def test_long_document_of_one_word():
    (_, first, length, period) = periodic_runs.runs(np.append(np.zeros(30_000, np.int64), 1), np.array([0]), np.array([30_000]))
    assert (first.tolist(), length.tolist(), period.tolist()) == ([0], [30_000], [1])


def test_frames(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "a " * 24, 6), (1, "b", 7), (2, "", 8), (3, "é é é\x1cé " * 30, 9)],
                                 "doc_id long, text string, runs int")
    rows = {(r.doc_id, r.n_words): r for r in periodic_runs.find(docs).collect()}
    assert set(rows) == {(1, 0), (None, 24), (1, 1), (2, 0), (3, 60)}
    assert rows[None, 24].runs == [(0, 24, 1)] and rows[None, 24].collapsed == "a"
    assert rows[3, 60].runs == [(0, 60, 2)] and rows[3, 60].collapsed == "é é é\x1cé"
    assert rows[1, 0].runs == [] and rows[2, 0].collapsed == ""
    assert periodic_runs.find(docs.limit(0)).count() == 0


def planted(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op12(spark, sf_dir).collect()
    assert len(rows) == len(texts) and any(r.n_runs for r in rows)
    for r in rows:
        words = planted(r.doc_id, texts[r.doc_id])
        runs = plain_runs(words)
        best = min(runs, key=lambda v: (-Fraction(v[1], v[2]), v[0], v[2])) if runs else (None, None, None)
        assert r.n_runs == len(runs) and (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        assert r.runs_sha256 == sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == sha256(" ".join(plain_kept(words, runs)).encode()).hexdigest()
