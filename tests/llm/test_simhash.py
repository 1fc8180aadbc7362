"""SimHash against an all-pairs version, the dense path, and the component rounds."""

import random

import numpy as np
import xxhash

from tapewright.llm import simhash
from tapewright.llm.components import components


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_components(ids, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(i)
    return {i: min((ids[k] for k in g if ids[k] is not None), default=None) for g in groups.values() for i in g}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.fp % 2 ** 64, r.component_id) for r in simhash.mark(df).collect()), key=str)
    fps = [plain_fingerprint(t) for _, t in rows]
    of = plain_components([i for i, _ in rows], fps)
    assert got == sorted(((i, fps[k], of[k]) for k, (i, _) in enumerate(rows)), key=str)


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    check(spark, [tuple(r) for r in docs.collect()])


def test_odd_rows(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (4, "A B"), (4, "A B"), (5, "one"), (6, "é É x y z")]
    for k in range(60):
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(400)] = "other"
        rows.append((100 + k, " ".join(words)))
    rows.append((900, "long " * 70000))
    check(spark, rows)
    assert simhash.mark(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    wide = spark.createDataFrame([(1, "a b c d", 5, 6), (2, "a b c d", 7, 8)], "doc_id long, text string, fp int, lost_id int")
    assert [tuple(r) for r in simhash.deduplicate(wide).collect()] == [(1, "a b c d", 5, 6)]


def near_words(rng, n, flips):
    centre = rng.getrandbits(64)
    out = set()
    while len(out) < n:
        x = centre
        for _ in range(rng.randrange(flips + 1)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return list(out)


def link_groups(spark, fps):
    signed = [(x - 2 ** 64 if x >= 2 ** 63 else x,) for x in fps]
    return spark.createDataFrame(signed, "fp long")


def test_links_lose_none(spark):
    rng = random.Random(5)
    fps = list({x for _ in range(8) for x in near_words(rng, 60, 9)} | {rng.getrandbits(64) for _ in range(500)})
    of = plain_components(list(range(len(fps))), fps)
    expected = sorted(sorted(k for k in of if of[k] == r) for r in set(of.values()))
    at = {(x - 2 ** 64 if x >= 2 ** 63 else x): i for i, x in enumerate(fps)}
    for links in (simhash.links(link_groups(spark, fps)), simhash.dense_links(link_groups(spark, fps))):
        groups = {i: {i} for i in range(len(fps))}
        for r in links.collect():
            a, b = groups[at[r.a]], groups[at[r.b]]
            if a is not b:
                a |= b
                for k in b:
                    groups[k] = a
        assert sorted({tuple(sorted(g)) for g in groups.values()}) == [tuple(g) for g in expected]


def test_dense_keys_leave_the_pairwise_path(spark, monkeypatch):
    rng = random.Random(7)
    fps = np.array(near_words(rng, 300, 2), np.uint64)
    import pyarrow as pa

    monkeypatch.setattr(simhash, "RUN", 50)
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(300, 9)), pa.array(fps.view(np.int64))], names=["key", "fp"])
    rows = [r for b in simhash._links(iter([batch.slice(0, 40), batch.slice(40)])) for r in b.to_pylist()]
    assert all(r["dense"] and r["a"] == 9 for r in rows)
    assert sorted(r["b"] for r in rows) == sorted(fps.view(np.int64).tolist())


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_deduplicate_null_and_repeated_ids(spark):
    near, far = " ".join(f"w{i}" for i in range(300)), " ".join(f"z{i}" for i in range(300))
    upper, only = near.upper(), " ".join(f"q{i}" for i in range(300))
    rows = [(1, near), (1, upper), (1, near), (None, near), (None, near), (7, upper), (1, far), (3, far),
            (None, only), (None, only), (None, only.upper())]
    fp = {r.fp for r in simhash.mark(spark.createDataFrame([(1, near), (2, upper)], "doc_id long, text string")).collect()}
    got = [tuple(r) for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(fp) == 1 and len(got) == 3
    assert sorted((i is None, i or 0, t.lower()) for i, t in got) == sorted([
        (False, 1, near), (False, 1, far), (True, 0, only)])
