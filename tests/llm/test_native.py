"""The operators that are DataFrame expressions: against plain versions on small odd tables, and the SQL twins."""

import hashlib
import random
import re

import duckdb
import pytest

from tapewright.llm import exact_copies, fair_mix, host_rules, line_runs
from tapewright.llm.queries import ORACLES, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()
ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "One two", "b"), (4, "one TWO", "b"), (5, "ÉCOLE two", "b"),
       (6, "école two", "b"), (None, "one two", None), (None, "x", "b"), (None, "x", "b"), (9, "w " * 50_000, "hot"),
       (10, "a b c d e f g h i " * 3, "hot"), (11, "# | $ word\n\nword\nword\n# | $ word", "hot")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, s, "x", 1, 2) for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, digest string, kept int, `a.b` int")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    rel = con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_copies(spark, odd):
    groups = {}
    for i, t, _ in ODD:
        groups.setdefault(fold(t), []).append(i)
    want = []
    for i, t, _ in ODD:
        ids = groups[fold(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(fold(t).encode()).hexdigest()))
    assert sorted((tuple(r) for r in exact_copies.mark(odd).collect()), key=str) == sorted(want, key=str)
    kept = exact_copies.deduplicate(odd)
    assert kept.columns == odd.columns
    texts = [fold(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted(groups)
    assert exact_copies.deduplicate(odd.limit(0)).count() == exact_copies.mark(odd.limit(0)).count() == 0


def test_shared_digests_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    keyed = exact_copies._keyed
    monkeypatch.setattr(exact_copies, "_keyed", lambda *a: keyed(*a).withColumn("digest", F.lit("same")))
    df = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_copies.mark(df).collect())
    assert got == [(1, 2, 2), (2, 2, 2), (3, 3, 1)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_measures(spark, odd):
    got = {}
    out, m, kept = host_rules.verdicts(odd)
    assert {*odd.columns} < {*out.columns}
    for r in out.collect():
        got.setdefault((r.doc_id, r.text), []).append(r[m])
    for i, t, _ in ODD:
        w = words(t)
        grams = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
        seen = {}
        for k, g in enumerate(grams):
            seen.setdefault(g, []).append(k)
        covered = {p for ks in seen.values() if len(ks) > 1 for k in ks for p in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines),
                len(lines) - len(set(lines)), len(covered))
        assert all(tuple(x) == want for x in got[(i, t)])
    assert host_rules.keep_good(odd).columns == odd.columns
    assert host_rules.keep_good(odd.limit(0)).count() == 0


def test_watched_hosts(spark):
    from pyspark.sql import functions as F

    # Ten hosts with one failure in ten, one bad, one of a single failing document.
    rows = [(f"h{h}", k == 0) for h in range(10) for k in range(50) if k % 5 == 0 or k > 4]
    rows += [("bad", k < 45) for k in range(50)] + [("tiny", True), (None, False)]
    rates = {r.host: r.rate for r in host_rules.host_rates(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
    assert rates["bad"] > host_rules.WATCH > rates["h0"] and rates["tiny"] < 1 and rates[None] > 0
    clean = " ".join(f"word{i}" for i in range(40))
    docs = [(k, "junk", "x") for k in range(30)] + [(100, clean, "x"), (101, clean + " # # # # # #", "x")]
    docs += [(200 + k, clean + f" {k}", f"s{k % 5}") for k in range(60)] + [(300, clean + " # # # # # #", "s1")]
    out, m, kept = host_rules.verdicts(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    got = {r.doc_id: r[kept] for r in out.where(F.col("doc_id") >= 100).collect()}
    assert got == {**{i: True for i in got}, 101: False}


def plain_mix(rows):
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 3 * sizes[s]}
        for s in full or open_:
            target[s] = min(level * weight[s], 3 * sizes[s])
        open_ = open_ - full if full else set()
    return sizes, target


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randrange(1, 40)), rng.choice(["a", "b", "b", "b", "b", "c", None, "é"])) for i in range(400)]
    rows += [(900, None, "a"), (901, "", "z"), (None, "x y", "c")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, last_round int")
    sizes, target = plain_mix(rows)
    source = {(i, len(words(t))): s for i, t, s in rows}
    taken = {}
    for r in fair_mix.mark(df).collect():
        s = source[(r.doc_id, r.size)]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert r.taken in {k * r.size for k in range(4)}
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 80 for s in sizes)
    assert sum(taken.values()) <= sum(sizes.values())
    mixed = fair_mix.mix(df)
    assert mixed.columns == df.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(taken.values())
    assert fair_mix.mix(df.limit(0)).count() == fair_mix.mark(df.limit(0)).count() == 0


def test_line_runs(spark):
    rng = random.Random(4)
    runs = [[f"r{k} line {i}" for i in range(rng.randrange(2, 6))] for k in range(5)]
    rows = [(1, None), (2, ""), (None, "\n".join(runs[0])), (50, "\n".join(runs[1])), (50, "\n".join(runs[1]))]
    rows += [(51, "\n".join(["same"] * 9)), (52, "a\n\nb\n \nc"), (53, "a\nb\n\nc\nd")]
    for i in range(60, 100):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            lines += rng.choice(runs) if rng.random() < 0.7 else [f"x{rng.randrange(5)}", ""]
        rows.append((i, "\n".join(lines)))
    seen, want = {}, []
    key = lambda r: (r[0] is None, r[0] or 0)
    for i, t in sorted(rows, key=key):
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if words(x)]
        gone = set()
        for k in range(len(at) - 2):
            run = tuple(lines[p] for p in at[k:k + 3])
            if seen.setdefault(run, (i, k)) != (i, k):
                gone.update(at[k:k + 3])
        want.append((i, len(at), len(gone), "\n".join(x for p, x in enumerate(lines) if p not in gone)))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, starts int, tid int")
    got = [tuple(r) for r in line_runs.remove_runs(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert line_runs.remove_runs(df.limit(0)).count() == 0


def test_line_runs_short(spark):
    rows = [(1, "one two three\nshort"), (2, "one two three\nshort"), (3, "x\n\none two three\ny"), (4, "short"),
            (5, "p q\nr s"), (6, "p q\n \nr s\nz"), (7, "z\np q"), (None, "short\nz"), (9, "a\nb\nc"), (10, "c\na\nb\nc")]
    for short_words in (1, 3, 4):
        seen, want = {}, []
        for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            lines = t.split("\n")
            at = [k for k, x in enumerate(lines) if words(x)]
            gone = set()
            for size in (1, 2, 3):
                for k in range(len(at) - size + 1):
                    run = tuple(lines[p] for p in at[k:k + size])
                    long_enough = size == 3 or sum(len(words(x)) for x in run) >= short_words
                    if long_enough and seen.setdefault(run, (i, k)) != (i, k):
                        gone.update(at[k:k + size])
            want.append((i, len(at), len(gone), "\n".join(x for p, x in enumerate(lines) if p not in gone)))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = [tuple(r) for r in line_runs.remove_runs(df, short_words=short_words).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert (2, 2, 2, "") in got
    assert line_runs.remove_runs(df.limit(0), short_words=1).count() == 0


def test_line_runs_beyond_the_first_place(spark):
    # The line that all three share stands first between other neighbours; the run is repeated after that.
    rows = [(1, "u\nshared\nv"), (2, "c\nshared\nd\ne"), (3, "c\nshared\nd\ne\nf")]
    got = line_runs.remove_runs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_removed, r.kept) for r in got.collect()) == [
        (1, 0, rows[0][1]), (2, 0, rows[1][1]), (3, 4, "f")]
