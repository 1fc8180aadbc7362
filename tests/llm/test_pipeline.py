"""The pipeline stage by stage against plain versions, and its odd inputs."""

import re
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tapewright.llm import fair_mix, host_rules  # noqa: E402
from tests.llm.test_simhash import plain_components, plain_fingerprint  # noqa: E402


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out, folder = [docs], tmp_path_factory.mktemp("stages")
    for name, function in corpus_pipeline.STAGES:
        function(spark, out[-1], sf_dir).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def test_stages_in_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "exact_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    for df in stages[1:5]:
        assert df.columns == stages[0].columns


def test_quality(stages):
    kept = {r.doc_id for r in stages[1].collect()}
    for r in stages[0].collect():
        w = words(r.text)
        grams, covered = {}, set()
        for k in range(len(w) - 7):
            grams.setdefault(tuple(w[k:k + 8]), []).append(k)
        for ks in grams.values():
            if len(ks) > 1:
                covered.update(p for k in ks for p in range(k, k + 8))
        bad = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        symbols = len(re.findall(r"[#*$%&|<>]", r.text))
        if bad or symbols > host_rules.SYMBOLS_PER_WORD[1] * len(w):
            assert r.doc_id not in kept
        elif symbols == 0 and len(set(r.text.split("\n"))) == len(r.text.split("\n")):
            assert r.doc_id in kept


def test_dedup(stages):
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    last = {}
    for r in stages[1].collect():
        last[fold(r.text)] = max(last.get(fold(r.text), -1), r.doc_id)
    rows = stages[2].collect()
    assert sorted(r.doc_id for r in rows) == sorted(last.values())
    of = plain_components([r.doc_id for r in rows], [plain_fingerprint(r.text) for r in rows])
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(set(of.values()))


def test_mix_and_packing(spark, stages):
    taken = {r.doc_id: r.taken // r.size for r in fair_mix.mark(stages[3]).collect() if r.size}
    copies = {}
    for r in stages[4].collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {i: n for i, n in taken.items() if n}
    pieces = stages[5].collect()
    lengths = {}
    for r in pieces:
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    assert max(lengths.values()) <= 1024
    total = {}
    for r in pieces:
        assert len(np.frombuffer(bytes(r.ids), "<u4")) == r.length
        total[r.doc_id] = (total.get(r.doc_id, (0, 0))[0] + r.length, r.doc_tokens)
    assert all(n == copies[i] * each for i, (n, each) in total.items()) and set(total) == set(copies)


def test_odd_documents(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(None, text, "fr", "a", 1), (None, text, "fr", "a", 1), (1, None, None, None, None), (2, "", "en", "b", 0),
            (3, "x " * 10, "en", None, 5), (4, text + " more", "en", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    empty = docs.limit(0)
    for name, function in corpus_pipeline.STAGES:
        docs, empty = function(spark, docs, ""), function(spark, empty, "")
        assert empty.count() == 0 and docs.count() > 0
