"""Noisy-or: held-out accuracy, the formula by hand, offending sentences, odd rows."""

import math
import zlib

import pytest

from tapewright.llm import noisy_or
from tapewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return noisy_or.train(docs, labels)


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op7_noisy_or"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in labels]
    toxic = [r for r in test if labels[r.doc_id]]
    assert sum(r.predicted for r in toxic) >= 0.88 * len(toxic) > 50
    assert sum(r.predicted for r in test) - sum(r.predicted for r in toxic) <= 0.01 * len(test)


def test_formula_and_sentences(model, spark):
    text = "The and of. You idiot, you moron! Here\nit is."
    spans = noisy_or.sentences(text)
    assert [text[a:b].strip() for a, b in spans] == ["The and of.", "You idiot, you moron!", "Here", "it is."]
    clean = 1 - model.leak
    for a, b in spans:
        z = model.bias + sum(model.weights.get(w, 0) for w in noisy_or.sentence_words(text, a, b))
        clean *= 1 - 1 / (1 + math.exp(-z))
    assert model.score(text) == pytest.approx(1 - clean)
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y")], "doc_id long, text string, score string")
    found = noisy_or.offending(df, model).collect()
    assert [(r.doc_id, r.sentence, text[r.begin:r.finish].strip()) for r in found] == \
        [(1, "You idiot, you moron!", "You idiot, you moron!")]


def test_odd_rows(model, spark):
    assert model.score(None) == model.score("") == pytest.approx(model.leak)
    assert model.score("the and of " * 200_000) < 0.3
    df = spark.createDataFrame([(None, "a"), (None, "a"), (3, None)], "doc_id long, text string")
    assert noisy_or.score(df, model).count() == 3
    assert noisy_or.score(df.limit(0), model).count() == 0
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert noisy_or.train(df, empty).score("anything") == 0
    one = spark.createDataFrame([(3, 1), (4, None)], "doc_id long, toxic int")
    assert noisy_or.train(df, one).leak in (0.0, 1.0)


def test_settings_are_chosen_without_held_out_rows(spark):
    texts = ["you idiot moron. the and of" if i % 3 == 0 else "the and of. here it is" for i in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(240)]
    labels = [[(i, (i % 3 == 0) != (flip and held[i])) for i in range(240)] for flip in (False, True)]
    grid = [noisy_or.Settings(rounds=60), noisy_or.Settings(rounds=2)]
    found = [noisy_or.choose(docs, spark.createDataFrame([(i, int(y)) for i, y in ys], "doc_id long, toxic int"), grid=grid)
             for ys in labels]
    assert found[0] == found[1] and found[0][0][1] == grid[0]
    assert {noisy_or.inner_fold(i) for i in range(240) if not held[i]} == {0, 1, 2}
