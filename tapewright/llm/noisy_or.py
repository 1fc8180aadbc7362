"""Toxicity by multiple-instance learning with a noisy-or.

A sentence is toxic with probability p = sigmoid(bias + the weights of its words), and
a document with 1 - (1 - leak) * product of (1 - p) over its sentences. Only documents
carry labels; the gradient shares a document's label out among its sentences by their
probabilities, so the model learns which sentences offend. The leak takes up labels
that no sentence explains, so long clean texts do not add up to a high score.

The model is fitted on the driver to at most ``SAMPLE`` labelled documents, the first
by a hash of doc_id: a bounded sample, so the model is bounded too (words seen in
``MIN_DOCS`` of them or more, weights made sparse by soft thresholding). Scoring is one
pass over all whole texts, without a shuffle.

Defined cases: an empty or null text scores the leak; a null label is no label; without
labels of both kinds every document scores the share of positive labels (0 if there is
none); repeated rows are scored each; an empty table gives an empty result; other
columns may have any name.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import quoted

SAMPLE = 6000
MIN_DOCS = 4
RATE = 0.1
START_BIAS = -7.0
STEM = 4      # letters that inflected forms of a word share
NEVER = -700.0  # bias of a model without words
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"[^\W_]+")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, blank ones left out."""
    return [m.span() for m in SENTENCE.finditer(text or "") if not m.group().isspace()]


def sentence_words(text: str, start: int, end: int) -> set[str]:
    """The words of a sentence, and the stems (marked by a star) of longer ones."""
    found = set(WORD.findall(text[start:end].lower()))
    found.update([w[:STEM] + "*" for w in found if len(w) > STEM])
    return found


@dataclass(frozen=True)
class Settings:
    """What choose() picks by folds inside the training rows; the values here are its choice."""
    end_bias: float = -9.5
    sparse: float = 1e-4
    rounds: int = 250


GRID = [Settings(b, s, r) for b in (-8.0, -9.5, -11.0) for s in (0.0, 1e-4, 1e-3) for r in (120, 250)]


@dataclass
class Model:
    leak: float
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def sentence_scores(self, text: str | None) -> np.ndarray:
        """Probability of each sentence of sentences(text)."""
        get = self.weights.get
        z = np.array([sum(get(w, 0.0) for w in sentence_words(text, a, b)) for a, b in sentences(text)])
        return 1 / (1 + np.exp(-(z + self.bias)))

    def score(self, text: str | None) -> float:
        return float(1 - (1 - self.leak) * np.prod(1 - self.sentence_scores(text)))


def fit(texts: list[str | None], labels: list[int], settings: Settings = Settings()) -> Model:
    """Fit to documents with a label each. Full-batch Adam; the result is deterministic."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(leak=float(y.mean()) if len(y) else 0.0, bias=NEVER)
    # Two passes over the texts: nothing but counts and flat arrays is held, so memory is that
    # of the sample's distinct words.
    seen: Counter = Counter()
    for t in texts:
        seen.update(set().union(*(sentence_words(t, a, b) for a, b in sentences(t))))
    names = sorted(w for w, n in seen.items() if n >= MIN_DOCS)
    del seen
    index = {w: i for i, w in enumerate(names)}
    doc, row, col = array("i"), array("i"), array("i")
    for d, t in enumerate(texts):
        for a, b in sentences(t):
            cols = sorted(index[w] for w in sentence_words(t, a, b) if w in index)
            row.extend([len(doc)] * len(cols))
            col.extend(cols)
            doc.append(d)
    n_rows = len(doc)
    doc, row, col = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (doc, row, col))
    w = np.zeros(len(names) + 2)       # words, bias, leak
    w[-2], w[-1] = START_BIAS, np.log(y.mean() / (1 - y.mean()))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, settings.rounds + 1):
        # Sentences start open to blame and end innocent unless their words tell, so that
        # thousands of clean ones do not add up; what nothing explains goes to the leak.
        w[-2] = START_BIAS + (settings.end_bias - START_BIAS) * t / settings.rounds
        z = np.bincount(row, w[col], n_rows) + w[-2]
        p = 1 / (1 + np.exp(-z))
        p = np.minimum(p, 1 - 1e-12)
        leak = 1 / (1 + np.exp(-w[-1]))
        clean = np.exp(np.log1p(-leak) + np.bincount(doc, np.log1p(-p), len(y)))
        # d loss / d z of a sentence: p for a clean document, -p * clean / toxic for a toxic one.
        pull = np.where(y > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0) / len(y)
        by_sentence = pull[doc] * p
        g = np.concatenate([np.bincount(col, by_sentence[row], len(names)), [0.0, pull.sum() * leak]])
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        step = RATE / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-8)
        w -= step * first / (1 - 0.9 ** t)
        words = w[:-2]
        w[:-2] = np.sign(words) * np.maximum(np.abs(words) - step[:-2] * settings.sparse, 0)
    kept = {n: float(v) for n, v in zip(names, w[:-2]) if abs(v) > 1e-3}
    return Model(float(1 / (1 + np.exp(-w[-1]))), float(w[-2]), kept)


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int) -> list:
    """k, t, y of at most sample labelled documents that are not held out (twice that, where ids repeat)."""
    marked = labels.select(quoted(doc_id).alias("k"), quoted(label).alias("y")).where(
        F.col("y").isNotNull() & ~held_out(F.col("k")))
    chosen = marked.orderBy(F.xxhash64("k"), "k", "y").limit(sample)
    return (docs.select(quoted(doc_id).alias("k"), quoted(text).alias("t")).join(chosen, "k")
            .orderBy("k", "y", F.xxhash64("t")).limit(2 * sample).collect())


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic", sample: int = SAMPLE, settings: Settings = Settings()) -> Model:
    """Fit to at most sample labelled documents that are not held out."""
    rows = _labelled(docs, labels, doc_id, text, label, sample)
    return fit([r.t for r in rows], [int(r.y) for r in rows], settings)


def inner_fold(key) -> int:
    """0, 1 or 2 for a row that is not held out: crc32 of the id as text leaves 0, 1 or 3 when divided by 4."""
    return {0: 0, 1: 1, 3: 2}[zlib.crc32(str(key).encode()) % 4]


def choose(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
           sample: int = SAMPLE, grid: list[Settings] = GRID) -> list[tuple[float, Settings]]:
    """(mean log loss over the inner folds, settings), best first.

    Each of three folds of the training rows is scored by a model of the other two. Held-out
    rows are not read. The fits, one for each settings and fold, are spread over tasks."""
    spark = docs.sparkSession
    rows = [(inner_fold(r.k), r.t, int(r.y)) for r in _labelled(docs, labels, doc_id, text, label, sample)]
    shared = spark.sparkContext.broadcast(rows)   # at most 2 * sample rows

    def run(batches):
        for batch in batches:
            out = []
            for number, fold in zip(batch["number"], batch["fold"]):
                known = [r for r in shared.value if r[0] != fold]
                model = fit([r[1] for r in known], [r[2] for r in known], grid[number])
                p = np.array([model.score(r[1]) for r in shared.value if r[0] == fold])
                y = np.array([r[2] for r in shared.value if r[0] == fold])
                p = np.clip(p, 1e-6, 1 - 1e-6)
                out.append((number, float(-np.where(y > 0, np.log(p), np.log1p(-p)).sum()), len(y)))
            yield pd.DataFrame(out, columns=["number", "loss", "n"])

    jobs = spark.range(3 * len(grid)).selectExpr("int(id div 3) as number", "int(id % 3) as fold")
    spread = jobs.repartitionByRange(3 * len(grid), "number", "fold")
    losses = (spread.mapInPandas(run, "number int, loss double, n long").groupBy("number")
              .agg((F.sum("loss") / F.sum("n")).alias("loss")).collect())
    return sorted(((r.loss, grid[r.number]) for r in losses), key=lambda x: (x[0], GRID.index(x[1]) if x[1] in GRID else 0))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of every row."""
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.select(quoted(doc_id).alias("doc_id"), F.pandas_udf(run, "double")(quoted(text)).alias("score"))


def offending(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text",
              least: float = 0.5) -> DataFrame:
    """Sentences with a probability of at least least: doc_id, begin, finish, sentence, p."""
    def run(batches):
        for batch in batches:
            found = []
            for key, t in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                for (a, b), p in zip(sentences(t), model.sentence_scores(t)):
                    if p >= least:
                        found.append((key, a, b, t[a:b].strip(), float(p)))
            yield pd.DataFrame(found, columns=["doc_id", "begin", "finish", "sentence", "p"])

    # Ids travel as text: pandas would turn whole numbers beside a null into doubles.
    found = docs.select(quoted(doc_id).cast("string"), quoted(text)).mapInPandas(
        run, "doc_id string, begin int, finish int, sentence string, p double")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))
