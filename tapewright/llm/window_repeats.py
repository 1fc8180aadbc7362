"""Substring dedup: words in 50-word windows that a document with a smaller id has too.

1. Anchors. Each window is represented by the smallest of its 16-word hashes. Equal
   windows have the same anchor, so a window occurs in no more documents than its
   anchor does. A document hands on each anchor once: about one for 18 words.
2. Count-min sketch. Anchors are counted in ``ROWS`` rows of cells. Tasks count their own
   part, the parts are merged by adding cell to cell, and the smaller cell of an anchor
   is its estimate, never below the true count. The sketch has eight to sixteen cells
   per anchor, so it thins equally well at every size; it is a distributed table, never
   sent to a task whole.
3. Exact pass. Only windows whose anchor is estimated to occur twice are hashed (95
   bits) and grouped; none that repeats is left out. A window loses where a smaller
   doc_id has it. The estimate also tells how many groups a hot window is salted into;
   the smallest document of each salt then meets the others in a second round.

Only documents with such windows are written again and cut.

Defined cases: a null text has no words; a null doc_id counts as the largest; rows that
share a doc_id are told apart by their text and never cut each other; texts of any
length are taken whole; an empty table gives an empty result; other columns may have
any name.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import LAST, keyed_rows, stage

WINDOW = 50
GRAM = 16
ROWS = 2
HOT = 10_000
BATCH = 50_000  # windows handed on at once
MEMO = 150_000   # word hashes remembered by a worker
# Odd multipliers of the rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

_memo: dict[bytes, int] = {}


def split(text: str | None) -> list[bytes]:
    """Words as bytes: split() on bytes cuts at the six ASCII spaces only."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_memo) > MEMO:
        _memo.clear()
    for w in set(words).difference(_memo):
        _memo[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def rolling(hashes: np.ndarray, length: int, base: int) -> np.ndarray:
    """Mixed 64-bit hash of every run of length consecutive values."""
    n = len(hashes)
    if n < length:
        return np.empty(0, np.uint64)
    powers = _powers(base, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers, out=sums[1:])
    # An odd base has an inverse; its powers bring every run to the same place.
    x = (sums[length:] - sums[:-length]) * _powers(pow(base, -1, 1 << 64), n - length + 1)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_anchors(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The anchor of every window: the smallest hash of its grams."""
    grams = rolling(hashes, gram, BASES[0])
    width = window - gram + 1
    n = len(hashes) - window + 1
    if n < 1:
        return np.empty(0, np.uint64)
    # Minimum over width values by doubling: each step joins two shorter minima.
    least, have = grams, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least[:n]


def anchors(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc, tid, anchor: the anchors of each document, each once."""
    def run(batches):
        for batch in batches:
            found = [np.unique(window_anchors(word_hashes(split(t)), window, gram))
                     for t, in _one_by_one(batch, ("text",))]
            sizes = [len(f) for f in found]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(batch.column("doc").to_numpy(zero_copy_only=False), sizes)),
                pa.array(np.repeat(batch.column("tid").to_numpy(zero_copy_only=False), sizes)),
                pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64))],
                names=["doc", "tid", "anchor"])

    return rows.select("doc", "tid", "text").mapInArrow(run, "doc long, tid long, anchor long")


def _one_by_one(batch: pa.RecordBatch, names):
    """Rows of a batch as Python values, one alive at a time: texts are not all copied at once."""
    columns = [batch.column(n) for n in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)


def _cell(row: int, width: int) -> Column:
    return F.pmod(F.xxhash64(F.col("anchor"), F.lit(row)), F.lit(width))


def repeated_anchors(found: DataFrame) -> DataFrame:
    """Rows of found whose anchor the sketch counts twice or more, with that estimate.

    Each task adds up its own cells before the shuffle merges them; a hot cell is one
    row per task."""
    width = 1 << (8 * max(1, found.count()) - 1).bit_length()
    sketch = stage(
        found.select(F.explode(F.array(*[F.struct(F.lit(r).alias("row"), _cell(r, width).alias("cell"))
                                         for r in range(ROWS)])).alias("at"))
        .groupBy("at.row", "at.cell").agg(F.count("*").alias("counted")).where("counted > 1"), "window-sketch")
    for r in range(ROWS):
        cells = sketch.where(F.col("row") == r).select("cell", F.col("counted").alias(f"n{r}"))
        found = found.withColumn("cell", _cell(r, width)).join(cells, "cell").drop("cell")
    return found.select("doc", "tid", "anchor", F.least(*[f"n{r}" for r in range(ROWS)]).alias("estimate"))


def windows(touched: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Exact rows of the windows whose anchor is listed: h1, h2, salts, salt, doc, tid, start."""
    columns = ["h1", "h2", "salts", "salt", "doc", "tid", "start"]
    types = [np.int64, np.int32, np.int32, np.int32, np.int64, np.int64, np.int32]

    def of_document(doc, tid, text, listed, estimates):
        hashes = word_hashes(split(text))
        own = window_anchors(hashes, window, gram).view(np.int64)
        order = np.argsort(listed)
        listed, salts = np.asarray(listed)[order], 1 + np.asarray(estimates)[order] // HOT
        at = np.minimum(np.searchsorted(listed, own), len(listed) - 1)
        every = rolling(hashes, window, BASES[1]).view(np.int64)
        # A window that a document repeats is one row, by its first start.
        start = np.unique(every, return_index=True)[1]
        start = start[listed[at[start]] == own[start]]
        salts = salts[at[start]]
        h1 = every[start]
        h2 = (rolling(hashes, window, BASES[2])[start] >> np.uint64(33)).astype(np.int32)
        salt = xxhash.xxh32_intdigest(doc.to_bytes(8, "little", signed=True)) % salts
        return h1, h2, salts, salt, np.full(len(start), doc), np.full(len(start), tid), start

    def run(batches):
        for batch in batches:
            parts, size = [], 0
            for row in _one_by_one(batch, ("doc", "tid", "text", "anchors", "estimates")):
                parts.append(of_document(*row))
                size += len(parts[-1][0])
                if size >= BATCH:
                    yield table(parts)
                    parts, size = [], 0
            if parts:
                yield table(parts)

    def table(parts):
        arrays = [pa.array(np.concatenate(p).astype(t)) for p, t in zip(zip(*parts), types)]
        return pa.RecordBatch.from_arrays(arrays, names=columns)

    return touched.mapInArrow(run, "h1 long, h2 int, salts int, salt int, doc long, tid long, start int")


def touched_documents(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Staged rows (doc, tid, text) that have anchors estimated to repeat, with these
    (anchors, estimates): at most one for each of a document's words."""
    found = stage(anchors(rows, window, gram), "window-anchors")
    listed = (repeated_anchors(found).groupBy("doc", "tid")
              .agg(F.collect_list("anchor").alias("anchors"), F.collect_list("estimate").alias("estimates")))
    return stage(rows.join(listed, ["doc", "tid"]), "window-touched")


def repeated_starts(touched: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc, tid, starts of the windows of touched documents that a smaller doc has."""
    exact = windows(touched, window, gram)
    first = F.min("doc").over(Window.partitionBy("h1", "h2", "salt"))
    marked = stage(exact.withColumn("lost", F.col("doc") > first).where("lost or salts > 1"), "window-marked")
    lost = marked.where("lost").select("doc", "tid", "start")
    winners = marked.where("not lost")
    if not winners.isEmpty():
        first = F.min("doc").over(Window.partitionBy("h1", "h2"))
        lost = lost.unionByName(winners.withColumn("first", first).where("doc > first").select("doc", "tid", "start"))
    return lost.groupBy("doc", "tid").agg(F.collect_list("start").alias("starts"))


def kept_words(text: str | None, starts, window: int = WINDOW) -> tuple[int, list[bytes]]:
    """Number of words of a text, and those outside the windows whose first starts are given."""
    words = split(text)
    if starts is None or not len(starts):
        return len(words), words
    # Starts name each repeated window once; its other places in the text go with it.
    own = rolling(word_hashes(words), window, BASES[1])
    starts = np.flatnonzero(np.isin(own, own[np.asarray(starts)]))
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    keep = np.cumsum(change[:-1]) == 0
    return len(words), [words[i] for i in np.flatnonzero(keep)]


def _cut(df: DataFrame, window: int) -> DataFrame:
    """doc, tid, text, starts -> doc, tid, n_words, n_removed, kept."""
    def run(batches):
        for batch in batches:
            parts = [kept_words(t, s, window) for t, s in zip(batch["text"], batch["starts"])]
            yield pd.DataFrame({
                "doc": batch["doc"], "tid": batch["tid"], "n_words": [n for n, _ in parts],
                "n_removed": [n - len(k) for n, k in parts],
                "kept": [b" ".join(k).decode("utf-8", "surrogatepass") for _, k in parts]})

    df = df.select("doc", "tid", "text", "starts")
    return df.mapInPandas(run, "doc long, tid long, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                   gram: int = GRAM, finish: Callable[[Column], Column] = lambda kept: kept) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (its words that stay, joined by a space).

    finish is applied to kept before rows meet, so a digest moves instead of a text."""
    rows, single = keyed_rows(docs, doc_id, text)
    touched = touched_documents(single, window, gram)
    cut = touched.select("doc", "tid", "text").join(repeated_starts(touched, window, gram), ["doc", "tid"])
    changed = _cut(cut, window).select(
        "doc", "tid", F.struct("n_removed", finish(F.col("kept")).alias("kept")).alias("new"))
    plain = _cut(rows.withColumn("starts", F.array().cast("array<int>")), window).withColumn(
        "kept", finish(F.col("kept")))
    return (plain.join(changed, ["doc", "tid"], "left")
            .select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "n_words",
                    F.coalesce("new.n_removed", "n_removed").alias("n_removed"),
                    F.coalesce("new.kept", "kept").alias("kept")))
