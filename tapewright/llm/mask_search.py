"""Ranked lexical search of a query set against all documents, by presence masks.

1. Index. Every document becomes one small row: how many terms it has, and which terms of
   the query set with what frequency. It is written once, so texts are read once.
2. Statistics. Tasks add up their document frequencies before the shuffle; the sums give
   each term its weight.
3. Search. A task goes through its rows in blocks. Each term has a bitmap of the block's
   documents. An item's bitmaps are stacked and turned, which gives every document the mask of
   the terms it holds; documents with equal masks form a group. A mask's score is at most
   the sum of its weights, each times the term's largest gain in the block. Masks are
   evaluated by descending bound, until the item's k-th score so far is above the bound.
4. Merge. The best k of each item and task meet in two rounds of ranking.

The query set goes through in blocks of at most ``ITEMS`` items and about ``ITEM_CHARS``
characters, which is the bound of what is broadcast; documents are never collected,
crossed or capped. A lost task reads its part of the index again.

Defined cases: a null or empty text has no terms and is never found; an item without terms
that score has no rows; equal items are each answered; among equal scores the smaller doc_id
comes first and null last; documents that repeat are ranked each; texts of any length are
taken whole; empty tables give an empty result; columns not named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.llm.arrow_text import blocks, listed, mapped_bytes, words
from tapewright.llm.common import quoted, stage
from tapewright.session import fresh_dir

K = 10
ITEMS = 4096              # items of a block of the query set
ITEM_CHARS = 4_000_000    # characters of such a block, but for one longer item
DOCS = 8192               # documents of a block of the index
POSTINGS = 4_000_000      # postings of such a block, but for one longer batch
FIRST = 64                # documents evaluated before the bound is tried first
SALTS = 64                # parts of an item's rows in the first round of ranking

# Digits, letters and whatever is not ASCII belong to terms; A-Z are lower-cased.
_TABLE = np.full(256, 0x20, np.uint8)
_TABLE[0x30:0x3A] = np.arange(0x30, 0x3A)
_TABLE[0x41:0x5B] = np.arange(0x61, 0x7B)
_TABLE[0x61:0x7B] = np.arange(0x61, 0x7B)
_TABLE[0x80:] = np.arange(0x80, 0x100)
# Fixed values of the score.
SCALE, UNIT, PULL = 1_000_000_000, 1000, 8
FLAT, SLOPE = 10, 90


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of texts and the row of each."""
    return words(mapped_bytes(texts, _TABLE))


@dataclass
class Items:
    """A block of the query set: the distinct terms, and per item its id and term numbers."""
    vocabulary: pa.Array
    ids: list
    terms: list[np.ndarray]


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """The query set in blocks of bounded size, streamed through the driver one after another."""
    def made(ids, texts):
        flat, row = terms(pa.array(texts, pa.string()))
        coded = flat.dictionary_encode()
        number = coded.indices.to_numpy().astype(np.int64)
        ends = np.searchsorted(row, np.arange(len(ids) + 1))
        return Items(coded.dictionary, ids, [np.unique(number[a:b]) for a, b in zip(ends[:-1], ends[1:])])

    ids, texts, chars = [], [], 0
    for row in items.select(quoted(item_id), quoted(text)).toLocalIterator():
        size = len(row[1] or "")
        if ids and (len(ids) == ITEMS or chars + size > ITEM_CHARS):
            yield made(ids, texts)
            ids, texts, chars = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        chars += size
    if ids:
        yield made(ids, texts)


def index(docs: DataFrame, vocabulary: pa.Array, doc_id: str, text: str) -> DataFrame:
    """doc_id, n (terms with repeats), terms, counts: those of the vocabulary, by number. Staged."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    columns = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    schema = T.StructType([columns.schema["doc_id"], T.StructField("n", T.LongType()),
                           T.StructField("terms", T.ArrayType(T.IntegerType())),
                           T.StructField("counts", T.ArrayType(T.IntegerType()))])

    def run(batches):
        known = shared.value
        for batch in batches:
            for block in blocks(batch):
                flat, row = terms(block.columns[-1])
                number = pc.index_in(flat, value_set=known)
                real = number.is_valid().to_numpy(zero_copy_only=False)
                key = row[real] * len(known) + number.drop_null().to_numpy()
                key, count = np.unique(key, return_counts=True)
                per_row = np.bincount(key // max(1, len(known)), minlength=block.num_rows)
                yield pa.RecordBatch.from_arrays([
                    block.columns[0], pa.array(np.bincount(row, minlength=block.num_rows), pa.int64()),
                    listed(pa.array(key % max(1, len(known)), pa.int32()), per_row),
                    listed(pa.array(count, pa.int32()), per_row)], names=schema.names)

    return stage(columns.mapInArrow(run, schema), "search-index")


def statistics(indexed: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and by term number the documents that hold it."""
    n, total = indexed.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def run(batches):
        counted = np.zeros(size, np.int64)
        for batch in batches:
            counted += np.bincount(batch.columns[0].flatten().to_numpy(zero_copy_only=False), minlength=size)
        held = np.flatnonzero(counted)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counted[held])], names=["term", "df"])

    rows = indexed.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    frequency = np.zeros(size, np.int64)
    for row in rows.collect():   # at most one for each term of the block of items
        frequency[row.term] = row.df
    return n, total, frequency


def weights(n: int, frequency: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(df) + 1))) if df else 0 for df in frequency], np.int64)


class Block:
    """Documents of the index, by ascending doc_id, with bitmaps of their terms."""

    def __init__(self, ids: list, sizes: np.ndarray, n_terms: np.ndarray, term: np.ndarray, count: np.ndarray,
                 documents: int, total: int):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
        self.ids = [ids[i] for i in order]
        begin = np.cumsum(n_terms) - n_terms
        self.n_terms = n_terms[order]
        take = np.repeat(begin[order] - (np.cumsum(self.n_terms) - self.n_terms), self.n_terms) + np.arange(len(term))
        self.term, count = term[take], count[take].astype(np.int64)
        self.begin = np.cumsum(self.n_terms) - self.n_terms
        doc = np.repeat(np.arange(len(order)), self.n_terms)
        # Integers of any size: SLOPE * n * documents is exact in 64 bits only while it fits.
        length = np.array([FLAT + SLOPE * int(s) * documents // max(1, total) for s in sizes[order]], np.int64)
        self.gain = (SCALE * count) // (UNIT * count + PULL * length[doc])
        by_term = np.argsort(self.term, kind="stable")
        self.present, first = np.unique(self.term[by_term], return_index=True)
        self.most = np.maximum.reduceat(self.gain[by_term], first) if len(first) else np.empty(0, np.int64)
        bits = np.zeros((len(self.present), -(-len(order) // 8)), np.uint8)
        at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(by_term))))
        np.bitwise_or.at(bits, (at, doc[by_term] >> 3), (0x80 >> (doc[by_term] & 7)).astype(np.uint8))
        self.bits = bits

    def groups(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For documents that hold any of the terms at rows: the documents sorted by their
        mask of those terms, and where each mask begins."""
        held = np.unpackbits(self.bits[rows], axis=1, count=len(self.ids))
        docs = np.flatnonzero(np.bitwise_or.reduce(held, axis=0))
        mask = np.packbits(held[:, docs], axis=0)
        mask = np.pad(mask, ((0, -len(mask) % 8), (0, 0))).T
        keys = np.ascontiguousarray(mask).view(np.uint64)
        order = np.lexsort(keys.T)   # stable: documents of a mask stay by doc_id
        keys = keys[order]
        new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1)) if len(keys) else np.empty(0, bool)
        return docs[order], np.flatnonzero(new)

    def bounds(self, rows: np.ndarray, weight: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The most that documents with the masks of docs can score."""
        held = np.unpackbits(self.bits[rows], axis=1, count=len(self.ids))[:, docs]
        return (weight * self.most[rows]) @ held.astype(np.int64)

    def scores(self, docs: np.ndarray, weight_of: np.ndarray) -> np.ndarray:
        n = self.n_terms[docs]
        at = np.repeat(self.begin[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.add.reduceat(weight_of[self.term[at]] * self.gain[at], np.cumsum(n) - n)


class Best:
    """The k best of each item so far: (score, doc_id), best first."""

    def __init__(self, items: Items, weight: np.ndarray, k: int):
        self.items, self.weight, self.k = items, weight, k
        self.found: list[list[tuple]] = [[] for _ in items.ids]
        self._weight_of = np.zeros(len(weight), np.int64)

    def add(self, block: Block) -> None:
        for i, own in enumerate(self.items.terms):
            own = own[self.weight[own] > 0]
            rows = np.searchsorted(block.present, own)
            here = rows < len(block.present)
            here[here] = block.present[rows[here]] == own[here]
            if here.any():
                self._search(i, block, own[here], rows[here])

    def _search(self, i: int, block: Block, own: np.ndarray, rows: np.ndarray) -> None:
        docs, begin = block.groups(rows)
        bound = block.bounds(rows, self.weight[own], docs[begin])
        order = np.argsort(-bound, kind="stable")
        ends = np.append(begin[1:], len(docs))
        self._weight_of[own] = self.weight[own]
        at, batch = 0, FIRST
        while at < len(order) and not self._done(i, bound[order[at]]):
            upto = at + max(1, int(np.searchsorted(np.cumsum((ends - begin)[order[at:at + batch]]), batch)))
            members = np.concatenate([docs[begin[m]:ends[m]] for m in order[at:upto]])
            self._merge(i, block, members, block.scores(members, self._weight_of))
            at, batch = upto, 2 * batch
        self._weight_of[own] = 0

    def _done(self, i: int, bound: int) -> bool:
        # A score that equals the bound may still win by its doc_id.
        return len(self.found[i]) == self.k and self.found[i][-1][0] > bound

    def _merge(self, i: int, block: Block, members: np.ndarray, score: np.ndarray) -> None:
        if len(members) > self.k:   # members of a smaller place have the smaller doc_id
            top = np.lexsort((members, -score))[:self.k]
            members, score = members[top], score[top]
        new = [(s, block.ids[m]) for s, m in zip(score.tolist(), members.tolist()) if s > 0]
        both = sorted(self.found[i] + new, key=lambda r: (-r[0], r[1] is None, r[1]))
        self.found[i] = both[:self.k]


def _index_blocks(batches, documents: int, total: int) -> Iterator[Block]:
    ids, size, n_terms, term, count, postings = [], [], [], [], [], 0

    def made():
        return Block([v for part in ids for v in part], *map(np.concatenate, (size, n_terms, term, count)), documents, total)

    for batch in batches:
        for at in range(0, batch.num_rows, DOCS):
            part = batch.slice(at, DOCS)
            numbers = part.column("terms").flatten().to_numpy(zero_copy_only=False)
            if ids and (sum(map(len, ids)) + part.num_rows > DOCS or postings + len(numbers) > POSTINGS):
                yield made()
                ids, size, n_terms, term, count, postings = [], [], [], [], [], 0
            ids.append(part.column("doc_id").to_pylist())
            size.append(part.column("n").to_numpy())
            n_terms.append(pc.list_value_length(part.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64))
            term.append(numbers)
            count.append(part.column("counts").flatten().to_numpy(zero_copy_only=False))
            postings += len(numbers)
    if ids:
        yield made()


def _ranked(df: DataFrame, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return df.withColumn("rank", F.row_number().over(order))


def search_block(docs: DataFrame, items: Items, k: int, doc_id: str, text: str) -> DataFrame:
    """item (number in the block), doc_id, score: the best k of each task for each item."""
    size = len(items.vocabulary)
    indexed = index(docs, items.vocabulary, doc_id, text)
    documents, total, frequency = statistics(indexed, size)
    shared = docs.sparkSession.sparkContext.broadcast((items, weights(documents, frequency)))
    schema = T.StructType([T.StructField("item", T.LongType()), indexed.schema["doc_id"], T.StructField("score", T.LongType())])

    def run(batches):
        own, weight = shared.value
        best = Best(own, weight, k)
        for block in _index_blocks(batches, documents, total):
            best.add(block)
        rows = [(i, doc, score) for i, found in enumerate(best.found) for score, doc in found]
        item, doc, score = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, kind), pa.array(score, pa.int64())],
                                         names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(indexed.schema["doc_id"].dataType)
    return indexed.where("size(terms) > 0").mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (1 to k), doc_id, score of the best documents of every item."""
    spark = docs.sparkSession
    path = fresh_dir(spark, "search-found")
    item_type, doc_type = items.schema[item_id].dataType, docs.schema[doc_id].dataType
    names = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", item_type)])
    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()),
                           T.StructField("doc_id", doc_type), T.StructField("score", T.LongType())])
    spark.createDataFrame([], schema).write.parquet(path)
    for block in item_blocks(items, item_id, item_text):
        found = search_block(docs, block, k, doc_id, text)
        parts = _ranked(found.withColumn("part", F.spark_partition_id() % SALTS), "item", "part").where(F.col("rank") <= k)
        best = _ranked(parts, "item").where(F.col("rank") <= k)
        ids = spark.createDataFrame(list(enumerate(block.ids)), names)
        best.join(ids, "item").select(*schema.names).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
