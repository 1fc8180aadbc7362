"""SimHash near-dedup with a pigeonring candidate filter.

The 64-bit fingerprints are cut into a ring of eight bytes. If two differ in at most
three bits, then some start of the ring has every chain of l consecutive bytes within
its proportional budget of floor(3 l / 8) bits: none in the first two bytes, at most
one in the first five, two in seven, three in all. As five bytes hold at most one
difference, two of the bytes three to five are equal as well. So 24 exact keys of four
bytes (eight starts, three bytes to leave out) meet every such pair; the rest of the
chain is tested next, and the full distance last.

* Equal fingerprints are one row before any key is made, so copies cost nothing.
* Fingerprints of a key are streamed from a sorted partition; a key hands on the links
  of a spanning forest, never all pairs.
* A key shared by more than ``RUN`` fingerprints is not compared pairwise. Its
  fingerprints meet at common neighbours instead: two of them are within three bits
  exactly if some word is within one bit of the one and two bits of the other. That
  costs 2 081 rows for each fingerprint, whatever the size of the key.
* Components are found by alternating large and small stars over the links, each round
  written to the shared folder.

Defined cases: a null or blank text has fingerprint zero and is linked like any other;
a null doc_id is never a component's id unless the component has no other; rows that
repeat are linked row by row; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.llm.common import free_names, one_per_key, quoted, stage, whole
from tapewright.llm.components import components

DISTANCE = 3
SHINGLE = 3
RUN = 4096
SEGMENTS = 8
_BLOCK = 255 * 256

_digest = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of a text. Memory is bounded for texts of any length."""
    # On bytes, lower() changes A-Z alone and split() cuts at the six ASCII spaces.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    if n == 1:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    hashes = np.fromiter(map(_digest, shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        part = hashes[at:at + _BLOCK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        # Sums of 255 bits fit a byte, which keeps the addition vectorised.
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, text: str = "text") -> Column:
    """Column expression: the fingerprint as a signed long."""
    return F.pandas_udf(_fingerprints, T.LongType())(quoted(text))


def _segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * (k % SEGMENTS)).bitwiseAND(F.lit(255))


def ring_keys(fp: Column) -> Column:
    """The 24 keys of a fingerprint; key >> 32 is three times the start, plus the byte left out."""
    keys = []
    for start in range(SEGMENTS):
        for left_out in range(3):
            key = F.lit(start * 3 + left_out).cast("long")
            for k in (0, 1, *(2 + j for j in range(3) if j != left_out)):
                key = F.shiftleft(key, 8).bitwiseOR(_segment(fp, start + k))
            keys.append(key)
    return F.array(*keys)


def _chain_masks(start: int) -> list[tuple[np.uint64, int]]:
    """(mask, most bits) of the chains from a start whose budgets imply all others."""
    masks = []
    for length in (5, 7, 8):
        mask = 0
        for k in range(length):
            mask |= 255 << (8 * ((start + k) % SEGMENTS))
        masks.append((np.uint64(mask), DISTANCE * length // SEGMENTS))
    return masks


_MASKS = [_chain_masks(s) for s in range(SEGMENTS)]


def forest(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links between fingerprints of one key that pass the chain, as a spanning forest."""
    label = np.arange(len(fps))
    links = []
    for i in range(len(fps) - 1):
        rest = np.arange(i + 1, len(fps))
        for mask, most in _MASKS[start]:
            rest = rest[np.bitwise_count((fps[rest] ^ fps[i]) & mask) <= most]
        for j in rest[label[rest] != label[i]]:
            if label[j] != label[i]:
                links.append((i, int(j)))
                label[label == label[j]] = label[i]
    return links


_FOUND = pa.schema([("dense", pa.bool_()), ("a", pa.int64()), ("b", pa.int64())])


def _links(batches):
    """Rows (key, fp) sorted by key -> links (false, fp, fp), or (true, key, fp) of dense keys."""
    held_key, held, dense = None, [], False

    def table(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind)), pa.array(a), pa.array(b)], schema=_FOUND)

    def close():
        if held_key is None or dense:
            return
        fps = np.concatenate(held)
        if len(fps) > 1:
            pairs = forest(fps, (held_key >> 32) // 3)
            if pairs:
                signed = fps.view(np.int64)
                ends = np.array(pairs)
                yield table(False, signed[ends[:, 0]], signed[ends[:, 1]])

    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        fps = batch.column(1).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        edges = np.flatnonzero(np.diff(keys)) + 1
        bounds = np.concatenate(([0], edges, [len(keys)]))
        sizes = np.diff(bounds)
        last = len(sizes) - 1
        # A lone fingerprint inside a batch has no partner; only the first run (which may
        # go on from the last batch), the last one and runs of two or more matter.
        for r in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == last)):
            key, part = int(keys[bounds[r]]), fps[bounds[r]:bounds[r + 1]]
            if key != held_key:
                yield from close()
                held_key, held, dense = key, [], False
            if not dense and sum(map(len, held)) + len(part) > RUN:
                for old in held:
                    yield table(True, np.full(len(old), key), old.view(np.int64))
                held, dense = [], True
            if dense:
                yield table(True, np.full(len(part), key), part)
            else:
                held.append(part.view(np.uint64).copy())
    yield from close()


_NEAR = np.array([0, *(1 << i for i in range(64))], np.uint64)
_TWO = np.array([(1 << i) | (1 << j) for i in range(64) for j in range(i)], np.uint64)


def _neighbours(batches):
    """fp -> every word within two bits of it, and whether it is within one."""
    flips = np.concatenate([_NEAR, _TWO])
    near = np.arange(len(flips)) < len(_NEAR)
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), 256):
            part = fps[at:at + 256]
            yield pa.RecordBatch.from_arrays([
                pa.array((part[:, None] ^ flips).ravel().view(np.int64)),
                pa.array(np.repeat(part, len(flips)).view(np.int64)),
                pa.array(np.tile(near, len(part)))], names=["word", "fp", "near"])


def dense_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly what lies within three bits, without comparing pairs.

    A word with a fingerprint within one bit of it joins all those within two bits."""
    words = fps.mapInArrow(_neighbours, "word long, fp long, near boolean")
    met = (words.groupBy("word").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.collect_set("fp").alias("all"))
           .where(F.col("a").isNotNull() & (F.size("all") > 1)))  # at most 2 081 distinct by construction
    return met.select("a", F.explode("all").alias("b")).where("a <> b")


def links(distinct_fps: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within three bits. Column: fp."""
    keyed = distinct_fps.select(F.explode(ring_keys(F.col("fp"))).alias("key"), "fp")
    found = stage(keyed.repartition("key").sortWithinPartitions("key")
                  .mapInArrow(_links, "dense boolean, a long, b long"), "simhash-links")
    pairs = found.where("not dense").select("a", "b")
    crowd = found.where("dense").select(F.col("b").alias("fp")).distinct()
    if not crowd.isEmpty():
        pairs = pairs.unionByName(dense_links(crowd))
    return pairs


def _firsts(rows: DataFrame, first: Column) -> DataFrame:
    """fp, best: the smallest value of first over all rows of the fingerprint's component."""
    groups = stage(rows.groupBy("fp").agg(F.min(first).alias("first")), "simhash-groups")
    linked = components(links(groups.select("fp")))
    rooted = groups.join(linked, groups.fp == linked.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("first").alias("best"))
    return stage(rooted.join(roots, "root").select("fp", "best"), "simhash-components")


def mark(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, fp (signed long), component_id (smallest doc_id reachable)."""
    rows = stage(docs.select(quoted(doc_id).alias("doc_id"), fingerprints(docs, text).alias("fp")), "simhash-rows")
    named = _firsts(rows, F.col("doc_id"))
    return rows.join(named, "fp").select("doc_id", "fp", F.col("best").alias("component_id"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: the smallest doc_id, null last; of rows that share it, the one
    whose text has the smallest hash."""
    key, lost_id, lost_key = free_names(docs, "text_key", "lost_id", "lost_key")
    text_key = F.md5(whole(quoted(text)).cast("binary"))
    rows = stage(docs.select(quoted(doc_id).alias("doc_id"), fingerprints(docs, text).alias("fp"),
                             text_key.alias("text_key")), "simhash-rows")
    place = F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "text_key")
    lost = stage(rows.join(_firsts(rows, place), "fp").where(~place.eqNullSafe(F.col("best")))
                 .select(F.col("doc_id").alias(lost_id), F.col("text_key").alias(lost_key)).distinct(), "simhash-lost")
    named = docs.withColumn(key, text_key)
    kept = named.join(lost, named[f"`{doc_id}`"].eqNullSafe(lost[lost_id]) & (named[key] == lost[lost_key]), "left_anti")
    return one_per_key(kept, [doc_id, key]).drop(key)
