"""Exact dedup by skew-safe combining.

Texts are equal when identical after lower-casing A-Z alone. Every stage groups by
the digest *and* the full normalised text, so a digest that two texts share never
merges them:

1. local: each task combines its own rows (the partial aggregate);
2. salted: rows of a digest meet in one of ``SALTS`` groups;
3. global: at most ``SALTS`` salt winners of a text are combined.

A group of copies of any size therefore reaches a task as a few rows. Winners are
then joined back to the documents by digest; the join leaves a hot digest to Spark's
skew handling. Should two texts ever share a digest, their documents are joined by
digest and text instead.

Defined cases: a null text is empty; a null doc_id is smaller than any other, and
``mark`` calls every row with the winning doc_id kept; ``deduplicate`` keeps exactly
one of such repeated rows. Empty tables give empty results. Other columns may have
any name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import free_names, one_per_key, quoted, stage, whole

SALTS = 8


def normalised(text: Column) -> Column:
    """The text with A-Z, and nothing else, in lower case."""
    text = whole(text)
    # lower() also changes letters beyond ASCII, so it serves texts without any.
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return (docs.select(quoted(doc_id).alias("doc_id"), normalised(quoted(text)).alias("content"))
            .withColumn("digest", F.sha2("content", 256)))


def winners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct text: digest, content, keep_id (largest doc_id), group_size."""
    salted = _keyed(docs, doc_id, text).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    merged = (salted.groupBy("digest", "content", "salt")
              .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    return (merged.groupBy("digest", "content")
            .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))


def mark(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's group: doc_id, keep_id, group_size, kept, text_sha256."""
    elected = winners(docs, doc_id, text)
    table = stage(elected.drop("content"), "copy-winners")
    shared = table.groupBy("digest").count().where("count > 1").select("digest")
    members, on = _keyed(docs, doc_id, text), ["digest"]
    if shared.isEmpty():
        members = members.drop("content")
    else:
        table, on = elected, ["digest", "content"]
    return members.join(table, on).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: one per distinct text."""
    digest, = free_names(docs, "digest")
    lost = stage(mark(docs, doc_id, text).where(~F.col("kept"))
                 .select(F.col("doc_id").alias("lost_id"), F.col("text_sha256").alias("lost_digest")).distinct(),
                 "copy-losers")
    named = docs.withColumn(digest, F.sha2(normalised(quoted(text)), 256))
    # Losers grow with the corpus: they are merged in, never broadcast, at any size.
    kept = named.join(lost.hint("merge"), named[f"`{digest}`"].eqNullSafe(lost.lost_digest)
                      & named[f"`{doc_id}`"].eqNullSafe(lost.lost_id), "left_anti")
    return one_per_key(kept, [doc_id, digest]).drop(digest)
