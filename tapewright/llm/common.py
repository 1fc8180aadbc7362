"""Shared pieces: the word rule, clash-free column names, staged tables, ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.session import fresh_dir

# Words are maximal runs of anything but these six characters.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

LAST = 2 ** 63 - 1  # stands for a null doc_id


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with underscores added until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(text: Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text; null or blank: an empty array."""
    trimmed = F.trim(whole(text), F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, SPACE_RUN))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared work folder and read it back.

    This cuts the lineage: a lost executor costs at most the running job, and a
    table that is used more than once is computed once.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of df for each value of keys; null is a value.

    Keys that repeat are found by counting keys alone. Only their rows are grouped
    whole, by an aggregate that combines before it shuffles, so a key of any size
    is no hot spot; without repeats no wide row moves at all.
    """
    again, = free_names(df, "n_rows")
    repeated = stage(df.select(*map(quoted, keys)).groupBy(*map(quoted, keys)).agg(F.count("*").alias(again))
                     .where(quoted(again) > 1).drop(again), "repeated-keys")
    if repeated.isEmpty():
        return df
    on = _null_safe(df, repeated, keys)
    return (df.join(repeated, on, "left_anti")
            .unionByName(df.join(repeated, on, "left_semi").dropDuplicates(keys)))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for key in keys:
        on = on & left[f"`{key}`"].eqNullSafe(right[f"`{key}`"])
    return on


def keyed_rows(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(all rows, rows without copies of a row) as doc, tid, text.

    doc is doc_id, or LAST where that is null. tid is zero unless doc_id repeats; then it
    is a hash of the text."""
    rows = docs.select(F.coalesce(quoted(doc_id).cast("long"), F.lit(LAST)).alias("doc"), quoted(text).alias("text"))
    repeated = stage(rows.groupBy("doc").count().where("count > 1").select("doc"), "repeated-ids")
    if repeated.isEmpty():
        rows = rows.withColumn("tid", F.lit(0).cast("long"))
        return rows, rows
    marked = rows.join(repeated.withColumn("again", F.lit(True)), "doc", "left")
    tid = F.when(F.col("again"), F.xxhash64(whole(F.col("text")))).otherwise(F.lit(0).cast("long"))
    rows = marked.select("doc", "text", tid.alias("tid"))
    return rows, rows.dropDuplicates(["doc", "tid"])
