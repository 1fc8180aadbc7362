"""Tables this library wrote before: runs by manifest, progress, run log."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapewright import schemas
from tapewright.functions.scalars import enum_or


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest lines, one per file of a run."""
    return spark.read.schema(schemas.MANIFEST).json(path)


# A manifest of this many files (some 100 bytes each) is broadcast; a longer one is left to the planner.
BROADCAST_FILES = 1_000_000


def scan_run(spark: SparkSession, root: str, manifest_path: str, date: str | None = None,
             since_ns: int | None = None, until_ns: int | None = None) -> DataFrame:
    """Option trades of exactly the files a run's manifest names (for one date, or all), with
    ``since_ns <= trade_ts_ns < until_ns`` where bounds are given.

    No file name passes through the driver: the table is read between the dates of the named files,
    which prunes partitions, time bounds go to the scan, and rows of other files are dropped by a
    semi-join with the manifest. A named file that is not there is an error. Closed-list columns
    are restored with their defaults and Greeks start empty.
    """
    manifest = read_manifest(spark, manifest_path)
    if date is not None:
        manifest = manifest.where(F.col("date") == date)
    if since_ns is not None:
        manifest = manifest.where(F.col("max_ts_ns") >= since_ns)
    if until_ns is not None:
        manifest = manifest.where(F.col("min_ts_ns") < until_ns)
    table = F.substring_index("relative_path", "/", 1)
    depth = F.size(F.split("relative_path", "/"))
    known = manifest.agg(  # one row
        F.count(F.lit(1)).alias("files"), F.min(table).alias("table"), F.max(table).alias("other"),
        F.min("date").alias("first"), F.max("date").alias("last"),
        F.min(depth).alias("depth"), F.max(depth).alias("deepest")).first()
    if not known.files:
        return spark.createDataFrame([], schemas.OPTION_TRADES)
    if (known.table, known.depth) != (known.other, known.deepest):
        raise ValueError(f"{manifest_path} names files of several tables")
    path = f"{root}/{known.table}"
    named = manifest.select(F.col("relative_path").alias("__file")).distinct()
    _check_files(spark, path, named, known.depth)
    if known.files <= BROADCAST_FILES:
        named = F.broadcast(named)
    reader = spark.read.schema(schemas.OPTION_TRADES)
    trades = reader.parquet(path).where(
        F.col("dt").between(F.lit(known.first).cast("date"), F.lit(known.last).cast("date")))
    if since_ns is not None:
        trades = trades.where(F.col("trade_ts_ns") >= since_ns)
    if until_ns is not None:
        trades = trades.where(F.col("trade_ts_ns") < until_ns)
    file = F.substring_index(F.col("_metadata.file_path"), "/", -known.depth)
    trades = trades.withColumn("__file", file).join(named, "__file", "left_semi").drop("__file")
    null = F.lit(None).cast("double")
    return trades.withColumns({
        "aggressor_side": enum_or("aggressor_side", schemas.AGGRESSOR_SIDES, "Unknown"),
        "class_method": enum_or("class_method", schemas.CLASS_METHODS, "Unknown"),
        "nbbo_state": enum_or("nbbo_state", schemas.NBBO_STATES, None),
        "source": enum_or("source", schemas.SOURCES, "Flatfile"),
        "quality": enum_or("quality", schemas.QUALITIES, "Prelim"),
        "delta": null, "gamma": null, "vega": null, "theta": null, "iv": null,
        "greeks_flags": F.lit(0).cast("bigint"),
    })


def _check_files(spark: SparkSession, path: str, named: DataFrame, depth: int) -> None:
    """Raise where a named file is missing. The listing is read without the files' contents."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.substring_index(F.col("_metadata.file_path"), "/", -depth).alias("__file"))
    missing = named.join(listed, "__file", "left_anti").first()
    if missing is not None:
        raise FileNotFoundError(f"{path}: {missing[0]} of the manifest is missing")


def _read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # the path does not exist yet
        return spark.createDataFrame([], schema)


def load_progress(spark: SparkSession, root: str, dataset: str, day: str) -> DataFrame:
    """Per-symbol progress of a dataset and day; empty when there is none."""
    return _read_or_empty(spark, f"{root}/progress/{dataset}/{day}", schemas.PROGRESS)


def load_run_log(spark: SparkSession, root: str) -> DataFrame:
    return _read_or_empty(spark, f"{root}/run_log", schemas.RUN_LOG)
