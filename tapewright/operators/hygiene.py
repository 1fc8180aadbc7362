"""Scope filters, incremental progress, batch metadata, dedup, and run reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tapewright.functions.scalars import floor_div, utc_date, utc_hour
from tapewright.operators import stats
from tapewright.operators.ordered import landed


# -------------------------------------------------------------------- filtering
def filter_scope(df: DataFrame, instruments: Sequence[str], start: str, end: str,
                 key: str, ts: str) -> DataFrame:
    """Instruments of a list (empty = all) between two UTC dates, both included.

    The time bound is a plain comparison on the stored column, so it is pushed into a
    Parquet scan; tables partitioned by ``dt`` are pruned as well.
    """
    day_ns = 86_400_000_000_000
    first = F.unix_date(F.lit(start).cast("date")).cast("bigint") * F.lit(day_ns)
    last = (F.unix_date(F.lit(end).cast("date")).cast("bigint") + 1) * F.lit(day_ns)
    out = df.where((F.col(ts) >= first) & (F.col(ts) < last))
    if "dt" in df.columns:
        out = out.where(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return out.where(F.col(key).isin(*instruments)) if instruments else out


def filter_symbol(df: DataFrame, symbol: str, key: str = "symbol") -> DataFrame:
    return df.where(F.col(key) == symbol)


# --------------------------------------------------------------------- progress
def progress_key(underlying: str = "underlying", contract: str = "contract"):
    """Options make progress by underlying, or by contract where the underlying is empty."""
    u = F.col(underlying)
    return F.when(u == "", F.col(contract)).otherwise(u)


def incremental_filter(df: DataFrame, progress: DataFrame, key: str,
                       ts: str = "trade_ts_ns") -> DataFrame:
    """Rows after the last completed hour of their symbol (none completed: all rows).

    Progress has one row per symbol. The join is left to the planner, which broadcasts
    progress only while its measured size is small.
    """
    done = progress.select(F.col("symbol").alias("__symbol"), F.col("max_hour").alias("__done"))
    return (
        df.join(done, F.col(key) == F.col("__symbol"), "left")
        .where(utc_hour(ts) > F.coalesce(F.col("__done").cast("int"), F.lit(-1)))
        .drop("__symbol", "__done")
    )


def advance_progress(df: DataFrame, progress: DataFrame, key: str,
                     ts: str = "trade_ts_ns") -> DataFrame:
    """Progress after a whole run: the newest hour seen, never below the old one."""
    seen = df.groupBy(F.col(key).alias("symbol")).agg(
        F.max(utc_hour(ts)).cast("smallint").alias("max_hour"))
    both = seen.unionByName(progress.select("symbol", "max_hour"))
    return both.groupBy("symbol").agg(F.max("max_hour").alias("max_hour"))


def with_metadata(df: DataFrame, source: str, quality: str, schema_version: int, run_id: str,
                  ts: str, events: DataFrame | None = None) -> DataFrame:
    """Stamp batch metadata; the watermark is the newest event time of the batch. ``events`` are rows with the
    same times, where df itself is dear to compute: it is then computed once."""
    newest = (df if events is None else events).agg(F.max(ts).alias("watermark_ts_ns"))
    return df.crossJoin(F.broadcast(newest)).withColumns({  # one row
        "source": F.lit(source), "quality": F.lit(quality),
        "schema_version": F.lit(schema_version), "run_id": F.lit(run_id),
    })


# ------------------------------------------------------------------------ dedup
def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every key. Copies collapse before the shuffle, so a key with a third
    of all rows costs one row per task.

    Rows are sorted for that. A hash of the key comes before it: a number that tells nearly all keys
    apart at the sort's prefix, where texts that begin alike would be compared row by row. What is shuffled has
    each column once: the least struct of order and other columns, beside the key. Columns must be comparable."""
    rest = [c for c in [*order, *df.columns] if c not in keys]
    rest = list(dict.fromkeys(rest))
    if not rest:
        return df.distinct()
    first = df.groupBy(F.xxhash64(*keys).alias("__hash"), *keys).agg(F.min(F.struct(*rest)).alias("__row"))
    return first.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])


def dedup_option_trades(df: DataFrame) -> DataFrame:
    return dedup_first(df, ["contract", "trade_ts_ns", "price", "size"], ["trade_ts_ns", "seq"])


def dedup_equity_trades(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    """By trade id within symbol and exchange; without an id, by time, price and size."""
    has_id = F.coalesce(F.col("trade_id"), F.lit("")) != ""
    keyed = df.withColumns({
        "__id": F.when(has_id, F.col("trade_id")),
        "__ts": F.when(~has_id, F.col("trade_ts_ns")),
        "__px": F.when(~has_id, F.col("price")),
        "__sz": F.when(~has_id, F.col("size")),
    })
    keys = [symbol, "exchange", "__id", "__ts", "__px", "__sz"]
    return dedup_first(keyed, keys, ["trade_ts_ns", "seq"]).select(*df.columns)


# ---------------------------------------------------------------------- reports
def adaptive_staleness(aged: DataFrame, key: str, warn_us: int, drop_us: int,
                       age: str = "nbbo_age_us") -> DataFrame:
    """Per-instrument p99 of quote age, exact, within (warn, drop)."""
    ages = landed(stats.runs(aged.select(key, F.col(age).cast("double").alias("age")), [key], "age"), "ages")
    p99 = stats.quantiles(ages, [key], {"p99": 0.99})
    bounded = F.greatest(F.least("p99", F.lit(float(drop_us))), F.lit(float(warn_us)))
    return p99.select(key, F.floor(bounded).cast("bigint").alias("staleness_us"))


def observe_ingest(df: DataFrame, ts: str, days: Sequence[str] = (), name: str = "ingest") -> tuple[DataFrame, Observation]:
    """Attach run counters that cost no extra pass; read them after the write.

    ``days`` are planned UTC days (one counter each). Attach them as the last step before a write:
    a stage that is repeated for lost shuffle files would count its rows again."""
    seen = Observation(name)
    counters = [F.count_if(utc_date(ts) == F.lit(day).cast("date")).alias(f"day_{day}") for day in days]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.min(ts).alias("min_ts_ns"),
                      F.max(ts).alias("max_ts_ns"), *counters), seen


def ingest_metrics(df: DataFrame, ts: str, batch_rows: int, planned_days: DataFrame) -> DataFrame:
    """Rows, batches and completion per planned day, and per other day that has rows."""
    daily = df.groupBy(utc_date(ts).alias("dt")).agg(F.count(F.lit(1)).alias("rows"))
    rows = F.coalesce(F.col("rows"), F.lit(0).cast("bigint"))
    return planned_days.join(daily, "dt", "full").select(
        "dt", rows.alias("rows"),
        floor_div(rows + F.lit(batch_rows - 1), batch_rows).alias("batches"),
        (rows > 0).alias("completed"))


def missing_days(expected: DataFrame, observed: DataFrame, today) -> DataFrame:
    """Expected days before today without a file."""
    return expected.where(F.col("dt") < F.lit(today).cast("date")).join(observed, "dt", "left_anti")


def dependency_lag(days: DataFrame) -> DataFrame:
    """Datasets whose dependency is missing or older than the day itself.

    Input: ``dataset, dt, dependency_dt``.
    """
    lag = F.greatest(F.datediff("dt", "dependency_dt"), F.lit(0))
    return (
        days.withColumns({"missing": F.col("dependency_dt").isNull(), "lag_days": lag})
        .where(F.col("missing") | (F.col("lag_days") > 0))
        .orderBy("dataset", "dt")
    )


def latest_run_state(log: DataFrame) -> DataFrame:
    """Latest state per dataset and date."""
    newest = F.max_by(F.struct("run_id", "state", "reason", "updated_ns"),
                      F.struct("updated_ns", "run_id"))
    return log.groupBy("dataset", "run_date").agg(newest.alias("__s")).select(
        "dataset", "run_date", "__s.*")


def range_envelope(ranges: DataFrame, now_ns) -> DataFrame:
    """Earliest start and latest end over several ranges; an open end means now."""
    return ranges.agg(
        F.min("start_ns").alias("start_ns"),
        F.max(F.coalesce(F.col("end_ns"), F.lit(now_ns))).alias("end_ns"))


