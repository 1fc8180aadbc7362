"""Quality rules judged by host.

Each document is measured by itself and fails up to four rules at narrow limits. The
share of failing documents of a host is shrunk towards the corpus by a beta prior that
is fitted to all hosts by moments, so a host of three documents is not condemned by
one. The host verdicts are joined back: in a host whose shrunk rate passes ``WATCH``
a document is rejected at the narrow limits, elsewhere at the wide ones. A document
that breaks no rule is kept whatever its host.

Counts per host are summed in the tasks before they are shuffled. The table of watched
hosts is written first, so Spark knows its size when it chooses the join, and a hot
host is left to its skew handling.

Defined cases: a null text has no words; a null host is a host of its own; rows that
repeat are judged row by row; empty tables give empty results; other columns may have
any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import SPACES, free_names, quoted, stage, whole, words

SPAN = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
# (narrow, wide) limits.
SYMBOLS_PER_WORD = (0.1, 0.3)
DUP_LINES_PER_LINE = (0.3, 0.5)
WORD_LENGTH_LOW = (3.0, 2.0)
WORD_LENGTH_HIGH = (10.0, 15.0)
WATCH = 0.35
NOT_SYMBOLS = r"[^#*$%&|<>]+"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """docs with a struct of MEASURES (all long), and that column's name.

    n_repeat_words counts the words inside windows of SPAN words that occur twice or
    more in the same text. Windows are compared by 64-bit hashes within one document;
    positions are sorted only where some hash repeats.
    """
    w, lines, grams, order, starts, out = free_names(docs, "w", "lines", "grams", "order", "starts", "measures")
    body = whole(quoted(text))
    df = docs.withColumns({
        w: words(quoted(text)),
        lines: F.filter(F.split(body, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != ""),
    })
    hashes, = free_names(df, "hashes")
    df = df.withColumn(hashes, F.transform(quoted(w), lambda x: F.xxhash64(x)))
    h, n = quoted(hashes), F.size(quoted(hashes))
    df = df.withColumn(grams, F.when(
        n >= SPAN, F.transform(F.sequence(F.lit(0), n - SPAN),
                               lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SPAN)])))
        .otherwise(F.array().cast("array<bigint>")))
    g = quoted(grams)
    df = df.withColumn(order, F.when(
        F.size(F.array_distinct(g)) < F.size(g),
        F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    o = quoted(order)
    df = df.withColumn(starts, F.sort_array(F.transform(
        F.filter(o, lambda x, i: F.get(o, i - 1)["h"].eqNullSafe(x["h"]) | F.get(o, i + 1)["h"].eqNullSafe(x["h"])),
        lambda x: x["i"])))
    s = quoted(starts)
    covered = F.aggregate(
        F.transform(s, lambda x, i: F.least(F.lit(SPAN), F.coalesce(F.get(s, i + 1) - x, F.lit(SPAN)))),
        F.lit(0), lambda a, x: a + x)
    values = {
        "n_words": F.size(quoted(w)),
        "word_chars": F.char_length(F.array_join(quoted(w), "")),
        "n_symbols": F.char_length(F.regexp_replace(body, NOT_SYMBOLS, "")),
        "n_lines": F.size(quoted(lines)),
        "n_dup_lines": F.size(quoted(lines)) - F.size(F.array_distinct(quoted(lines))),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    df = df.withColumn(out, F.struct(*[v.cast("long").alias(k) for k, v in values.items()]))
    return df.drop(w, lines, hashes, grams, order, starts), out


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])


def breaks(m: Column, wide: bool) -> Column:
    """Whether a document breaks a rule at the wide or the narrow limits."""
    k = 1 if wide else 0
    n = m["n_words"]
    return (base_failed(m)
            | (m["n_symbols"] > SYMBOLS_PER_WORD[k] * n)
            | (m["n_dup_lines"] > DUP_LINES_PER_LINE[k] * m["n_lines"])
            | (m["word_chars"] < WORD_LENGTH_LOW[k] * n) | (m["word_chars"] > WORD_LENGTH_HIGH[k] * n))


def host_rates(judged: DataFrame) -> DataFrame:
    """Per host (column host; failed per document): docs, failures, shrunk rate."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.col("failed").cast("long")).alias("fails"))
    prior = hosts.agg(
        (F.sum("fails") / F.sum("docs")).alias("mean"),
        F.var_pop(F.col("fails") / F.col("docs")).alias("spread"))
    # Moments of a beta: strength = mean (1 - mean) / variance - 1. Hosts that do not
    # differ at all say nothing against the common rate.
    room = F.col("mean") * (1 - F.col("mean"))
    strength = F.when(F.col("spread") > 0, F.greatest(room / F.col("spread") - 1, F.lit(1e-3)))
    return (hosts.crossJoin(prior.withColumn("strength", strength))
            .select("host", "docs", "fails", F.when(F.col("strength").isNull(), F.col("mean")).otherwise(
                (F.col("fails") + F.col("mean") * F.col("strength")) / (F.col("docs") + F.col("strength")))
                .alias("rate")))


def verdicts(docs: DataFrame, host: str = "source", text: str = "text", carry: list[str] | None = None):
    """docs (or only the columns in carry) with a struct of measures and a boolean.

    Returns the DataFrame and the names of the two added columns. Measures are taken
    once and staged; both the host table and the result read the staged rows.
    """
    df, m = measured(docs, text)
    kept, watched, failed = free_names(df, "kept", "watched", "failed")
    names = docs.columns if carry is None else carry
    keys = [] if host in names else [quoted(host)]
    rows = stage(df.select(*map(quoted, names), *keys, quoted(m)), "host-measures")
    hosts = stage(host_rates(rows.select(quoted(host).alias("host"), breaks(quoted(m), wide=False).alias("failed")))
                  .where(F.col("rate") > WATCH).select(F.col("host").alias(watched)), "watched-hosts")
    hosts = hosts.withColumn(failed, F.lit(True))
    joined = rows.join(hosts, rows[f"`{host}`"].eqNullSafe(hosts[f"`{watched}`"]), "left")
    narrow = F.coalesce(quoted(failed), F.lit(False))
    out = joined.withColumn(kept, ~F.when(narrow, breaks(quoted(m), wide=False)).otherwise(breaks(quoted(m), wide=True)))
    return out.select(*map(quoted, names), quoted(m), quoted(kept)), m, kept


def keep_good(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns."""
    out, m, kept = verdicts(docs, host, text)
    return out.where(quoted(kept)).drop(m, kept)
