"""Line dedup by winnowing.

A document's lines (those with a word) are hashed. In every window of ``WINDOW``
consecutive lines the smallest hash, the rightmost if it repeats, is selected as a
fingerprint; a place is kept once, however many windows select it, with the hashes of up
to WINDOW - 1 lines on either side. A run of WINDOW lines that occurs twice therefore has
the same fingerprint at the same place of both copies. Places whose fingerprint stands
nowhere else go no further. Positions are joined by fingerprint and neighbours: a place
belongs to one run of WINDOW lines for each offset at which it may lie in one, and meets
the first place in (doc_id, line) order for each of them, as the first place of a
fingerprint alone may stand between other neighbours. Every such pair is extended line by
line both ways, over the lines carried; a longer run is the union of the matches of its
places, which lie at most WINDOW apart. The later lines are deleted.
Runs of fewer than WINDOW lines stay unless
``short_words`` is given; then windows of one line up to WINDOW - 1 select places too.

A place is compared with the first place of its lines only, never with every other
one, so a line that a third of the documents share costs one row per occurrence: its
occurrences are counted and its first place found by aggregates that combine before
they shuffle, and the joins leave a hot fingerprint to Spark's skew handling.

Defined cases: a null text is an empty one; lines without a word match nothing, break
no run and are never deleted; later copies inside one document go too; a null doc_id
comes last; rows that share a doc_id are ordered by a hash of their text, and equal
ones are treated alike; an empty table gives an empty result; other columns may have
any name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import LAST, SPACES, keyed_rows, stage, whole, words

WINDOW = 3


def _worded(lines: Column) -> Column:
    """Positions of the lines that have a word."""
    return F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x, F.lit(SPACES)) != "", i)), lambda i: i.isNotNull())


BYTES = 16   # of a line's hash


def _selected(hashes: Column, size: int) -> Column:
    """Places that the windows of so many lines select."""
    def place(start: Column) -> Column:
        part = F.slice(hashes, start + 1, size)
        return (start + size - F.array_position(F.reverse(part), F.array_min(part))).cast("int")

    none = F.array().cast("array<int>")
    return F.when(F.size(hashes) >= size, F.transform(F.sequence(F.lit(0), F.size(hashes) - size), place)).otherwise(none)


def places(rows: DataFrame, window: int = WINDOW, sizes: Sequence[int] = (WINDOW,)) -> DataFrame:
    """doc, tid, place, fingerprint of every selected place, and what surrounds it.

    around holds the hashes of the lines within window - 1 of the place (within the longest of
    sizes, if that is less), counts their words, and mid is the place among them. Lines are
    hashed to 128 bits, so places are told apart by content for any corpus."""
    reach = max(sizes) - 1
    lines = rows.withColumn("lines", F.split(whole(F.col("text")), "\n")).drop("text")
    at = lines.withColumn("at", _worded(F.col("lines")))
    line = lambda i: F.get("lines", i)
    counts = F.transform("at", lambda i: F.size(words(line(i)))) if len(sizes) > 1 else F.array().cast("array<int>")
    hashed = at.select("doc", "tid", F.transform("at", lambda i: F.md5(line(i).cast("binary"))).alias("h"),
                       counts.alias("c"))
    each = F.array_distinct(F.concat(*[_selected(F.col("h"), k) for k in sizes]))
    spots = hashed.select("doc", "tid", "h", "c", F.explode(each).alias("place"))
    low = F.greatest(F.col("place") - reach, F.lit(0))
    length = F.col("place") + reach + 1 - low
    return spots.select("doc", "tid", "place", F.unhex(F.get("h", F.col("place"))).alias("fingerprint"),
                        F.unhex(F.array_join(F.slice("h", low + 1, length), "")).alias("around"),
                        F.slice("c", low + 1, length).alias("counts"), (F.col("place") - low).alias("mid"))


def _hash(around: str, i: Column, n: int = 1) -> Column:
    """n hashes from position i on."""
    return F.substring(F.col(around), i * BYTES + 1, F.lit(n * BYTES))


def _keys(sizes: Sequence[int]) -> Column:
    """One key for each run of so many lines that holds the place: size, offset and the lines."""
    held = F.length("around") / BYTES
    keys = []
    for size in sizes:
        for offset in range(size):
            start = F.col("mid") - offset
            keys.append(F.when((start >= 0) & (start + size <= held), F.concat(
                F.lit(bytes([size, offset])), _hash("around", start, size))))
    return F.array_compact(F.array(*keys))


def _equal_lines(step: int, reach: int) -> Column:
    """Lines equal to those of the first place, going one way from the place."""
    found = F.lit(reach)
    for i in range(reach, 0, -1):
        here, there = F.col("mid") + step * i, F.col("first.mid") + step * i
        inside = ((here >= 0) & (there >= 0) & (here < F.length("around") / BYTES)
                  & (there < F.length("first.around") / BYTES))
        found = F.when(inside & (_hash("around", here) == _hash("first.around", there)), found).otherwise(i - 1)
    return found


def later_runs(rows: DataFrame, window: int = WINDOW, short_words: int | None = None) -> DataFrame:
    """doc, tid, starts: start and size of each document's matches with lines that come earlier somewhere."""
    # A single line has a word, so where one word is enough, windows of one line cover all longer ones.
    sizes = [window] if short_words is None else [1] if short_words <= 1 else [*range(1, window + 1)]
    every = stage(places(rows, window, sizes), "line-places")
    shared = every.groupBy("fingerprint").count().where("count > 1").select("fingerprint")
    keyed = (stage(every.join(shared, "fingerprint"), "line-shared")
             .select("doc", "tid", "place", "mid", "around", "counts", F.explode(_keys(sizes)).alias("key")))
    first = keyed.groupBy("key").agg(F.min(F.struct("doc", "tid", "place", "mid", "around")).alias("first"))
    later = keyed.join(first, "key").where(F.struct("doc", "tid", "place") > F.struct("first.doc", "first.tid", "first.place"))
    reach = max(sizes) - 1
    left, right = _equal_lines(-1, reach), _equal_lines(1, reach)
    matches = later.select("doc", "tid", "counts", "mid", (F.col("place") - left).alias("start"),
                           left.alias("left"), (left + right + 1).alias("size"))
    if len(sizes) > 1:
        of_match = F.slice("counts", F.col("mid") - F.col("left") + 1, F.col("size"))
        n_words = F.aggregate(of_match, F.lit(0), lambda x, y: x + y)
        matches = matches.where((F.col("size") >= window) | (n_words >= short_words))
    return matches.groupBy("doc", "tid").agg(F.collect_set(F.struct("start", "size")).alias("starts"))


def remove_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                finish: Callable[[Column], Column] = lambda kept: kept, short_words: int | None = None) -> DataFrame:
    """Per row: doc_id, n_lines (with a word), n_removed, kept (the text without deleted lines).

    Repeated runs of at least window lines go; with short_words also shorter ones of at least
    so many words, those of documents with fewer lines included (1: every repeated line).
    finish is applied to kept as soon as it is made."""
    rows, single = keyed_rows(docs, doc_id, text)
    # The runs grow with the documents, so they are never broadcast, small as they may be: one plan at every size.
    cut = rows.join(later_runs(single, window, short_words).hint("merge"), ["doc", "tid"], "left")
    lines = cut.withColumn("lines", F.split(whole(F.col("text")), "\n")).drop("text")
    at = lines.withColumn("at", _worded(F.col("lines")))
    covered = F.array_distinct(F.flatten(F.transform(
        "starts", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))))
    gone = at.withColumn("gone", F.coalesce(F.transform(covered, lambda k: F.get("at", k)),
                                            F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = gone.withColumn("kept", F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return kept.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"),
                       F.size("at").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"),
                       finish(F.col("kept")).alias("kept"))
