"""Periodic runs of words: maximal stretches that repeat with a smallest period.

Documents are numbered in blocks: the words of a block lie one after another, each
document closed by a word of its own that equals nothing.

1. Difference cover. Of every ``COVER`` positions only those of a difference cover are
   sampled: any two positions reach sampled ones by the same step of less than COVER.
   Only sampled suffixes are sorted: by their first words while ties last, then by
   doubling, as the suffix COVER words on is sampled too.
2. Longest common extension of two positions: a few words are compared up to the
   step, then the least common prefix between the two places in the sorted order answers,
   from a sparse table of minima.
3. Harmonic grid. For each period p, positions a step apart are compared with those p
   words on; the step is about p, so n words need n (1 + 1/2 + 1/3 + ...) pairs. A run
   holds two grid places at least, so from the first of them the extension is long and its start
   is less than a step away, found by bisection. A stretch found with several periods
   keeps the smallest, which divides the others.

Nothing is shuffled and documents are never cut. A task holds one block, or one longer
document. Pairs are compared in slices, so the memory of a document is linear in its words.

Defined cases: a null or empty text has no words and no runs; texts of any length are taken
whole; null, repeated or any other keys are carried as they are, with a row for a row; an
empty table gives an empty result; columns that are not named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapewright.llm.arrow_text import blocks, listed, words
from tapewright.llm.common import quoted

MIN_LENGTH = 24        # words
MIN_EXPONENT = 3       # periods
PAIRS = 1 << 20        # grid pairs compared at once
# A perfect difference cover modulo 31.
COVER = 31
SAMPLED = np.array([1, 5, 11, 24, 25, 27])


def _steps() -> np.ndarray:
    """Least step from residues (a, b) to two sampled ones."""
    shift = np.arange(COVER)
    inside = np.isin(np.arange(COVER), SAMPLED)
    both = inside[(shift[:, None, None] + shift) % COVER] & inside[(shift[:, None, None] + shift[:, None]) % COVER]
    return both.argmax(axis=0).astype(np.int64)


_STEPS = _steps()
_SLOT = np.full(COVER, -1)
_SLOT[SAMPLED] = np.arange(len(SAMPLED))


class Extension:
    """Longest common extensions within one sequence whose last word is unlike any other."""

    def __init__(self, sequence: np.ndarray):
        n = len(sequence)
        self.words = sequence
        at = (np.arange(n // COVER + 1)[:, None] * COVER + SAMPLED).ravel()
        self.sampled = at[at < n]
        self._sort()

    def _sort(self) -> None:
        """Order of the sampled suffixes, and tables of the common prefixes of neighbours."""
        at, m = self.sampled, len(self.sampled)
        unique, dense = np.unique(self.words, return_inverse=True)
        dense += 1   # zero stands for the end
        width = len(unique).bit_length()
        per_key = 62 // width
        key_of = np.zeros(len(dense), np.int64)   # the next per_key words of each position, as one number
        for k in range(per_key):
            shifted = np.zeros(len(dense), np.int64)
            shifted[:max(0, len(dense) - k)] = dense[k:]
            key_of = (key_of << width) | shifted
        order = np.arange(m)
        group = np.zeros(m, np.int64)    # by suffix: place of the first suffix that ties with it
        levels, depth = [], 0

        def refine(keys):
            """Split tied groups by keys (by suffix); groups are numbered by place in the order."""
            nonlocal order
            size = np.bincount(group, minlength=m)
            tied = order[size[group[order]] > 1]
            if not len(tied):
                return False
            # Slots of tied groups stay the same; only their members change places.
            slots = np.flatnonzero(size[group[order]] > 1)
            tied = tied[np.lexsort((keys[tied], group[tied]))]
            order[slots] = tied
            g, k = group[tied], keys[tied]
            new = np.append(True, (g[1:] != g[:-1]) | (k[1:] != k[:-1]))
            group[tied] = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
            return True

        busy = True
        while depth < COVER and busy:
            busy = refine(key_of[np.minimum(at + depth, len(key_of) - 1)])
            depth += per_key
        # From here on ties share at least COVER words; doubling goes by whole covers.
        jump = 1
        while busy:
            levels.append((jump, group.copy()))
            busy = refine(group[np.minimum(np.arange(m) + jump * len(SAMPLED), m - 1)])
            jump *= 2
        self.order, self.place = order, np.empty(m, np.int64)
        self.place[order] = np.arange(m)
        self._minima(self._neighbours(levels, per_key))

    def _neighbours(self, levels, per_key: int) -> np.ndarray:
        """Common prefix of each sorted suffix and the one before it."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        common = np.zeros(len(a), np.int64)
        m = len(self.order)
        for jump, group in reversed(levels):
            same = group[a] == group[b]
            common[same] += jump * COVER
            for side in (a, b):
                side[same] = np.minimum(side[same] + jump * len(SAMPLED), m - 1)
        at_a, at_b = self.sampled[self.order[:-1]] + common, self.sampled[self.order[1:]] + common
        return common + self._compare(at_a, at_b, np.full(len(common), COVER + per_key))

    def _compare(self, a, b, most) -> np.ndarray:
        """Equal words from positions a and b on, up to most; the last word ends any comparison."""
        count = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            live = live[self.words[a[live] + count[live]] == self.words[b[live] + count[live]]]
            count[live] += 1
            live = live[count[live] < most[live]]
        return count

    def _minima(self, row: np.ndarray) -> None:
        self.table, width = [row.astype(np.int32)], 1
        while 2 * width <= len(row):
            self.table.append(np.minimum(self.table[-1][:-width], self.table[-1][width:]))
            width *= 2

    def _prefix(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common prefix of suffixes at different places x and y of the order."""
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(x), np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.table[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return out

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from positions a and b (a < b) on."""
        step = _STEPS[a % COVER, b % COVER]
        out = self._compare(a, b, step)
        on = np.flatnonzero(out == step)
        x, y = a[on] + step[on], b[on] + step[on]
        index = [v // COVER * len(SAMPLED) + _SLOT[v % COVER] for v in (x, y)]
        out[on] += self._prefix(self.place[index[0]], self.place[index[1]])
        return out


def _grid(start: np.ndarray, size: np.ndarray, min_length: int, min_exponent: int):
    """Slices of grid pairs: position, period, step, document."""
    longest = size // min_exponent
    top = int(longest.max(initial=0))
    held = []
    count = 0
    for p in range(1, top + 1):
        # A run spans this many places i whose word is that of i + p; two grid places lie in it.
        span = max(min_length, min_exponent * p) - p
        step = max(1, span // 2)
        docs = np.flatnonzero((longest >= p) & (size >= p + span))
        if not len(docs):
            continue
        n = (size[docs] - p + step - 1) // step
        held.append((docs, n, p, step))
        count += int(n.sum())
        if count >= PAIRS:
            yield _spread(held, start)
            held, count = [], 0
    if held:
        yield _spread(held, start)


def _spread(held, start):
    docs = np.concatenate([h[0] for h in held])
    n = np.concatenate([h[1] for h in held])
    period = np.repeat([h[2] for h in held], [len(h[0]) for h in held])
    step = np.repeat([h[3] for h in held], [len(h[0]) for h in held])
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(start[docs], n) + k * np.repeat(step, n)
    return at, np.repeat(period, n), np.repeat(step, n), np.repeat(docs, n)


def runs(sequence: np.ndarray, start: np.ndarray, size: np.ndarray, min_length: int = MIN_LENGTH,
         min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of documents (start and size in sequence, a word like no other after each):
    document, first word, length, period; by document, first word, period."""
    found = []
    lce = None
    for at, period, step, doc in _grid(start, size, min_length, min_exponent):
        same = np.flatnonzero(sequence[at] == sequence[at + period])
        if not len(same):
            continue
        if lce is None:
            lce = Extension(sequence)
        at, period, step, doc = at[same], period[same], step[same], doc[same]
        forward = lce.of(at, at + period)
        # The first grid place of a run is less than a step from its start, so this much is left.
        span = np.maximum(min_length, min_exponent * period) - period
        far = forward > span - step
        at, period, step, doc, forward, span = (v[far] for v in (at, period, step, doc, forward, span))
        # Words before the place that belong to the run: bisection on whole extensions.
        back, reach = np.zeros(len(at), np.int64), np.minimum(step, at - start[doc])
        bit = 1 << int(reach.max(initial=0)).bit_length()
        while bit:
            tried = np.flatnonzero(back + bit <= reach)
            shift = back[tried] + bit
            place = at[tried] - shift
            fits = lce.of(place, place + period[tried]) >= shift
            back[tried[fits]] += bit
            bit >>= 1
        # A whole step back lies another grid place, which finds the run by itself.
        own = (back < step) & (back + forward >= span)
        if own.any():
            found.append(np.stack([doc, at - start[doc] - back, back + forward + period, period])[:, own])
    if not found:
        return tuple(np.empty((4, 0), np.int64))
    doc, first, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, first, doc))
    doc, first, length, period = (v[order] for v in (doc, first, length, period))
    # Equal stretches: only the smallest period.
    new = np.append(True, (doc[1:] != doc[:-1]) | (first[1:] != first[:-1]) | (length[1:] != length[:-1]))
    doc, first, length, period = (v[new] for v in (doc, first, length, period))
    order = np.lexsort((period, first, doc))
    return tuple(v[order] for v in (doc, first, length, period))


def _kept(total: int, offsets: np.ndarray, doc, first, length, period) -> np.ndarray:
    """Mask of the words that no run holds after its first period."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, offsets[doc] + first + period, 1)
    np.add.at(change, offsets[doc] + first + length, -1)
    return np.cumsum(change[:-1]) == 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def block_runs(texts: pa.Array, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[pa.Array]:
    """Number of words, runs and collapsed text of each text of a block."""
    flat, parent = words(texts)
    size = np.bincount(parent, minlength=len(texts)).astype(np.int64)
    offsets = np.cumsum(size) - size
    ids = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    # After each document one word of its own.
    sequence = np.empty(len(ids) + len(size), np.int64)
    sequence[np.arange(len(ids)) + parent] = ids
    sequence[offsets + size + np.arange(len(size))] = len(ids) + np.arange(len(size))
    doc, first, length, period = runs(sequence, offsets + np.arange(len(size)), size, min_length, min_exponent)
    keep = _kept(len(ids), offsets, doc, first, length, period)
    kept = flat if keep.all() else flat.filter(pa.array(keep))
    collapsed = pc.binary_join(listed(kept, np.bincount(parent[keep], minlength=len(size)), pa.LargeListArray),
                               pa.scalar(" ", pa.large_string()))
    found = pa.StructArray.from_arrays([pa.array(v) for v in (first, length, period)], fields=list(_RUN))
    return [pa.array(size), listed(found, np.bincount(doc, minlength=len(size))), collapsed.cast(pa.string())]


def find(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", min_length: int = MIN_LENGTH,
         min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Per row: keys, n_words, runs (start, length, period by start and period), and collapsed:
    the words outside of repeats, joined by one space."""
    columns = docs.select(*map(quoted, keys), quoted(text).alias("text"))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([*columns.schema.fields[:-1], T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])

    def of_batches(batches):
        for batch in batches:
            for block in blocks(batch):
                made = block_runs(block.columns[-1], min_length, min_exponent)
                yield pa.RecordBatch.from_arrays([*block.columns[:-1], *made], names=schema.names)

    return columns.mapInArrow(of_batches, schema)
