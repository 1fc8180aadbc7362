"""Cost-balanced packing of token ids into sequences.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n``: attention within a piece
is quadratic, the rest linear. A task tokenises its documents, gathers about
``BUFFER`` tokens of pieces, and assigns them in descending length to the cheapest
sequence that still has room. There are exactly as many sequences as the gathered
tokens fill; a piece that fits nowhere is cut at the largest room left. What remains,
less than a sequence, joins the next buffer, and at the end of the task is cut into
sequences whose lengths are powers of two. So no sequence needs padding.

Documents are packed where they are read: nothing is shuffled, a task's memory is one
buffer, and a lost task is simply run again. Sequence ids are unique by the task's
number in their upper bits, as those of monotonically_increasing_id.

Defined cases: a null or empty text is its end token alone; a null doc_id is kept;
repeated rows are packed each; long texts fill whole sequences; an empty table gives
an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.llm.common import quoted
from tapewright.llm.tokens import encoder

LENGTH = 1024
END = 0
LINEAR = 1.0
QUADRATIC = 1.0 / 1024
BUFFER = 1 << 19   # tokens
ENCODE_ROWS = 256

COLUMNS = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: list[int], capacity: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Fill sum(lengths) // capacity sequences to the brim.

    Returns placements (piece, first token in it, tokens, sequence) and what is left,
    as (piece, first token, tokens).
    """
    n_seq = sum(lengths) // capacity
    costs, room = np.zeros(n_seq), np.full(n_seq, capacity)
    queue = [(-n, i, 0) for i, n in enumerate(lengths)]
    heapq.heapify(queue)
    placed = []
    open_room = n_seq * capacity
    while open_room:
        size, piece, first = heapq.heappop(queue)
        size = -size
        fits = np.flatnonzero(room >= size)
        if len(fits):
            at, take = int(fits[np.argmin(costs[fits])]), size
        else:
            at = int(np.argmax(room))
            take = int(room[at])
            heapq.heappush(queue, (take - size, piece, first + take))
        placed.append((piece, first, take, at))
        costs[at] += cost(take)
        room[at] -= take
        open_room -= take
    return placed, [(piece, first, -size) for size, piece, first in sorted(queue)]


class _Packer:
    """Pieces of one task -> rows of COLUMNS."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.pieces: list[tuple] = []   # (doc_id, start, ids, doc_tokens)
        self.tokens = 0
        self.rows: list[tuple] = []

    def _open(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def add(self, doc_id, ids: bytes) -> None:
        total, step = len(ids) // 4, self.capacity
        full = total // step * step
        for start in range(0, full, step):
            self.rows.append((doc_id, start, step, total, self._open(), 0, ids[4 * start:4 * (start + step)]))
        if full < total:
            self.pieces.append((doc_id, full, ids[4 * full:], total))
            self.tokens += total - full

    def pack(self) -> None:
        placed, left = assign([len(p[2]) // 4 for p in self.pieces], self.capacity)
        ids, offset = {}, {}
        for piece, first, n, sequence in placed:
            if sequence not in ids:
                ids[sequence], offset[sequence] = self._open(), 0
            self._emit(piece, first, n, ids[sequence], offset[sequence])
            offset[sequence] += n
        self.pieces = [(d, s + first, b[4 * first:4 * (first + n)], t)
                       for (d, s, b, t), first, n in ((self.pieces[i], f, n) for i, f, n in left)]
        self.tokens = sum(n for _, _, n in left)

    def _emit(self, piece, first, n, sequence, offset):
        doc_id, start, ids, total = self.pieces[piece]
        self.rows.append((doc_id, start + first, n, total, sequence, offset, ids[4 * first:4 * (first + n)]))

    def finish(self) -> None:
        """Fewer tokens than a sequence are left: one sequence for each of their binary digits."""
        self.pack()
        at, first = 0, 0
        for power in range(self.tokens.bit_length() - 1, -1, -1):
            if not self.tokens >> power & 1:
                continue
            sequence, offset = self._open(), 0
            while offset < 1 << power:
                n = min(len(self.pieces[at][2]) // 4 - first, (1 << power) - offset)
                self._emit(at, first, n, sequence, offset)
                offset, first = offset + n, first + n
                if first == len(self.pieces[at][2]) // 4:
                    at, first = at + 1, 0


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text",
         capacity: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of every document with their place: COLUMNS, ids as little-endian bytes."""
    # Ids travel as text: pandas would turn whole numbers beside a null into doubles.
    schema = T.StructType([T.StructField("doc_id", T.StringType()),
                           *[T.StructField(c, T.LongType()) for c in COLUMNS[1:-1]],
                           T.StructField("ids", T.BinaryType())])
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        packer = _Packer(capacity, TaskContext.get().partitionId() << 33)
        encode = encoder(vocabulary).encode

        def flush():
            frame = pd.DataFrame(packer.rows, columns=COLUMNS)
            packer.rows = []
            return frame

        for batch in batches:
            keys, texts = batch.iloc[:, 0].tolist(), batch.iloc[:, 1].tolist()
            for at in range(0, len(texts), ENCODE_ROWS):
                part = [t or "" for t in texts[at:at + ENCODE_ROWS]]
                for key, ids in zip(keys[at:at + ENCODE_ROWS], encode(part)):
                    packer.add(key, ids + tail)
                    if packer.tokens >= BUFFER:
                        packer.pack()
                    if len(packer.rows) >= 4096:
                        yield flush()
        packer.finish()
        if packer.rows:
            yield flush()

    packed = docs.select(quoted(doc_id).cast("string").alias("doc_id"), quoted(text).alias("text")).mapInPandas(run, schema)
    return packed.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))
