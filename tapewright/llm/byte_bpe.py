"""Byte-level BPE through a sentencepiece model that is written directly from a vocabulary.

A rank file gives byte strings and their merge order. ``model_bytes`` serialises a
sentencepiece BPE model for it, without any training: byte b becomes the letter
U+0100 + b, every entry is a piece of such letters scored by its negative rank, and the
normalisation is the identity. Merging the best scored neighbours first, leftmost on
ties, is then what merging the lowest rank first is. A text is cut into pre-tokens by the
vocabulary's pattern and each is encoded by itself; decoding maps pieces back to bytes.

An entry that its own merges cannot build (a vocabulary may hold such) is taken whole
where it is a whole pre-token, as rank files ask. Letter and number classes of the
pattern are read as the rank files' own library reads them, whatever Unicode version
the regular expressions here know.

Rows are coded where they are read: nothing is shuffled. A worker holds one batch and a
memo bounded in characters, and a lost task is simply run again.

Defined cases: a null or empty text has no ids and decodes to no bytes; null ids decode
to no bytes; null, repeated or any other keys are carried as they are, with a row for a
row; texts of any length are taken whole; an empty table gives an empty result; columns
that are not named are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import re
import struct
import sys
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapewright.llm.common import quoted

FIRST = 0x100            # the letter of byte 0
MEMO_CHARS = 4_000_000   # characters of pre-tokens remembered by a worker, besides those of a slice of rows
ROWS_OUT = 512           # rows of a slice

_LETTERS = {b: FIRST + b for b in range(256)}
_BYTES = {FIRST + b: b for b in range(256)}


def to_letters(data: bytes) -> str:
    return data.decode("latin-1").translate(_LETTERS)


def to_bytes(letters: str) -> bytes:
    return letters.translate(_BYTES).encode("latin-1")


def read_ranks(path: str) -> dict[bytes, int]:
    """Entries of a rank file: base64 of the bytes, a space, the rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(entry): int(rank) for entry, rank in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def model_bytes(entries: Iterable[bytes]) -> bytes:
    """A serialised sentencepiece BPE model of entries in ascending order of rank.

    Piece i is entry i with score -i; one more piece, never produced where all 256 bytes
    are entries, stands for the unknown."""
    # Field numbers and codes of the public model format.
    pieces_field, trainer_field, normalizer_field = 1, 2, 3
    piece, score, kind, unknown_kind = 1, 2, 3, 2
    model_type, bpe, vocabulary_size, unknown_id = 3, 2, 4, 40
    name, dummy_prefix, drop_spaces, escape_spaces = 1, 3, 4, 5

    out, n = [], 0
    for entry in entries:
        body = _block(piece, to_letters(entry).encode()) + _varint(score << 3 | 5) + struct.pack("<f", -n)
        out.append(_block(pieces_field, body))
        n += 1
    out.append(_block(pieces_field, _block(piece, b"<unk>") + _number(kind, unknown_kind)))
    out.append(_block(trainer_field, _number(model_type, bpe) + _number(vocabulary_size, n + 1) + _number(unknown_id, n)))
    out.append(_block(normalizer_field, _block(name, b"identity") + _number(dummy_prefix, 0)
                      + _number(drop_spaces, 0) + _number(escape_spaces, 0)))
    return b"".join(out)


def _ranges(points: list[int]) -> str:
    """Members of a regular expression's set for code points."""
    ends = np.flatnonzero(np.diff(points) != 1)
    starts = np.append(0, ends + 1)
    return "".join(f"\\U{points[a]:08x}-\\U{points[b]:08x}" for a, b in zip(starts, np.append(ends, len(points) - 1)))


def compiled(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern, its letter and number classes as tiktoken has them.

    Where a text holds none of the characters that the two libraries class differently,
    the pattern is used as it is, which is faster."""
    import regex
    import tiktoken

    every = "".join(chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
    byte_ranks = {bytes([i]): i for i in range(256)}
    careful, differing = pattern, set()
    for name in (r"\p{L}", r"\p{N}"):
        own = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=byte_ranks, special_tokens={})
        have = set(bytes(own.encode_ordinary(every)).decode())
        mine = set(regex.findall(name, every))
        less, more = sorted(map(ord, mine - have)), sorted(map(ord, have - mine))
        differing |= mine ^ have
        if less or more:
            # Classes stand inside and outside of sets in a pattern; a nested set suits both.
            nested = f"[[{name}{_ranges(more) if more else ''}]" + (f"--[{_ranges(less)}]]" if less else "]")
            careful = careful.replace(name, nested)
    plain = regex.compile(pattern).findall
    if not differing:
        return plain
    careful = regex.compile(careful, regex.V1).findall
    high = re.compile(f"[\\U{min(map(ord, differing)):08x}-\\U0010ffff]").search   # one range: quick, rarely true
    odd = re.compile(f"[{_ranges(sorted(map(ord, differing)))}]").search
    return lambda text: careful(text) if not text.isascii() and high(text) and odd(text) else plain(text)


class Codec:
    """Ids of texts and bytes of ids, for one rank file and pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        import sentencepiece

        ranks = read_ranks(ranks_path)
        order = sorted(ranks, key=ranks.__getitem__)
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(order))
        self._rank = np.array([ranks[e] for e in order], "<u4")   # piece -> rank
        self._match = compiled(pattern)
        self._bytes = {int(r): to_bytes(self._model.id_to_piece(i)) for i, r in enumerate(self._rank)}
        built = self._model.encode([to_letters(e) for e in order], num_threads=1)
        # Entries their merges do not build: only whole pre-tokens are taken as these.
        self._whole = {to_letters(e): [i] for i, (e, ids) in enumerate(zip(order, built)) if ids != [i]}
        self._memo: dict[str, bytes] = {}
        self._memo_chars = 0

    def _learn(self, tokens: list[str]) -> None:
        letters = [to_letters(t.encode("utf-8", "surrogatepass")) for t in tokens]
        found = self._model.encode(letters, num_threads=1)
        if self._whole:
            found = [self._whole.get(w, ids) for w, ids in zip(letters, found)]
        ends = np.cumsum([len(ids) for ids in found], dtype=np.int64).tolist()
        ranks = self._rank[np.fromiter(chain.from_iterable(found), np.int64, ends[-1] if ends else 0)].tobytes()
        self._memo.update((t, ranks[4 * (end - len(ids)):4 * end]) for t, ids, end in zip(tokens, found, ends))
        self._memo_chars += sum(map(len, tokens))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [self._match(t) for t in texts]
        if self._memo_chars > MEMO_CHARS:
            self._memo.clear()
            self._memo_chars = 0
        self._learn(list(set(chain.from_iterable(cut)).difference(self._memo)))
        return [b"".join(map(self._memo.__getitem__, tokens)) for tokens in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple, Codec] = {}


def codec(*settings) -> Codec:
    """The worker's codec of a rank file, pattern."""
    if settings not in _codecs:
        _codecs[settings] = Codec(*settings)
    return _codecs[settings]


def _mapped(df: DataFrame, keys: tuple[str, ...], value: str, out: str, code: Callable[[list], list[bytes]]) -> DataFrame:
    """Keys of df and, as binary column out, what code makes of lists of value."""
    columns = df.select(*map(quoted, keys), quoted(value).alias("value"))
    schema = T.StructType([*columns.schema.fields[:-1], T.StructField(out, T.BinaryType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                made = pa.array(code(part.columns[-1].to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=[*part.schema.names[:-1], out])

    return columns.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str,
           keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Per row: keys and ids, the text's ids as little-endian unsigned 32-bit integers."""
    return _mapped(docs, keys, text, "ids",
                   lambda texts: codec(ranks_path, pattern).encode([t or "" for t in texts]))


def decode(coded: DataFrame, ranks_path: str, pattern: str,
           keys: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """Per row: keys and data, the bytes that ids stand for; an id that no entry has is an error."""
    return _mapped(coded, keys, ids, "data",
                   lambda rows: [codec(ranks_path, pattern).decode(r or b"") for r in rows])
