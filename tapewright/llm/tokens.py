"""Token ids of whole texts, with a memo of the pieces between single spaces."""

from __future__ import annotations

import json
import os

import numpy as np

MEMO = 1_500_000   # pieces remembered by a worker
START = "\r"        # marks the first piece of a line; never part of a printable one
JOIN = 1 << 18     # characters of new pieces encoded in one call


class Encoder:
    """Little-endian unsigned 32-bit ids of texts, equal to the tokenizer's own.

    A byte-level pre-tokenizer without a normaliser always cuts before a space or line
    feed that has no white space beside it. Lines that consist of printable text and
    single spaces are therefore cut there and their pieces looked up; any other text,
    and one that contains a special token, goes to the tokenizer whole.
    """

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        facts = json.loads(self._tokenizer.to_str())
        before = facts.get("pre_tokenizer") or {}
        self._special = [t["content"] for t in facts.get("added_tokens", [])]
        newline = self._tokenizer.encode("\n", add_special_tokens=False).ids
        self._by_piece = (facts.get("normalizer") is None and before.get("type") == "ByteLevel"
                          and not before.get("add_prefix_space", True) and len(newline) == 1)
        self._newline = newline[0]
        self._memo = {"\n": np.array(newline, "<u4").tobytes()}

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pieces(self, text: str) -> list[str] | None:
        """The text cut before single spaces and around single line feeds, or None.

        A piece stands for itself after a space, or, marked by START, without one."""
        if not self._by_piece or any(s in text for s in self._special):
            return None
        pieces = []
        for line in text.split("\n"):
            if not line or "  " in line or line[0] == " " or line[-1] == " " or not line.isprintable():
                return None
            if pieces:
                pieces.append("\n")
            words = line.split(" ")
            words[0] = START + words[0]
            pieces.extend(words)
        return pieces

    def _learn(self, new: list[str]) -> None:
        """Encode pieces, some thousand in a call; line feeds between them keep them apart."""
        at = 0
        while at < len(new):
            size, upto = 0, at
            while upto < len(new) and size < JOIN:
                size += len(new[upto]) + 1
                upto += 1
            keys = new[at:upto]
            part = [k[1:] if k[0] == START else " " + k for k in keys]
            ids = np.array(self._tokenizer.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self._newline), len(ids))
            if len(ends) == len(part):
                data = ids.tobytes()
                starts = np.append(0, ends[:-1] + 1)
                self._memo.update((k, data[4 * a:4 * b]) for k, a, b in zip(keys, starts.tolist(), ends.tolist()))
            else:  # a vocabulary in which a line feed joins its neighbours
                self._memo.update((k, self._whole(p)) for k, p in zip(keys, part))
            at = upto

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._pieces(t) for t in texts]
        memo = self._memo
        new = list(dict.fromkeys(p for pieces in cut if pieces for p in pieces if p not in memo))
        if len(memo) + len(new) > MEMO:
            memo = self._memo = {"\n": memo["\n"]}
            new = list(dict.fromkeys(p for pieces in cut if pieces for p in pieces if p not in memo))
        self._learn(new)
        return [self._whole(t) if pieces is None else b"".join(map(memo.__getitem__, pieces))
                for t, pieces in zip(texts, cut)]


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]
