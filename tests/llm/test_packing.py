"""Packing: an exact round trip of ids, no overlap, no padding, balance."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tapewright.llm import cost_packing
from tapewright.llm.queries import vocabulary
from tapewright.llm.tokens import Encoder

ODD = ["", "\n", "a\n\nb", " a", "a  b", "x\t y", "é b <|endoftext|> c", "it's\n'tis o'clock\n 9", "word.\nNext 's",
       "nb sp   x", "a b", "\U0001f600 smile", None]


def truth(text):
    return Tokenizer.from_file(vocabulary()).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("memo", [1_000_000, 3])
def test_ids_equal_the_tokenizers(sf_dir, spark, monkeypatch, memo):
    from tapewright.llm import tokens

    monkeypatch.setattr(tokens, "MEMO", memo)
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    got = Encoder(vocabulary()).encode([t or "" for t in texts])
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [truth(t) for t in texts]


def test_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(20_000, "word " * 5000)], docs.schema)
    rows = cost_packing.pack(docs.union(odd), vocabulary()).collect()
    texts = {r.doc_id: r.text for r in docs.union(odd).collect()}
    pieces, sequences = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for doc_id, parts in pieces.items():
        parts.sort()
        whole = np.frombuffer(b"".join(p[1] for p in parts), "<u4").tolist()
        assert whole == truth(texts[doc_id]) + [0]
        assert [p[0] for p in parts] == [sum(len(q[1]) // 4 for q in parts[:i]) for i in range(len(parts))]
        assert {p[2] for p in parts} == {len(whole)}
    for parts in sequences.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:i]) for i in range(len(parts))]
        total = sum(p[1] for p in parts)
        assert total <= 1024 and total & (total - 1) == 0


def test_cheapest_with_room():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 1024) for _ in range(400)]
    placed, left = cost_packing.assign(lengths, 1024)
    assert sum(n for *_, n in left) == sum(lengths) % 1024
    first = [p for p in placed if p[1] == 0][:sum(lengths) // 1024]
    assert [lengths[p[0]] for p in first] == sorted(lengths, reverse=True)[:len(first)]
    assert len({p[3] for p in first}) == len(first)
    used = {}
    for piece, at, n, sequence in placed:
        used[sequence] = used.get(sequence, 0) + n
    assert set(used.values()) == {1024}


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, ids string, start int")
    assert cost_packing.pack(empty, vocabulary()).count() == 0
    big = 2 ** 62 + 1
    twice = spark.createDataFrame([(None, "a"), (None, "a"), (big, "a")], "doc_id long, text string").coalesce(1)
    got = cost_packing.pack(twice, vocabulary()).collect()
    assert sorted(((r.doc_id, r.doc_tokens) for r in got), key=str) == [(big, 2), (None, 2), (None, 2)]
