"""Byte-level BPE: ids equal tiktoken's, decoding is an exact round trip."""

import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from tapewright.llm import byte_bpe
from tapewright.llm.queries import op11, rank_vocabulary

ODD = ["", " ", "\n", "a\n\nb", " a", "a  b", "x\t y", "it's\n'tis o'clock\n 9", "ééé ñ", "<|endoftext|>", "\x00\x1c\x85​",
       "\U0001f600 smile \U00010940x", "a" * 30_000, " " * 3000, "ñ" * 2000]


def truth():
    path, pattern = rank_vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


def random_texts(n):
    rng = random.Random(7)
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    return ["".join(rng.choice(every) if rng.random() < 0.5 else rng.choice("  ab'\n\tstre9") for _ in range(50))
            for _ in range(n)]


@pytest.mark.parametrize("memo_chars", [byte_bpe.MEMO_CHARS, 10])
def test_ids_are_tiktokens(spark, sf_dir, monkeypatch, memo_chars):
    monkeypatch.setattr(byte_bpe, "MEMO_CHARS", memo_chars)
    texts = ODD + random_texts(400) + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    codec, own = byte_bpe.Codec(*rank_vocabulary()), truth()
    for at in range(0, len(texts), 100):
        part = texts[at:at + 100]
        ids = codec.encode(part)
        assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [own.encode_ordinary(t) for t in part]
        assert [codec.decode(i) for i in ids] == [t.encode() for t in part]


def test_entry_that_merges_cannot_build(tmp_path):
    import base64

    entries = [bytes([i]) for i in range(256)] + [b"abc"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(e) + b" " + str(2 * i).encode() for i, e in enumerate(entries)))
    codec = byte_bpe.Codec(str(path), r"[a-z]+|\s+")
    own = tiktoken.Encoding("own", pat_str=r"[a-z]+|\s+", mergeable_ranks={e: 2 * i for i, e in enumerate(entries)},
                            special_tokens={})
    for text in ("abc", "abcd", "abc abc ab", "A-abc"):
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == own.encode_ordinary(text)


def test_frames(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "x y", "b"), (None, "x y", "c"), (2**62, "", "d")],
                                 "doc_id long, text string, ids string")
    path, pattern = rank_vocabulary()
    coded = byte_bpe.encode(docs, path, pattern)
    assert coded.columns == ["doc_id", "ids"]
    back = byte_bpe.decode(coded, path, pattern).select("doc_id", F.col("data").cast("string")).collect()
    assert sorted((str(r[0]), r[1]) for r in back) == [("1", ""), ("1", "x y"), (str(2**62), ""), ("None", "x y")]
    assert byte_bpe.encode(docs.limit(0), path, pattern).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bytes(byte_bpe.decode(nothing, path, pattern).first().data) == b""


def test_query_round_trip(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    own, rows = truth(), op11(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    from hashlib import sha256

    for r in rows:
        ids = np.array(own.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), sha256(ids.tobytes()).hexdigest(), sha256(texts[r.doc_id].encode()).hexdigest())
