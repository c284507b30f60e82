"""A row that occurs very often is dealt to all shards, and odd white space is encoded in linear time."""

import time
from collections import Counter

import numpy as np
import public_tokenizers as P
import tokenizers

from veilwright.llm import byte_tokens, packing
from veilwright.llm.queries import pattern, vocabulary


def test_a_row_repeated_very_often_fills_all_shards(spark):
    rows = [(7, "the same words again and again")] * 3000 + [(i, f"text {i} of its own") for i in range(300)] + [(None, "x")] * 5 + [(9, None)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    packs = packing.pack(df, vocabulary("byte_bpe_50k.tiktoken"), pattern(), seq_len=64, shard_bytes=8000).collect()
    shards = Counter(r.shard for r in packs for d in r.doc_ids if d == 7)
    assert len(shards) >= 10 and max(shards.values()) < 2 * 3000 / len(shards)
    assert Counter(d for r in packs for d in r.doc_ids) == Counter(d for d, t in rows if t)
    tokens = byte_tokens.loaded(vocabulary("byte_bpe_50k.tiktoken"), pattern())
    assert sum(r.n_tokens for r in packs) == sum(len(tokens.encode(t)) for _, t in rows)
    again = packing.pack(df.repartition(3), vocabulary("byte_bpe_50k.tiktoken"), pattern(), seq_len=64, shard_bytes=8000).collect()
    assert sorted((r.shard, r.row, bytes(r.input_ids)) for r in packs) == sorted((r.shard, r.row, bytes(r.input_ids)) for r in again)


def test_odd_white_space(spark):
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokens = byte_tokens.loaded(vocabulary("byte_bpe_50k.tiktoken"), pattern())
    spaces = "　", " \n", " ", "  \t", "\x85", "\x1c", "　 \r\n "
    for s in spaces:
        for text in (s * 6000, "a" + s * 3000 + "b" + s * 3000, (s * 1500 + "word ") * 3, s * 2100 + "\x1c" * 2100):
            want = library.encode(text, add_special_tokens=False).ids
            assert np.array_equal(tokens.encode(text), want), (s, len(text))
            assert np.array_equal(tokens.encode(text, 1000, 64), want), (s, len(text))
    for s in ("　", " \n"):
        began = time.perf_counter()
        tokens.encode(s * (1_000_000 // len(s)))
        assert time.perf_counter() - began < 20
