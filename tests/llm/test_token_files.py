from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import documents, rows
from vacantia.llm import token_files as t

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = t.WordEncoder(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB'sStTlLéÉ́ß²½ıİΣσς\t\n  \x1c\x85\xa0​﻿|,.!?0٣Ⅷ漢🙂<|> ͅ \x00"), max_size=40))
def test_words_give_the_library_ids(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_packing_round_trip_and_random_access(bits):
    values = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype("<u4")
    packed = t.pack(values, bits)
    assert len(packed) == -(-1000 * bits // 8)
    assert (t.unpack(packed, bits, 0, 1000) == values).all()
    assert (t.unpack(packed, bits, 333, 44) == values[333:377]).all()
    assert len(t.unpack(packed, bits, 5, 0)) == 0


def test_minimum_bits():
    assert [t.bits_for(n) for n in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]


def test_files_give_back_every_document(spark):
    texts = ["it's ok", None, "", "<|endoftext|> x", "Ünïcode   ok", "long " * 30_000, "it's ok"]
    given_rows = [(5 * (7 - i), x) for i, x in enumerate(texts)] + [(None, "no id"), (35, "a same id")]
    path = t.write_tokens(documents(spark, given_rows), PATH, 1, block_ids=50)
    got = sorted(rows(t.token_table(spark, path)), key=lambda r: r[1])
    start, expected = 0, []
    for doc_id, text in sorted(given_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        own = np.array(ids(text) + [1], "<u4")
        expected.append((doc_id, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert got == expected
    assert t.blocks(spark, path).where("n_ids > 50 + 30001").count() == 0


def test_no_documents(spark):
    assert rows(t.token_table(spark, t.write_tokens(documents(spark, []), PATH, 1))) == []


def test_word_route_only_for_the_described_layout(tmp_path):
    import json

    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert t.WordEncoder(path).by_word
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    described["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"
    other = tmp_path / "other.json"
    other.write_text(json.dumps(described), encoding="utf-8")
    words = t.WordEncoder(str(other))
    assert not words.by_word
    text = "Mixed 12ab34, it's 99"
    assert np.frombuffer(words.encode(text), "<u4").tolist() == words.library.encode(text, add_special_tokens=False).ids


def test_many_rows_of_one_id_keep_their_order(spark):
    import public_tokenizers

    given = [(5, f"{i % 400:04d} text") for i in range(1200)] + [(None, f"{i:04d}") for i in range(300)] + [(9, None)]
    path = t.write_tokens(documents(spark, given), public_tokenizers.path("word_bpe_49k.json"), 1, block_ids=200)
    out = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in t.token_table(spark, path).collect())
    encoder, at, expected = t.encoder(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, text in sorted(given, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.append(np.frombuffer(encoder.encode(text or ""), "<u4"), np.uint32(1)).astype("<u4")
        expected.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert out == expected
    assert spark.read.parquet(path).select("shard").distinct().count() > 2
