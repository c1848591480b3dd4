from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.helpers import documents, prose
from vacantia.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "<|endoftext|> and </s><s> <unk> <0x41>", "a▁b", "▁", " lead", "trail  ", "tabs\t\tand\n\n\nlines\r\n", "näive ä ﬁ ① Å", "你好世界 \U0001f600\U0001f469‍\U0001f4bb",
    "\x00\x01\x7f", "  　x", "don't I'LL we've", "1234567890 3.14", "العربية", "x" * 3000, " " * 3000, "ab" * 2000, "﻿bom", "สวัสดี �", "a", " ", "\n",
]


def letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            table[chr(extra)] = b
            extra += 1
    return table


@pytest.fixture(scope="module")
def plain_model():
    """Both libraries as they are, and the alignment token by token."""
    a, b, byte = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), letters()
    a.encode_special_tokens = True

    def tokens(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        raw = b" " + text.encode()
        return (ids_a, bytes_a, ids_b, bytes_b) if text and b"".join(bytes_a) == raw == b"".join(bytes_b) else ([], [], [], [])

    def aligned(text):
        ids_a, bytes_a, ids_b, bytes_b = tokens(text or "")
        groups, links, i, j = [], [], 0, 0
        end_a = end_b = 0
        spans_a, spans_b = [], []
        for b_ in bytes_a:
            spans_a.append((end_a, end_a := end_a + len(b_)))
        for b_ in bytes_b:
            spans_b.append((end_b, end_b := end_b + len(b_)))
        common = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        for end in common:
            own = [], []
            while i < len(ids_a) and spans_a[i][1] <= end:
                own[0].append(ids_a[i])
                i += 1
            while j < len(ids_b) and spans_b[j][1] <= end:
                own[1].append(ids_b[j])
                j += 1
            groups.append(",".join(map(str, own[0])) + "|" + ",".join(map(str, own[1])))
        first = 0
        for x, (s, e) in zip(ids_a, spans_a, strict=True):
            while first < len(ids_b) and spans_b[first][1] <= s:
                first += 1
            j = first
            while j < len(ids_b) and spans_b[j][0] < e:
                links.append((x, ids_b[j]))
                j += 1
        return ids_a, ids_b, groups, links

    return aligned


def brute(plain_model, given):
    each = [(i, plain_model(text)) for i, text in given]
    counts = Counter(pair for _, (_, _, _, links) in each for pair in links)
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    out = []
    for i, (ids_a, ids_b, groups, links) in each:
        told = ";".join(groups)
        sha = hashlib.sha256(told.encode()).hexdigest() if groups else ""
        out.append((i, len(ids_a), len(ids_b), len(groups), len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), sha))
    return sorted(out, key=repr)


def found(spark, given, sizes=(ta.CHUNK_BYTES, ta.BLOCK_BYTES), **options):
    aligned = ta.stored(ta.digest(ta.align(documents(spark, given).repartition(3), A, B, *sizes)))
    out = ta.with_link_counts(aligned, ta.vocabulary(A, B)[0], **options)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in out.select(*names).collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    random_ = random.Random(2)
    given = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, ""), (None, "no id"), (7, "repeated id"), (7, "repeated id")]
    given += [(200 + i, " ".join(prose(i, random_.randrange(1, 80), 300))) for i in range(40)]
    return given + [(300 + i, "the same words again and again") for i in range(50)]


@pytest.mark.parametrize("table_bytes", [ta.TABLE_BYTES, 0])
def test_equals_plain_alignment(spark, plain_model, texts, table_bytes):
    assert found(spark, texts, table_bytes=table_bytes) == brute(plain_model, texts)


@pytest.mark.parametrize("sizes", [(50, 200), (50, 10**6), (10**6, 1)])
def test_small_blocks_and_counts(spark, plain_model, texts, sizes):
    assert found(spark, texts, sizes, table_bytes=0, held_keys=100) == brute(plain_model, texts)


def test_empty_table(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (2, "")], table_bytes=0) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_very_long_text(plain_model):
    text = " ".join(prose(4, 60_000, 20_000)) + "é" * 5000
    n_a, n_b, n_groups, n_links, groups, keys, times = ta.align_texts([text], A, B)[0]
    ids_a, ids_b, told, links = plain_model(text)
    assert (n_a, n_b, n_groups, n_links) == (len(ids_a), len(ids_b), len(told), len(links)) and groups.decode() == ";".join(told)
    size = ta.vocabulary(A, B)[0]
    assert Counter({(k % size, k // size): n for k, n in zip(keys.tolist(), times.tolist(), strict=True)}) == Counter(links)


def test_gallop_equals_binary_search():
    random_ = np.random.default_rng(1)
    for _ in range(200):
        hay = np.unique(random_.integers(0, 500, random_.integers(1, 100)))
        needles = np.sort(random_.integers(0, hay[-1] + 1, random_.integers(0, 50)))
        start = random_.integers(-5, len(hay) + 5, len(needles))
        assert ta.gallop(needles, hay, start).tolist() == np.searchsorted(hay, needles).tolist()


def test_fast_route_equals_the_library():
    own, library = ta.ByteLevel(A), Tokenizer.from_file(A)
    library.encode_special_tokens = True
    random_ = random.Random(8)
    alphabet = [chr(c) for c in [*range(32, 127), 9, 10, 13, 0xA0, 0xE9, 0x301, 0x2003, 0x2028, 0x4E00, 0x661, 0x1F600, 0xFE0F, 0x2160]]
    given = ODD + ["".join(random_.choices(alphabet, k=random_.randrange(1, 60))) for _ in range(3000)]
    assert own.encode(given) == [e.ids for e in library.encode_batch([" " + t for t in given], add_special_tokens=False)]


def test_other_files_take_the_library(tmp_path):
    with open(A, encoding="utf-8") as f:
        text = f.read()
    changed = tmp_path / "other.json"
    changed.write_text(text.replace('"use_regex":true', '"use_regex":false').replace('"use_regex": true', '"use_regex": false'), encoding="utf-8")
    library = Tokenizer.from_file(str(changed))
    assert ta.ByteLevel(str(changed)).encode(["two words"]) == [library.encode(" two words", add_special_tokens=False).ids]


def test_packed_links_return():
    for keys in ([], [0], [5, 300, 2**33], list(range(0, 70_000, 7))):
        data = ta._packed(np.array(keys, np.int64), np.arange(1, len(keys) + 1))
        assert ta._links(*data)[0].tolist() == keys and ta._links(*data)[1].tolist() == list(range(1, len(keys) + 1))
