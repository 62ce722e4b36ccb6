"""Tokenizing, packing and token files against the library itself."""

from __future__ import annotations

import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spendcast.llm import packing, text, token_files
from spendcast.llm.text import let_go
from spendcast.llm.tokens import Encoder, encoder, word_stretches
from spendcast.session import scratch_path

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def plain(name: str):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_encoder_equals_the_library(name):
    rng, encode = random.Random(7), plain(name)
    letters = list("abcXYZé 's01 \n\t\r\x0b\x1c\x85\xa0　.,!?_ñß²“—😀​́")
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(4000)] + ["", None, "a" * 5000]
    texts += ["<|endoftext|>", "x <|endoftext|>y", "a <|ENDOFTEXT|> b", "<|startoftext|> It's", "<|endoftext", "p<|endoftext|><|endoftext|>"]
    own = Encoder(public_tokenizers.path(name), 3)
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        assert ids.tolist() == [*encode(text), 3]


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(odd, odd_rows, nothing):
    path, encode = public_tokenizers.path(FILES[0]), plain(FILES[0])
    rows = packing.packed_documents(odd, path, max_tokens=64).collect()
    expected = Counter()
    for i, t, *_ in odd_rows:
        ids = [*encode(t), 0]
        first = (len(ids) - 1) % 64 + 1
        edges = [0, *range(first, len(ids) + 1, 64)]
        expected.update((i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 64
    assert packing.packed_documents(nothing, path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 30, 2000, 100_000])
def test_plan_uses_up_the_histogram(n):
    rng = np.random.default_rng(n)
    lengths = np.clip(np.exp(rng.normal(5.5, 1.0, n)).astype(int), 1, 2048)
    histogram = {int(x): int(c) for x, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    planned, used = packing.plan(histogram), Counter()
    for pattern, count in planned:
        assert count > 0 and sum(x * m for x, m in pattern) <= 2048
        used.update({x: m * count for x, m in pattern})
    assert used == Counter(histogram)
    assert sum(c for _, c in planned) <= 1.02 * -(-int(lengths.sum()) // 2048) + 1


def test_codes_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        values = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        assert token_files.unpack_codes(*token_files.pack_codes(values), n).tolist() == values.tolist()


def test_token_files(spark, odd, odd_rows, nothing):
    path, encode = public_tokenizers.path(FILES[1]), plain(FILES[1])
    folder = scratch_path(spark, "test-token-files")
    token_files.write_token_files(odd, folder, path)
    rows = token_files.read_token_files(spark, folder).collect()
    expected = Counter((i, tuple([*encode(t), 2])) for i, t, *_ in odd_rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == expected
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    known = [r.doc_id for r in sorted(rows, key=lambda r: r.start) if r.doc_id is not None]
    assert known == sorted(known)
    folder = scratch_path(spark, "test-empty-files")
    token_files.write_token_files(nothing, folder, path)
    assert token_files.read_token_files(spark, folder).count() == 0


def test_other_work_lets_go_of_the_cache():
    """The cache stayed with an idle worker, beside the work that Spark gave it next."""
    path = public_tokenizers.path(FILES[0])
    own = encoder(path, 0)
    own.encode(["some words here"])
    assert encoder(path, 0) is own and len(own.places)
    let_go()
    assert encoder(path, 0) is not own and not encoder(path, 0).places


def test_a_cache_nobody_asks_for_is_dropped(monkeypatch):
    """It stayed with a worker for as long as Spark kept that, beside stages that run in the JVM alone."""
    monkeypatch.setattr(text, "IDLE_SECONDS", 0.2)
    let_go()
    own = encoder(path := public_tokenizers.path(FILES[1]), 0)
    own.encode(["some words here"])
    assert encoder(path, 0) is own
    for _ in range(100):
        if not text._kept:
            break
        time.sleep(0.1)
    assert not text._kept
    # what was dropped is made again, and dropped again
    assert encoder(path, 0) is not own
    assert text._watch is not None
    let_go()


def test_word_level_stretches():
    """Every occurrence was an own Python string, and a word and its capital were learnt one by one."""
    texts = ["Well, WELL, don't 9a,b", "", " \t", "Café, a\xa0b É,x", "end"]
    different, row, sizes = word_stretches(texts)
    assert [different[i] for i in row] == ["well", ",", "well", ",", "don", "'t", "9a,b", "Café,", "a\xa0b", "É,x", "end"]
    assert sizes.tolist() == [7, 0, 0, 3, 1] and len(set(different)) == len(different)
    assert [len(x) for x in word_stretches([])] == [0, 0, 0]
    own, encode = Encoder(path := public_tokenizers.path(FILES[1]), 3), plain(FILES[1])
    assert path and [x.tolist() for x in own.encode(texts)] == [[*encode(t), 3] for t in texts]
    assert own.encode([]) == []
