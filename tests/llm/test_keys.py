"""Keys beyond 2^53 beside a NULL key, and columns with clashing and dotted names, come back as they went in."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
import pytest

from spendcast.llm import (
    decontaminate,
    lexical,
    mixing,
    near_dedup,
    packing,
    passages,
    quality,
    scoring,
    sharding,
    token_files,
    vectors,
    warc,
)
from spendcast.session import scratch_path
from tests.llm.conftest import prose

KEYS = [9007199254740993, None, 9007199254740995, 1152921504606846977, 9007199254740992]
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def read_back(docs):
    folder = scratch_path(docs.sparkSession, "test-keys")
    token_files.write_token_files(docs, folder, WORD)
    return token_files.read_token_files(docs.sparkSession, folder)


OPERATORS = {
    "quality": lambda d, labels: quality.judge(d, labels),
    "near_dedup": lambda d, _: near_dedup.near_duplicates(d),
    "mixing": lambda d, _: mixing.mix(d),
    "packing": lambda d, _: packing.packed_documents(d, BYTE),
    "token_files": lambda d, _: read_back(d),
    "passages": lambda d, _: passages.without_repeats(d),
    "warc": lambda d, _: warc.derivatives(warc.responses(d, key="doc_id", url="lang", page="text"), key="doc_id").dropDuplicates(["doc_id"]),
    "scoring": lambda d, _: scoring.score(d),
    "vectors": lambda d, _: vectors.near_vectors(d.selectExpr("doc_id", "array(double(length(text)), 1D) AS v", "1 AS row"), "doc_id", "v"),
    "sharding": lambda d, _: sharding.shard_documents(d),
    "decontamination": lambda d, _: decontaminate.contamination(d, d.selectExpr("doc_id AS item_id", "text")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_keys_keep_all_digits(spark, name):
    rows = [(k, prose(70 + i, 60), "en", "s", 1, 2, 3, 4) for i, k in enumerate(KEYS)]
    kind = "doc_id long, text string, lang string, source string, _at_row int, _spans_to_cut int, `a.b` int, n_chars int"
    labels = spark.createDataFrame([(KEYS[0], 1, 0)], "doc_id long, quality int, toxic int")
    found = OPERATORS[name](spark.createDataFrame(rows, kind).coalesce(1), labels)
    assert Counter(r["doc_id"] for r in found.collect()) == Counter(KEYS)
    if name == "near_dedup" or name == "vectors":
        assert {r["component_id"] for r in found.where("kept").collect()} <= set(KEYS)
    if name == "passages":
        assert found.columns == ["doc_id", "text", "lang", "source", "_at_row", "_spans_to_cut", "a.b", "n_chars"]


def test_search_keeps_keys(spark):
    docs = spark.createDataFrame([(k, prose(70, 60)) for k in KEYS], "doc_id long, text string").coalesce(1)
    found = lexical.ranked_documents(docs, spark.createDataFrame([(1, prose(70, 60) + " new")], "item_id int, text string")).collect()
    assert [r["doc_id"] for r in sorted(found, key=lambda r: r["rank"])] == [*sorted(filter(None, KEYS)), None]
