"""Scoring against a plain trie, archive records by round trip, and the pipeline stage by stage."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from spendcast.llm import scoring, warc
from tests.conftest import SMALL


def plain_model(rows):
    contexts = {}
    for i, t in rows:
        if zlib.crc32((str(i) if i is not None else "").encode()) % 10:
            s = b"\n" * 5 + b" ".join(scoring.tokens(t)) + b"\n"
            for at in range(5, len(s)):
                for k in range(6):
                    followers = contexts.setdefault(s[at - k : at], Counter())
                    followers[s[at]] += 1

    def byte_score(s, at):
        score, refused = 0.0, set()
        for k in range(5, -1, -1):
            followers = contexts.get(s[at - k : at])
            if not followers:
                refused = set()
                continue
            offered = {b: n for b, n in followers.items() if b not in refused}
            if offered:
                room = sum(offered.values())
                if s[at] in offered:
                    return score + math.log10((offered[s[at]] - 0.5) / room)
                score += math.log10(0.5 * len(offered) / room)
            refused = set(followers)
        return score - math.log10(256 - len(refused))

    def score(t):
        s = b"\n" * 5 + b" ".join(scoring.tokens(t)) + b"\n"
        return sum(byte_score(s, at) for at in range(5, len(s)))

    return score


@pytest.mark.parametrize("block", [300, 1 << 22])
def test_scores(odd, odd_rows, block):
    rows = [(i, t) for i, t, *_ in odd_rows]
    found = scoring.score(odd, block=block).collect()
    exact = plain_model(rows)
    train = Counter()
    for i, t in rows:
        if zlib.crc32((str(i) if i is not None else "").encode()) % 10:
            train.update([*scoring.tokens(t), b"\n"])
    n, v, texts = sum(train.values()), len(train), {}
    for i, t in rows:
        texts[i] = t
    assert len(found) == len(rows)
    for r in found:
        words = [*scoring.tokens(texts[r.doc_id]), b"\n"]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in train for w in words), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(exact(texts[r.doc_id]))


def test_scoring_workers_hold_little():
    """Workers loaded pandas, kept half a million words beside the tables, and looked up two million pairs at a time."""
    import subprocess
    import sys

    code = "import sys, spendcast.llm.scoring as s; print('pandas' in sys.modules, hasattr(s, 'WordHashes'), s.SCORED_AT_ONCE)"
    told = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert told[:2] == ["False", "False"] and int(told[2]) <= 500_000


def test_scores_in_parts(spark, odd, monkeypatch):
    """The same scores however many bytes are looked up, and pairs counted, at a time."""
    def rows():
        return sorted(map(str, scoring.score(odd, block=1 << 22).collect()))

    expected = rows()
    monkeypatch.setattr(scoring, "SCORED_AT_ONCE", 50)
    monkeypatch.setattr(scoring, "COUNTED_AT_ONCE", 10)
    assert rows() == expected


def test_scores_of_nothing(nothing):
    assert scoring.score(nothing).count() == 0


def test_probabilities_of_a_context_add_up(odd_rows):
    """Over all bytes, what follows a context has probability 1."""
    import numpy as np

    keys = np.concatenate([scoring.pairs(scoring.tokens(t)) for _, t, *_ in odd_rows])
    keys, counts = np.unique(keys, return_counts=True)
    trie = scoring.levels(keys, counts, scoring.ORDER, 0, [])
    for context in (b"\n\n\n\n\n", b"abc d", b"zzzzz", b"\xff\xfe a "):
        asked = (np.uint64(int.from_bytes(context, "big")) << np.uint64(8)) + np.arange(256, dtype=np.uint64)
        assert (10 ** scoring.log_probabilities(asked, trie)).sum() == pytest.approx(1.0)


PAGES = [
    (1, "http://a.example/x/", '<html><head><title>T &amp; t</title><script>var a="</p>";</script></head><body><p>One<br>two <b>th</b>ree</p><a href="y?q=1&amp;z">l</a><!-- no --></body></html>'),
    (2, None, None),
    (3, "http://[bad", "<p>open <a href='//[x'>é &lt;b&gt; < 3"),
    (3, "http://[bad", "<p>open <a href='//[x'>é &lt;b&gt; < 3"),
    (4, "http://a.example/long", "<div>" * 20000 + "w " * 50000),
]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    captured = warc.responses(pages)
    source = {r.page_id: warc.read_record(bytes(r.record)) for r in captured.collect()}
    derived = warc.derivatives(captured).collect()
    assert len(derived) == 2 * len(PAGES)
    for r in derived:
        fields, block = warc.read_record(bytes(r.record))
        head, response = source[r.page_id]
        assert fields["warc-refers-to"] == r.refers_to == head["warc-record-id"]
        assert fields["warc-target-uri"] == head["warc-target-uri"] and fields["warc-date"] == head["warc-date"]
        payload = response.partition(b"\r\n\r\n")[2]
        assert fields["warc-source-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert fields["warc-block-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    text = {r.page_id: warc.read_record(bytes(r.record))[1].decode() for r in derived if r.warc_type == "conversion"}
    about = {r.page_id: warc.read_record(bytes(r.record))[1].decode() for r in derived if r.warc_type == "metadata"}
    assert text[1] == "T & t\nOne\ntwo three\nl" and text[2] == ""
    assert text[3] == "open é <b> < 3"
    assert "title: T & t\r\n" in about[1] and "outlink: http://a.example/x/y?q=1&z\r\n" in about[1]
    assert "http-header-content-type: text/html; charset=UTF-8\r\n" in about[1]
    assert warc.derivatives(captured.limit(0)).count() == 0


def test_archive_files(spark, tmp_path):
    records = [warc.response(i, u, h, "2024-01-01T00:00:00Z") for i, u, h in PAGES]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc").write_bytes(b"".join(records) + b"WARC/1.1\r\nbroken")
    found = warc.read_files(spark, str(tmp_path)).collect()
    assert Counter(bytes(r.record) for r in found) == Counter(records + records)
    assert warc.derive(b"nonsense") == [] and warc.derive(gzip.compress(records[0])[:-9]) == []


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SMALL).cache()
        assert docs.columns == columns, name
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    pieces = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_of_odd_rows(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).cache()
    assert docs.count() > 0
    empty = odd.limit(0).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
        assert empty.count() == 0
