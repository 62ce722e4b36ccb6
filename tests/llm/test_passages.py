"""Repeated passages against a plain search of every window of words, and edited ones against what was planted."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from spendcast.llm import passages

WORD = re.compile("[^\x20\x09-\x0d]+")


def sentence(rng, n, mark="."):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(n)) + mark


@pytest.fixture(scope="module")
def planted():
    """Passages of 30 to 90 words between words of their own, cut at any word."""
    rng = random.Random(11)
    two = sentence(rng, 29) + " " + sentence(rng, 24)
    unmarked, listed = sentence(rng, 53, ""), "\n".join(sentence(rng, 1, "") for _ in range(60))
    many = [sentence(rng, n) for n in (30, 31, 45, 60, 90)]
    texts = []
    for passage in (two, unmarked, listed, *many):
        for _ in range(3):
            texts.append(sentence(rng, rng.randint(3, 20), "") + " " + passage + " " + sentence(rng, rng.randint(3, 20)))
    # a part of a passage from inside a sentence, and too short a part
    texts += [sentence(rng, 7, "") + " " + " ".join(many[4].split()[20:61]) + " " + sentence(rng, 9, "")]
    texts += [sentence(rng, 7, "") + " " + " ".join(many[4].split()[20:49]) + " " + sentence(rng, 9, "")]
    return list(enumerate(texts))


def repeated_words(texts, n=30):
    """Places of words in windows of n that an earlier text holds too, or only a later one."""
    held = defaultdict(set)
    words = {i: WORD.findall(t) for i, t in texts}
    for i, w in words.items():
        for at in range(len(w) - n + 1):
            held[tuple(w[at : at + n])].add(i)
    out = {True: defaultdict(set), False: defaultdict(set)}
    for i, w in words.items():
        for at in range(len(w) - n + 1):
            rows = held[tuple(w[at : at + n])]
            if len(rows) > 1:
                # the first text keeps the words
                out[i != min(rows)][i].update(range(at, at + n))
    return out


def places(found):
    spans = {True: defaultdict(set), False: defaultdict(set)}
    for row, first, last, removed in found:
        spans[removed][row].update(range(first, last))
    return spans


def test_exact_passages_are_found_to_their_last_word(spark, planted):
    docs = spark.createDataFrame(planted, "doc_id long, text string").repartition(3)
    expected = repeated_words(planted)
    spans = places((r.doc_id, r.first_word, r.last_word, r.removed) for r in passages.repeated_passages(docs).collect())
    assert all(expected[removed][i] <= spans[removed][i] for removed in (True, False) for i, _ in planted)
    # nothing else is removed, but for a word that chance adds
    assert sum(len(spans[True][i] - expected[True][i]) for i, _ in planted) <= 2


def edited(rng, words, marked):
    """A passage of its own with one word changed, put in or left out, and another one in place of the marks' sentences."""
    at = rng.randrange(3, len(words) - 3)
    new = [sentence(rng, 1, "." if marked and at % 9 == 8 else "")]
    return [words[:at] + new + words[at + 1 :], words[:at] + new + words[at:], words[:at] + words[at + 1 :]][rng.randrange(3)]


@pytest.mark.parametrize("marked", [True, False])
def test_edited_passages_are_removed_whole(spark, marked):
    """200 passages of 50 to 100 words and an edited copy of each, with and without marks of sentences."""
    rng = random.Random(17 + marked)
    rows, expected = [], {}
    for i in range(200):
        words = sentence(rng, rng.randint(50, 100), "").split()
        if marked:
            words = [w + "." if k % 9 == 8 else w for k, w in enumerate(words)]
        other = edited(rng, words, marked)
        for key, passage in ((i, words), (1000 + i, other)):
            before = sentence(rng, rng.randint(5, 60), "").split()
            rows.append((key, " ".join([*before, *passage, *sentence(rng, rng.randint(5, 60), "").split()])))
            expected[key] = (len(before), len(before) + len(passage))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = passages.repeated_passages(docs).collect()
    whole = {(r.doc_id, r.removed) for r in found if r.first_word <= expected[r.doc_id][0] and r.last_word >= expected[r.doc_id][1]}
    assert sum((1000 + i, True) in whole for i in range(200)) >= 180
    assert sum((i, False) in whole for i in range(200)) >= 180
    assert all(r.removed == (r.doc_id >= 1000) and r.first_doc_id == r.doc_id % 1000 for r in found)
    # words around a passage stay, but for what chance adds
    assert all(r.first_word >= expected[r.doc_id][0] - 2 and r.last_word <= expected[r.doc_id][1] + 2 for r in found)


def test_variants_of_one_passage(spark):
    """Variants of one text by one word each: all but the first go, whichever words they share."""
    rng = random.Random(5)
    template = sentence(rng, 60).split()
    texts = [" ".join(template)]
    for at in [rng.randrange(2, 58) for _ in range(80)]:
        texts.append(" ".join([*template[:at], sentence(rng, 1, "x"), *template[at + 1 :]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = passages.repeated_passages(docs).collect()
    removed = {r.doc_id for r in found if r.removed and (r.first_word, r.last_word) == (0, 60)}
    assert removed == set(range(1, 81)) and all(r.first_doc_id == 0 for r in found)


def test_clusters_join_through_a_common_member(spark):
    """Links 2-0 and 2-1 of the same words of 2 make one cluster, of which 1 goes as well."""
    links = spark.createDataFrame(
        [(900, 5, 45, 100, 0, 40), (900, 5, 45, 500, 7, 47), (900, 5, 80, 600, 0, 75)],
        "row long, first long, last long, holder long, at long, to long",
    )
    found = {(r.row, r.first, r.last): (r.first_row, r.removed) for r in passages.clustered(links).collect()}
    assert found == {
        (100, 0, 40): (100, False),
        (500, 7, 47): (100, True),
        (900, 5, 45): (100, True),
        (600, 0, 75): (600, False),
        (900, 5, 80): (600, True),
    }


def test_repeats_inside_a_document(spark):
    """The first copy stays, the words between copies too; halves of two texts that overlap by a paragraph go."""
    rng = random.Random(23)
    one, other, between = sentence(rng, 60, ""), sentence(rng, 70, "").split(), sentence(rng, 25, "")
    texts = [f"{one} {between} {one}", " ".join(other[:45]), " ".join(other[20:]), " ".join(other)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    cut = {r.doc_id: r.text.split() for r in passages.without_repeats(docs).collect()}
    assert cut[0] == f"{one} {between}".split() and cut[1] == other[:45] and cut[2] == other[20:] and cut[3] == []


def test_a_text_of_one_word(spark):
    """A stretch of one shingle has a bound, and the first paragraph of a text like this is kept."""
    docs = spark.createDataFrame([(1, "x " * 3000), (2, "x " * 500), (3, None), (None, "x " * 40)], "doc_id long, text string")
    cut = {r.doc_id: (r.text or "").split() for r in passages.without_repeats(docs).collect()}
    assert 1 <= len(cut[1]) <= 20 and cut[2] == [] and cut[3] == [] and cut[None] == []


def test_the_smallest_key_keeps_a_passage(spark):
    rng = random.Random(29)
    text = sentence(rng, 80)
    rows = [(k, text) for k in (7, None, 3, 9, 3)]
    for parts in (1, 4):
        cut = passages.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert sorted((str(r.doc_id), bool(r.text)) for r in cut) == [("3", False), ("3", True), ("7", False), ("9", False), ("None", False)]
