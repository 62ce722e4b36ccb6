"""Lexical search, collocations and decontamination against brute force, on odd rows and small parameters."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from spendcast.llm import decontaminate, lexical, phrases
from tests.llm.conftest import prose

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


# ---- search


def brute_search(rows, items, top):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(x for *_, x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = Counter()
    for name, text in items:
        scores = []
        for i, c, length in docs:
            m = 10 + 90 * length * n // total
            wanted = [t for t in set(terms(text)) if t in c]
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted
            )
            if score:
                scores.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:top], 1):
            out[name, rank, i, -score] += 1
    return out


def search_rows():
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.5)) % 400}" for _ in range(5000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 30, 30, 80, 700])))) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(2**53 + 1, rows[7][1]), (None, rows[7][1]), (5, rows[5][1])]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 25])))) for i in range(20)]
    items += [(50, rows[7][1]), (50, rows[9][1]), (None, "w1 W1 w2"), (60, None), (61, " .,"), (62, "unseen")]
    return rows, items


@pytest.mark.parametrize("top,pilots,at_once", [(10, 256, 1024), (3, 1, 5)])
def test_search_equals_brute_force(spark, monkeypatch, top, pilots, at_once):
    monkeypatch.setattr(lexical, "PILOTS", pilots)
    monkeypatch.setattr(lexical, "ITEMS_AT_ONCE", at_once)
    rows, items = search_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = lexical.ranked_documents(docs, spark.createDataFrame(items, "item_id long, text string"), top=top)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in found.collect()) == brute_search(rows, items, top)


def test_bounds_are_never_below_scores(spark):
    rows, items = search_rows()
    index = lexical.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    df = {r["hash"]: r["df"] for r in index.vocabulary.collect()}
    known = lexical.WordHashes()
    wanted = [np.unique(lexical.hashed([t.encode() for t in terms(text)], known)).view(np.int64) for _, text in items]
    wanted = [[(h, df[h]) for h in w.tolist() if h in df] for w in wanted]
    wanted = [w for w in wanted if w]
    some = lexical.Items(list(range(len(wanted))), wanted, index)
    tight = []
    for row in index.blocks.collect():
        block = lexical.Block(row.asDict(), some)
        places = [lexical.bit_places(some.hashes, level, block.log_bits) for level in range(len(lexical.LEVELS))]
        bounds, exact = block.bounds(places), block.scores(np.arange(block.n)).T
        assert (bounds >= exact).all()
        tight += (exact[bounds > 0] / bounds[bounds > 0]).tolist()
    assert np.mean(tight) > 0.7


def test_search_edges(odd, odd_rows, nothing):
    items = odd.where("doc_id < 12")
    found = lexical.ranked_documents(odd, items, item="doc_id").toDF("item", "rank", "doc", "score")
    pairs = [(i, t) for i, t, *_ in odd_rows]
    expected = brute_search(pairs, [p for p in pairs if p[0] is not None and p[0] < 12], 10)
    assert Counter(tuple(r) for r in found.collect()) == expected
    assert lexical.ranked_documents(nothing, items, item="doc_id").count() == 0
    assert lexical.ranked_documents(odd, nothing, item="doc_id").count() == 0


# ---- collocations


def brute_phrases(rows, least, first):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for i in range(len(words)) for k in range(1, min(5, len(words) - i) + 1))
    frequent = {k: a for k, a in counts.items() if a >= least}
    longer = Counter()
    for (lang, p), a in frequent.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    longer[lang, p[i:j]] = max(longer[lang, p[i:j]], a)
    out, by_lang = set(), {}
    for (lang, p), a in frequent.items():
        if len(p) > 1 and longer[lang, p] < a:
            cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    for lang, found in by_lang.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:first], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def phrase_rows():
    rng = random.Random(9)
    vocabulary = [f"W{int(rng.paretovariate(0.6)) % 60}é" for _ in range(3000)]
    rows = [(" ".join(w + rng.choice(["", "", "", "", ".", ",\n"]) for w in rng.choices(vocabulary, k=60)), rng.choice(["en", "de", None])) for _ in range(200)]
    fixed = "by and large a hot topic"
    return rows + [(fixed, "en")] * 150 + [("a a a a a a a a", "en")] * 9 + [(None, "en"), ("", None), ("?!", "xx")]


@pytest.mark.parametrize("group_most,group_least", [(1 << 22, 1 << 16), (300, 20), (15, 1)])
def test_phrases_equal_brute_force(spark, group_most, group_least):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    found = phrases.collocations(docs, least=12, first=60, group_most=group_most, group_least=group_least)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in found.collect()} == brute_phrases(rows, 12, 60)


def test_phrase_edges(spark, odd, odd_rows, nothing):
    rows = [(t, lang) for _, t, lang, *_ in odd_rows]
    assert {tuple(r) for r in phrases.collocations(odd, least=2).collect()} == brute_phrases(rows, 2, 2000)
    assert phrases.collocations(nothing).count() == 0
    # products of more than 64 bits
    big = spark.range(1).selectExpr("CAST(1000 AS DECIMAL(4,0)) * CAST(900000000000 AS DECIMAL(18,0)) * CAST(900000000000000 AS DECIMAL(15,0)) AS top")
    assert big.selectExpr("CAST(top div (CAST(1e12 AS DECIMAL(18,0)) * CAST(1e12 AS DECIMAL(18,0))) AS BIGINT)").first()[0] == 810000


# ---- decontamination


def brute_hits(rows, items, window=10):
    wins = {}
    for name, text in items:
        words = terms(text)
        length = min(window, len(words))
        for i in range(len(words) - length + 1 if words else 0):
            wins.setdefault(tuple(words[i : i + length]), set()).add(name)
    lengths, out = {len(w) for w in wins}, []
    for i, text in rows:
        words, hit, names = terms(text), set(), set()
        for length in lengths:
            for at in range(len(words) - length + 1):
                found = wins.get(tuple(words[at : at + length]))
                if found is not None:
                    hit.update(range(at, at + length))
                    names |= found
        out.append((i, len(words), hit, sorted(str(n) for n in names if n is not None)))
    return out


def benchmark_rows():
    items = [(i, prose(100 + i, n)) for i, n in enumerate([40, 25, 10, 9, 3, 12, 30])]
    items += [(70, items[0][1]), (71, None), (72, " . "), (None, prose(300, 15)), (0, prose(301, 14))]
    w = [t.split(" ") for _, t in items if t]
    rows = [(i, prose(400 + i, 60)) for i in range(20)]
    rows += [(30, "x " + items[0][1].upper() + " y"), (31, " ".join(w[0][5:20]) + "! " + prose(450, 30) + " ".join(w[1][:9]))]
    rows += [(32, "-".join(w[4])), (33, " ".join(w[6][:12] + ["odd"] + w[6][12:])), (34, prose(300, 15)), (34, prose(300, 15))]
    rows += [(35, None), (36, ""), (2**53 + 1, " ".join(w[2] + w[2] + w[5])), (None, items[3][1]), (37, "É東 " + items[6][1] + " 東É")]
    return rows, items


@pytest.mark.parametrize("at_once", [1 << 20, 30])
def test_contamination_equals_brute_force(spark, monkeypatch, at_once):
    rows, items = benchmark_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = Counter()
    for i, n, hit, names in brute_hits(rows, items):
        expected[i, n, len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)] += 1
    found = decontaminate.contamination(docs, bench, at_once=at_once)
    assert Counter(tuple(r) for r in found.collect()) == expected
    kept = decontaminate.decontaminated(docs, bench, "documents", at_once=at_once).collect()
    assert Counter(map(tuple, kept)) == Counter(r for r, x in zip(rows, brute_hits(rows, items), strict=True) if not x[2])
    cut = decontaminate.decontaminated(docs, bench, at_once=at_once).collect()
    left = Counter((r.doc_id, tuple(terms(r.text))) for r in cut)
    assert left == Counter((i, tuple(w for k, w in enumerate(terms(t)) if k not in x[2])) for (i, t), x in zip(rows, brute_hits(rows, items), strict=True))
    assert {r.text for r in cut if r.doc_id == 35} == {None}
    assert {r.text for r in cut if r.doc_id == 37} == {"É東 . 東É" if items[6][1].endswith(".") else "É東  東É"}


def test_long_items_are_read_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_WORDS", 7)
    rows, items = benchmark_rows()
    found = decontaminate.find_benchmark(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]
    ).collect()
    got = Counter((r.doc_id, tuple(x for a, b in zip(r["first"], r["last"], strict=True) for x in range(a, b)), tuple(r["items"])) for r in found)
    assert got == Counter((i, tuple(sorted(hit)), tuple(names)) for i, _, hit, names in brute_hits(rows, items))


def test_decontamination_edges(spark, odd, odd_rows, nothing):
    bench = odd.where("doc_id IN (1, 5, 7)").withColumnRenamed("doc_id", "item_id")
    for remove in ("spans", "documents"):
        assert decontaminate.decontaminated(odd, nothing, remove, item="doc_id").count() == len(odd_rows)
        cleaned = decontaminate.decontaminated(odd, bench, remove)
        assert cleaned.columns == odd.columns and cleaned.dtypes == odd.dtypes
        assert decontaminate.decontaminated(nothing, bench, remove).count() == 0
    clash = spark.createDataFrame([(2**60 + 1, "one two", 1, 2)], "`a.b` long, text string, `_cut` int, _n_hit int")
    assert decontaminate.decontaminated(clash, bench).collect()[0][:] == (2**60 + 1, "", 1, 2)
    with pytest.raises(ValueError):
        decontaminate.decontaminated(odd, bench, "words")


def test_suffixes_are_cut_in_parts():
    """A batch of a thousand texts was cut at once, with 64 bytes and a dozen numbers for each of its words."""
    texts, langs = [b"a b", b"c d.", b"", b"e f", b"g"], ["x", "x", "y", "x", "x"]
    assert list(phrases.by_language(texts, langs)) == [("x", b"a b ! c d ! ! e f ! g".split()), ("y", [])]
    parts = list(phrases.by_language(texts, langs, 4))
    assert len(parts) > 2 and [w for lang, words in parts if lang == "x" for w in words if w != b"!"] == b"a b c d e f g".split()
    assert list(phrases.by_language([], [])) == []
