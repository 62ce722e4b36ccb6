"""Near duplicates, repeated passages and near vectors against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from spendcast.llm import near_dedup, passages, vectors
from spendcast.llm.components import components
from spendcast.llm.text import all_but, asked_for
from tests.llm.conftest import prose

WORD = re.compile("[^\x20\x09-\x0d]+")


def roots_of(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(200)] + [(rng.randint(300, 900), rng.randint(300, 900)) for _ in range(350)]
    links += [(1000, i) for i in range(1001, 1100)] + [(5, 5), (None, 3), (2000, None)]
    found = components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    good = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    expected = roots_of(good, {x for p in good for x in p})
    assert {r.node: r.root for r in found} == expected and len(found) == len(expected)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, n=3):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def expected_components(rows, percent=85, n=3):
    sets = [shingles(t, n) for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    links = [
        (order.index(i), order.index(j))
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    roots = roots_of(links, range(len(rows)))
    return Counter((rows[i][0], len(sets[i]), rows[order[roots[order.index(i)]]][0]) for i in range(len(rows)))


def copies(seed, changes):
    """A text and copies, each with some words of its own."""
    rng, words = random.Random(seed), prose(seed, 150).split(" ")
    out = [" ".join(words)]
    for k, n in enumerate(changes):
        own = list(words)
        for at in rng.sample(range(len(own)), n):
            own[at] = f"own{k}x{at}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("crowded", [False, True])
def test_near_duplicates(spark, odd_rows, crowded, monkeypatch):
    if crowded:  # short lists, so that groups go through hubs and blocks
        monkeypatch.setattr(near_dedup, "LONGEST_LIST", 3)
        monkeypatch.setattr(near_dedup, "BLOCK", 4000)
    rows = [(i, t) for i, t, *_ in odd_rows if i is not None]
    texts = copies(31, [n for n in range(1, 13) for _ in range(4)]) + copies(32, [1, 2, 3]) + [prose(40 + i, 60) for i in range(20)]
    rows += [(100 + i, t) for i, t in enumerate(texts)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == expected_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_edges(odd, nothing):
    assert near_dedup.near_duplicates(odd).count() == odd.count()
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 200)).astype(np.int64)) for _ in range(20)]
    exact = [[len(np.intersect1d(a, b)) for b in sets[:7]] for a in sets]
    assert near_dedup.shared_counts(sets, sets[:7], columns=50).tolist() == exact


def test_passages(odd, odd_rows, nothing):
    found = passages.repeated_passages(odd).collect()
    texts = {i: t for i, t, *_ in odd_rows}
    spans = {(r.doc_id, r.removed): " ".join(WORD.findall(texts[r.doc_id])[r.first_word : r.last_word]) for r in found}
    passage = prose(2, 60).capitalize() + "."
    assert passage in spans[9, False] and passage in spans[10, True]
    assert (2, True) in spans and {i for i, _ in spans} <= {1, 2, 3, 9, 10}
    assert passages.repeated_passages(nothing).count() == 0


def test_passages_are_cut_out(odd, nothing):
    cut = passages.without_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    passage = prose(2, 60).capitalize() + "."
    assert sum(passage in (r.text or "") for r in cut.collect()) == 1
    before = {r.doc_id: r.text for r in odd.collect()}
    after = {r.doc_id: r.text for r in cut.collect()}
    assert all(after[i] == before[i] for i in (1, 4, 5, 6, 7, 8, 11, 12, 13, 14))
    assert after[10].startswith(prose(6, 20)) and after[10].endswith(prose(7, 50))
    assert len(WORD.findall(after[10])) == 20 + 50
    assert passages.without_repeats(nothing).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    many = [base[i % 40] + rng.normal(size=16) * s for i, s in enumerate(rng.uniform(0, 0.5, 200))]
    rows = [(i, v.tolist()) for i, v in enumerate(many)] + [(300, many[0].tolist()), (301, (many[0] * 3).tolist())]
    bad = [None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] * 16, [1.0] * 4]
    rows += [(400 + i, v) for i, v in enumerate(bad)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = {r.vec_id: r for r in vectors.near_vectors(table, block=32).collect()}
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows[:202]}
    links = [(i, j) for i in good for j in good if i < j and good[i] @ good[j] >= 0.95]
    counts = Counter(x for p in links for x in p)
    roots = roots_of(links, [i for i, _ in rows])
    assert len(found) == len(rows)
    assert all((r.n_links, r.component_id, r.kept) == (counts[i], roots[i], roots[i] == i) for i, r in found.items())
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_rows_of_other_tasks_are_not_asked_for(spark):
    """Row numbers of all tasks end alike; rows of one task asked for those of every other task as well."""
    rows = spark.range(2000).selectExpr("shiftleft(id % 20, 33) + id div 20 AS n", "id AS x")
    wanted = rows.where("n < 100").select("n")
    assert 100 <= asked_for(rows, "n", wanted, "n").count() < 300
    assert asked_for(rows, "n", wanted, "n").join(wanted, "n").count() == 100
    left = all_but(rows, wanted, "n").collect()
    assert sorted(r.x for r in left) == [x for x in range(2000) if x % 20]
    assert all_but(rows, rows.where("false").select("n"), "n").count() == 2000


def test_sketches_of_first_rows_only(spark):
    texts = [prose(s % 7, 60) for s in range(40)]
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    found = near_dedup.NearCopies(docs, "doc_id", "text", 85, 3)
    nodes = sorted(r.node for r in found.sketches.collect())
    assert len(nodes) == 7 and nodes == sorted(r.node for r in found.classes.collect())
