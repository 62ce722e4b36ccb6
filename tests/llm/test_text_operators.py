"""Quality rules, mixing and sharding on odd rows; their results on whole tables are held against SQL elsewhere."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pytest

import __spark_entry__ as entry_point
from checks.compare import connect, difference
from spendcast.llm import mixing, quality, sharding
from spendcast.llm.queries import oracle_sql
from tests.conftest import SMALL

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    result = entry_point.queries()[name](spark, SMALL).toPandas()
    assert difference(result, connect(SMALL).execute(oracle_sql()[name]).df()) is None


def measures(text):
    words = WORD.findall(text or "")
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated)


def test_measures(odd, odd_rows):
    found = quality.base_measures(odd).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r.doc_id, *[r[c] for c in columns]) for r in found) == Counter((i, *measures(t)) for i, t, *_ in odd_rows)


def test_permitted_count(spark):
    from math import comb

    from pyspark.sql import functions as F

    rate, level = 0.01, 0.003
    rows = spark.range(0, 3000, 37).select("id", quality.permitted_count(F.col("id"), rate, F.lit(level)).alias("k")).collect()
    for n, k in rows:
        tail, exact = 0.0, -1
        for i in range(n + 1):
            tail += comb(n, i) * rate**i * (1 - rate) ** (n - i)
            if tail > level:
                break
            exact = i
        assert k == exact


def test_cutoffs_limit_false_rejects(spark):
    """With enough labelled good documents a cutoff is proven; the rate above it stays below what is permitted."""
    good = [(i, "en", 100, 500, 100 if i % 1000 == 0 else 0, 10, 0, 0) for i in range(4000)]
    few = [(i, "de", 100, 500, 0, 10, 0, 0) for i in range(50)]
    columns = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
    cuts = {r.lang: r for r in quality.thresholds(spark.createDataFrame(good + few, columns)).collect()}
    assert cuts["en"].cut_symbols == 10 and cuts["en"].cut_repeats == 50
    assert cuts["en"].cut_short_words == -45 and cuts["de"].cut_symbols is None


def test_quality_edges(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    judged = quality.judge(odd, labels)
    assert judged.count() == odd.count() and not judged.where("n_words = 0 AND kept").count()
    assert quality.judge(nothing, labels.limit(0)).count() == 0


def test_mixing(odd, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in rows)
    # by hand: filling repeated until no source is above its limit
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        for s in full or set(open_):
            target[s] = 2.0 * sizes[s] if full else weight[s] * level
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ -= full
    assert all(r.target == pytest.approx(target[r.source]) for r in rows)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).columns == nothing.columns


def test_mixed_documents_repeat_rows(odd):
    copies = Counter()
    for r in mixing.mix(odd).collect():
        copies[r.doc_id] += r.copies
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +copies


def test_sharding(spark, odd, odd_rows, nothing):
    rows = sharding.shard_documents(odd).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows
    )
    slots = {}
    for r in rows:
        assert r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(nothing).count() == 0


def test_weighted_shards_take_their_share(spark):
    from pyspark.sql import functions as F

    weights = [1.0, 2.0, 5.0]
    found = spark.range(20000).groupBy(sharding.rendezvous(F.col("id"), weights).alias("s")).count().collect()
    for r in found:
        assert r["count"] == pytest.approx(20000 * weights[r.s] / 8, rel=0.06)
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), [1.0, 0.0])


def test_row_numbers_do_not_follow_the_cores(spark, tmp_path):
    """Executors may come and go between two readings, which cuts the same files into other tasks."""
    from spendcast.llm.text import ROW_TAG, steadily_tagged

    spark.range(2000).repartition(6).write.parquet(str(tmp_path / "docs"))
    numbered, setting, seen = steadily_tagged(spark.read.parquet(str(tmp_path / "docs"))), "spark.sql.leafNodeDefaultParallelism", []
    try:
        for cores in (3, 2):
            spark.conf.set(setting, cores)
            seen.append({r.id: r[ROW_TAG] for r in numbered.select("id", ROW_TAG).collect()})
    finally:
        spark.conf.unset(setting)
    assert seen[0] == seen[1] and len(set(seen[0].values())) == 2000
