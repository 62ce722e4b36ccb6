"""What is written on the way to a result, and what is moved that nobody asks for."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers

from spendcast.llm import passages, token_files
from spendcast.llm.text import asked_for
from spendcast.session import freed, materialize, scratch_path, scratch_root
from tests.llm.conftest import prose


def tables(spark) -> set[str]:
    root = Path(scratch_root(spark).removeprefix("file:")) / f"spendcast-{spark.sparkContext.applicationId}"
    return {p.name.rpartition("-")[0] + p.name[-33:] for p in root.iterdir()} if root.exists() else set()


def test_tables_are_removed_once_used(spark):
    materialize(spark.range(1), "first")
    before = tables(spark)
    with freed(spark) as outer:
        with freed(spark) as inner:
            materialize(spark.range(2), "gone")
            kept = inner.keep(materialize(spark.range(3), "kept"))
        assert len(tables(spark) - before) == 1 and kept.count() == 3
        last = outer.keep(materialize(kept, "last"))
    assert len(tables(spark) - before) == 1 and last.count() == 3


def test_repeated_passages_leave_documents_and_cuts(spark):
    """Stretches, paragraphs, chains and clusters are gone when the texts are cut."""
    shared = prose(2, 60)
    docs = spark.createDataFrame([(i, f"{prose(10 + i, 30)} {shared}") for i in range(4)], "doc_id long, text string")
    before = tables(spark)
    cut = passages.without_repeats(docs)
    assert {t.rpartition("-")[0] for t in tables(spark) - before} == {"numbered", "cuts"}
    assert sum(shared in r.text for r in cut.collect()) == 1


def test_texts_that_nobody_asks_for_stay(spark):
    texts = spark.range(1000).selectExpr("id AS node", "repeat('x', 100) AS text")
    wanted = spark.createDataFrame([(5,), (700,), (5000,)], "node long")
    assert sorted(r.node for r in asked_for(texts, "node", wanted, "node").collect()) == [5, 700]


def test_ids_are_decoded_where_they_are_read(spark):
    path = scratch_path(spark, "token-files")
    docs = spark.createDataFrame([(i, prose(i, 40)) for i in range(9)], "doc_id long, text string")
    token_files.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    read = token_files.read_token_files(spark, path)
    plan = read._jdf.queryExecution().executedPlan().toString()
    # blocks meet their starts below the decoding; nothing is moved above it
    assert "Join" not in plan[: plan.index("MapInArrow")] and "Exchange" not in plan[: plan.index("MapInArrow")]
    starts = {r.doc_id: (r.start, r.n_tokens) for r in read.collect()}
    assert [starts[i][0] for i in range(9)] == [sum(starts[j][1] for j in range(i)) for i in range(9)]
