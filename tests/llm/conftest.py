from __future__ import annotations

import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, size long, target string, row int, node int, value int, key int, shard int, _cuts int"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


@pytest.fixture(scope="session")
def odd_rows():
    """NULLs, empty and long texts, copies, near copies, a shared passage, repeated rows, odd white space."""
    base, passage = prose(1, 120), prose(2, 60).capitalize() + "."
    near = base.split(" ")
    near[50] = "changed"
    texts = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, " ".join(near), "de", None),
        (4, None, "en", "b"),
        (5, "", None, "b"),
        (6, " \n\t ", "en", "c"),
        (7, "one two", "en", "c"),
        (8, "One  TWO", "en", "é"),
        (None, prose(3, 40), None, None),
        (9, prose(4, 30) + ". " + passage + " " + prose(5, 30), "en", "a"),
        (10, prose(6, 20) + ".\n" + passage + "\n" + prose(7, 50), "fr", "b"),
        (11, prose(8, 9000), "en", "a"),
        (12, "x" * 20000, "en", "a"),
        (13, "# | # | a b c a b c a b c a b c\na b\na b\n", "en", "a"),
        (13, "# | # | a b c a b c a b c a b c\na b\na b\n", "en", "a"),
        (14, "<|endoftext|> It's  übergroß\r\nÉcole 東京 \x1c x", "en", "a"),
    ]
    return [(i, t, lang, source, len(t) if t else None, 7, "t", 1, 2, 3, 4, 5, 6) for i, t, lang, source in texts]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, KIND).coalesce(2)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], KIND)
