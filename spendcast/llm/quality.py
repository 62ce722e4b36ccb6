"""Quality rules whose thresholds keep a stated limit on wrongly rejected documents.

Each rule has a measure and cutoffs from lenient to strict; a document at or above the cutoff is rejected. The
labelled good documents of a stratum are a holdout: with k of n of them at or above a cutoff, the exact binomial
tail P(X <= k) for the permitted rate says how surely the true rate is below it. Cutoffs are tested from lenient to
strict and testing ends at the first failure, so all cutoffs of a rule together need one level; the level of all
rules and strata is shared out evenly among them. The rates of the rules add up to the rate permitted per stratum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendcast.llm.text import WHITE, WORD, whole, words
from spendcast.session import materialize

# The characters counted as symbols, and the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

# Measures are whole numbers (per mille, or tenths of a character), so cutoffs compare exactly. Lenient to strict.
RULES: dict[str, tuple[str, tuple[int, ...]]] = {
    "symbols": ("1000 * n_symbols div greatest(word_chars, 1)", (300, 200, 150, 100, 75, 50, 40, 30, 20, 15, 10)),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", (800, 600, 500, 400, 300, 250, 200, 150, 100, 50)),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", (450, 400, 350, 300, 250, 200, 150, 100, 50)),
    "long_words": ("10 * word_chars div greatest(n_words, 1)", (300, 200, 150, 130, 120, 110, 100, 90, 80)),
    "short_words": ("-(10 * word_chars div greatest(n_words, 1))", (-20, -25, -30, -35, -40, -45)),
}
MOST_FALSE_REJECTS = 0.02
LEVEL = 0.05


def base_measures(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``key``, ``keep`` and the counts of every whole text. A NULL text has no words.

    Words are counted in 3-word windows found twice or more. Windows are told apart by 64-bit hashes, which in one
    text of a million words agree by chance once in forty million texts; only a text with equal hashes is sorted.
    """
    split = docs.select(key, *keep, whole(text).alias("t")).select(
        key,
        *keep,
        words(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(WORD)).alias("lines"),
        F.length(F.regexp_replace("t", f"[{WHITE}]+", "")).alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", f"[{SYMBOLS}]+", ""))).alias("n_symbols"),
    )
    hashes = F.transform(
        F.slice("w", F.lit(1), F.size("w") - 2),
        lambda word, i: F.xxhash64(word, F.get("w", i + 1), F.get("w", i + 2)),
    )
    counts = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")
    # one projection after the other, so that what is used twice is computed once and word lists end early
    counted = split.select(
        key,
        *keep,
        F.size("w").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 3, hashes).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
    )
    columns = [key, *keep, *counts]
    repeating = counted.select(*columns, F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.col("hashes")).alias("hashes"))
    by_hash = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    in_order = repeating.select(*columns, by_hash.alias("o"))
    equal = F.zip_with("o", F.slice("o", F.lit(2), F.size("o") - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    places = in_order.select(*columns, F.flatten(F.array_compact(equal)).alias("p"))
    placed = places.select(*columns, F.sort_array(F.array_distinct("p")).alias("p"))
    # a word is in reach of the place before it, at most three words
    gaps = F.zip_with("p", F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    reach = F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)
    return placed.select(*columns, F.coalesce(reach, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def measure(rule: str, rules: Mapping = RULES) -> Column:
    return F.expr(rules[rule][0])


def permitted_count(n: Column, rate: float, level: Column) -> Column:
    """The largest k for which P(X <= k) <= level, X binomial of ``n`` trials at ``rate``; -1 if there is none.

    The tail is summed in logarithms, term by term from 0 up to the expected count, above which it exceeds any
    level below one half.
    """
    state = lambda term, tail, k: F.struct(term.alias("term"), tail.alias("tail"), k.alias("k"))
    nothing = state(F.lit(0.0), F.lit(float("-inf")), F.lit(-1).cast("long"))

    def add(s: Column, i: Column) -> Column:
        ratio = (n - i + 1).cast("double") / i.cast("double") * F.lit(rate / (1 - rate))
        term = F.when(i == 0, n * F.log(F.lit(1 - rate))).otherwise(s["term"] + F.log(ratio))
        tail = F.when(i == 0, term).otherwise(
            F.greatest(s["tail"], term) + F.log1p(F.exp(-F.abs(s["tail"] - term)))
        )
        return state(term, tail, F.when(tail <= F.log(level), i).otherwise(s["k"]))

    counts = F.sequence(F.lit(0).cast("long"), F.ceil(n * F.lit(rate)).cast("long"))
    return F.aggregate(counts, nothing, add)["k"]


def thresholds(
    holdout: DataFrame,
    stratum: str = "lang",
    rules: Mapping = RULES,
    most_false_rejects: float = MOST_FALSE_REJECTS,
    level: float = LEVEL,
) -> DataFrame:
    """One row per stratum: ``n_good`` and ``cut_<rule>``, NULL where no cutoff is proven.

    ``holdout`` holds the measures of labelled good documents.
    """
    counts = [
        F.count_if(measure(r, rules) >= cut).alias(f"{r}_{i}") for r, (_, cuts) in rules.items() for i, cut in enumerate(cuts)
    ]
    per_stratum = holdout.groupBy(stratum).agg(F.count(F.lit(1)).alias("n_good"), *counts)
    n_strata = F.count(F.lit(1)).over(Window.partitionBy())  # one row per stratum
    each = F.lit(level) / (F.col("n_strata") * len(rules))
    tested = per_stratum.withColumn("n_strata", n_strata).withColumn(
        "k", permitted_count(F.col("n_good"), most_false_rejects / len(rules), each)
    )
    # counts rise from lenient to strict, so the last cutoff within the count is where testing ends
    return tested.select(
        stratum,
        "n_good",
        *[
            F.coalesce(
                *[F.when(F.col(f"{r}_{i}") <= F.col("k"), F.lit(cuts[i])) for i in reversed(range(len(cuts)))]
            ).cast("long").alias(f"cut_{r}")
            for r, (_, cuts) in rules.items()
        ],
    )


def good_documents(labels: DataFrame, key: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Keys with a label, all of which say good. Labels without key or value say nothing."""
    return (
        labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull())
        .groupBy(key)
        .agg(F.min(quality).alias("worst"))
        .where("worst >= 1")
        .select(F.col(key).alias("_good"))
    )


def judge(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    rules: Mapping = RULES,
    most_false_rejects: float = MOST_FALSE_REJECTS,
    level: float = LEVEL,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``broken`` (names of the rules that reject it) and ``kept``.

    NULL and empty texts have no words and fail the base rules. A NULL stratum is a stratum. A stratum without
    labelled good documents, or with too few to prove any cutoff, rejects by the base rules alone. Repeated rows are
    judged alike; rows that share a key share its label. Empty tables give an empty result.
    """
    counted = materialize(base_measures(docs, key, text, [stratum, *keep]).withColumn("base_failed", base_failed()), "measures")
    holdout = counted.where(~F.col("base_failed")).join(good_documents(labels, key), F.col(key) == F.col("_good"), "left_semi")
    # written, so that its size is known: Spark then broadcasts it below its own threshold and shuffles it above
    cuts = materialize(thresholds(holdout, stratum, rules, most_false_rejects, level), "thresholds")
    cuts = cuts.withColumnRenamed(stratum, "_stratum")
    broken = F.array_compact(F.array(*[F.when(measure(r, rules) >= F.col(f"cut_{r}"), F.lit(r)) for r in rules]))
    return (
        counted.join(cuts, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
        .withColumn("broken", broken)
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
        .select(*counted.columns, "broken", "kept")
    )
