"""Quality rules by weak supervision.

Each rule reads a few counts of a text and votes that it is good (1), bad (0)
or abstains (null).  The rules' accuracies are unknown; expectation-maximisation
estimates them, and the share of good documents, from how the votes of all
documents agree.  A document's verdict is its posterior probability of being good
under that model, not an all-must-pass filter.

Vote patterns are counted on the executors; there are at most 3 ** rules of
them, so the model is fitted on a table whose size does not grow with the
corpus, while every document is in the counts.  A weak prior names the classes:
without it "good" and "bad" could be swapped.

Defined cases: null and empty texts have no words, fail the base rule and are
not kept.  A corpus whose rules all abstain keeps its documents: the posterior
is the prior share.  Repeated rows vote like any rows; an empty table gives no
rows.  Columns of the input other than the text and the id pass unread.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import Store, words

SYMBOLS = "#*$%&|<>"
#: Function words of the corpus languages (en, de, fr, es); fixed values.
FUNCTION_WORDS = ("the", "of", "and", "to", "in", "is", "that", "der", "die", "das", "und", "ist", "nicht",
                  "le", "la", "les", "et", "de", "des", "est", "el", "los", "que", "es", "y", "en")
#: The model starts from, and is drawn to by PRIOR_DOCS imaginary documents of each class: the share of good documents,
#: and of a rule's votes on bad and on good documents the share that is right.  A rule looks for one fault, so it
#: finds few of the bad documents and wrongs few of the good ones.
PRIOR_GOOD, PRIOR_ACC, PRIOR_DOCS = 0.8, (0.3, 0.995), 50.0
EM_STEPS = 100
KEEP_FROM = 0.5


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts the rules read, each over the whole text, under names that start with ``q_``."""
    text = F.coalesce(docs[text_col], F.lit(""))
    has_word = lambda line: F.translate(line, " \t\x0b\f\r", "") != ""
    out = docs.withColumns({
        "q_w": words(docs[text_col]),
        "q_lines": F.filter(F.split(text, "\n"), has_word),
        "q_n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long"),
        "q_marks": F.regexp_count(text, F.lit("[#*$%&|<>]+")).cast("long"),
        "q_upper": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
    })
    lower = F.array(*[F.lit(w) for w in FUNCTION_WORDS])
    out = out.withColumns({
        "q_n_words": F.size("q_w").cast("long"),
        "q_word_chars": F.char_length(F.array_join("q_w", "")).cast("long"),
        "q_n_lines": F.size("q_lines").cast("long"),
        "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        "q_ended": F.size(F.filter("q_lines", lambda x: F.rtrim(x).rlike("[.!?:;\"']$"))).cast("long"),
        "q_function": F.size(F.array_intersect("q_w", lower)).cast("long"),
        "q_three": F.transform(
            F.slice("q_w", 1, F.greatest(F.size("q_w") - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get("q_w", i + 1), F.get("q_w", i + 2))),
    })
    # Sorted with their places, equal windows are neighbours.  Texts without equal windows skip the sort.
    twice = F.size(F.array_distinct("q_three")) < F.size("q_three")
    placed = F.sort_array(F.transform("q_three", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("q_placed", F.when(twice, placed))
    same = lambda x, other: F.coalesce(F.get("q_placed", other)["h"] == x["h"], F.lit(False))
    out = out.withColumn("q_at", F.sort_array(F.transform(
        F.filter("q_placed", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("q_at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("q_at", j + 1), p + 3) - p)),
        F.lit(0).cast("long"), lambda a, b: a + b)
    out = out.withColumn("q_n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    return out.drop("q_w", "q_lines", "q_three", "q_placed", "q_at")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1).cast("int")


def votes() -> dict[str, Column]:
    """The rules, over the columns of ``base_counts``."""
    n, lines = F.col("q_n_words"), F.col("q_n_lines")
    long_enough = n >= 50
    return {
        "length": _vote(n >= 80, n < 50),
        "repeats": _vote(F.col("q_n_repeat_words") * 10 <= n, F.col("q_n_repeat_words") * 10 > n * 3),
        "symbols": _vote(F.col("q_n_symbols") * 100 <= n, F.col("q_n_symbols") * 10 > n),
        "marks": _vote(F.col("q_marks") * 50 <= n, F.col("q_marks") * 5 > n),
        "lines": _vote((lines >= 2) & (F.col("q_n_dup_lines") == 0), F.col("q_n_dup_lines") * 10 > lines * 4),
        "word_length": _vote(F.lit(False), (F.col("q_word_chars") < n * 2) | (F.col("q_word_chars") > n * 14)),
        "capitals": _vote(F.col("q_upper") * 10 <= F.col("q_word_chars"),
                          F.col("q_upper") * 10 > F.col("q_word_chars") * 4),
        "function_words": _vote(long_enough & (F.col("q_function") >= 2), long_enough & (F.col("q_function") == 0)),
        "line_ends": _vote(F.col("q_ended") * 2 >= lines, (lines > 0) & (F.col("q_ended") * 10 < lines)),
    }


def fit(patterns: list[tuple[tuple[int | None, ...], int]], steps: int = EM_STEPS) -> tuple[float, list[list[float]]]:
    """The share of good documents, and each rule's accuracy on bad and on good ones, from counted vote patterns."""
    rules = len(patterns[0][0]) if patterns else 0
    share, acc = PRIOR_GOOD, [list(PRIOR_ACC) for _ in range(rules)]
    for _ in range(steps):
        right = [[a * PRIOR_DOCS for a in PRIOR_ACC] for _ in range(rules)]
        voted = [[PRIOR_DOCS] * 2 for _ in range(rules)]
        good = everything = 0.0
        for vote, n in patterns:
            p = posterior(vote, share, acc)
            good, everything = good + n * p, everything + n
            for j, v in enumerate(vote):
                if v is not None:
                    for c, q in ((0, 1 - p), (1, p)):
                        voted[j][c] += n * q
                        right[j][c] += n * q * (v == c)
        before = share, [list(a) for a in acc]
        share = (good + PRIOR_GOOD * PRIOR_DOCS) / (everything + PRIOR_DOCS)
        acc = [[r / v for r, v in zip(right[j], voted[j], strict=True)] for j in range(rules)]
        # What a vote means is given, only its weight is learned: a bad vote never speaks for a document.
        acc = [[min(0.9999, max(bad, 1 - good)), min(0.9999, max(good, 0.5))] for bad, good in acc]
        if abs(before[0] - share) + sum(abs(x - y) for a, b in zip(before[1], acc, strict=True)
                                        for x, y in zip(a, b, strict=True)) < 1e-10:
            break
    return share, acc


def _logs(v: int | None, acc: list[float]) -> float:
    """What a vote adds to the log odds of good."""
    if v is None:
        return 0.0
    return math.log(acc[1] / (1 - acc[0])) if v else math.log((1 - acc[1]) / acc[0])


def posterior(vote: tuple[int | None, ...], share: float, acc: list[list[float]]) -> float:
    odds = math.log(share / (1 - share)) + sum(_logs(v, a) for v, a in zip(vote, acc, strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id with its counts, votes, base_failed, quality (posterior) and kept."""
    store = Store(docs.sparkSession, "quality-rules")
    rules = votes()
    counted = base_counts(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("q_text")), "q_text")
    counted = store.keep(counted.drop("q_text").withColumns({f"v_{k}": v for k, v in rules.items()}), "votes")
    return counted.transform(_verdicts)


def _verdicts(counted: DataFrame) -> DataFrame:
    """counted (``base_counts`` and the votes as v_ columns) with base_failed, quality and kept."""
    names = [f"v_{k}" for k in votes()]
    seen = sorted((tuple(r[:-1]), r[-1]) for r in
                  counted.groupBy(*[F.coalesce(n, F.lit(-1)).alias(n) for n in names]).count().collect())
    share, acc = fit([(tuple(None if v < 0 else v for v in p), n) for p, n in seen])
    odds = F.lit(math.log(share / (1 - share)))
    for n, a in zip(names, acc or [list(PRIOR_ACC)] * len(names), strict=True):
        odds = odds + F.when(F.col(n) == 1, _logs(1, a)).when(F.col(n) == 0, _logs(0, a)).otherwise(0.0)
    failed = (F.col("q_n_words") < 50) | (F.col("q_n_repeat_words") * 100 > F.col("q_n_words") * 50)
    quality = 1 / (1 + F.exp(-odds))
    return (counted.withColumn("base_failed", failed).withColumn("quality", quality)
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM)))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their own columns.

    The rules read each row; the verdict stays beside it, so rows without an id or with
    a repeated one are judged by their own text.
    """
    store = Store(docs.sparkSession, "quality-filter")
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("q_row"), docs[text_col].alias("q_text"))
    counted = base_counts(inner, "q_text").drop("q_text").withColumns({f"v_{k}": v for k, v in votes().items()})
    return _verdicts(store.keep(counted, "votes")).filter("kept").select("q_row.*")


def op4_weak_supervision(docs: DataFrame) -> DataFrame:
    """The digest of ``judged``."""
    return judged(docs).select("doc_id", F.col("q_n_words").alias("n_words"), F.col("q_word_chars").alias("word_chars"),
                               F.col("q_n_symbols").alias("n_symbols"), F.col("q_n_dup_lines").alias("n_dup_lines"),
                               F.col("q_n_repeat_words").alias("n_repeat_words"), "base_failed", "kept",
                               F.round("quality", 9).alias("quality"))
