"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

DataFrame functions only. Each text is reduced to measures (one projection, no shuffle); each rule turns measures
into a vote for a good text (1), for a bad one (0) or an abstention (null). Rows are counted by vote pattern, at
most 3 ** rules of them, and expectation-maximisation over the counted patterns estimates how often each rule votes
rightly on good and on bad texts, and the share of good texts. An abstention says nothing about a text. The
posterior probability of a good text replaces an all-must-pass filter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightloom.llm.common import WORD_SEPARATORS, fresh, words_of, written

WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_distinct", "n_plain"]
#: A word of letters with one mark behind it at most.
PLAIN = r"(?<![^ \x09-\x0D])[\p{L}'’-]+[.,;:!?]?(?![^ \x09-\x0D])"


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns, with one more column `measures`, a struct of longs.

    n_words, word_chars: words and the code points in them. n_symbols: characters of `[#*$%&|<>]`. n_dup_lines:
    lines with a word that equal an earlier line. n_repeat_words: words inside 8-word windows that the text has
    twice or more. n_lines: lines with a word. n_capitals: A to Z. n_distinct: different words. n_plain: words of
    letters with one mark behind at most. A null or empty text measures 0 throughout; whole texts are measured,
    however long. A column `measures` is replaced.
    """
    w, h, g, s, p = (fresh(docs, f"_{x}") for x in ("words", "hashes", "grams", "sorted", "places"))
    filled = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn(w, words_of(F.col(text)))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    n = F.size(h)
    df = df.withColumn(g, F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    repeats = F.size(F.array_distinct(g)) < F.size(g)
    df = df.withColumn(s, F.when(repeats, F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda a, b: F.coalesce(F.get(F.col(s), a)["h"] == F.get(F.col(s), b)["h"], F.lit(False))
    df = df.withColumn(p, F.when(repeats, F.array_sort(F.transform(F.filter(F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), (same(k, k - 1) | same(k, k + 1)).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"]))))
    # Each place where a repeated window starts covers the words up to the next such place, eight at most.
    covered = F.when(repeats, F.aggregate(p, F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("sum")), lambda a, i: F.struct(i.alias("at"), (a["sum"] + F.lit(WINDOW) - F.greatest(F.lit(0), a["at"] + WINDOW - i)).alias("sum")), lambda a: a["sum"])).otherwise(0)
    lines = F.filter(F.split(filled, "\n"), lambda x: F.length(F.btrim(x, F.lit(WORD_SEPARATORS))) > 0)
    found = {
        "n_words": n,
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.length(filled) - F.length(F.regexp_replace(filled, r"[#*$%&|<>]+", "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": covered,
        "n_lines": F.size(lines),
        "n_capitals": F.length(filled) - F.length(F.regexp_replace(filled, r"[A-Z]+", "")),
        "n_distinct": F.size(F.array_distinct(h)),
        "n_plain": F.regexp_count(filled, F.lit(PLAIN)),
    }
    # As the one row of an array: else every later use of a measure would repeat its expression.
    once = F.explode(F.array(F.struct(*[v.cast("long").alias(k) for k, v in found.items()])))
    return df.select(*[c for c in docs.columns if c.lower() != "measures"], once.alias("measures"))


def rules(m: str = "measures") -> dict[str, Column]:
    """A vote for each rule: 1 good, 0 bad, null for an abstention. Thresholds are fixed values.

    Each defect is seen by two rules, one by its own sign and one by what it does to the words at large; a text
    without a word gets no vote but that of length.
    """
    x = {k: F.col(f"{m}.{k}") for k in MEASURES}
    words = F.greatest(x["n_words"], F.lit(1))

    def vote(value: Column, good: tuple[float, float], fair: tuple[float, float]) -> Column:
        """Good within `good`, bad outside of `fair`; ends are inside."""
        return F.when(x["n_words"] > 0, F.when((value >= good[0]) & (value <= good[1]), 1).when((value < fair[0]) | (value > fair[1]), 0))

    inf = float("inf")
    # The share of different words in ordinary prose falls with its length, and a bound on it does, too.
    varied = x["n_distinct"] / F.pow(words.cast("double"), F.lit(0.7))
    return {
        "length": F.when(x["n_words"] >= 50, 1).when(x["n_words"] < 20, 0),
        "word_length": vote(x["word_chars"] / words, (3, 9), (2, 14)),
        "symbols": vote(x["n_symbols"] / words, (0, 0.02), (0, 0.1)),
        "capitals": vote(x["n_capitals"] / F.greatest(x["word_chars"], F.lit(1)), (0, 0.15), (0, 0.4)),
        "plain": vote(x["n_plain"] / words, (0.9, inf), (0.7, inf)),
        "repetition": vote(F.greatest(x["n_dup_lines"] / F.greatest(x["n_lines"], F.lit(1)), x["n_repeat_words"] / words), (0, 0.1), (0, 0.3)),
        "variety": vote(varied, (1, inf), (0.7, inf)),
    }


Votes = tuple[int | None, ...]
#: For a rule, by class (0 bad, 1 good): the probability of a good vote where it votes.
Habits = dict[int, float]
#: Where the estimate starts: a bad text has a given defect less often than not, a good one hardly ever. The start weighs as so many texts.
START: Habits = {0: 0.7, 1: 0.98}
START_PRIOR, START_WEIGHT = 0.8, 10.0


def fitted(patterns: list[tuple[Votes, int]], rounds: int = 200) -> tuple[float, list[Habits]]:
    """Expectation-maximisation over counted vote patterns: the share of good texts, and each rule's habits.

    The start counts as START_WEIGHT texts, which also keeps every estimate off 0 and 1. No rows: the start. Ends
    when nothing moves by more than a millionth, or after `rounds`.
    """
    n_rules = len(patterns[0][0]) if patterns else 0
    prior, habits = START_PRIOR, [dict(START) for _ in range(n_rules)]
    for _ in range(rounds):
        classes = {1: START_PRIOR * START_WEIGHT, 0: (1 - START_PRIOR) * START_WEIGHT}
        cast = [{y: START_WEIGHT for y in (0, 1)} for _ in range(n_rules)]
        good = [{y: START_WEIGHT * START[y] for y in (0, 1)} for _ in range(n_rules)]
        for votes, n in patterns:
            p = 1 / (1 + math.exp(-log_odds(votes, prior, habits)))
            for y, share in ((1, n * p), (0, n * (1 - p))):
                classes[y] += share
                for k, v in enumerate(votes):
                    if v is not None:
                        cast[k][y] += share
                        good[k][y] += share * v
        before = [prior, *[h[y] for h in habits for y in (0, 1)]]
        prior = classes[1] / (classes[0] + classes[1])
        habits = [{y: g[y] / c[y] for y in (0, 1)} for g, c in zip(good, cast)]
        if max(abs(a - b) for a, b in zip(before, [prior, *[h[y] for h in habits for y in (0, 1)]])) < 1e-6:
            break
    return prior, habits


def weight(habits: Habits, v: int | None) -> float:
    """What a vote adds to the log odds of a good text."""
    if v is None:
        return 0.0
    return math.log(habits[1] / habits[0]) if v else math.log((1 - habits[1]) / (1 - habits[0]))


def log_odds(votes: Votes, prior: float, habits: list[Habits]) -> float:
    """Of a good text, within 500 of 0."""
    odds = math.log(prior / (1 - prior)) + sum(weight(h, v) for v, h in zip(votes, habits))
    return max(-500.0, min(500.0, odds))


def judged(docs: DataFrame, text: str = "text", carry: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """The columns in `carry` (default: all) of every row, with `measures`, `votes`, `base_failed`, `posterior`
    (probability of a good text) and `kept`.

    base_failed: under 20 words, or over 30 of 100 words in repeated windows. kept: not base_failed and a
    posterior of `threshold` or more. Null and empty texts fail the base; repeated rows get equal verdicts; an
    empty table stays empty. Input columns with the names of the new ones are replaced. The measured rows are written
    to the shared folder, so that texts are measured once for both the estimate and the verdict.
    """
    taken = {"measures", "votes", "base_failed", "posterior", "kept"}
    rows = measures(docs, text)
    keep = [c for c in (docs.columns if carry is None else carry) if c.lower() not in taken]
    voted = {f"v_{k}": v.cast("int").alias(k) for k, v in rules().items()}
    rows = written(rows.select(*keep, "measures", F.struct(*voted.values()).alias("votes")))
    counted = rows.groupBy("votes").count().collect()  # at most 3 ** rules rows
    patterns = sorted(((tuple(r["votes"]), r["count"]) for r in counted), key=str)
    prior, habits = fitted(patterns)
    odds = F.lit(math.log(prior / (1 - prior)))
    for h, name in zip(habits, rules()):
        v = F.col(f"votes.{name}")
        odds = odds + F.when(v == 1, weight(h, 1)).when(v == 0, weight(h, 0)).otherwise(0.0)
    m = F.col("measures")
    failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    rows = rows.withColumns({"base_failed": failed, "posterior": 1 / (1 + F.exp(-odds))})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document, by `judged`: a null or empty text measures 0 and fails the base, whole
    texts are measured however long, repeated rows get equal verdicts, an empty table stays empty. Other columns of
    the table don't matter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    m = F.col("measures")
    return judged(docs, carry=["doc_id"]).select("doc_id", *[m[k].alias(k) for k in MEASURES[:5]], "base_failed", "kept", "posterior")
