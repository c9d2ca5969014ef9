"""Quality rules by weak supervision, in DataFrame expressions only.

Every rule votes for keeping a text (1), against it (-1) or abstains (0). None of them is sure: clean texts break some, and each
kind of junk passes some. The corpus is counted by pattern of votes (at most 3 ** len(RULES) patterns), expectation-maximisation
over these counts estimates the share of good texts and how often each rule is right on good and on bad ones, and a text
is kept if the posterior probability of being good is a half or more. So rules that are often wrong are outvoted by rules that
hardly ever are, and a text without any vote against it can still go where most texts like it are bad. A text that fails a
base rule goes in any case.

Defined results: a null or empty text has no words and fails the base rule; repeated rows get the same verdict; an
empty table gives an empty one. All that is new is in one struct column, which replaces a column of that name;
working columns start with two underscores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, materialise

#: Rounds of expectation-maximisation, and pseudo-counts (of WEIGHT texts) that keep the rates of a small corpus near where they
#: start: the share of good texts, how often a vote on a good text is for it, and how often one on a bad text is against it.
ROUNDS, WEIGHT, GOOD, YES, NO = 40, 20.0, 0.8, 0.9, 0.6
SPACE = r"[\x20\x09-\x0D]"
#: Where a word begins and where it ends.
HERE, THERE = r"(?<![^\x20\x09-\x0D])", r"(?![^\x20\x09-\x0D])"
#: Words that hold sentences together, in English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in is that was for it with as on at by this are or from be have not "
    "der die das und den von zu mit ist ein eine nicht im für auf "
    "de la le et les des un une que est du pour qui dans en "
    "el los las por con del se al"
).split()
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_function_words", "n_plain_words", "n_ends")


def _graded(value: Column, good: Column, bad: Column) -> Column:
    """A vote on a share: for up to good, against from bad on, else none."""
    return F.when(value <= good, 1).when(value >= bad, -1).otherwise(0)


#: By name, the vote of each rule on the counts of a text.
RULES = {
    "length": lambda q: F.when(q.n_words < 80, -1).when(q.n_words >= 160, 1).otherwise(0),
    "repeats": lambda q: _graded(q.n_repeat_words, 0.02 * q.n_words, 0.1 * q.n_words),
    "symbols": lambda q: _graded(q.n_symbols, 0.02 * q.n_words, 0.1 * q.n_words),
    "lines": lambda q: _graded(q.n_dup_lines, 0 * q.n_lines, 0.1 * q.n_lines),
    "capitals": lambda q: _graded(q.n_upper, 0.1 * q.word_chars, 0.3 * q.word_chars),
    "marks": lambda q: _graded(q.n_marks, 0.02 * q.n_words, 0.1 * q.n_words),
    "word_length": lambda q: F.when((q.word_chars < 4 * q.n_words) | (q.word_chars > 7 * q.n_words), -1).when((q.word_chars >= 4.5 * q.n_words) & (q.word_chars <= 6 * q.n_words), 1).otherwise(0),
    "function_words": lambda q: F.when(q.n_function_words < 0.08 * q.n_words, -1).when(q.n_function_words >= 0.16 * q.n_words, 1).otherwise(0),
    "plain_words": lambda q: F.when(q.n_plain_words < 0.7 * q.n_words, -1).when(q.n_plain_words >= 0.95 * q.n_words, 1).otherwise(0),
    "sentences": lambda q: F.when(q.n_ends < 0.03 * q.n_words, -1).when(q.n_ends >= 0.06 * q.n_words, 1).otherwise(0),
}


def features(docs: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """Adds the struct of counts NAMES. Words are runs of anything but ASCII white space; n_repeat_words counts the
    words in windows of three that the text has twice or more, by a 64-bit hash of the window."""
    t = F.coalesce(F.col(text), F.lit(""))
    col = F.col
    df = docs.withColumn("__words", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    df = df.withColumn("__n", F.size("__words"))
    three = F.transform("__words", lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2)))
    df = df.withColumn("__three", F.when(col("__n") >= 3, F.slice(three, F.lit(1), F.greatest(col("__n") - 2, F.lit(0)))).otherwise(F.array().cast("array<bigint>")))
    placed = F.array_sort(F.transform("__three", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__placed", F.when(F.size(F.array_distinct("__three")) < F.size("__three"), placed))
    twice = F.filter("__placed", lambda x, j: (x.h == F.get("__placed", j - 1).h) | (x.h == F.get("__placed", j + 1).h))
    starts = F.sort_array(F.transform(twice, lambda x: x.i))
    # a window adds the words that the one before has not covered
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a.n + F.least(F.lit(3), i - a.last)).alias("n"), i.alias("last")),
        lambda a: a.n,
    )
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    df = df.withColumn("__lines", lines)
    counts = {
        "n_words": col("__n"),
        "word_chars": F.length(t) - F.regexp_count(t, F.lit(SPACE)),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size("__lines"),
        "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
        "n_marks": F.regexp_count(t, F.lit("!!+")),
        "n_function_words": F.regexp_count(t, F.lit(f"{HERE}(?:{'|'.join(FUNCTION_WORDS)})[.,;:]?{THERE}")),
        "n_plain_words": F.regexp_count(t, F.lit(rf"{HERE}\p{{L}}++[.,;:]?{THERE}")),
        "n_ends": F.regexp_count(t, F.lit(f"[.?!]{THERE}")),
    }
    return df.withColumn(out, F.struct(*(counts[n].cast("long").alias(n) for n in NAMES))).drop("__words", "__n", "__three", "__placed", "__lines")


def _fit(patterns: Column) -> Column:
    """Expectation-maximisation over an array of (votes, n): a struct of pi, and by rule yes (a vote for a good text) and no (a vote against a bad one)."""
    rules = len(RULES)

    def step(state: Column, _: Column) -> Column:
        def rate(done: Column, r: int, vote: int, start: float, weight) -> Column:
            hit = F.aggregate(done, F.lit(0.0), lambda s, x: s + F.when(x.votes[r] == vote, weight(x)).otherwise(0.0))
            cast = F.aggregate(done, F.lit(0.0), lambda s, x: s + F.when(x.votes[r] != 0, weight(x)).otherwise(0.0))
            return (hit + WEIGHT * start) / (cast + WEIGHT)

        def again(done: Column) -> Column:
            good = F.aggregate(done, F.lit(0.0), lambda s, x: s + x.n * x.p)
            total = F.aggregate(done, F.lit(0.0), lambda s, x: s + x.n)
            return F.struct(
                ((good + WEIGHT * GOOD) / (total + WEIGHT)).alias("pi"),
                F.array(*(rate(done, r, 1, YES, lambda x: x.n * x.p) for r in range(rules))).alias("yes"),
                F.array(*(rate(done, r, -1, NO, lambda x: x.n * (1 - x.p)) for r in range(rules))).alias("no"),
            )

        return let(F.transform(patterns, lambda x: F.struct(x.votes.alias("votes"), x.n.alias("n"), _posterior(x.votes, state).alias("p"))), again)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(F.lit(GOOD).alias("pi"), F.array_repeat(F.lit(YES), rules).alias("yes"), F.array_repeat(F.lit(NO), rules).alias("no")), step)


def _posterior(votes: Column, fitted: Column) -> Column:
    rules = range(len(RULES))
    times = lambda cols: reduce(lambda a, b: a * b, cols)
    good = fitted.pi * times(F.when(votes[r] == 1, fitted.yes[r]).when(votes[r] == -1, 1 - fitted.yes[r]).otherwise(1.0) for r in rules)
    bad = (1 - fitted.pi) * times(F.when(votes[r] == -1, fitted.no[r]).when(votes[r] == 1, 1 - fitted.no[r]).otherwise(1.0) for r in rules)
    return good / (good + bad)


def judge(featured: DataFrame, out: str = "quality") -> DataFrame:
    """Adds to the struct: votes, base_failed, posterior and kept. The rows are written once in the shared folder, as the
    fit and the verdict both read them; the fit itself is one row."""
    q = F.col(out)
    voted = materialise(featured.withColumn(out, q.withField("votes", F.array(*(f(q) for f in RULES.values())))))
    counted = voted.groupBy(F.col(f"{out}.votes").alias("votes")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    gathered = counted.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    fitted = gathered.select("patterns", _fit(F.col("patterns")).alias("fit"))
    verdicts = fitted.select("fit", F.explode("patterns").alias("p")).select(F.col("p.votes").alias("__votes"), _posterior(F.col("p.votes"), F.col("fit")).alias("__posterior"))
    # at most 3 ** len(RULES) rows, whatever the size of the corpus
    joined = voted.join(F.broadcast(verdicts), F.col(f"{out}.votes") == F.col("__votes"), "left")
    failed = (q.n_words < 50) | (100 * q.n_repeat_words > 50 * q.n_words)
    kept = ~failed & (F.col("__posterior") >= 0.5)
    return joined.withColumn(out, q.withField("base_failed", failed).withField("posterior", F.col("__posterior")).withField("kept", kept)).drop("__votes", "__posterior")


def digest(docs: DataFrame) -> DataFrame:
    judged = judge(features(docs.select("doc_id", "text")).drop("text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *(F.col(f"quality.{n}").alias(n) for n in names))


def _sql() -> str:
    """The digest in DuckDB's SQL; the rounds are a recursive query with one row of rates each."""
    rules = range(1, len(RULES) + 1)
    graded = lambda v, good, bad: f"CASE WHEN {v} <= {good} THEN 1 WHEN {v} >= {bad} THEN -1 ELSE 0 END"
    votes = (
        "CASE WHEN n_words < 80 THEN -1 WHEN n_words >= 160 THEN 1 ELSE 0 END",
        graded("n_repeat_words", "0.02 * n_words", "0.1 * n_words"),
        graded("n_symbols", "0.02 * n_words", "0.1 * n_words"),
        graded("n_dup_lines", "0", "0.1 * n_lines"),
        graded("n_upper", "0.1 * word_chars", "0.3 * word_chars"),
        graded("n_marks", "0.02 * n_words", "0.1 * n_words"),
        "CASE WHEN word_chars < 4 * n_words OR word_chars > 7 * n_words THEN -1 WHEN word_chars >= 4.5 * n_words AND word_chars <= 6 * n_words THEN 1 ELSE 0 END",
        "CASE WHEN n_function_words < 0.08 * n_words THEN -1 WHEN n_function_words >= 0.16 * n_words THEN 1 ELSE 0 END",
        "CASE WHEN n_plain_words < 0.7 * n_words THEN -1 WHEN n_plain_words >= 0.95 * n_words THEN 1 ELSE 0 END",
        "CASE WHEN n_ends < 0.03 * n_words THEN -1 WHEN n_ends >= 0.06 * n_words THEN 1 ELSE 0 END",
    )
    good = " * ".join(f"CASE votes[{r}] WHEN 1 THEN yes[{r}] WHEN -1 THEN 1 - yes[{r}] ELSE 1 END" for r in rules)
    bad = " * ".join(f"CASE votes[{r}] WHEN -1 THEN no[{r}] WHEN 1 THEN 1 - no[{r}] ELSE 1 END" for r in rules)
    posterior = f"(pi * {good}) / (pi * {good} + (1 - pi) * {bad})"
    rate = lambda r, vote, weight, start: f"(coalesce(sum({weight}) FILTER (votes[{r}] = {vote}), 0) + {WEIGHT * start}) / (coalesce(sum({weight}) FILTER (votes[{r}] <> 0), 0) + {WEIGHT})"
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), k AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, three) AS n FROM (SELECT r, i, words[i : i + 2] AS three FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 3))
), again AS (
  SELECT r, count(DISTINCT i + j) AS n FROM k, (VALUES (0), (1), (2)) t(j) WHERE n > 1 GROUP BY r
), c AS (
  SELECT d.r, doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines, coalesce(again.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper,
         len(regexp_extract_all(t, '!!+')) AS n_marks, len(list_filter(words, lambda w: regexp_full_match(w, '(?:{"|".join(FUNCTION_WORDS)})[.,;:]?'))) AS n_function_words,
         len(list_filter(words, lambda w: regexp_full_match(w, '\p{{L}}+[.,;:]?'))) AS n_plain_words, len(list_filter(words, lambda w: regexp_matches(w, '[.?!]$'))) AS n_ends
  FROM d LEFT JOIN again ON d.r = again.r
), q AS (SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM c
), v AS MATERIALIZED (SELECT *, [{", ".join(votes)}] AS votes FROM q
), p AS MATERIALIZED (SELECT votes, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY votes
), em AS (
  SELECT 0 AS k, CAST({GOOD} AS DOUBLE) AS pi, list_transform(range({len(RULES)}), lambda x: CAST({YES} AS DOUBLE)) AS yes, list_transform(range({len(RULES)}), lambda x: CAST({NO} AS DOUBLE)) AS no
  UNION ALL
  SELECT k + 1, (sum(n * p) + {WEIGHT * GOOD}) / (sum(n) + {WEIGHT}), [{", ".join(rate(r, 1, "n * p", YES) for r in rules)}], [{", ".join(rate(r, -1, "n * (1 - p)", NO) for r in rules)}]
  FROM (SELECT k, votes, n, {posterior} AS p FROM em, p WHERE k < {ROUNDS}) GROUP BY k
), g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM v)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND {posterior} >= 0.5 AS kept
FROM g, (SELECT pi, yes, no FROM em WHERE k = {ROUNDS})
"""


SQL = _sql()
