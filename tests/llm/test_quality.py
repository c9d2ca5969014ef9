import random
import re
from collections import Counter

import duckdb
import pytest
import regex

from keelson.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    again = {j for i, x in enumerate(windows) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def brute_forms(text):
    w = WORD.findall(text or "")
    end = "(?:[.,;:])?"
    function = sum(re.fullmatch("(?:" + "|".join(quality.FUNCTION_WORDS) + ")" + end, x) is not None for x in w)
    return function, sum(regex.fullmatch(r"\p{L}+" + end, x) is not None for x in w), sum(x[-1] in ".?!" for x in w)


def texts():
    rnd = random.Random(5)
    junk = ["", None, " \t\n\x0b\x0c\r", "a", "a a a a", "\n\n", "x\ny\nx\n x\n", "日本 語 　x ##|<>", "b " * 5000]
    return junk + ["".join(rnd.choice("ab \n") for _ in range(rnd.randrange(200))) for _ in range(200)]


def test_counts_like_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts())], "doc_id long, text string, quality int")
    for r in quality.digest(docs).collect():
        want = brute(texts()[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r.kept or not r.base_failed)
    forms = {r.doc_id: r.quality for r in quality.features(docs).collect()}
    for i, t in enumerate(texts()):
        assert (forms[i].n_function_words, forms[i].n_plain_words, forms[i].n_ends) == brute_forms(t)


def em(patterns):
    rules = range(len(quality.RULES))
    pi, yes, no = quality.GOOD, [quality.YES for _ in rules], [quality.NO for _ in rules]

    def post(v):
        g, b = pi, 1 - pi
        for r, x in enumerate(v):
            g *= yes[r] if x == 1 else 1 - yes[r] if x == -1 else 1
            b *= no[r] if x == -1 else 1 - no[r] if x == 1 else 1
        return g / (g + b)

    for _ in range(quality.ROUNDS):
        done = [(v, n, post(v)) for v, n in patterns.items()]
        w = quality.WEIGHT
        pi = (sum(n * p for _, n, p in done) + w * quality.GOOD) / (sum(n for _, n, _ in done) + w)
        yes = [(sum(n * p for v, n, p in done if v[r] == 1) + w * quality.YES) / (sum(n * p for v, n, p in done if v[r]) + w) for r in rules]
        no = [(sum(n * (1 - p) for v, n, p in done if v[r] == -1) + w * quality.NO) / (sum(n * (1 - p) for v, n, p in done if v[r]) + w) for r in rules]
    return {v: post(v) for v in patterns}


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return quality.judge(quality.features(docs.select("doc_id", "text")).drop("text")).collect()


def test_fit_like_plain_python(judged):
    want = em(Counter(tuple(r.quality.votes) for r in judged))
    assert all(abs(r.quality.posterior - want[tuple(r.quality.votes)]) < 1e-9 for r in judged)


def test_better_than_votes_by_count_and_than_all_must_pass(spark, judged):
    said = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [(said[r.doc_id], r.quality) for r in judged if r.doc_id in said and not r.quality.base_failed]
    share = lambda verdict: sum(verdict(q) == bool(good) for good, q in rows) / len(rows)
    fitted, most, all_pass = share(lambda q: q.kept), share(lambda q: sum(q.votes) > 0), share(lambda q: -1 not in q.votes)
    assert fitted > 0.99 and fitted > most + 0.02 and fitted > all_pass + 0.02
    past = [r.quality for r in judged if not r.quality.base_failed]
    for against in (1, 2):
        some = [q for q in past if q.votes.count(-1) == against]
        assert sum(q.kept for q in some) > 0.9 * len(some) > 40
    assert any(q.kept and q.votes.count(-1) == 3 for q in past) and any(not q.kept and q.votes.count(-1) == 3 for q in past)


def test_a_text_without_a_vote_against_may_go(spark):
    # most of this corpus is junk that breaks every rule it can; what no rule speaks for or against is taken for more of it
    rules = len(quality.RULES)
    fields = ", ".join(f"{n}:bigint" for n in quality.NAMES)
    counts = lambda **own: tuple({"n_words": 100, "word_chars": 430, "n_symbols": 5, "n_dup_lines": 1, "n_repeat_words": 5, "n_lines": 20, "n_upper": 80, "n_marks": 5, "n_function_words": 10, "n_plain_words": 80, "n_ends": 4, **own}[n] for n in quality.NAMES)
    junk = counts(word_chars=900, n_symbols=60, n_function_words=0, n_plain_words=0, n_ends=0)
    good = counts(n_words=200, word_chars=1000, n_symbols=0, n_dup_lines=0, n_repeat_words=0, n_upper=20, n_marks=0, n_function_words=60, n_plain_words=198, n_ends=20)
    rows = [(i, junk if i < 300 else good if i < 360 else counts()) for i in range(361)]
    got = {r.doc_id: r.quality for r in quality.judge(spark.createDataFrame(rows, f"doc_id long, quality struct<{fields}>")).collect()}
    assert list(got[360].votes) == [0] * rules and not got[360].base_failed and not got[360].kept
    assert not got[0].kept and got[359].kept


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_like_sql(spark, sf):
    path = f"/root/testdata/{sf}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as from '{path}'")
    rel = con.execute(quality.SQL)
    names = [d[0] for d in rel.description]
    df = quality.digest(spark.read.parquet(path))
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(rel.fetchall())


def test_repeated_rows_get_the_same_verdict(spark):
    rows = [(1, "one two " * 60), (1, "one two " * 60), (2, None), (2, None)]
    got = sorted(map(tuple, quality.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert len(got) == 4 and got[0] == got[1] and got[2] == got[3]


def test_empty_table(spark):
    assert quality.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
