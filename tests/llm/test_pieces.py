import random

import public_tokenizers as P

from keelson.llm import pieces

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def brute(word, starts, rest):
    n = i = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in (rest if i else starts)), 0)
        if not j:
            return 0
        n, i = n + 1, j
    return n


def test_automaton_like_greedy():
    rnd = random.Random(6)
    for _ in range(60):
        some = lambda: bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 6)))
        starts, rest = {some() for _ in range(rnd.randrange(12))}, {some() for _ in range(rnd.randrange(12))}
        machine = pieces.Automaton(sorted(starts), sorted(rest))
        for _ in range(200):
            word = bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 15)))
            assert machine.count(word) == brute(word, starts, rest)


def test_documents_like_greedy(spark):
    starts, rest = (set(x) for x in pieces.vocabulary(PATH))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [None, "", " \x0b\x1c ", "日本語 é", "x" * 500, "a\x1cb\x85c d"] + [r.text for r in docs.limit(40).collect()]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    for r in pieces.counted(df, PATH).collect():
        words = (texts[r.doc_id] or "").encode().split()
        n = [brute(w, starts, rest) for w in words]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(n) + n.count(0), n.count(0))
    assert pieces.counted(df.limit(0), PATH).collect() == []


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "some words"), (1, "some words"), (None, None), (None, None)], "doc_id long, text string")
    got = sorted(map(str, map(tuple, pieces.counted(df, PATH).collect())))
    assert len(got) == 4 and got[0] == got[1] and got[2] == got[3]
