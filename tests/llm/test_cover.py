import hashlib
import random
import re
import types

import duckdb
import numpy as np
import pytest

from keelson.llm import cover

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows):
    first = {}
    split = [(-(1 << 63) if d is None else d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), (o, w) in zip(rows, split, strict=True):
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < o for j in range(i, i + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "é", "xyz", "B"]) * rnd.randrange(1, 5)
    passages = [[word() for _ in range(rnd.randrange(10, 40))] for _ in range(6)]
    out = [(None, " ".join(passages[0])), (3, None), (4, ""), (5, " \n\t "), (6, "b " * 900), (7, "b " * 50), (8, "b"), (8, "b " * 40)]
    for i in range(120):
        w = [word() for _ in range(rnd.randrange(30))]
        for _ in range(rnd.randrange(3)):
            p, at = rnd.choice(passages), rnd.randrange(len(w) + 1)
            w[at:at] = p[rnd.randrange(3) :]
        out.append((rnd.randrange(80), rnd.choice([" ", "\n", " \t"]).join(w)))
    return out + [(900, " ".join(passages[1]))] * 5


@pytest.mark.parametrize("block", [1 << 22, 400])
def test_like_brute_force(spark, block):
    docs = spark.createDataFrame([(*r, 1) for r in rows(block)], "doc_id long, text string, block int")
    got = sorted((tuple(r) for r in cover.digest(docs, block).collect()), key=str)
    assert got == brute(rows(block))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((tuple(r) for r in cover.digest(docs, 20_000).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_and_texts(spark):
    docs = spark.createDataFrame([(1, "x y"), (2, None)], "doc_id long, text string")
    assert cover.digest(docs.limit(0)).collect() == []
    assert {r.doc_id: bytes(r.kept) for r in cover.dedup(docs).collect()} == {1: b"x y", 2: b""}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_like_sql(spark, sf):
    path = f"/root/testdata/{sf}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as from '{path}'")
    rel = con.execute(cover.SQL)
    names = [d[0] for d in rel.description]
    df = cover.digest(spark.read.parquet(path), 300_000)
    assert sorted(df.columns) == sorted(names) and sorted(map(tuple, df.select(*names).collect())) == sorted(rel.fetchall())


def test_words_are_compared(spark, monkeypatch):
    # hashes of which all are equal: nothing may go that isn't the same, so the job stops
    texts = [" ".join(f"{c}{i}" for i in range(20)) for c in "ab"]
    block = types.SimpleNamespace(ids=np.array([1, 2]), texts=[t.encode() for t in texts], number=0)
    monkeypatch.setattr(cover, "xxh64", lambda flat, starts, ends: np.ones(len(starts), np.uint64))
    with pytest.raises(ValueError, match="one hash"):
        cover.removed(block, [])
    assert cover._confirm(block, 0, 2, 3, b"a2 a3 a4") and not cover._confirm(block, 0, 2, 3, b"a2 a3 b4") and not cover._confirm(block, 0, 18, 3, b"a18 a19 b0")


def test_cover_has_every_difference():
    assert {(a - b) % cover.PERIOD for a in cover.COVER for b in cover.COVER} == set(range(cover.PERIOD))
