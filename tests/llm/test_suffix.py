import hashlib
import os
import random
import subprocess
import sys
import types
from pathlib import Path

import duckdb
import numpy as np
import pytest

from keelson.llm import suffix


def brute(rows):
    docs = sorted((-(1 << 63) if d is None else d, (t or "").encode()) for d, t in rows)
    first = {}
    for k, (d, t) in enumerate(docs):
        for i in range(len(t) - 99):
            x = (d, i, k)
            if first.setdefault(t[i : i + 100], x) > x:
                first[t[i : i + 100]] = x
    out = []
    for k, (d, t) in enumerate(docs):
        gone = [False] * len(t)
        for i in range(len(t) - 99):
            if first[t[i : i + 100]] != (d, i, k):
                gone[i : i + 100] = [True] * 100
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows(seed, n=60):
    rnd = random.Random(seed)
    some = lambda k: "".join(rnd.choice("abé d\n") for _ in range(k))
    passages = [some(rnd.randrange(90, 400)) for _ in range(5)]
    out = [(None, passages[0]), (3, None), (4, ""), (6, "b" * 700), (7, "b" * 260), (8, "ab" * 300), (8, "x" * 99), (9, "x" * 100)]
    for _ in range(n):
        t = some(rnd.randrange(200))
        for _ in range(rnd.randrange(3)):
            p, at = rnd.choice(passages), rnd.randrange(len(t) + 1)
            t = t[:at] + p[rnd.randrange(40) :] + t[at:]
        out.append((rnd.randrange(10, 2000), t))
    return out + [(2500 + i, passages[1]) for i in range(4)]


def got(df):
    return sorted((-(1 << 63) if r[0] is None else r[0], *r[1:]) for r in map(tuple, df.collect()))


@pytest.mark.parametrize(("block", "often"), [(1 << 22, 1 << 30), (2000, 1 << 30), (2000, 2)])
def test_like_brute_force(spark, block, often):
    docs = spark.createDataFrame([(*r, 1) for r in rows(block)], "doc_id long, text string, block int")
    assert got(suffix.digest(docs, block, often)) == brute(rows(block))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(suffix.digest(docs, 40_000)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_and_texts(spark):
    docs = spark.createDataFrame([(1, "x" * 150), (2, None)], "doc_id long, text string")
    assert suffix.digest(docs.limit(0)).collect() == []
    assert {r.doc_id: bytes(r.kept) for r in suffix.dedup(docs).collect()} == {1: b"x", 2: b""}
    assert {r.doc_id: r.n_removed for r in suffix.dedup(docs).collect()} == {1: 149, 2: 0}


def test_multikey_sort():
    keys = np.random.default_rng(0).integers(0, 2, (500, 9)).astype(np.uint64)
    order, prefix = suffix.multikey_sort(keys)
    assert keys[order].tolist() == sorted(keys.tolist())
    lead = [tuple(x[:7]) for x in keys[order].tolist()]
    assert all((lead[i] == lead[i - 1]) == (prefix[i] == prefix[i - 1]) for i in range(1, 500))


@pytest.mark.parametrize("run", [b"=", b"ab", b"lorem ipsum dolor sit amet, "])
def test_long_runs_have_few_anchors(run):
    texts = [b"x" * 60 + run * (200_000 // len(run)) + b"y" * 130, b"", run * 40, b"z" * 99]
    doc, at, _, (of, start, end) = suffix.sparse(texts)
    assert len(doc) < 800 < len(suffix.anchors(texts)[0])
    for k, t in enumerate(texts):
        mine, spans = set(at[doc == k].tolist()), [(a, b) for d, a, b in zip(of, start, end, strict=True) if d == k]
        first = {}
        for i in range(len(t) - 99) if k != 0 else (*range(3000), *range(len(t) - 3000, len(t) - 99)):
            has = bool(mine & set(range(i, i + suffix.SPAN)))
            assert has or any(a <= i and i + 100 <= b for a, b in spans)
            first.setdefault(t[i : i + 100], i)
        for a, b in spans:  # all of them repeats
            assert all(t.find(t[i : i + 100]) < i for i in (a, (a + b) // 2, b - 100))


def test_windows_do_not_matter(monkeypatch):
    texts = [(t or "").encode() for _, t in rows(5)]
    whole, sparse = suffix.anchors(texts), suffix.sparse(texts)
    monkeypatch.setattr(suffix, "WINDOW", 37)
    assert all((a == b).all() for a, b in zip(whole, suffix.anchors(texts), strict=True))
    assert all((a == b).all() for a, b in zip(sparse[:3], suffix.sparse(texts)[:3], strict=True))


def test_four_megabytes_of_one_byte(tmp_path):
    # in a process of its own, whose memory is held below 1 GB
    code = """
import resource, types
resource.setrlimit(resource.RLIMIT_AS, (1 << 30, 1 << 30))
import numpy as np
from keelson.llm import blocks, suffix
block = types.SimpleNamespace(texts=[b"=" * (4 << 20), b"=" * 5000], ids=np.array([1, 2]), number=0)
keys, _ = suffix._name(block)
rows = suffix._hang(np.zeros(0, "S16"))(block, np.unique(keys >> np.uint64(16)), np.zeros(len(np.unique(keys >> np.uint64(16))), bool), 16)
table = blocks.sent(rows)
told = [blocks.unpack(x) for b in sorted(set(r[0] for r in rows)) for x in suffix._settle(table.filter(np.array(table["bucket"]) == b))["data"].to_pylist()]
n, spans, kept = suffix._applied(block, told)
assert (n.tolist(), [len(k) for k in kept]) == ([(4 << 20) - 1, 5000], [1, 0]), (n, [len(k) for k in kept])
"""
    env = {**os.environ, "PYTHONPATH": str(Path(__file__).parents[2]), "OPENBLAS_NUM_THREADS": "1", "OMP_NUM_THREADS": "1", "ARROW_DEFAULT_MEMORY_POOL": "system"}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_neighbours_decide_like_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 3, (6, 150)).astype(np.uint8)
    context = base[rng.integers(0, 6, 300)].copy()
    for _ in range(2):
        context[np.arange(300), rng.integers(0, 150, 300)] ^= 1
    before, after = rng.choice([50, 50, 50, 20, 0], 300), rng.choice([100, 100, 100, 70, 50], 300)
    context[np.arange(150) < 50 - before[:, None]] = 0
    context[np.arange(150) >= 50 + after[:, None]] = 0
    order, prefix = suffix.multikey_sort(suffix.digits(context))
    age = rng.permutation(300)
    low, high = suffix.repeats(context[order], before[order], after[order], prefix, age)
    for x in range(300):
        a, b = order[x], []
        for k in range(suffix.SPAN):
            cut = slice(50 - k, 150 - k)
            fits = lambda r: before[r] >= k and after[r] >= 100 - k  # noqa: E731, B023
            if fits(a) and any(age[y] < age[x] and fits(order[y]) and (context[order[y], cut] == context[a, cut]).all() for y in range(300)):
                b.append(k)
        assert (low[x], high[x]) == ((min(b), max(b)) if b else (1, 0))


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    # two claims, of which one doesn't hold
    block = types.SimpleNamespace(texts=[b"a" * 120])
    assert suffix._confirm(block, 0, 5, 100, b"a" * 100) and not suffix._confirm(block, 0, 5, 100, b"a" * 99 + b"b") and not suffix._confirm(block, 0, 50, 100, b"a" * 100)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_like_sql(spark, sf):
    path = f"/root/testdata/{sf}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as from '{path}'")
    rel = con.execute(suffix.SQL)
    names = [d[0] for d in rel.description]
    df = suffix.digest(spark.read.parquet(path), often=30)
    assert sorted(df.columns) == sorted(names) and sorted(map(tuple, df.select(*names).collect())) == sorted(rel.fetchall())


def test_every_string_has_an_anchor():
    texts = [(t or "").encode() for _, t in rows(1)]
    doc, at, _ = suffix.anchors(texts)
    for k, t in enumerate(texts):
        own = set(at[doc == k].tolist())
        assert all(own & set(range(i, i + suffix.SPAN)) for i in range(len(t) - 99))
