import hashlib

import corpus_pipeline as p
import pytest
from test_leaks import leaks
from test_simhash import jaccard
from test_suffix import brute as brute_suffix

from keelson.llm import bpe, quality

SF = "/root/testdata/sf0.001"


def prose(seed):
    """A text as the quality rules know it: made-up nouns, function words and sentences."""
    noun = lambda i: "".join(chr(97 + (i + 7907 * seed) // 26**k % 26) for k in range(6))
    return " ".join(f"The {noun(7919 * i)} of {noun(104729 * i + 5)} is not {noun(1299709 * i + 9)}." for i in range(1, 30))


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    steps = [docs]
    for _, stage in p.STAGES:
        steps.append(stage(spark, steps[-1], SF).cache())
    return steps


def test_documents_keep_their_columns(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality_stage(spark, stages):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in stages[:2])
    kept = {r.doc_id for r in quality.digest(stages[0]).where("kept").collect()}
    assert set(after) == kept and all(before[i] == t for i, t in after.items())


def test_near_dedup_stage(stages):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in stages[1:3])
    ids = sorted(before)
    root = {i: i for i in ids}
    close = [(i, j) for i in ids for j in ids if i < j and jaccard(before[i] or "", before[j] or "") >= 0.8]
    for _ in ids:
        for i, j in close:
            root[i] = root[j] = min(root[i], root[j])
    assert close and set(after) == {i for i in ids if root[i] == i}


def test_suffix_stage(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[2:4])
    want = {r[0]: r for r in brute_suffix([(i, r.text) for i, r in before.items()])}
    for i, r in before.items():
        if want[i][2] == 0:
            assert after[i].text == r.text and after[i].n_chars == len(r.text) and after[i].source == r.source
        elif i in after:
            assert abs(len(after[i].text.encode()) - (want[i][1] - want[i][2])) <= 6 * want[i][3]
        else:
            assert want[i][1] - want[i][2] <= 6 * want[i][3]


def test_leak_stage(spark, stages):
    before, after = ({r.doc_id for r in s.collect()} for s in stages[3:5])
    leaked = {r.doc_id for r in leaks.digest(stages[3], spark.read.parquet(f"{SF}/benchmark.parquet")).where("leaked").collect()}
    assert after == before - leaked


def test_last_stage(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[4:6])
    x = bpe.encoder(p.public_tokenizers.path(p.RANKS), p.public_tokenizers.PATTERN)
    assert set(before) == set(after)
    for i, r in after.items():
        assert r.round_trip and list(r.ids) == x.encode([before[i].text])[0].tolist() and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(before[i].text.encode()).hexdigest()


def test_run_and_nulls(spark, tmp_path, stages):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 9, None, None, 45), (2, "word " * 9, None, None, 45)]
    a, b, c = (prose(k) for k in (1, 2, 3))
    rows += [(None, a, None, "s", None), (7, a, "en", None, 1), (9, a, None, None, None), (None, b, None, None, None), (8, c, "en", "s", 2), (8, c, None, "t", 2)]
    docs = spark.createDataFrame(rows, stages[0].schema)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
    # of a group the smallest id stays, a text without an id if no other has it, and one of two rows with the same id and text
    got = docs.collect()
    assert sorted((r.doc_id or 0, r.decoded_sha256) for r in got) == sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in ((7, a), (0, b), (8, c))) and all(r.round_trip for r in got)
    assert p.run(spark, SF).count() == stages[-1].count()
    empty = stages[0].limit(0)
    for _, stage in p.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.collect() == []


def test_clashing_columns_stay(spark):
    names = ("quality", "kept", "ids", "score", "leaked", "item_id", "n_items", "node", "f0", "shard", "block", "bucket", "doc")
    text = prose(0)
    row = (1, text, "en", "s", len(text), *("own" for _ in names))
    docs = spark.createDataFrame([row], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert [tuple(r) for r in docs.collect()] == [row]
    assert p.STAGES[-1][1](spark, docs, SF).first().round_trip
