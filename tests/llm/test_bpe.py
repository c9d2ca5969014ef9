import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from keelson.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "plain words, 12 of 'em", "naïve 日本語 🙂🙂 ‍ x", "a" * 3000, "x y\n\n  z\t" * 400, "<|endoftext|>", "\x00\x01", "é ſ K"]


@pytest.fixture(scope="module")
def own():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_like_tiktoken_and_back(spark, own):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS + TEXTS)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in bpe.digest(docs, PATH, P.PATTERN).collect()}
    assert len(rows) == 2 * len(TEXTS)
    for i, t in enumerate(TEXTS + TEXTS):
        ids = own.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_documents(spark, own):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(docs.select("doc_id", "text"), PATH, P.PATTERN).collect()}
    assert all(got[r.doc_id] == own.encode_ordinary(r.text) for r in docs.collect())


def test_offsets_and_split_characters(spark):
    x, table = bpe.encoder(PATH, P.PATTERN), bpe.decoder(PATH)
    text = "é🙂日本 naïve"
    ids = x.encode([text])[0].tolist()
    starts, chars = table.offsets(text, ids)
    assert b"".join(table.token_bytes[i] for i in ids) == text.encode()
    for s, c in zip(starts, chars, strict=True):
        assert len(text[:c].encode()) <= s < len(text[: c + 1].encode())
    assert "".join(table.pieces(ids)) == text
    cut = next(i for i in x.encode(["🙂"])[0].tolist())
    assert table.pieces([*ids, cut])[-1] in ("�", "🙂")
    rows = bpe.encode(spark.createDataFrame([(text,), (None,)], "text string"), PATH, P.PATTERN, offsets=True).collect()
    assert list(rows[0].byte_starts) == list(starts) and list(rows[1].ids) == []


def test_decode_like_in_one_pass(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    both = bpe.decode(bpe.encode(df, PATH, P.PATTERN, decoded="one"), PATH, out="two").collect()
    assert all(r.one == r.two == (r.text or "").encode() for r in both)
    assert bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), PATH).first().decoded == b""


def test_empty_table(spark):
    assert bpe.digest(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).collect() == []


def test_long_matches_are_not_remembered(own):
    x = bpe.Encoder(PATH, P.PATTERN)
    texts = ["a" * 100_000, "b" * bpe.LONGEST, "short " + "c" * 5000 + " words", "c" * 5000]
    for _ in range(2):
        assert [i.tolist() for i in x.encode(texts)] == [own.encode_ordinary(t) for t in texts]
    assert max(map(len, x.seen)) <= bpe.LONGEST and "b" * bpe.LONGEST in x.seen
