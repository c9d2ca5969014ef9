import re

import pytest

from keelson.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [None, "", "...", "MIT License", "the mit\n license, MIT-License; smit license", "GNU General Public License general public license", "é Apache  LICENSE Ünder", "mit licenses", "x " * 5000 + "Apache License, Version 2.0", "mit license " * 3000]


def test_base_like_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = TEXTS + [r.text for r in docs.collect()]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    for r in licenses.digest(df).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"),
        ("GNU Lesser General Public License v2.1", "gpl,lgpl-2.1"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
        ("under Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa-4.0"),
        ("released under the Boost Software License 1.0", "bsl-1.0"),
        ("nothing of the kind", ""),
        ("All rights reserved.", "proprietary"),
    ],
)
def test_labels(text, labels):
    assert licenses.scan(text)[5] == labels


def test_suppression_like_all_pairs():
    norm = licenses.normal("Released under the terms of the GNU Lesser General Public License, version 2.1. MIT license. " * 5)
    hits = [(m.start(), m.end(), s) for s in licenses.signatures() for m in s.regex.finditer(norm)]
    rank = lambda h: (-h[2].priority, h[0] - h[1], h[2].label)
    want = sorted((h[0], h[2].label) for h in hits if not any(o[0] <= h[0] and o[1] >= h[1] and rank(o) < rank(h) for o in hits))
    got = [(d.start, d.label) for d in licenses.detect(norm)]
    assert [x for _, x in got] == [x for _, x in want] and len(got) == 15


def test_every_signature_is_gated():
    gate, by = licenses._gate()
    assert len(licenses.signatures()) > 300
    for label, (name, keyword, _) in licenses.FAMILIES.items():
        sample = re.sub(r"\(\?:[^()|]*\)\?", "", name)
        sample = re.sub(r"\(\?:([^()|]*)[^()]*\)", r"\1", sample).replace("[cs]", "c").replace("\\w+", "atives").replace(" ?", " ").split("|")
        for one in sample:
            assert keyword in {k for _, k in gate.iter(f" {one} ")}, (label, one)


def sample(pattern):
    """A text that a pattern matches: first alternatives, without what is optional."""
    out = re.sub(r"\.\{\d+,\d+\}\?", "x", pattern).replace("[cs]", "c")
    while "(?:" in out:
        out = re.sub(r"\(\?:[^()]*\)\?", "", out, count=1) if re.search(r"\(\?:[^()]*\)\?", out) else re.sub(r"\(\?:([^()|]*)[^()]*\)", r"\1", out, count=1)
    return " ".join(re.sub(r"[a-z ]\?", "", out).split())


def test_every_notice_is_found():
    gate, by = licenses._gate()
    notices = [(label, p) for label, patterns in licenses.NOTICES.items() for p in patterns]
    assert len(notices) > 100 and len(notices) == len(set(p for _, p in notices))
    for label, p in notices:
        norm = licenses.normal(f"Some words, then {sample(p).upper()}; and more.")
        keys = {k for _, k in gate.iter(norm.decode("latin-1"))}
        assert any(s.label == label and s.priority == 6 and s.regex.search(norm) for k in keys for s in by[k]), (label, p, norm)


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "MIT License"), (1, "MIT License"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, licenses.digest(df).collect()), key=str)
    assert len(got) == 3 and got[0] == got[1] and got[2][0] is None


def test_empty(spark):
    assert licenses.scanned(spark.createDataFrame([], "doc_id long, text string")).collect() == []
