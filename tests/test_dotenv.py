import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelson.sources import dotenv

CASES = [
    ("A=1", {"A": "1"}),
    ("A", {}),
    ("A=1\nA", {}),
    ("A=1\nA\nA=2", {"A": "2"}),
    ("export A=1", {"A": "1"}),
    ("export A", {}),
    ("export =v", {}),
    ("export=v", {"export": "v"}),
    ("'a b'=1", {"a b": "1"}),
    ("'a\nb'=1", {"a\nb": "1"}),
    ("'a b=1\nB=2", {"B": "2"}),
    ("''=1\nB=2", {"B": "2"}),
    ("'a' junk\nB=2", {"B": "2"}),
    ('A="x\ny"\nB=2', {"A": "x\ny", "B": "2"}),
    ('A="x" junk\nB=2', {"B": "2"}),
    ('A="x\ny" junk\nB=2', {"B": "2"}),
    ('A="x\nB=2', {"B": "2"}),
    (r'A="a\n\t\"\\b\q"', {"A": 'a\n\t"\\b\\q'}),
    (r"A='a\n\'\\'", {"A": "a\\n'\\"}),
    ("K= # c", {"K": "# c"}),
    ("K=v # c", {"K": "v"}),
    ("K=#FF", {"K": "#FF"}),
    ("K=a#b", {"K": "a#b"}),
    ("K=a'b # c", {"K": "a'b"}),
    ("A=1\nB=${A}${C:-x}${D}", {"A": "1", "B": "1x"}),
    ("A=${B}\nB=1", {"A": "", "B": "1"}),
    ("B\nA=${B:-x}", {"A": ""}),
    ("A=$x\nB=${A}\nC='${B}'", {"A": "$x", "B": "$x", "C": "$x"}),
    ("A=${HOME:-no}", {"A": "/h"}),
    ("\ufeffA=1", {"A": "1"}),
    ("A=x\u2028y\x0cz", {"A": "x\u2028y\x0cz"}),
    ("A=1\r\nB=2\rC=3", {"A": "1", "B": "2", "C": "3"}),
    ("1PW=x\nX-KEY=y\nCAFÉ=z", {"1PW": "x", "X-KEY": "y", "CAFÉ": "z"}),
    ("  A  =  v  ", {"A": "v"}),
    ("", {}),
    ("# only\n\n", {}),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_values(text, want):
    parsed = dotenv.parse(text, environ={"HOME": "/h"})
    got = {}
    events = sorted([(a.line_number, a.name, a.value) for a in parsed.assignments] + [(n, k, None) for k, n in parsed.bare])
    for _, k, v in events:
        got.pop(k, None)
        if v is not None:
            got[k] = v
    assert got == want


def test_strict_keys_and_places():
    parsed = dotenv.parse("1A=x\n# c\nB='p\nq'\nC", lenient=False)
    assert parsed.unparsed_lines == [1] and parsed.comments == ["# c"] and parsed.bare == [("C", 5)]
    assert parsed.assignments == [("B", "p\nq", 3, "plaintext", "B='p\nq'", None)]
    assert dotenv.parse("\ufeffA=encrypted:x\nB=ENC[AES256_GCM,y]\nC=").assignments[0].status == "encrypted"
    assert [a.backend for a in dotenv.parse("A=encrypted:x\nB=ENC[AES256_GCM,y]\nC=").assignments] == ["dotenvx", "sops", None]


@given(st.text(alphabet="AB='\"\\ \n\r#${}:-xé\u2028", max_size=60), st.booleans())
@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.too_slow])
def test_never_fails(text, lenient):
    parsed = dotenv.parse(text, lenient)
    assert all(a.line_number >= 1 for a in parsed.assignments)


def test_loose_value():
    assert [dotenv.loose_value(x) for x in ('"a" # c', '"a" b # c', " v # c", "'x", '"\\n"')] == ["a", '"a" b', "v", "'x", "\n"]


def test_files_and_latest(spark):
    rows = [("a", "X=1\nY=2\nX=3\nY"), ("b", None), ("c", "X=${E}")]
    parsed = dotenv.parse_files(spark.createDataFrame(rows, "path string, content string"), environ={"E": "env"})
    assert {(r.path, r.name, r.value) for r in dotenv.assignments(parsed).collect()} == {("a", "X", "1"), ("a", "Y", "2"), ("a", "X", "3"), ("c", "X", "env")}
    assert {(r.path, r.name, r.value) for r in dotenv.latest(dotenv.events(parsed)).collect()} == {("a", "X", "3"), ("c", "X", "env")}


def test_two_kinds_of_lines(spark):
    df = spark.createDataFrame([("a", "x\r\ny\x0cz\u2028w\n")], "path string, content string")
    assert [r.line for r in dotenv.physical_lines(df).orderBy("line_number").collect()] == ["x", "y\x0cz\u2028w", ""]
    assert [r.line for r in dotenv.text_lines(df).orderBy("line_number").collect()] == "x\r\ny\x0cz\u2028w\n".splitlines()


def test_first_key(spark):
    df = spark.createDataFrame([("a", "# x\nK='1'\nK=2"), ("b", "K="), ("c", "L=1")], "path string, content string")
    assert {r.path: r.value for r in dotenv.first_key(df, "K").collect()} == {"a": "1", "b": "", "c": None}
    assert df.where(F.col("path") == "").count() == 0
