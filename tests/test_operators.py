import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keelson.functions import classify, coerce, keys, rules
from keelson.operators import contract, drift, findings, reconcile, render
from keelson.sources import dotenv, files, reports


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def token(*parts):
    return "".join(parts)


def test_value_equality(spark):
    cases = [
        ("a", "a", "str", True), ("a ", "\ta", None, True), ("true", "1", None, True), ("YES", "off", None, False), ("1", "01", "int", True), ("1", "x", "int", False),
        ("yes", "on", "int", False), ("1.0", "1", "float", True), ("[1, 2]", "[1,2]", None, True), ("{'a': 1}", '{"a":1.0}', None, True), ("[1,2]", "[2,1]", None, False), ("[", "{", None, False), ("on", "true", "bool", True),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string, kind string, want boolean")
    got = df.select("want", drift.equal_values(F.col("a"), F.col("b"), F.col("kind"), collections=True).alias("x"), "i").collect()
    assert [(r.i, r.x) for r in got] == [(r.i, r.want) for r in got]


def test_drift_is_a_mirror(spark):
    a = spark.createDataFrame([("A", "1", 1), ("B", "", 2), ("C", "x", 3)], "name string, value string, line_number int")
    b = spark.createDataFrame([("B", "y", 1), ("C", "x ", 2), ("D", "z", 3)], "name string, value string, line_number int")
    fields = spark.createDataFrame([("B", "str", True)], "field string, type string, sensitive boolean")
    ab = {r.name: (r.diff_type, r.value1, r.value2) for r in drift.drift(a, b, fields).collect()}
    assert ab == {"A": ("removed", "1", None), "B": ("changed", None, "********"), "D": ("added", None, "z")}
    ba = {r.name: r.diff_type for r in drift.drift(b, a).collect()}
    assert ba == {"A": "added", "B": "changed", "D": "removed"}
    assert drift.drift(a, a).count() == 0 and drift.summary(drift.drift(a, a)).first().has_drift is False
    report = json.loads(drift.report(drift.drift(a, b), "dev", "prod").first().report)
    assert report["summary"] == {"added": 1, "removed": 1, "changed": 1, "has_drift": True} and [d["name"] for d in report["differences"]] == ["A", "B", "D"]


def test_coercion_like_pydantic(spark):
    pydantic = pytest.importorskip("pydantic")
    texts = ["1", "+1", "-0", "1_000", "1__0", "_1", "1.0", "1.5", "1e3", "", " 7 ", "１", "x", "true", "TRUE", "T", "yes", "2", "off", "inf", "nan", ".5", "5.", "[1]", '{"a":1}', "[", "null"]
    for kind, real in (("int", int), ("float", float), ("bool", bool), ("str", str)):
        adapter = pydantic.TypeAdapter(real)
        got = col(spark, texts, lambda v, kind=kind: coerce.accepted(v, F.lit(kind)))
        for t, g in zip(texts, got, strict=True):
            try:
                adapter.validate_strings(t)
                want = True
            except pydantic.ValidationError:
                want = False
            assert g == want, (kind, t)
    assert col(spark, ["[1]", '{"a":1}', "[", "x"], lambda v: coerce.accepted(v, F.lit("list[int]"))) == [True, False, False, False]
    assert col(spark, ["x"], lambda v: coerce.accepted(v, F.lit("any"))) == [None]


FIELDS = [("host", "str", False, False, "h", ["host"], None), ("port", "int", True, False, None, ["APP_PORT", "port"], "the port"), ("key", "str", True, True, None, ["key"], None)]


def test_contract(spark):
    fields = spark.createDataFrame(FIELDS, contract.FIELDS)
    rows = [("a", "PORT", "x", 1), ("a", "app_port", "", 2), ("a", "KEY", token("sk", "-1"), 3), ("a", "key", "encrypted:y", 4), ("a", "NEW_TOKEN", "t", 5), ("a", "DOTENV_PUBLIC_KEY_X", "p", 6), ("b", "host", "q", 1)]
    v = spark.createDataFrame(rows, "path string, name string, value string, line_number int")
    k = ("path",)
    assert {(r.path, r.field) for r in contract.missing(v, fields, k).collect()} == {("a", "host"), ("b", "port"), ("b", "key")}
    assert {r.name for r in contract.extra(v, fields, k).collect()} == {"NEW_TOKEN"}
    assert {(r.field, r.name, r.value) for r in contract.bind(v, fields, k).collect()} == {("port", "app_port", ""), ("key", "key", "encrypted:y"), ("host", "host", "q")}
    assert {(r.field, r.name) for r in contract.bind(v, fields, k, ignore_empty=True).collect()} >= {("port", "PORT")}
    assert {r.message for r in contract.mistyped(v, fields, k).collect()} == {"Expected integer, got ''"}
    assert {r.message for r in contract.mistyped(v, fields, k, ignore_empty=True).collect()} == {"Expected integer, got 'x'"}
    assert {(r.name) for r in contract.unencrypted(v, fields, k).collect()} == {"KEY"}
    assert {(r.name, r.reason) for r in contract.unmarked(v, fields, k).collect()} == {("NEW_TOKEN", "name")}
    assert [(r.folded, r.names, r.kept) for r in contract.collisions(v, k).collect()] == [("key", ["KEY", "key"], "key")]
    found = {r.path: (r.errors, r.warnings, r.valid) for r in contract.verdict(contract.violations(v, fields, k), k).collect()}
    assert found == {"a": (2, 4, False), "b": (2, 0, False)}
    text = {r.path: r.template for r in contract.fix_template(contract.missing(v, fields, k), fields, k).collect()}
    assert text["b"] == '# Missing required variables:\nkey="encrypted:YOUR_VALUE_HERE"\n\n# the port\nport=\n' and "# host=h" in text["a"]
    empty = spark.createDataFrame([("c",)], "path string")
    assert contract.missing(v, fields, k, files=empty).count() == 3


def test_encryption_report_and_inference(spark):
    rows = [("f", "A", "encrypted:1"), ("f", "B", ""), ("f", "MY_KEY", "plain"), ("f", "sops_mac", "x"), ("f", "DOTENV_PUBLIC_KEY", "p"), ("g", "A", "ENC[AES256_GCM,x]")]
    v = spark.createDataFrame(rows, "path string, name string, value string")
    r = {x.path: x for x in contract.encryption_report(v, ("path",)).collect()}
    assert (r["f"].encrypted, r["f"].plaintext, r["f"].empty, r["f"].plaintext_secrets, r["f"].ratio, r["f"].should_block, r["f"].backend) == (["A"], ["MY_KEY"], ["B"], ["MY_KEY"], 0.5, True, "dotenvx")
    assert r["g"].fully_encrypted and r["g"].backend == "sops"
    assert contract.recommendations(contract.encryption_report(v, ("path",)), ("path",)).count() == 2
    many = spark.createDataFrame([("N", "1"), ("N", "22"), ("B", "True"), ("M", "1"), ("M", "x"), ("API_KEY", "9")], "name string, value string")
    assert {(x.field, x.type, x.sensitive) for x in contract.infer(many).collect()} == {("N", "int", False), ("B", "bool", False), ("M", "str", False), ("API_KEY", "int", True)}


def test_scalars(spark):
    texts = ["", "a", "aab", "x" * 8, "abcdefghi", "é🙂é"]
    got = col(spark, texts, classify.entropy)
    for t, g in zip(texts, got, strict=True):
        n = len(t)
        want = -sum(c / n * math.log2(c / n) for c in Counter(t).values()) if n else 0.0
        assert abs(g - want) < 1e-9 and abs(findings.bits(t) - want) < 1e-9 and 0 <= g + 1e-12 and g <= math.log2(max(1, len(set(t)))) + 1e-9
    assert col(spark, texts, classify.redact) == ["", "*", "***", "*" * 8, "abcd*fghi", "***"]
    assert all(len(a) == len(b) for a, b in zip(col(spark, texts, classify.redact), texts, strict=True))
    codes = ["config.Password", "a?.readToken()", "Xk9.mQ2vLp8wRt4nZs6yBdFh", "plain", "p->field"]
    assert [classify.member_access(c) for c in codes] == [True, True, False, False, True]
    more = {"a.b": True, "a().b": False, "a.b( )": True, "a.b(x)": False, "$x.y": True, "this . props->apiKey": True, "a.": False, ".a": False, "a..b": False, "1a.b": False, "obj.qwrtpsd": False, "obj.qwrtpsd()": True, "é.b": False, " a.b": False}
    assert {v: classify.member_access(v) for v in more} == more
    shapes = ["{T:G}|{Message}|{X}|{Y}", "%Y-%m-%d", "{{a}} {{b}}", "plain"]
    assert [s >= 2 for s in col(spark, shapes, classify.template_score)] == [findings._template(s) for s in shapes]
    assert col(spark, [None, "", "abc"], lambda v: classify.redact_keyed(v, "s"))[:2] == [None, "<empty>"]
    names = ["service.env.docker", "a-docker.env", "docker.env", ".env", "x.docker.env", "docker"]
    assert col(spark, names, lambda v: classify.name_encodes(v, F.lit("docker"))) == [True, True, True, False, True, False]
    assert col(spark, [".env", "a.env"], lambda v: classify.name_encodes(v, F.lit("production"))) == [True, True]
    lines = ['K="encrypted:x"', "note encrypted: x", "K=ENC[AES256_GCM,x]", "K=ENC[x]", "# K=encrypted:x"]
    assert col(spark, lines, classify.encrypted_line) == [True, False, True, False, False]
    assert col(spark, lines, classify.agent_encrypted_line) == [True, False, True, True, False]
    assert col(spark, ["A=1", "A=", "A=encrypted:x", "sops_mac=x", "# A=1", 'A="" # c', "DOTENV_PUBLIC_KEY=x"], classify.plaintext_secret_line) == [True, False, False, False, False, False, False]
    assert col(spark, ["A=encrypted:1", "sops_version=3", "A=1"], classify.backend) == ["dotenvx", "sops", None]


@pytest.mark.parametrize("how", [{}, {"extra_policy": "ignore"}, {"extra_policy": "warn", "case_sensitive": True}, {"check_encryption": False, "ignore_empty": True}])
def test_violations_are_those_of_the_single_checks(spark, how):
    rnd = random.Random(6)
    names = ["A", "a", "B", "PORT", "port", "DB_PASSWORD", "API_KEY", "X", "DOTENV_PUBLIC_KEY", "FLAG"]
    values = ["", "1", "x", "encrypted:y", "ghp_abc", "yes", "ENC[z", "sk-1"]
    rows = [(f"f{k}", n, rnd.choice(values), i) for k in range(12) for i, n in enumerate(rnd.sample(names, rnd.randrange(len(names))))]
    v = spark.createDataFrame(rows, "path string, name string, value string, line_number int")
    files_ = spark.createDataFrame([(f"f{k}",) for k in range(13)], "path string")
    fields = spark.createDataFrame(
        [("a", "str", True, True, None, ["A", "B"], None), ("port", "int", True, False, None, [], None), ("flag", "bool", False, False, "1", ["FLAG", "X"], None), ("pw", "str", False, True, None, ["DB_PASSWORD"], None), ("num", "int", True, False, None, ["X"], None)],
        contract.FIELDS,
    )
    k, case, empty = ("path",), how.get("case_sensitive", False), how.get("ignore_empty", False)
    want = [(r.path, "missing_required" if r.required else "missing_optional", r.field) for r in contract.missing(v, fields, k, case, empty, files_).collect()]
    want += [(r.path, "type", r.field) for r in contract.mistyped(v, fields, k, case, empty).collect()]
    if how.get("extra_policy") != "ignore":
        want += [(r.path, "extra", r["name"]) for r in contract.extra(v, fields, k, case).collect()]
    if how.get("check_encryption", True):
        want += [(r.path, "unencrypted", r["name"]) for r in contract.unencrypted(v, fields, k, case).collect()]
        want += [(r.path, f"suspicious_{r.reason}", r["name"]) for r in contract.unmarked(v, fields, k, case).collect()]
    if not case:
        want += [(r.path, "collision", r.folded) for r in contract.collisions(v, k).collect()]
    got = [(r.path, r.kind, r["name"]) for r in contract.violations(v, fields, k, files=files_, **how).collect()]
    assert sorted(got) == sorted(want) and len(want) > 40
    one = v.where("path = 'f3'").drop("path")
    assert sorted(r.kind for r in contract.violations(one, fields, **how).collect()) == sorted(x[1] for x in want if x[0] == "f3")


def test_which_types_are_decoded_from_json():
    from dataclasses import make_dataclass
    from typing import Annotated, Optional

    pydantic = pytest.importorskip("pydantic")
    type Names = list[str]
    type Pair[T] = dict[str, T]
    roots = {k: type(k, (pydantic.RootModel[t],), {}) for k, t in (("Text", str), ("Texts", list[str]))}
    want = {
        "plain": [(str, (False, False)), (bytes, (False, False)), (int, (False, False)), (None, (False, False)), (Optional[int], (False, False)), (str | int, (False, False))],
        "structured": [(x, (True, False)) for x in (list, list[int], dict[str, int], tuple[int, ...], set[int], frozenset, make_dataclass("D", ["x"]), pydantic.create_model("M", x=(int, 1)), roots["Texts"], Names, Pair[int], Annotated[list[int], "note"])],
        "tolerant": [(x, (True, True)) for x in (Optional[list[int]], str | list[str], int | Names, Annotated[dict | None, "note"])],
        "root of a text": [(roots["Text"], (False, False))],
        "marked": [(Annotated[list[int], pydantic.Json], (False, False)), (Annotated[list[int] | None, pydantic.Json()], (False, False))],
    }
    for cases in want.values():
        for kind, result in cases:
            assert coerce.complexity(kind) == result, kind
    assert coerce.complexity(list[int], [pydantic.Json()]) == (False, False)


def test_other_backends(spark):
    mine = classify.Backend("mine", lambda v: v.startswith("mine:"), lambda c: c.contains("=mine:"))
    every = (*classify.BACKENDS, mine)
    assert col(spark, ["encrypted:1", "ENC[AES256_GCM,x]", "mine:x", "y", None], lambda v: classify.value_backend(v, every)) == ["dotenvx", "sops", "mine", None, None]
    assert col(spark, ["A=mine:x", "A=mine:x\nB=encrypted:y", "A=1"], lambda v: classify.backend(v, every)) == ["mine", "dotenvx", None]


def test_agent_and_editor_verdicts(spark):
    lines = ['K="encrypted:BDqb+/9z=="', "K=encrypted:AbC=", "K='ENCRYPTED:x' # note", "export K=ENC[x]", "NOTE=not encrypted: yet", "DOTENV_PUBLIC_KEY_PROD=encrypted:x", "sops_mac=ENC[x]", "sops_age__list=ENC[x]", "sops_token=ENC[x]", "  # K=encrypted:x", "encrypted:x", "K=a=encrypted:x"]
    assert col(spark, lines, classify.agent_encrypted_line) == [True, True, True, True, False, False, False, False, True, False, False, False]
    files = {
        "A=encrypted:x==\n# note\nB=": True,
        "A=encrypted:x\nB=plain": False,
        "A=encrypted:x\nDOTENV_PUBLIC_KEY=03ab\nsops_mac=x\nsops_pgp_1=y": True,
        "A=encrypted:x\nsops_token=plain": False,
        "A=\nB=''": False,
        "": False,
        "A=encrypted:x\nB=\"\" # empty": True,
    }
    got = col(spark, list(files), lambda v: classify.agent_encrypted(F.split(v, "\n")))
    assert dict(zip(files, got, strict=True)) == files
    editor = {"DOTENV_PUBLIC_KEY=03ab": True, "DOTENV_PUBLIC_KEY_CI = 03ab": True, "# DOTENV_PUBLIC_KEY=03ab": False, "A=encrypted:x": True, "A=1": False, "X_DOTENV_PUBLIC_KEY=1": False}
    got = col(spark, list(editor), lambda v: classify.editor_encrypted(F.split(v, "\n")))
    assert dict(zip(editor, got, strict=True)) == editor


def test_name_assigned_twice_is_no_collision(spark):
    rows = [("f", "A", 1), ("f", "A", 2), ("f", "B", 3), ("f", "b", 4), ("f", "B", 5), ("g", "b", 1)]
    got = contract.collisions(spark.createDataFrame(rows, "path string, name string, line_number int"), ("path",)).collect()
    assert [tuple(r) for r in got] == [("f", "b", ["b", "B"], "B")]


def test_walk_prunes_below_its_root_only(spark, tmp_path):
    root = tmp_path / "build" / "app"
    for name in ("a.env", "src/b.env", "node_modules/c.env", "src/build/d.env", "src/vendor", "x/target/deep/e.env"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("A=1")
    for path in (str(root), f"file://{root}/", f"{tmp_path}/*/app"):
        got = sorted(r.path.split("/app/")[1] for r in files.read_files(spark, path).collect())
        assert got == ["a.env", "src/b.env", "src/vendor"]


def test_pattern_extension(spark):
    patterns = spark.createDataFrame([("p", ".env*"), ("p", "a?.txt"), ("p", "[bc].env"), ("p", "[!x]y"), ("p", "[z"), ("p", "1+1")], "project string, pattern string")
    names = [".env.prod", "ab.txt", "abc.txt", "b.env", "d.env", "zy", "xy", "z", "[z", "1+1", "11"]
    mapped = spark.createDataFrame([("p", n) for n in names], "project string, name string")
    got = {r.pattern for r in reconcile.more_patterns(patterns, mapped).collect()}
    assert got == {".env*", "a?.txt", "[bc].env", "[!x]y", "[z", "1+1", "abc.txt", "d.env", "xy", "z", "11"}


def test_all_rules_compile_and_find():
    assert len(rules.RULES) == 92 and len({r.id for r in rules.RULES}) == 92 and len(rules.compiled()) == 92
    assert sum(r.gated for r in rules.RULES) == 5 and [r.id for r in rules.RULES if r.whole] == ["gcp-service-account"]
    text = "\n".join([
        "k = " + token("gh", "p_", "a" * 36),
        "# " + token("gh", "p_", "b" * 36),
        token("AK", "IA", "ABCDEFGHIJKLMNOP") + " x " + token("AK", "IA", "ABCDEFGHIJKLMNOQ"),
        token("S", "K", "0" * 32),
        "postgres://u:" + token("pa", "ss") + "@h/db",
        'password = "' + "Xk9-mQ2vLp8wRt4nZs6yBdFh" + '"',
        "token = config.settings.Password",
        "secret: ${VALUE_FROM_ELSEWHERE}",
        "DOTENV_PUBLIC_KEY=03" + "ab" * 32,
    ])
    got = [(r, n) for r, n, *_ in findings.scan_text(text)]
    assert got == [("github-pat", 1), ("aws-access-key-id", 3), ("aws-access-key-id", 3), ("database-url-postgres", 5), ("generic-secret", 6)]
    assert ("twilio-api-key", 4) in [(r, n) for r, n, *_ in findings.scan_text(text + "\ntwilio")]
    whole = findings.scan_text('{"type": "service_account",\n"private_key": "' + token("-----BEGIN", " PRIVATE KEY-----") + '"}')
    assert ("gcp-service-account", 1, 2) in [x[:3] for x in whole]


def test_needles_miss_nothing():
    # every rule on every line, without the texts that gate it
    def plainly(text):
        out = []
        lowered = text.lower()
        for at, line in enumerate(text.splitlines()):
            if not line.strip() or findings._quiet(line, ("#",)):
                continue
            for rule, pattern, _ in rules.compiled():
                if rule.whole or rule.gated and not any(k in lowered for k in rule.keywords):
                    continue
                for m in pattern.finditer(line):
                    secret = m.group(1) if m.re.groups else m.group()
                    if secret is None or findings._EC_KEY.match(secret):
                        continue
                    if rule.id == "generic-secret" and (findings.bits(secret) < findings.SECRET_BITS or secret.startswith(("$", "%", "{", "\\${")) or classify.member_access(secret)):
                        continue
                    out.append((rule.id, at + 1, m.start() + 1, secret, None))
        return out

    words = ["\u017fecret", "pa\u017f\u017fword", "to\u212aen", "TOKEN", "Secret", "\u0130", "=", ":", " ", "\n", "\u2028", "#", "'", '"', "Xk9-mQ2vLp8wRt4nZs6yBdFh", "api_key", "ghp_" + "a" * 36, "AKIA" + "A" * 16, "redis://:", "x@h", "authorization: bearer ", "eyJa.eyJb.c", "twilio SK" + "0" * 32, "é"]
    rnd = random.Random(4)
    for _ in range(3000):
        text = "".join(rnd.choices(words, k=rnd.randrange(12)))
        assert findings.scan_text(text) == plainly(text), text


def test_high_entropy():
    lines = ["k=aB3dE5gH7jK9mN1pQ2sT4vW6xYzZ0", "u=https://aB3dE5gH7jK9mN1pQ3sT5vW7", "w=abcdefghijklmnopqrstuvwxyz", "// k=aB3dE5gH7jK9mN1pQ2sT4vW6xYzZ0", "f={T:G}|{Message}|{aB3}|{Y}x"]
    assert [(r, n) for r, n, *_ in findings.scan_text("\n".join(lines), entropy=True, patterns=False)] == [("high-entropy-string", 1)]


def finding(path, line, rule, severity, hash_=None, verified=False, scanner="native", preview=None):
    return (path, rule, rule, severity, line, None, preview, hash_, None, scanner, verified)


def test_dedup_scenarios(spark):
    def run(rows, **how):
        df = spark.createDataFrame(rows, findings.FINDING)
        once = findings.dedup(df, **how)
        assert findings.dedup(once, **how).count() == once.count()
        return sorted((r.rule_id, r.severity, r.secret_hash, r.verified, r.scanner) for r in once.collect())

    f = finding
    assert len(run([f("p", 1, "r", "high", "h"), f("p", 1, "r", "high", "h", scanner="other")])) == 1
    assert run([f("p", 1, "r", "low", "h"), f("p", 1, "r", "high", "h")])[0][1] == "high"
    assert run([f("p", 1, "r", "high", "h"), f("p", 1, "r", "high", "h", True)])[0][3] is True
    assert len(run([f("p", 1, "r", "high", "h"), f("p", 1, "r", "high", "g")])) == 2
    assert run([f("p", 1, "r", "high", "h"), f("p", 1, "r", "high")]) == run([f("p", 1, "r", "high", "h")])
    assert len(run([f("p", 1, "r", "high", "h"), f("p", 1, "r", "critical")])) == 2
    assert len(run([f("p", 1, "r", "high", "h"), f("q", 9, "s", "high", "h")], unique_secret=True)) == 1
    assert len(run([f("p", None, "r", "high"), f("p", None, "r", "high"), f("p", None, "s", "high")])) == 2


def test_guard_reads_once_what_its_operators_find(spark):
    rnd = random.Random(8)
    pat, oauth = token("gh", "p_", "a" * 36), token("gh", "o_", "b" * 36)
    lines = [f"x {pat}", f"A={pat}", f"B=encrypted:{pat}", f"# {oauth}", f"C=ENC[AES256_GCM,{pat}]", f"{oauth} # keelson:ignore", f"{oauth} // KeelSon:ignore:github-oauth", f"{pat} /* keelson:ignore:other */", "sops_version=3", "# sops_mac=1", f"DOTENV_PUBLIC_KEY={pat}", f"DOTENV_PUBLIC_KEY_CI={oauth}", "", "  ", "k=aB3dE5gH7jK9mN1pQ2sT4vW6xYzZ0", "\u2028", f"'q {oauth}", "sops:"]
    paths = ["a.txt", "b.env", ".env.prod", "c.secret", "d.clear", "e/.env.keys", "f.lock"]
    rows = [(f"{i}/{rnd.choice(paths)}", rnd.choice(["\n", "\r\n"]).join(rnd.choices(lines, k=rnd.randrange(6))), rnd.random() < 0.7) for i in range(250)]
    df = spark.createDataFrame([*rows, ("none.env", None, True)], "path string, content string, tracked boolean")
    for entropy in (False, True):
        found = findings.scan(df.where(~F.col("path").endswith(".clear") & F.col("content").isNotNull()), entropy=entropy).unionByName(findings.policy(df.where("content is not null")))
        found = findings.without_ciphertext(findings.without_clear(found), df)
        found = findings.without_public_keys(found, dotenv.assignments(dotenv.parse_files(df.select("path", "content"))))
        found = findings.dedup(findings.suppress(found, dotenv.text_lines(df.select("path", "content")), noisy_paths=("*.lock",)))
        got = findings.guard(df, entropy=entropy, noisy_paths=("*.lock",))
        assert sorted(map(str, got.collect())) == sorted(map(str, found.collect())) and got.count() > 100


def test_verdicts(spark):
    rows = [finding("b", 2, "r", "low"), finding("a", 9, "r", "high"), finding("a", None, "r", "high"), finding("a", 3, "r", "info")]
    df = spark.createDataFrame(rows, findings.FINDING)
    runs = spark.createDataFrame([("native", None, 1), ("x", "boom", 0)], "scanner string, error string, files_scanned long")
    code = lambda d, **k: findings.exit_code(d, **k).first().exit_code
    asked = spark.createDataFrame([("x", "boom", True)], "scanner string, error string, explicit boolean")
    assert [code(df.limit(0), runs=asked), code(df.limit(0), runs=asked.withColumn("explicit", F.lit(False)))] == [5, 0]
    assert [code(df), code(df, fail_on="critical"), code(df, runs=runs, fail_on="critical"), code(df.where("severity = 'info'")), code(df.limit(0), runs=runs), code(df.limit(0))] == [2, 0, 5, 0, 5, 0]
    assert [(r.severity, r.path, r.line_number) for r in findings.ordered(df).collect()] == [("high", "a", 9), ("high", "a", None), ("low", "b", 2), ("info", "a", 3)]
    assert {r.severity: r.n for r in findings.by_severity(df).collect()} == {"critical": 0, "high": 2, "medium": 0, "low": 1, "info": 1}
    some = spark.createDataFrame([("a", "x"), ("b", "y" * 50), ("c", None), ("d", "")], "path string, content string")
    assert [tuple(r) for r in findings.run_of(some, most_bytes=20).collect()] == [("native", None, 2)]
    assert json.loads(render.scan_json(df, findings.run_of(some)).first().report)["scanners"] == [{"scanner": "native", "files_scanned": 3}]
    report = json.loads(render.scan_json(df, runs).first().report)
    assert report["exit_code"] == 2 and report["summary"]["high"] == 2 and len(report["findings"]) == 4
    doc = json.loads(render.sarif(df.withColumn("path", F.lit("/r/a b.env")), "/r").first().sarif)
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and run["tool"]["driver"]["rules"][0]["properties"]["security-severity"] == "7.0" and run["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "a%20b.env"


def test_suppression(spark):
    secret = token("gh", "p_", "a" * 36)
    texts = [
        (".env", f"A={secret}\nB=encrypted:x {secret}", True),
        ("a.txt", f"{secret} # keelson:ignore\n{secret} # KEELSON:ignore:github-pat reason='x'\n{secret} # keelson:ignore:other\n{secret}", True),
        ("x/yarn.lock", "password = Xk9-mQ2vLp8wRt4nZs6yBdFh", True),
        ("b.clear", secret, True),
        ("sub/.env.keys", "DOTENV_PRIVATE_KEY=x", True),
        ("c/prod.env", "A=1", False),
        ("c/db.secret", "A=1", False),
        ("ignored.txt", secret, False),
    ]
    df = spark.createDataFrame(texts, "path string, content string, tracked boolean")
    ignored = spark.createDataFrame([("ignored.txt",)], "path string")
    found = findings.guard(df, ignored=ignored, noisy_paths=("*.lock",), ignore_rules={"unencrypted-env-file": ("c/*",)})
    got = sorted((r.path, r.rule_id, r.line_number or 0) for r in found.collect())
    assert got == [(".env", "github-pat", 1), ("a.txt", "github-pat", 3), ("a.txt", "github-pat", 4), ("c/db.secret", "unencrypted-secret-file", 0), ("sub/.env.keys", "committed-private-key", 0)]
    paths = ["/repo/sub/pyproject.toml", "a/tests/b", "x.pyc", "src/[a].txt", ".env.test", "m.test"]
    assert col(spark, paths, lambda p: findings.matches_path(p, ("pyproject.toml",))) == [True] + [False] * 5
    assert col(spark, paths, lambda p: findings.ignored_by_default(p, ("*.pyc", "[!.]*.test"))) == [False, False, True, False, False, True]
    keyed = spark.createDataFrame([finding("p", 1, "r", "high", "x")], findings.FINDING).withColumn("secret_hash", F.sha2(F.lit("03ab").cast("binary"), 256))
    names = spark.createDataFrame([("p", "DOTENV_PUBLIC_KEY_A", "03ab")], "path string, name string, value string")
    assert findings.without_public_keys(keyed, names).count() == 0
    shown = spark.createDataFrame([("p", "real/p")], "path string, display_path string")
    assert findings.remap(keyed, shown).first().path == "real/p"


def test_key_material():
    n = "DOTENV_PRIVATE_KEY_"
    cases = [
        (" 'abc' ", ("abc", None, None)), (f'{n}PROD=" abc"', (" abc", "PROD", None)), (f'"{n}PROD=abc"', ("abc", "PROD", None)), (json.dumps({f"{n}PROD": "x"}), ("x", "PROD", None)),
        (json.dumps({f"{n}PROD": "x", f"{n}DEV": "y"}), ("x", "PROD", None)), (json.dumps({"value": f"{n}DEV=z"}), ("z", "DEV", None)), (f"# c\n{n}DEV=a\n{n}PROD=b", ("b", "PROD", None)), (json.dumps({f"{n}PROD": f"{n}PROD=x"}), ("x", "PROD", None)),
    ]
    for raw, want in cases:
        assert keys.normalized(raw, "prod") == want
    for raw in ("[1]", '{"a":1}', "x\ny", f"{n}A=1\n{n}B=2", f"{n}PROD=1\n{n}PROD=2"):
        assert keys.normalized(raw, "prod")[2]


def test_sync_outcomes(spark):
    m = [("s1", "f1", "prod", None, False, "found"), ("s2", "f2", None, "dev", False, "found"), ("s3", "f3", "prod", None, True, "found"), ("s4", "f4", "prod", None, False, "found"), ("s5", "f5", "prod", None, False, "not_found"), ("s6", "f6", "prod", None, False, "folder_not_found"), ("s7", "f7", "prod", None, False, "found"), ("s8", "f8", "prod", None, False, "found")]
    mappings = spark.createDataFrame(m, "secret_name string, folder string, environment string, profile string, ephemeral boolean, status string")
    vault = spark.createDataFrame([("s1", "a"), ("s2", "b"), ("s3", "c"), ("s7", "DOTENV_PRIVATE_KEY_DEV=x"), ("s8", "new")], "secret_name string, value string")
    local = spark.createDataFrame([("f1", "DOTENV_PRIVATE_KEY_PROD", "a"), ("f8", "DOTENV_PRIVATE_KEY_PROD", "old")], "folder string, key_name string, value string")
    run = lambda **k: {r.secret_name: r.action for r in reconcile.sync(mappings, vault, local, **k).collect()}
    assert run() == {"s1": "skipped", "s2": "created", "s3": "ephemeral", "s4": "error", "s5": "skipped", "s6": "error", "s7": "error", "s8": "skipped"}
    assert run(force=True)["s8"] == "updated"
    assert run(verify=True) == {"s1": "skipped", "s2": "error", "s3": "ephemeral", "s4": "error", "s5": "error", "s6": "error", "s7": "error", "s8": "error"}
    c = reconcile.counts(reconcile.sync(mappings, vault, local)).first()
    assert (c.created, c.error, c.total, c.has_errors) == (1, 3, 8, True)
    lock = {r.secret_name: r.verdict for r in reconcile.verify_lock(mappings, vault, local).collect()}
    assert (lock["s1"], lock["s8"], lock["s2"]) == ("match", "mismatch", "unavailable")
    assert reconcile.profile_filter(mappings).count() == 7 and reconcile.profile_filter(mappings, "dev").count() == 8


def test_other_inventories(spark):
    requested = spark.createDataFrame([("f", "age", "k1"), ("f", "age", "k2"), ("f", "azure_kv", "https://v/keys/n/1"), ("f", "azure_kv", "https://v/keys/n/2")], "path string, kind string, recipient string")
    meta = [("f", "sops_age__list_0__map_recipient", "k1"), ("f", "sops_azure_kv__list_0__map_vault_url", "https://v"), ("f", "sops_azure_kv__list_0__map_name", "n"), ("f", "sops_azure_kv__list_0__map_version", "1"), ("f", "sops_azure_kv__list_1__map_version", "2")]
    got = reconcile.missing_recipients(requested, spark.createDataFrame(meta, "path string, key string, value string")).collect()
    assert {r.recipient for r in got} == {"k2", "https://v/keys/n/2"}
    lines = spark.createDataFrame([("f", 1, "DOTENV_PRIVATE_KEY_OLD"), ("f", 2, "DOTENV_PRIVATE_KEY_X"), ("g", 1, "DOTENV_PRIVATE_KEY_PROD")], "folder string, line_number int, name string")
    wanted = spark.createDataFrame([("f", "DOTENV_PRIVATE_KEY_PROD"), ("g", "DOTENV_PRIVATE_KEY_PROD")], "folder string, key_name string")
    assert [(r.folder, r.stale_name) for r in reconcile.stale_key(lines, wanted).collect()] == [("f", "DOTENV_PRIVATE_KEY_OLD")]
    on = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("d", True)], "project string, failed boolean")
    off = spark.createDataFrame([("b",), ("d",), ("e",)], "project string")
    assert {r.project: r.action for r in reconcile.registry(on, off).collect()} == {"a": "start", "b": "keep", "c": "wait", "d": "keep", "e": "stop"}
    patterns = spark.createDataFrame([("p", ".env*")], "project string, pattern string")
    mapped = spark.createDataFrame([("p", ".env.x"), ("p", "db.env")], "project string, name string")
    assert {r.pattern for r in reconcile.more_patterns(patterns, mapped).collect()} == {".env*", "db.env"}
    assert [r.schema for r in reconcile.schema_for(spark.createDataFrame([("a",), ("b",)], "environment string"), {"a": "A"}, "D").orderBy("environment").collect()] == ["A", "D"]
    assert reconcile.not_ignored(mapped.select(F.col("name").alias("path")), mapped.limit(1).select(F.col("name").alias("path"))).count() == 1


def test_documents(spark):
    parts = spark.createDataFrame([("f", "secret", 1, "S=encrypted:x"), ("f", "clear", 2, "B=2"), ("f", "clear", 1, "A=1"), ("f", "secret", 2, "DOTENV_PUBLIC_KEY=x")], "path string, section string, line_number int, line string")
    built = render.combined(parts, "# made\n")
    assert built.first().text == "# made\nA=1\nB=2\nS=encrypted:x\nDOTENV_PUBLIC_KEY=x\n" and built.first().clear_lines == 2
    assert render.merged(parts).first().text == "A=1\nB=2\nS=encrypted:x\n"
    there = spark.createDataFrame([("f", built.first().text)], "path string, content string")
    assert render.in_sync(built, there).first().in_sync and not render.in_sync(built, there.withColumn("content", F.lit(""))).first().in_sync
    lines = spark.createDataFrame([("f", 1, "K=old"), ("f", 2, "X=1")], "path string, line_number int, line string")
    new = spark.createDataFrame([("f", "K", "new", "prod"), ("f", "L", "l", "dev")], "path string, key string, value string, environment string")
    assert [r.line for r in render.upsert_key(lines, new).orderBy("line_number").collect()] == ["K=new", "X=1", "# dev", "L=l"]
    assert render.identifiers(["A", "a-b", "a_b", "1x", "class"]) == {"1x": "field_1x", "A": "a", "a-b": "a_b", "a_b": "a_b_2", "class": "class_"}
    source = render.contract_module([{"field": "API_KEY", "type": "str", "sensitive": True}, {"field": "x-y", "type": "int"}])
    compile(source, "m", "exec")
    assert 'api_key: str = Field(json_schema_extra={"sensitive": True})' in source and "x_y: int = Field(validation_alias='x-y')" in source


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, raw in {"a.env": b"A=1", "b": "K=é".encode("utf-16"), "c": "KEY=value9".encode("utf-16-le"), "d/e": b"\x00\x01\x02\x03" * 9, "f": b" \n", "node_modules/x": b"y", "g": b"ok\xff"}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: r.content for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.env": "A=1", "b": "K=é", "c": "KEY=value9", "g": "ok"}
    good, bad = files.read_strict(spark, str(tmp_path / "*"))
    assert {r.path.rsplit("/", 1)[1] for r in bad.collect()} >= {"g"} and good.count() >= 2
    listed = spark.createDataFrame([("a", True, False), ("b", False, True), ("x/.env.local", False, True), (".env.keys", False, True), ("c", False, False), ("m", False, True)], "path string, tracked boolean, ignored boolean")
    assert [r.path for r in files.listing(listed, ("m",)).collect()] == ["a", "c", "m", "x/.env.local"]
    tree = spark.createDataFrame([("f", ".env"), ("f", ".env.dev"), ("f", ".env.example"), ("g", "a-dev.env"), ("g", "b-dev.env"), ("h", "x")], "folder string, name string")
    want = spark.createDataFrame([("f", "production", None), ("f", "dev", None), ("g", "dev", None), ("h", "dev", None), ("h", "dev", "x"), ("z", "dev", None)], "folder string, environment string, env_file string")
    there = tree.select("folder").distinct()
    out = {(r.folder, r.environment, r.env_file): (r.name, r.status) for r in files.env_files(tree, want, there).collect()}
    assert out == {("f", "production", None): (".env", "found"), ("f", "dev", None): (".env.dev", "found"), ("g", "dev", None): (None, "multiple_found"), ("h", "dev", None): (None, "not_found"), ("h", "dev", "x"): ("x", "found"), ("z", "dev", None): (None, "folder_not_found")}
    (tmp_path / "r.json").write_text('{"projects": [{"path": "/p", "added": "1"}]}')
    (tmp_path / "s.json").write_text("{broken")
    assert [r.path for r in files.registry(spark, str(tmp_path / "r.json")).collect()] == ["/p"] and files.registry(spark, str(tmp_path / "s.json")).count() == 0
    (tmp_path / "pyproject.toml").write_text("[tool.keelson]\nschmea = 1\n[[tool.keelson.maps]]\nfoldr = 2\n")
    found = files.find_config(tmp_path / "d")
    assert found == tmp_path / "pyproject.toml"
    assert files.unknown_keys(files.load_config(found), {"schema": None, "maps": [{"folder": None}]}) == [("schmea", "schema"), ("maps.foldr", "folder")]
    assert [files.idle_timeout(t).total_seconds() for t in ("30s", "5m", "1h30m", "1d", "x")] == [30, 300, 5400, 86400, 300]
    same = spark.createDataFrame([("a\r\nb ", "a\nb")], "a string, b string")
    assert same.select(files.same_text(F.col("a"), F.col("b")).alias("x")).first().x


def test_reports(spark, tmp_path):
    def write(name, data, many=False):
        (tmp_path / name).write_text("\n".join(map(json.dumps, data)) if many else json.dumps(data))
        return str(tmp_path / name)

    g = reports.gitleaks(spark, write("g", [{"RuleID": "aws", "File": "a", "StartLine": 3, "Secret": "secretsecret", "Entropy": 3.5, "Commit": "c"}])).first()
    assert (g.rule_id, g.severity, g.line_number, g.secret_preview, g.entropy, g.commit_sha) == ("gitleaks-aws", "high", 3, "secr****cret", 3.5, "c")
    t = reports.trufflehog(spark, write("t", [{"DetectorName": "AWS Key", "Verified": True, "Raw": "r", "SourceMetadata": {"Data": {"Git": {"file": "b", "line": 2, "email": "e"}}}}], True)).first()
    assert (t.rule_id, t.severity, t.path, t.verified, t.commit_author) == ("trufflehog-aws-key", "critical", "b", True, "e")
    k = reports.kingfisher(spark, write("k", [{"rule": {"id": "k1", "name": "n"}, "finding": {"path": "p", "line": 1, "snippet": "s", "validation": {"status": "Active"}}}], True)).first()
    assert (k.rule_id, k.severity, k.verified) == ("kingfisher-k1", "critical", True)
    lines = spark.createDataFrame([("t", 1, "key = abc123 end")], "path string, line_number int, line string")
    v = reports.trivy(spark, write("v", {"Results": [{"Target": "t", "Secrets": [{"RuleID": "r", "Severity": "CRITICAL", "Title": "T", "StartLine": 1, "Match": "key = ****** end"}]}]}), lines).first()
    assert (v.severity, v.secret_hash) == ("critical", __import__("hashlib").sha256(b"abc123").hexdigest())
    s = reports.talisman(spark, write("s", {"results": [{"filename": "f", "failure_list": [{"type": "filecontent", "message": 'Potential secret pattern : "abcd..."', "severity": "low"}]}]})).first()
    assert (s.rule_id, s.severity, s.secret_hash) == ("talisman-filecontent", "low", __import__("hashlib").sha256(b"abcd").hexdigest())
    both = reports.union({"z": spark.createDataFrame([finding("p", 1, "r", "high")], findings.FINDING), "a": reports.infisical(spark, write("i", [{"RuleID": "q", "File": "x"}]))})
    assert both.count() == 2
    assert dotenv.parse("").assignments == []


def test_history_mixed_files_and_constraints(spark):
    secret = token("gh", "p_", "a" * 36)
    blobs = spark.createDataFrame([("b1", f"k={secret}"), ("b2", "x")], "blob string, content string")
    commits = spark.createDataFrame([("b1", "f", "c1", "me", "d"), ("b1", "g", "c2", "me", "d")], "blob string, path string, commit_sha string, commit_author string, commit_date string")
    assert {(r.path, r.commit_sha, r.rule_id) for r in findings.scan_history(blobs, commits).collect()} == {("f", "c1", "github-pat"), ("g", "c2", "github-pat")}
    texts = [("a", "A=ENC[AES256_GCM,x]\nB=plain\nC_unencrypted=ok\nB=again\nsops_mac=1"), ("b", "A=x\nsops_encrypted_regex=^A"), ("c", "A=x\nB_p=1\nsops_unencrypted_suffix=_p")]
    df = spark.createDataFrame(texts, "path string, content string")
    assert {(r.path, r.name, r.line_number) for r in findings.surviving_plaintext(df).collect()} == {("a", "B", 2), ("c", "A", 1)}
    assert [r.path for r in findings.mixed_files(df).collect()] == ["a"]
    bound = spark.createDataFrame([("port", "70000"), ("host", "h")], "field string, value string")
    checks = {"port": ("try_cast(value as int) between 1 and 65535", "no port"), "host": ("length(value) > 0", "empty")}
    assert [(r.field, r.message) for r in contract.constrained(bound, checks).collect()] == [("port", "no port")]
    assert contract.constrained(bound, {}).count() == 0


def test_api(spark):
    from keelson import api

    dev, prod = "A=1\nB=true\nMY_KEY=x\n", "A=1\nB=yes\nC=3\n"
    files_ = spark.createDataFrame([("dev", dev), ("prod", prod)], "path string, content string")
    assert {(r.name, r.diff_type) for r in api.diff(files_, "dev", "prod").collect()} == {("C", "added"), ("MY_KEY", "removed")}
    fields = api.init(files_.where("path = 'dev'"))
    assert {(r.field, r.type, r.sensitive) for r in fields.collect()} == {("A", "int", False), ("B", "bool", False), ("MY_KEY", "str", True)}
    kinds = {(r.path, r.kind) for r in api.validate(files_, fields).collect()}
    assert kinds == {("prod", "missing_required"), ("prod", "extra"), ("dev", "unencrypted")}
    assert api.guard(files_.withColumn("tracked", F.lit(True))).count() == 0
