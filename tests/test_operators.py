import random
import re

import pytest
from pyspark.sql import functions as F

from gristmill.functions import regex, severity
from gristmill.operators import chunks, clones, dashboard, detectors, findings, intervals, learning, metrics, policy, rules, supply
from gristmill.sources import cache, files, responses, sinks
from gristmill.streaming import counters

FINDING = "ord long, type string, severity string, file_path string, line_start long, line_end long, message string, suggestion string, confidence double, category string"
CASES = [
    (0, "security", "critical", "app.py", 10, 12, "SQL injection vulnerability detected", "yes", 0.95, "security"),
    (1, "security", "critical", "app.py", 11, 13, "SQL injection vulnerability detected", "yes", 0.90, "security"),
    (2, "performance", "medium", "utils.py", 50, 55, "Inefficient loop detected", "yes", 0.75, "performance"),
    (3, "correctness", "high", "app.py", 100, 102, "Potential null pointer exception", "yes", 0.85, "correctness"),
    (4, "maintainability", "low", "utils.py", 200, 205, "Function too long", None, 0.70, "quality"),
]


@pytest.fixture
def some(spark):
    return spark.createDataFrame(CASES, FINDING)


def test_similar_findings_fold(some):
    kept = findings.dedup_similar(some, ["ord"]).collect()
    assert len(kept) == 4 and {r["confidence"] for r in kept if r["severity"] == "critical"} == {0.95}


def test_priority_puts_critical_security_first(some):
    first = findings.priority(some).orderBy(F.desc("priority_score"), "ord").first()
    assert first["ord"] == 0 and first["priority_score"] == 100.0 and "security-related" in first["reasons"]


def test_groups(some):
    by_file = {r["file_path"]: r for r in findings.by_file(some).collect()}
    assert by_file["app.py"]["findings"] == 3 and by_file["utils.py"]["lines"] == [50, 200]
    assert findings.summary(some).first()["actionable"] == 4


def test_filters(some):
    assert findings.filter_findings(some, "medium", "high", 0.8).count() == 1
    assert findings.filter_findings(some, file_patterns=["util*"]).count() == 2
    with pytest.raises(ValueError):
        findings.filter_findings(some, "grave")
    assert findings.ci_status(some).first()["state"] == "FAILURE"


def _levels(spark, levels):
    return spark.createDataFrame([(x, "f") for x in levels], "severity string, file_path string")


def test_debt_and_scores(spark):
    d = _levels(spark, ["critical", "critical", "high", "medium", "low", "info"])
    assert d.agg(dashboard.debt_hours()).first()[0] == 23.5
    s = _levels(spark, ["critical", "high", "medium"])
    assert s.agg(dashboard.quality_score(F.lit(10))).first()[0] == 83.0
    assert s.limit(0).agg(dashboard.quality_score(F.lit(10))).first()[0] == 100.0
    assert s.agg(dashboard.quality_score(F.lit(0))).first()[0] == 100.0


@pytest.mark.parametrize(("values", "direction", "rate"), [([100, 90, 80, 70, 60], "improving", 40.0), ([60, 70, 80, 90, 100], "declining", None), ([50, 51, 49, 50, 51], "stable", None), ([50], "stable", 0.0), ([100, 90, 80, 70], "improving", 30.0), ([0, 5], "declining", 0.0)])
def test_trend(spark, values, direction, rate):
    s = spark.createDataFrame([("p", i, v) for i, v in enumerate(values)], "k string, i int, v long")
    r = dashboard.trend(s, "k", ["i"], "v").first()
    assert r["direction"] == direction and (rate is None or r["improvement_rate"] == rate)


def _feedback(spark, rule, accept, reject, skip=0, severity_="high"):
    return [(rule, k, severity_) for k, n in (("accept", accept), ("reject", reject), ("skip", skip)) for _ in range(n)]


def test_learning(spark):
    schema = "rule_id string, feedback_type string, severity string"
    f = spark.createDataFrame(_feedback(spark, "r", 2, 1, 1), schema)
    s = learning.feedback_stats(f).first()
    assert (s["accept_rate"], s["reject_rate"]) == (0.5, 0.25)
    f = spark.createDataFrame(_feedback(spark, "noisy", 3, 7) + _feedback(spark, "good", 8, 2) + _feedback(spark, "loved", 9, 1) + _feedback(spark, "weak", 2, 3, 5), schema)
    assert [r["rule_id"] for r in learning.false_positive_rules(f).collect()] == ["noisy"]
    a = {r["rule_id"]: r for r in learning.rule_adjustments(f).collect()}
    assert a["noisy"]["suppress"] and not a["good"]["suppress"] and a["loved"]["multiplier"] > 1 and a["weak"]["adjusted_severity"] == "medium"
    x = spark.createDataFrame([("noisy", "high", 0.5), ("weak", "high", 0.5), ("new", "low", 0.5)], "rule_id string, severity string, confidence double")
    out = {r["rule_id"]: r for r in learning.apply_learning(x, learning.rule_adjustments(f)).collect()}
    assert set(out) == {"weak", "new"} and out["weak"]["severity"] == "medium" and out["weak"]["original_severity"] == "high"


def test_policy(spark, some):
    v = policy.severity_rule(some.withColumn("k", F.lit(1)), "k", 0).collect()
    assert [(r["rule"], r["found"]) for r in v] == [("severity-critical", 2)]
    p = spark.createDataFrame([("p", ["pre-commit"], [], [], True, 1, "block", "strict"), ("q", ["merge"], ["main"], [], True, 2, "warn", "flexible")], "id string, scope array<string>, branches array<string>, exclude_branches array<string>, enabled boolean, priority int, action string, enforcement string")
    assert [r["id"] for r in policy.applicable(p, "pre-commit", "x").collect()] == ["p"] and policy.applicable(p, "merge", "dev").count() == 0
    r = {x["id"]: x for x in policy.verdicts(spark.createDataFrame([("p",), ("q",)], "policy_id string"), p).collect()}
    assert r["p"]["blocks"] and not r["q"]["blocks"] and r["q"]["can_override"]


def test_manifests(spark):
    m = spark.createDataFrame([("a/requirements.txt", "# c\nflask==2.0.1\nrequests>=2\n-r x\n"), ("go.mod", "module m\nrequire (\n\tgithub.com/a/b v1.2.3\n)\nrequire x/y v0.1.0\n"), ("Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = "1.0"\ntokio = { version = "1.2", features = [] }\n'), ("package.json", '{"dependencies": {"react": "^18.0"}, "devDependencies": {"jest": "~29"}}')], "file_path string, content string")
    got = {(r["ecosystem"], r["name"], r["version"]) for r in supply.dependencies(m).collect()}
    assert got == {("PyPI", "flask", "2.0.1"), ("PyPI", "requests", "2"), ("Go", "github.com/a/b", "1.2.3"), ("Go", "x/y", "0.1.0"), ("crates.io", "serde", "1.0"), ("crates.io", "tokio", "1.2"), ("npm", "react", "18.0"), ("npm", "jest", "29")}


def test_diffs(spark):
    d = spark.createDataFrame([("f", "--- a\n+++ b\n@@ -1 +1,2 @@ x\n-a\n+b\n+c\n@@ -9,2 +10,1 @@\n d\n-e")], "file_path string, diff string")
    r = sorted(intervals.parse_diffs(d).collect(), key=lambda x: x["hunk"])
    assert [(x["old_start"], x["old_count"], x["new_start"], x["new_count"], x["lines"]) for x in r] == [(1, 1, 1, 2, ["-a", "+b", "+c"]), (9, 2, 10, 1, [" d", "-e"])]


def _conflicts(fixes):
    fixes, out, i = sorted(fixes), [], 0
    while i < len(fixes):
        cluster, j = [fixes[i]], i + 1
        while j < len(fixes) and fixes[j][0] <= fixes[i][1]:
            cluster.append(fixes[j])
            j += 1
        best = cluster[0]
        for c in cluster[1:]:
            if c[3] > best[3]:
                best = c
        out.append(best)
        i = j
    return out


def test_fix_conflicts_against_the_sequential_rule(spark):
    r = random.Random(4)
    rows, want = [], set()
    for f in range(40):
        own = [(s := r.randrange(40), s + r.randrange(9), k, r.randrange(4) / 4) for k in range(r.randrange(1, 15))]
        rows += [(str(f), *x) for x in own]
        want |= {(str(f), *x) for x in _conflicts(own)}
    df = spark.createDataFrame(rows, "file_path string, line_start long, line_end long, ord long, confidence double")
    assert {tuple(x) for x in intervals.resolve_conflicts(df).collect()} == want


def test_apply_fixes(spark):
    f = spark.createDataFrame([("a", "1\n2\n3\n4"), ("b", "x")], "file_path string, content string")
    x = spark.createDataFrame([("a", 2, 2, "two\nand a half"), ("a", 4, 4, "four")], "file_path string, line_start long, line_end long, new_code string")
    assert {r["file_path"]: r["content"] for r in intervals.apply_fixes(f, x).collect()} == {"a": "1\ntwo\nand a half\n3\nfour", "b": "x"}


def test_clone_blocks_against_all_starts(spark):
    r = random.Random(8)
    texts = {f"f{k}": [r.choice(["a", "b", "c", "", "# x"]) for _ in range(30)] for k in range(5)}
    want = set()
    for f, a in texts.items():
        for g, b in texts.items():
            if f > g:
                continue
            for i in range(30):
                for j in range(30):
                    n = 0
                    while i + n < 30 and j + n < 30 and a[i + n] == b[j + n] and a[i + n] not in ("", "# x"):
                        n += 1
                    if n >= 3 and (f != g or j - i >= 3):
                        want.add((f, i + 1, g, j + 1, n))
    df = spark.createDataFrame([(f, "\n".join(x)) for f, x in texts.items()], "file_path string, content string")
    got = {tuple(x) for x in clones.clone_blocks(clones.code_lines(df), 3).collect()}
    assert got == want


def test_chunks(spark):
    df = spark.createDataFrame([("a", "\n".join(map(str, range(200)))), ("b", "x")], "file_path string, content string")
    got = sorted(chunks.line_chunks(df, 625, 10).collect(), key=lambda r: (r["file_path"], r["chunk"]))
    assert [(r["file_path"], r["start_line"], r["end_line"]) for r in got] == [("a", 1, 50), ("a", 41, 90), ("a", 81, 130), ("a", 121, 170), ("a", 161, 200), ("b", 1, 1)]
    assert got[0]["context"] is None and got[1]["context"] == "\n".join(map(str, range(30, 40)))


CODE = """
def simple(x):
    return x

def nested(a, b):
    if a:
        for i in b:
            if i and a or b:
                with open(i) as f:
                    assert f
    return [x for x in b if x]
"""


def test_python_metrics(spark):
    df = spark.createDataFrame([("a.py", "python", CODE), ("b.py", "python", "def ("), ("c.go", "go", CODE), ("d.py", "python", None)], "file_path string, language string, content string")
    m = {r["name"]: r for r in metrics.with_levels(metrics.python_metrics(df)).collect()}
    assert set(m) == {"simple", "nested"}
    s, n = m["simple"], m["nested"]
    assert (s["cyclomatic"], s["cognitive"], s["cyclomatic_level"], s["is_maintainable"]) == (1, 0, "low", True)
    assert n["cyclomatic"] == 1 + 3 + 2 + 1 + 1 + 1 and n["cyclomatic_analysis"] == 1 + 3 + 2 + 2
    assert n["cognitive"] == 1 + 2 + 3 + 2 and n["nesting"] == 3
    assert metrics.debt_minutes(metrics.python_metrics(df)).count() == 2


def test_sqale(spark):
    for ratio, rating in ((0.03, "A"), (0.15, "C"), (0.8, "E")):
        r = spark.range(1).select(*[c.alias(n) for c, n in zip(dashboard.sqale(F.lit(ratio * 500.0), F.lit(1000.0)), ("ratio", "rating"), strict=True)]).first()
        assert r["rating"] == rating


def test_rules_against_finditer(spark, sf):
    engine = rules.RulesEngine((*rules.DEFAULT_RULES, *rules.SAST_RULES))
    snippets = [(0, "python", 'password = "abcdefghij"\neval (x)\nprint(1) # TODO: y\nq = "SELECT a" + b\n'), (1, None, "debugger;\nMD5 sha1 Des\n"), (2, "JavaScript", "debugger ;\nel.innerHTML = x\n")]
    docs = snippets + [(10 + r["doc_id"], "python", r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame(docs, "doc_id long, language string, content string")
    got = {(r["doc_id"], r["rule_id"], r["line_start"], r["col"], r["matched"]) for r in engine.scan(df, keep=("doc_id", "language")).collect()}
    want = set()
    for i, lang, text in docs:
        for r in engine.rules.values():
            if r.languages and (lang or "").lower() not in r.languages:
                continue
            for m in re.finditer(r.pattern, text, 0 if r.case_sensitive else re.IGNORECASE):
                before = text[: m.start()]
                want.add((i, r.id, before.count("\n") + 1, m.start() - (before.rfind("\n") + 1) + 1, m[0]))
    assert got == want and len(want) > 100


def test_detectors_against_finditer(spark):
    texts = {
        "go": 'x := os.Open(base + name)\nfilepath.Clean(x)\n' + "y" * 300 + '\nos.Open(dir + f)\nexec.Command("sh " + cmd)\ncrypto/des\ninterface {}\ndefer f.Close()\napiKey := "abcdefghijklmnopqrstuvwx"\n',
        "java": 'catch (Throwable t) {}\nnew Date(1)\nsynchronized ("a") { }\nfor (x) { Pattern.compile("a") }\nBoolean.valueOf(true)\n',
        "javascript": "var a = `${x}`\nconsole.error(a)\ndb.query(`select ${x}`)\nnew Function(a)\nx.__proto__ = 1\n",
        "rust": "let y = transmute::<A, B>(x);\nunsafe fn g() {}\nv.len() == 0\nr.ok();\n",
    }
    df = spark.createDataFrame([(k, k, v) for k, v in texts.items()], "file_path string, language string, content string")
    got = {(r["language"], r["detector"], r["line_start"], r["matched"]) for r in detectors.detect(df, languages=texts).collect()}
    want = set()
    for lang, t in texts.items():
        for d in detectors.BY_LANGUAGE[lang]:
            f = sum({"i": re.I, "m": re.M, "s": re.S}[x] for x in d.flags)
            for m in re.finditer(d.pattern, t, f):
                near = t[max(0, m.start() - d.around) : m.end() + d.around]
                if not (d.around and any(w in near for w in d.unless)):
                    want.add((lang, d.id, t[: m.start()].count("\n") + 1, m[0]))
    assert got == want and len(want) > 20


def test_rule_files():
    r = rules.load_rules("rules:\n- {id: a, name: A, pattern: x, message: m, languages: [go]}\n")
    assert r[0].severity == "medium" and r[0].languages == ("go",)
    with pytest.raises(ValueError):
        rules.load_rules('{"rules": [{"id": "a"}]}', "json")
    e = rules.RulesEngine()
    assert e.enable("no-eval", False) and not e.rules["no-eval"].enabled and e.remove("no-eval") and not e.remove("no-eval")


def test_files(spark, tmp_path):
    for name, data in (("a.py", b"x"), ("b.pyc", b"x"), ("node_modules/c.js", b"x"), ("Makefile", b"x"), ("run", b"#!/usr/bin/env python\n"), ("bad.py", b"\xff\xfe\xff"), ("notes.txt", b"x"), ("big.py", b"x" * 3000)):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    got = {(r["file_path"], r["language"]) for r in files.read_files(spark, str(tmp_path), max_size=2000).collect()}
    assert got == {("a.py", "python"), ("Makefile", "makefile"), ("run", "python")}


def test_cache_and_responses(spark):
    f = spark.createDataFrame([("a",), ("b",)], "key string")
    c = spark.createDataFrame([("a", 100)], "key string, stored_at long")
    hit, miss = cache.split_by_cache(f, c, ["key"], 50, F.timestamp_seconds(F.lit(120)))
    assert [r[0] for r in hit.collect()] == ["a"] and [r[0] for r in miss.collect()] == ["b"]
    hit, _ = cache.split_by_cache(f, c, ["key"], 50, F.timestamp_seconds(F.lit(200)))
    assert hit.count() == 0
    a = spark.createDataFrame([(1, '```json\n[{"severity": "low", "message": "m"}]\n```'), (2, "sorry")], "k int, answer string")
    r = responses.parse_findings(a, "answer", ["k"]).collect()
    assert len(r) == 1 and r[0]["confidence"] == 1.0
    assert responses.ask(spark.createDataFrame([(1, "x")], "k int, content string"), str.upper, ["k"]).first()["answer"] == "X"


def test_sinks(some):
    assert '"level":"error"' in sinks.sarif_results(some).first()["result"]
    j = {r["file_path"]: r for r in sinks.junit_cases(some).collect()}
    assert j["app.py"]["failures"] == 3 and "<failure" in j["app.py"]["testcase"]
    assert {r["severity"] for r in sinks.markdown(some).collect()} == {"critical", "high", "medium", "low"}
    p = sinks.pr_comment(some.withColumn("review", F.lit(1)), ["review"], ["ord"], 3).first()
    assert (p["badge"], p["findings"], p["shown"]) == ("blocked", 5, 3)


def test_glob_forms(spark):
    df = spark.createDataFrame([("src/a/b.py",), ("b.pyc",)], "p string")
    assert [r[0] for r in df.select(regex.glob("p", "src/*.p?")).collect()] == [True, False]
    assert [r[0] for r in df.select(regex.prefix_glob("p", "src/a")).collect()] == [True, False]
    assert [r[0] for r in df.select(severity.shift(F.lit("critical"), 1)).collect()] == ["critical"] * 2


def test_running_counters(spark, tmp_path):
    rows = spark.createDataFrame([(1, "high"), (1, "low"), (2, "critical")], "review_id long, severity string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = counters.start(counters.running_counters(stream), "live_counters", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {(r["review_id"], r["total_findings"], r["critical"]) for r in spark.table("live_counters").collect()} == {(1, 2, 0), (2, 1, 1)}


BAD = '''
import os, json
from x import *

def run(request, a=[], b: int = 1):
    q = request.args.get("q")
    cursor.execute("select " + q)
    try:
        eval(q)
    except:
        pass
    if a == None or a is 3 or b == True:
        return 1
        print("never")
    for i in a:
        for j in a:
            for k in a:
                out += requests.get(f"http://{k}")
    # TODO later
    password = "abcdefghijk"
    return os.path

def twin():
    return 1

def twin():
    return 1
'''


def test_python_checks(spark):
    from gristmill.operators import python_checks

    df = spark.createDataFrame([("a.py", "python", BAD), ("b.py", "python", "def ("), ("c.go", "go", BAD), ("ok.py", "python", "x = 1\n")], "file_path string, language string, content string")
    got = [(r["file_path"], r["check"], r["line_start"]) for r in python_checks.check_files(df).collect()]
    want = {("a.py", c, n) for c, n in (("unused-import", 2), ("wildcard-import", 3), ("mutable-default", 5), ("partial-annotations", 5), ("return-annotation", 5), ("sql", 7), ("taint", 7), ("eval", 9), ("taint", 9), ("bare-except", 10), ("swallowed", 10), ("none-equality", 12), ("is-literal", 12), ("bool-equality", 12), ("unreachable", 14), ("nested-loops", 15), ("network-loop", 17), ("concat-loop", 16), ("ssrf", 18), ("todo", 19), ("secret", 20), ("duplicate", 26), ("unused-function", 23))}
    assert want <= set(got), want - set(got)
    assert ("b.py", "syntax", 1) in got and not any(f in ("c.go", "ok.py") for f, _, _ in got)


def test_fixes(spark):
    from gristmill.operators import fixes

    f = spark.createDataFrame([("a.py", "python", "import os\nif x == None:\n    pass\nexcept:\ns = \"a {} b\".format(v)\n"), ("b.js", "javascript", "var x = a == b\ny = x && x.z\n")], "file_path string, language string, content string")
    said = [("a.py", 1, 1, "Unused import: 'os'"), ("a.py", 2, 2, "Use 'is None' for None checks"), ("a.py", 4, 4, "Bare except clause"), ("a.py", 5, 5, "Use an f-string"), ("a.py", 3, 3, "Bare except"), ("b.js", 1, 1, "Use 'let' or 'const' instead of 'var'"), ("b.js", 2, 2, "Use optional chaining")]
    x = spark.createDataFrame(said, "file_path string, line_start long, line_end long, message string")
    got = {(r["file_path"], r["line_start"]): (r["fix"], r["new_code"]) for r in fixes.propose_fixes(x, f).collect()}
    assert got == {("a.py", 1): ("unused-import", ""), ("a.py", 2): ("none-comparison", "if x is None:"), ("a.py", 4): ("bare-except", "except Exception:"), ("a.py", 5): ("f-string", 's = f"a {v} b"'), ("b.js", 1): ("var", "const x = a == b"), ("b.js", 2): ("optional-chaining", "y = x?.z")}
    out = {r["file_path"]: r["content"] for r in intervals.apply_fixes(f, fixes.propose_fixes(x, f)).collect()}
    assert out["b.js"] == "const x = a == b\ny = x?.z\n"


def test_patterns_that_are_data(spark):
    import fnmatch

    patterns = ["*", "a*", "*.py", "src/*/x.?s", "[ab]*", "[!ab]*", "a[", "[", "a.b", "(x)", "a+b", "**/api/**", "$x^", "{a}", "a|b", "x\\\\y", "[]x]y", ""]
    files = ["a", "b.py", "src/m/x.js", "src/m/n/x.ts", "a[", "[", "a.b", "axb", "(x)", "a+b", "aab", "v1/api/get", "$x^", "{a}", "a|b", "x\\\\y", "]y", "xy", "", "a\nb"]
    from gristmill.functions import regex

    df = spark.createDataFrame([(f, p) for f in files for p in patterns], "f string, p string")
    got = {(r["f"], r["p"]): r["fits"] for r in df.select("f", "p", regex.glob_of(df["f"], df["p"]).alias("fits")).collect()}
    assert {k for k, v in got.items() if v} == {(f, p) for f in files for p in patterns if fnmatch.fnmatchcase(f, p)}


def test_templates_and_approvals(spark):
    p = policy.from_templates(spark)
    asked = lambda files: [r["id"] for r in policy.applicable(p, "pull-request", "dev", files).collect()]
    assert asked(["x/auth/y.py"]) == ["quality-gate", "security-critical", "security-review-required"]
    assert asked(["x/y.py"]) == ["quality-gate", "security-critical"] and "architecture-review" in asked(["x/api/y", "z"]) and len(asked([])) == 4
    v = spark.createDataFrame([("architecture-review",), ("quality-gate",), ("quality-gate",)], "policy_id string")
    got = {r["id"]: (r["violations"], r["requires_approval"], r["teams"], r["roles"], r["approvers"], r["warns"]) for r in policy.approvals(v, p).collect()}
    assert got == {"architecture-review": (1, True, [], ["architect", "tech-lead"], 1, False), "quality-gate": (2, False, [], [], 0, True)}


def test_store(spark, tmp_path):
    from gristmill.sources.store import Store

    s = Store(spark, str(tmp_path))
    assert s.project("a") == s.project("a") != s.project("b") and s.read("projects").count() == 2
    s.append("reviews", spark.createDataFrame([(1, 5), (2, 5)], "review_id long, project_id long"))
    s.append("findings", spark.createDataFrame([(1, "low", "b"), (1, "high", "a"), (2, "low", "c")], "review_id long, severity string, file_path string"))
    assert [r["severity"] for r in s.review_findings(1).collect()] == ["high", "low"] and s.recent_reviews(1).first()["review_id"] == 2


def test_presets_and_policy_files():
    from gristmill.plans import presets

    assert presets.compare("security", "quick")["min_severity"] == ("medium", "high")
    assert presets.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    p = policy.load_policies("policies:\n- {id: a, name: A, action: warn}\n- {id: b, name: B, action: block, priority: 2}\n")
    assert [x["id"] for x in p] == ["b", "a"]
    with pytest.raises(ValueError):
        policy.load_policies('{"policies": [{"id": "a"}]}', "json")


def test_blocks(spark):
    from gristmill.operators import braces

    go = 'go func() {\n\tfor i := range x {\n\t\ts += "a"\n\t}\n}()\ngo func() {\n\tselect {}\n}()\nfor {\n\tdefer f()\n\tdb.Query(q)\n}\n'
    js = "function f() {\n" + "  if (a && b) {}\n" * 6 + "}\nfunction g() { return 1 }\n"
    df = spark.createDataFrame([("a.go", "go", go), ("b.js", "javascript", js), ("c.py", "python", go)], "file_path string, language string, content string")
    got = {(r["file_path"], r["check"], r["line_start"], r["severity"]) for r in braces.check_blocks(df).collect()}
    assert got == {("a.go", "go-goroutine-leak", 1, "high"), ("a.go", "go-concat-loop", 2, "medium"), ("a.go", "go-defer-loop", 9, "medium"), ("a.go", "go-query-loop", 9, "high"), ("b.js", "js-complexity", 1, "low")}
