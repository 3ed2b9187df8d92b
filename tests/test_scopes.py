"""The table of scopes against programs whose scopes are known, and the checks that read it."""

import random
import re
from collections import defaultdict

import pytest

from gristmill.operators import scopes
from gristmill.operators.scope_checks import check_scopes
from gristmill.plans import samples

HEADS = {
    "go": {"loop": "for i := range xs {", "if": "if a {", "select": "select {", "go": "go func() {", "defer": "defer func() {", "closure": "f(func(a int) {", "block": "x = T{"},
    "java": {"loop": "for (int i = 0; i < n; i++) {", "if": "if (a && b(c)) {", "sync": "synchronized (this) {", "try": "try {", "closure": "f(x -> {", "while": "while (a) {"},
    "javascript": {"loop": "for (let i = 0; i < n; i++) {", "if": "if (a) {", "each": "xs.forEach((x) => {", "try": "try {", "closure": "f(function (x) {", "while": "while (a) {"},
}
LABELS = {"while": ["loop", "while"], "each": ["closure", "loop"]}
NOISE = {"go": ['s := "}{"', "// }", "/* { */", "r := '{'", "t := `}\n{`"], "java": ['String s = "}{";', "// }", "/* {\n */", "char c = '{';"], "javascript": ["s = '}{'", "// }", "/* { */", "t = `}${a}{`", "r = /[}]{/.test(a)"]}
FUNCTION = {"go": "func {}(a int) error {{", "java": "public List<A> {}(int a, B b) throws E {{", "javascript": "function {}(a, b) {{"}


def program(language, seed):
    """Source lines and, for each call ``markN``, the function, the line of the loop around it and the open labels."""
    r, lines, want, marks = random.Random(seed), [], {}, [0]

    def body(depth, fn, loop, labels):
        for _ in range(r.randrange(1, 5)):
            pad = "  " * (depth + 1)
            if r.random() < 0.3:
                lines.extend((pad + r.choice(NOISE[language])).split("\n"))
            elif depth < 5 and r.random() < 0.5:
                kind = r.choice(list(HEADS[language]))
                lines.append(pad + HEADS[language][kind])
                here, opened = len(lines), LABELS.get(kind, [kind])
                body(depth + 1, fn, here if "loop" in opened else loop, labels + opened)
                lines.append(pad + ("})" if HEADS[language][kind].count("(") > HEADS[language][kind].count(")") else "}()" if kind in ("go", "defer") else "}") + (";" if language == "java" else ""))
            else:
                marks[0] += 1
                lines.append(f"{pad}mark{marks[0]}(a){';' if language == 'java' else ''}")
                want[f"mark{marks[0]}"] = (fn, loop, ["function"] + labels, len(lines))

    if language == "java":
        lines.append("public class C {")
    for k in range(r.randrange(1, 4)):
        lines.append(FUNCTION[language].format(f"fn{k}"))
        body(0, f"fn{k}", None, [])
        lines.append("}")
    if language == "java":
        lines.append("}")
    return "\n".join(lines) + "\n", want


@pytest.mark.parametrize("language", ["go", "java", "javascript"])
def test_calls_stand_in_their_scopes(language):
    for seed in range(150):
        text, want = program(language, seed)
        got = {}
        for f in scopes.facts(text, language):
            row = dict(zip((n for n, _ in scopes.COLUMNS), f, strict=True))
            if row["kind"] == "call" and row["name"].startswith("mark"):
                got[row["name"]] = (row["fn_name"], row["loop_line"], row["inside"], row["line_start"])
        assert got == want, text


@pytest.mark.parametrize("language", ["go", "java", "javascript", "typescript"])
def test_blanking_keeps_places(language):
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice(["a", "{", "}", '"', "'", "`", "\\", "/", "*", "\n", "${", " ", "(", ")", "=", "é", ";", '"""']) for _ in range(60))
        code = scopes.blank(text, language)
        assert len(code) == len(text) and [k for k, c in enumerate(text) if c == "\n"] == [k for k, c in enumerate(code) if c == "\n"]
        assert all(a == b or b == " " for a, b in zip(text, code, strict=True))
        list(scopes.facts(text, language))  # unpaired braces and quotes are no error


def test_every_check_hits_and_misses(spark):
    df = spark.createDataFrame([(k, language, text) for k, (language, text, _) in enumerate(samples.SCOPES)], "file_path long, language string, content string")
    got = defaultdict(list)
    for r in check_scopes(df).collect():
        got[r["file_path"]].append((r["check"], r["severity"], r["line_start"]))
    for k, (_, text, want) in enumerate(samples.SCOPES):
        assert sorted(got[k]) == sorted(want), text
    from gristmill.operators.scope_checks import _checks

    assert {c for *_, found in samples.SCOPES for c, *_ in found} == {c for c, *_ in _checks()}


def test_messages_name_and_count(spark):
    texts = [
        ("go", "func load(a, b, c, d, e, f int) {\n\tp := new(T)\n\tp.Run()\n\thttp.Get(u)\n}\n"),
        ("java", "class C {\n  static int n;\n  void a(List<A> x, Map<B, C> y, int z, int u, int v, int w) { n++; n--; if (k.get() == 1) { k.set(2); } }\n}\n"),
        ("javascript", "const unused = 1\n"),
        ("python", "x = 1"),
        ("go", None),
        ("java", ""),
        (None, "func x() {}"),
    ]
    df = spark.createDataFrame([(str(k), language, t, "extra") for k, (language, t) in enumerate(texts)], "path string, language string, text string, message string")
    got = {r["message"] for r in check_scopes(df, "path", "text").collect()}
    assert {"Function has 6 parameters (> 5)", "Method has 6 parameters (> 5)", "Potential nil pointer dereference: p used without nil check", "Function load should accept context.Context"} <= got
    assert {'Potential race condition: Shared mutable field "n" without synchronization', 'Check-then-act race condition on Atomic variable "k"', "Variable 'unused' appears to be unused"} <= got
    assert not any(re.search("None|null", m) for m in got)


def test_one_shuffle_of_facts(spark):
    df = spark.createDataFrame([("a", "go", "func f() {}")], "file_path string, language string, content string")
    plan = check_scopes(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
