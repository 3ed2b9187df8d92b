"""Edits: what they make of varied texts parses, means the same where that is promised, and leaves other lines alone."""

import ast
import random

from gristmill.operators import edits
from gristmill.plans import samples

STATEMENTS = [
    "import os", "import os, sys", "from a import b, c as d", "from __future__ import annotations", "x = 'é' + str(1)", "s = 'a{}b{}'.format(x, y.z)", "s = '%s and %s' % (x, y)", "s = '%d' % x", "t = 'a' + x + 'c' + y",
    "if x == None: pass", "z = x != True and (y) == False", "q = x == None == y", "w = 'x == None'", "v = f'{x == None}'", "u = x ==\\\n  None", "k = '{}{{}}'.format(x)", "r = 'a' + 'b' + 'c'", "m = 'q\"' + x + 'é'",
]
BLOCKS = ["def f(a=[], *, b={}):", "def g(a, b=[1, 2]):", "if y:", "for i in y:", "while x:", "try:", "class C:", "with a as b:", "async def h(a=set()):"]


def program(seed):
    r = random.Random(seed)
    out = []

    def body(pad, depth):
        if r.random() < 0.2:
            out.append(f'{pad}"""text é"""')
        for _ in range(r.randrange(1, 4)):
            if depth < 3 and r.random() < 0.4:
                head = r.choice(BLOCKS)
                out.append(pad + head)
                body(pad + r.choice(["    ", "  ", "\t"]) if not pad else pad + "    ", depth + 1)
                if head == "try:":
                    out.append(pad + r.choice(["except:", "except :", "except E:"]))
                    body(pad + "    ", depth + 1)
            else:
                statement = r.choice(STATEMENTS)
                out.append(pad + (statement if depth == 0 or "__future__" not in statement else "pass"))

    body("", 0)
    return "\n".join(out) + r.choice(["", "\n"])


def test_python_texts_parse_and_other_lines_stay():
    seen = set()
    for seed in range(1500):
        text = program(seed)
        try:
            ast.parse(text)
        except SyntaxError:
            assert list(edits.python_edits(text)) == []
            continue
        fixes = list(edits.python_edits(text))
        for kind, spans in fixes:  # each on its own
            out, n = edits.put(text, "python", [spans])
            assert n == 1 and edits.parses(out, "python"), (kind, text, out)
            touched = {k for start, end, _ in spans for k in range(text.count("\n", 0, start), text.count("\n", 0, max(start, end - 1)) + 1)}
            rest = [x for k, x in enumerate(text.split("\n")) if k not in touched]
            left = iter(out.split("\n"))
            assert all(x in left for x in rest), (kind, text, out)
            seen.add(kind)
    assert seen == {k for k in edits.KINDS if k not in ("var", "equality", "template", "arrow", "optional-chaining", "nullish")}


def test_strings_and_comparisons_mean_the_same():
    r = random.Random(3)
    for _ in range(400):
        pieces = [r.choice(["", "a", "é ", " - ", "x'y"]) for _ in range(3)]
        code = r.choice([repr("{}".join(pieces)) + ".format(x, y)", repr("%s".join(pieces)) + " % (x, y)", f"{pieces[0]!r} + x + {pieces[1]!r} + x + {pieces[2]!r}", "(x == None, None != y, y == True, x != False)"])
        fixes = [e for _, e in edits.python_edits(f"r = {code}\n")]
        out, n = edits.put(f"r = {code}\n", "python", fixes)
        for x, y in (("é{}", "y"), ("", "%s")):
            before, after = {"x": x, "y": y}, {"x": x, "y": y}
            exec(f"r = {code}", before)
            exec(out, after)
            assert before["r"] == after["r"], (code, out)


def test_javascript_leaves_strings_and_comments():
    text = "// var a == b\nconst s = 'var a == b || c'\n/* x && x.y */ const t = `a == b ${c == d}`\n"
    out, n = edits.put(text, "javascript", [e for _, e in edits.javascript_edits(text)])
    assert n == 1 and out == text.replace("c == d", "c === d")
    for k, (language, before, after, n) in enumerate(samples.EDITS):
        if language in edits.FINDERS and k != 1:
            assert edits.put(before, language, [e for _, e in edits.FINDERS[language](before)]) == (after, n)


def test_conflicts_and_whole_fixes(spark):
    files = spark.createDataFrame([(str(k), language, text.replace("KEY", "7")) for k, (language, text, _, _) in enumerate(samples.EDITS)] + [("none", "python", None), ("empty", "python", "")], "path string, language string, body string")
    proposed = edits.propose_edits(files, "path", "body")
    got = {r["path"]: (r["content"], r["applied"]) for r in edits.apply_edits(files, proposed, "path", "body").collect()}
    assert got == {str(k): (after.replace("KEY", "7"), n) for k, (_, _, after, n) in enumerate(samples.EDITS)} | {"none": (None, 0), "empty": ("", 0)}
    safe = {r["path"]: r["content"] for r in edits.apply_edits(files, proposed, "path", "body", safe_only=True).collect()}
    assert "x7=[]" in safe["1"] and "is None" in safe["1"]
    # Two fixes on the same span: the surer one.
    text = "s = 'a' + x + 'b'\n"
    clash = [("p", 0, "concatenation", 4, 17, "first", 1, 1, "style", 0.5, False, ""), ("p", 1, "f-string", 10, 11, "y", 1, 1, "style", 0.9, True, "")]
    one = spark.createDataFrame([("p", "python", text)], "file_path string, language string, content string")
    rows = spark.createDataFrame(clash, f"file_path string, {edits.COLUMNS}")
    assert edits.apply_edits(one, rows).first()["content"] == "s = 'a' + y + 'b'\n"
