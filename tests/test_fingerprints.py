"""Fingerprints against renaming, classes against a plain grouping."""

import ast
import random
from collections import defaultdict

from pyspark.sql import functions as F

from gristmill.operators import fingerprints as fp

BODY = """def {f}({a}, {b}=1, *rest):
    {t} = 0
    for {i} in range({a}):
        if {i} % 2 and len(rest) > {n}:
            {t} += {i} * {b}
        else:
            with open(str({i})) as {h}:
                {t} -= int({h}.read())
    try:
        return [{x} for {x} in rest if {x}], {t}
    except ValueError as {e}:
        raise RuntimeError({e}) from None
"""


def named(seed, n=3):
    r = random.Random(seed)
    names = r.sample([f"v{k}" for k in range(50)], 9)
    return BODY.format(n=n, **dict(zip("fabtihxe", names, strict=False)))


def prints(code, least=8):
    return [r[0] for r in fp.subtrees(code, least)]


def test_names_do_not_count_but_all_else_does():
    want = prints(named(0))
    assert len(want) == 5 and len(set(want)) == 5  # function, loop, test, with, try
    assert all(prints(named(k)) == want for k in range(1, 30))
    assert prints(named(1, n=4))[0] != want[0]
    changed = [("range", "reversed"), ("+=", "-="), (".read", ".write"), ("ValueError", "KeyError"), ("and", "or"), ("=1", "=2"), ("*rest", "**rest"), ("if v", "if not v")]
    code = named(0)
    for old, new in changed:
        assert old in code and prints(code.replace(old, new, 1))[0] != want[0], old
    # Which name is which counts: these are no renamed copies.
    assert prints("def f(a, b):\n    return a + b * a - b\n") != prints("def f(a, b):\n    return a + b * b - a\n")
    assert prints("def f(a):\n    return g(a) + f(a) * 2\n") == prints("def h(b):\n    return g(b) + h(b) * 2\n") != prints("def f(a):\n    return g(a) + g(a) * 2\n")


def test_canonical_words_tell_shapes_apart():
    seen = {}
    for code in ["f(a, b)", "f((a, b))", "f([a], b)", "f(a)(b)", "f(a, *b)", "f(a, b=b)", "f(a).b", "'a'", "a", "1", "'1'", "1.0", "True", "None", "b'1'", "x['a']", "x[a]", "[a, [b]]", "[[a], b]", "'.id'", "'#0'"]:
        words = tuple(fp.canonical(ast.parse(code), frozenset())[0])
        assert words not in seen, (code, seen.get(words))
        seen[words] = code


def test_classes_across_files(spark):
    r = random.Random(4)
    rows = []
    for k in range(60):
        code = "".join(named(r.randrange(1000), n=r.choice([3, 3, 4, 5])) for _ in range(r.randrange(3)))
        rows.append((f"f{k:02}", r.choice(["python", "python", "python", "go"]), code))
    rows += [rows[0], ("bad", "python", "def f(:"), ("none", "python", None), ("empty", "python", "")]
    df = spark.createDataFrame(rows, "file_path string, language string, content string")
    p = fp.fingerprints(df, least_nodes=8).cache()
    by = defaultdict(list)
    for file, language, code in rows:
        for x in fp.subtrees(code or "", 8) if language == "python" else ():
            by[x[0]].append((file, x[4], x[1], x[2], x[3]))
    want = {k: v for k, v in by.items() if len(v) > 1}

    def inside(v):
        parents = {x[2] for x in v}
        return len(parents) == 1 and None not in parents and len(by[min(parents)]) > 1

    classes = {c["fingerprint"]: c for c in fp.clone_classes(p).collect()}
    assert classes.keys() == want.keys()
    for k, v in want.items():
        assert (classes[k]["members"], tuple(classes[k]["first"])[:2], classes[k]["maximal"]) == (len(v), min(v)[:2], not inside(v))
    members = fp.clone_members(p).groupBy("fingerprint").count().collect()
    assert {m[0]: m[1] for m in members} == {k: len(v) for k, v in want.items() if not inside(v)}
    got = sorted((d["file_path"], d["line_start"]) for d in fp.duplicate_functions(df, least_nodes=8).collect())
    assert got == sorted(x[:2] for v in want.values() if v[0][3] == "FunctionDef" for x in v if x[:2] != min(v)[:2])
    nodes = {n["fingerprint"]: n for n in fp.consed(p).collect()}
    assert {k: n["uses"] for k, n in nodes.items()} == {k: len(v) for k, v in by.items()}
    assert all(set(n["inside"]) == {k for k, v in by.items() if any(x[2] == n["fingerprint"] for x in v)} for n in nodes.values())


def test_a_class_of_many_members_is_as_many_rows(spark):
    code = F.concat(F.lit("def f"), "id", F.lit("(a"), "id", F.lit("):\n    b = a"), "id", F.lit(" + 1\n    return print(b, b * 2)\n"))
    files = spark.range(100_000).select(F.col("id").cast("string").alias("file_path"), F.lit("python").alias("language"), code.alias("content"))
    p = fp.fingerprints(files, least_nodes=10)
    m = fp.clone_members(p).agg(F.count("*"), F.countDistinct("fingerprint"), F.countDistinct("file_path"), F.min("members"), F.count_if("is_first")).first()
    assert tuple(m) == (100_000, 1, 100_000, 100_000, 1)
