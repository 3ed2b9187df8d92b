"""Diffs against brute force: shortest edits, hunks that apply, files that come, go and move."""

import random

import pytest

from gristmill.operators import diffs, intervals


def common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def rising(a, b, m):
    return all(a[x] == b[y] for x, y in m) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:]))


def put(old, found):
    lines = [] if old is None else old.split("\n")
    for _, start, count, _, news, body in reversed(found):
        at = start - (count > 0)
        assert [x[1:] for x in body if x[0] in " -"] == lines[at : at + count] and sum(x[0] in " +" for x in body) == news
        lines[at : at + count] = [x[1:] for x in body if x[0] in " +"]
    return "\n".join(lines)


def test_the_search_in_a_gap_is_shortest():
    r = random.Random(1)
    for _ in range(2000):
        a, b = ([r.randrange(5) for _ in range(r.randrange(13))] for _ in range(2))
        m = sorted(diffs._shortest(a, b, 10**6))
        assert len(m) == common(a, b) and rising(a, b, m)
        assert rising(a, b, diffs.matches(a, b)) and rising(a, b, diffs.matches(a, b, most=1))
    unique = list(range(50))
    shuffled = unique[10:20] + unique[:10] + unique[20:]
    assert len(diffs.matches(unique, shuffled)) == 40


@pytest.mark.parametrize("context", [0, 1, 5])
def test_hunks_apply(context):
    r = random.Random(2)
    for _ in range(1500):
        a = "\n".join(str(r.randrange(9)) for _ in range(r.randrange(60)))
        lines = a.split("\n")
        for _ in range(r.randrange(5)):
            at = r.randrange(len(lines) + 1)
            lines[at : at + r.randrange(3)] = [f"n{r.randrange(3)}"] * r.randrange(3)
        b = "\n".join(lines) if lines else ""
        if not lines:
            continue
        found = list(diffs.hunks(a, b, context))
        assert put(a, found) == b and (a == b) == (not found)
        assert all(p[1] + p[2] <= q[1] + (q[2] == 0) for p, q in zip(found, found[1:]))  # hunks do not meet
        assert put(None, list(diffs.hunks(None, b, context))) == b


def test_trees(spark):
    r = random.Random(3)
    text = lambda: "\n".join(r.choice("abcdefgh") * r.randrange(4) for _ in range(r.randrange(30)))
    old = {f"f{k}": text() for k in range(80)}
    new = {k: v if r.random() < 0.3 else "\n".join(x for x in v.split("\n") if r.random() < 0.9) + r.choice(["", "\nz"]) for k, v in old.items() if r.random() < 0.9}
    new |= {f"n{k}": text() for k in range(10)}
    old |= {"moved": "here\nand there", "twin1": "same", "twin2": "same", "empty": "", "null": None, "gone null": None}
    new |= {"to": "here\nand there", "twin3": "same", "empty": "x", "null": "", "Ünï": None}
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, body string")
    a, b = frame(old), frame(new)
    got = {c["path"]: (c["status"], c["old_path"]) for c in diffs.file_changes(a, b, "path", "body").collect()}
    want = {k: ("deleted" if k not in new else "added" if k not in old else "unchanged" if (old[k] or "") == (new[k] or "") else "modified", None) for k in {**old, **new} if k != "moved"}
    # A content that one file loses and one file gains is a move, wherever it happens.
    for digest in {v or "" for v in new.values()}:
        gone, come = [k for k in old if k not in new and (old[k] or "") == digest], [k for k in new if k not in old and (new[k] or "") == digest]
        if len(gone) == len(come) == 1:
            want[come[0]] = ("renamed", gone[0])
            want.pop(gone[0], None)
    assert got == want and want["to"] == ("renamed", "moved") and want["twin3"][0] == "added"
    found = diffs.diff_files(a, b, 3, "path", "body")
    made = {x["path"]: x["content"] for x in diffs.apply_hunks(a, found, "path", "body").collect()}
    assert made == {k: new[k] or "" for k, (status, _) in want.items() if status in ("added", "modified")}
    # Unified text and back.
    text_of = diffs.unified(found, "path")
    parsed = intervals.parse_diffs(text_of.select(text_of["path"].alias("file_path"), "diff")).collect()
    flat = lambda rows: sorted((x[0], *(int(v) for v in x[1:6]), tuple(x[6])) for x in rows)
    assert flat(parsed) == flat((x["path"], *(x[c] for c in ("hunk", "old_start", "old_count", "new_start", "new_count", "lines")) ) for x in found.collect())
    flags = {x["path"]: (x["is_new"], x["is_deleted"], x["has_changes"]) for x in diffs.diff_flags(text_of, "path").collect()}
    assert flags == {k: (s == "added", s == "deleted", True) for k, (s, _) in want.items() if s in ("added", "deleted", "modified")}


def test_flags_and_shown_content(spark):
    moved = "diff --git a/x b/y\nsimilarity index 90%\nrename from x y\nrename to y\n@@ -1 +1 @@\n-a\n+b"
    rows = [("m", moved), ("n", None), ("o", "binary files differ")]
    got = {x["file_path"]: tuple(x)[1:] for x in diffs.diff_flags(spark.createDataFrame(rows, "file_path string, diff string")).collect()}
    assert got == {"m": (False, False, True, "x y", True), "n": (False, False, False, None, False), "o": (False, False, False, None, False)}
    old, new = "a\nb\nc\nd\n" + "x\n" * 20 + "e", "a\nB\nc\nd\n" + "x\n" * 20 + "f"
    frame = lambda t: spark.createDataFrame([("p", t)], "file_path string, content string")
    shown = diffs.changed_content(diffs.diff_files(frame(old), frame(new), 1)).first()["changed"]
    rule = "=" * 60
    assert shown == f"# Changed section at lines 1-3\n\na\nb\nB\nc\n\n{rule}\n\n# Changed section at lines 24-25\n\nx\ne\nf"
