"""Diffs of two versions of a tree of files: what became of each file, hunks, unified text, and back.

Files are told apart by digests first, so that only texts of changed files are shuffled. A file's lines become
numbers; lines that are unique on both sides anchor the two versions (the longest run of anchors in the
same order, patience diff), gaps are searched the same way, and what is left without anchors goes through a
shortest-edit search over lines that both sides have. Hunks are rows.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edits that the search in a gap tries; beyond, the gap is replaced whole, which is right but longer.
MOST_EDITS = 1000
HUNK_SCHEMA = "hunk long, old_start long, old_count long, new_start long, new_count long, lines array<string>"


def _anchors(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of lines that are unique in both, the longest run that rises in both."""
    in_a, in_b = Counter(a), Counter(b)
    at_b = {x: j for j, x in enumerate(b) if in_b[x] == 1}
    tails, ends, back, places = [], [], [], []
    for i, x in enumerate(a):
        if in_a[x] == 1 and x in at_b:
            j = at_b[x]
            k = bisect_left(tails, j)
            tails[k : k + 1] = [j]
            back.append(ends[k - 1] if k else -1)
            ends[k : k + 1] = [len(places)]
            places.append((i, j))
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(places[k])
        k = back[k]
    return out[::-1]


def _shortest(a: list[int], b: list[int], most: int) -> list[tuple[int, int]]:
    """Places of equal lines on a shortest edit of ``a`` into ``b``; none if it takes over ``most`` edits."""
    most = min(most, len(a) + len(b))
    far, zero, trail = array("q", [0] * (2 * most + 3)), most + 1, []  # how far each diagonal reaches

    def came(k: int, d: int, f: array, z: int) -> int:
        return k + 1 if k == -d or k != d and f[z + k - 1] < f[z + k + 1] else k - 1

    for d in range(most + 1):
        trail.append(far[zero - d - 1 : zero + d + 2])
        for k in range(-d, d + 1, 2):
            p = came(k, d, far, zero)
            x = far[zero + p] + (p < k)
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            far[zero + k] = x
            if x >= len(a) and x - k >= len(b):
                break
        else:
            continue
        break
    else:
        return []
    out, x, y = [], len(a), len(b)
    for d in range(len(trail) - 1, -1, -1):
        p = came(x - y, d, trail[d], d + 1)
        px = trail[d][d + 1 + p]
        while x > px and y > px - p:
            x, y = x - 1, y - 1
            out.append((x, y))
        x, y = px, px - p
    return out


def matches(a: list[int], b: list[int], most: int = MOST_EDITS) -> list[tuple[int, int]]:
    """Places of equal lines in both lists, rising in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        if found := _anchors(a[i:m], b[j:n]):
            found = [(i + x, j + y) for x, y in found]
            out += found
            edges = [(i - 1, j - 1), *found, (m, n)]
            todo += [(x + 1, p, y + 1, q) for (x, y), (p, q) in zip(edges, edges[1:])]
            continue
        both = set(a[i:m]) & set(b[j:n])
        of_a, of_b = [x for x in range(i, m) if a[x] in both], [y for y in range(j, n) if b[y] in both]
        out += [(of_a[x], of_b[y]) for x, y in _shortest([a[x] for x in of_a], [b[y] for y in of_b], most)]
    return sorted(out)


def hunks(old: str | None, new: str | None, context: int = 5) -> Iterator[tuple]:
    """Rows of HUNK_SCHEMA that make ``new`` of ``old``; null is a file that is not there, with no line.

    A line ends with \\n; a text is its lines joined, so the last one may be empty. Changes up to twice ``context``
    lines apart share a hunk. A side without lines begins at 0, as unified diffs have it.
    """
    a, b = ([] if t is None else t.split("\n") for t in (old, new))
    numbers: dict[str, int] = {}
    ids_a, ids_b = ([numbers.setdefault(x, len(numbers)) for x in side] for side in (a, b))
    same = [*matches(ids_a, ids_b), (len(a), len(b))]
    # Changed ranges between matching lines.
    changes, i, j = [], 0, 0
    for x, y in same:
        if x > i or y > j:
            changes.append((i, x, j, y))
        i, j = x + 1, y + 1
    groups: list[list[tuple]] = []
    for c in changes:
        if groups and c[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(c)
        else:
            groups.append([c])
    for k, group in enumerate(groups, 1):
        first, last = group[0], group[-1]
        before, after = min(context, first[0]), min(context, len(a) - last[1])
        lines, at = [], first[0] - before
        for x, m, y, n in group:
            lines += [" " + t for t in a[at:x]] + ["-" + t for t in a[x:m]] + ["+" + t for t in b[y:n]]
            at = m
        lines += [" " + t for t in a[at : at + after]]
        olds, news = last[1] + after - (first[0] - before), last[3] + after - (first[2] - before)
        yield k, first[0] - before + (olds > 0), olds, first[2] - before + (news > 0), news, lines


def file_changes(old: DataFrame, new: DataFrame, key: str = "file_path", text: str = "content") -> DataFrame:
    """``key, status, old_path`` for every file of either version: added, deleted, modified, renamed or unchanged.

    A file is renamed if its content is that of exactly one file that is gone and no other new file has it; then the old
    path is no row of its own. Digests of contents are compared, no text is shuffled. A null text is an empty
    file; keys are unique in a version.
    """
    side = lambda df, name: df.select(F.col(key).alias(f"{name}_key"), F.sha2(F.coalesce(text, F.lit("")), 256).alias(name))
    both = side(old, "was").join(side(new, "now"), F.col("was_key") == F.col("now_key"), "full")
    # Contents of one file that is gone and one that is new: counted, so that copies of a frequent content fall together.
    apart = both.where("now IS NULL OR was IS NULL").groupBy(F.coalesce("was", "now").alias("digest")).agg(F.count("was").alias("gone"), F.count("now").alias("come"), F.max("was_key").alias("from_key"), F.max("now_key").alias("to_key"))
    moved = apart.where("gone = 1 AND come = 1").select("from_key", "to_key")
    rows = both.join(moved.select(F.col("to_key"), F.col("from_key")), F.col("was").isNull() & (F.col("now_key") == F.col("to_key")), "left")
    rows = rows.join(moved.select(F.col("from_key").alias("left_key")), F.col("now").isNull() & (F.col("was_key") == F.col("left_key")), "left_anti")
    status = F.when(F.col("to_key").isNotNull(), "renamed").when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "unchanged").otherwise("modified")
    return rows.select(F.coalesce("now_key", "was_key").alias(key), status.alias("status"), "from_key").withColumnRenamed("from_key", "old_path")


def diff_files(old: DataFrame, new: DataFrame, context: int = 5, key: str = "file_path", text: str = "content") -> DataFrame:
    """Hunks of every added, deleted and modified file: ``key``, status and HUNK_SCHEMA, numbered within a file.

    Only texts of files that changed are shuffled, each to its other version.
    """
    changed = file_changes(old, new, key, text).where("status IN ('added', 'deleted', 'modified')").select(key, "status")
    side = lambda df, name: df.join(changed, key, "left_semi").select(key, F.coalesce(text, F.lit("")).alias(name))
    pairs = changed.join(side(old, "_old"), key, "left").join(side(new, "_new"), key, "left").select(key, "status", "_old", "_new")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = [pa.int64()] * 5 + [pa.list_(pa.string())]
            shape = pa.schema([b.schema.field(0), b.schema.field(1), *(pa.field(c.split()[0], t) for c, t in zip(HUNK_SCHEMA.split(", "), kinds, strict=True))])
            for k, status, was, now in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = [(k, status, *h) for h in hunks(was, now, context)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)

    return pairs.mapInArrow(run, f"`{key}` {pairs.schema[key].dataType.simpleString()}, status string, {HUNK_SCHEMA}")


def _starting(lines: str, marks: str) -> Column:
    """The lines of a hunk that begin with one of ``marks``, without it."""
    return F.expr(f"transform(filter({lines}, l -> substr(l, 1, 1) IN ({', '.join(repr(m) for m in marks)})), l -> substr(l, 2))")


def apply_hunks(old: DataFrame, found: DataFrame, key: str = "file_path", text: str = "content") -> DataFrame:
    """``key, content`` of the files of ``old`` that ``found`` (hunks) changes, and of those it adds: deleted files are gone.

    One sorted array of hunks a file is folded over its lines, from the bottom up.
    """
    todo = found.groupBy(key).agg(F.max("status").alias("status"), F.sort_array(F.collect_list(F.struct("old_start", "old_count", _starting("lines", " +").alias("put"))), asc=False).alias("hunks"))
    lines = F.expr(f"CASE WHEN status = 'added' THEN cast(array() AS array<string>) ELSE split(coalesce({text}, ''), '\n', -1) END")
    fold = """aggregate(hunks, all_lines, (l, h) -> concat(slice(l, 1, cast(h.old_start - IF(h.old_count > 0, 1, 0) AS int)), h.put,
      slice(l, cast(h.old_start + h.old_count + IF(h.old_count > 0, 0, 1) AS int), size(l))))"""
    rows = todo.where("status <> 'deleted'").join(old.select(key, text), key, "left").withColumn("all_lines", lines)
    return rows.select(key, F.array_join(F.expr(fold), "\n").alias("content"))


def unified(found: DataFrame, key: str = "file_path") -> DataFrame:
    """``key, diff``: the hunks of each file as one unified diff with git's header lines."""
    name = F.col(key).cast("string")
    head = lambda start, count: F.concat(start.cast("string"), F.lit(","), count.cast("string"))
    one = F.concat(F.lit("@@ -"), head(F.col("old_start"), F.col("old_count")), F.lit(" +"), head(F.col("new_start"), F.col("new_count")), F.lit(" @@\n"), F.array_join("lines", "\n"))
    all_of = found.groupBy(key).agg(F.max("status").alias("status"), F.array_sort(F.collect_list(F.struct("hunk", one.alias("h")))).alias("hs"))
    mode = F.when(F.col("status") == "added", "new file mode 100644\n").when(F.col("status") == "deleted", "deleted file mode 100644\n").otherwise("")
    files = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n"), mode, F.when(F.col("status") == "added", "--- /dev/null\n").otherwise(F.concat(F.lit("--- a/"), name, F.lit("\n"))), F.when(F.col("status") == "deleted", "+++ /dev/null\n").otherwise(F.concat(F.lit("+++ b/"), name, F.lit("\n"))))
    return all_of.select(key, F.concat(files, F.array_join(F.transform("hs", lambda x: x["h"]), "\n")).alias("diff"))


def diff_flags(diffs: DataFrame, key: str = "file_path") -> DataFrame:
    """``key, is_new, is_deleted, is_renamed, old_path, has_changes`` of unified diffs (``key``, diff), from their first ten lines; a null diff has no flag set."""
    top = F.slice(F.split("diff", "\n"), 1, 10)
    any_of = lambda start: F.coalesce(F.exists(top, lambda l: l.startswith(start)), F.lit(False))
    old = F.get(F.filter(top, lambda l: l.startswith("rename from")), 0)
    flags = diffs.select(key, any_of("new file mode").alias("is_new"), any_of("deleted file mode").alias("is_deleted"), any_of("rename from").alias("is_renamed"), F.trim(F.substring(old, 13, 1 << 30)).alias("old_path"), F.coalesce(F.col("diff").rlike("(?m)^@@"), F.lit(False)).alias("_hunks"))
    return flags.withColumn("has_changes", F.col("_hunks") | F.col("is_new") | F.col("is_deleted")).drop("_hunks")


def changed_content(found: DataFrame, key: str = "file_path") -> DataFrame:
    """``key, changed``: what is shown of a changed file: each hunk's lines under a heading, context before and after, a rule between hunks."""
    first = "array_position(transform(lines, l -> substr(l, 1, 1) <> ' '), true)"
    shown = F.expr(f"""transform(concat(filter(slice(lines, 1, greatest(cast({first} AS int) - 1, 0)), l -> true), filter(lines, l -> substr(l, 1, 1) IN ('+', '-')),
      filter(slice(lines, greatest(cast({first} AS int), 1), size(lines)), l -> substr(l, 1, 1) = ' ')), l -> substr(l, 2))""")
    head = F.concat(F.lit("# Changed section at lines "), F.col("new_start").cast("string"), F.lit("-"), (F.col("new_start") + F.col("new_count") - 1).cast("string"), F.lit("\n"))
    parts = found.select(key, "hunk", F.concat(F.when(F.col("hunk") > 1, F.lit(f"\n{'=' * 60}\n\n")).otherwise(""), head, F.lit("\n"), F.array_join(shown, "\n")).alias("part"))
    return parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hunk", "part"))), lambda x: x["part"]), "\n").alias("changed"))
