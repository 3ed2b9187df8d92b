import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import oracle
import pytest

from gristmill.operators import findings, intervals, policy, rules
from gristmill.plans import tables
from gristmill.plans.queries import ORACLES, ORDER, QUERIES
from gristmill.sources import sinks

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    oracle.compare(QUERIES[name](spark, SF), ORACLES[name], SF)


def plain_similar(rows):
    """Every finding against all kept before it, in order; ``rows`` are dictionaries."""
    first = {}
    for r in sorted(rows, key=lambda r: tuple(r[c] for c in ORDER)):
        first.setdefault((r["file_path"], r["line_start"], r["severity"], r["message"][:50]), r)
    kept = []
    for r in first.values():
        twin = next((k for k in kept if k["file_path"] == r["file_path"] and k["severity"] == r["severity"] and abs(k["line_start"] - r["line_start"]) <= 5 and SequenceMatcher(None, k["message"].lower(), r["message"].lower()).ratio() >= 0.85), None)
        if twin is None:
            kept.append(r)
        elif r["confidence"] > twin["confidence"]:
            kept.remove(twin)
            kept.append(r)
    return Counter(tuple(k[c] for c in ("review_id", "ord", "tie", "severity", "confidence")) for k in kept)


def test_similar_findings_against_all_pairs(spark):
    rows = [r.asDict() for r in tables.findings(spark, SF).collect()]
    assert Counter(map(tuple, QUERIES["d2_similar_dedup"](spark, SF).collect())) == plain_similar(rows)
    # Lines far apart are islands of their own.
    sparse = [r | {"line_start": r["line_start"] * 3, "message": r["message"] * (1 + r["ord"] % 3)} for r in rows[:1500]]
    df = spark.createDataFrame([tuple(r.values()) for r in sparse], tables.findings(spark, SF).schema)
    got = findings.dedup_similar(df, ORDER).select("review_id", "ord", "tie", "severity", "confidence").collect()
    assert Counter(map(tuple, got)) == plain_similar(sparse)


def test_fix_conflicts_against_a_loop(spark):
    f = tables.findings(spark, SF).select("file_path", "line_start", "line_end", "ord", "confidence")
    wide = f.selectExpr("file_path", "line_start * 4 AS line_start", "line_start * 4 + ord % 9 AS line_end", "ord", "confidence")
    for fixes in (f, wide):
        by_file, want = defaultdict(list), Counter()
        for r in fixes.collect():
            by_file[r["file_path"]].append(tuple(r)[1:])
        for file, items in by_file.items():
            items.sort()
            while items:
                reach = items[0][1]
                cluster = [x for x in items if x[0] <= reach]
                best = max(cluster, key=lambda x: x[3])  # the first of equals
                want[(file, *best)] += 1
                items = items[len(cluster) :]
        assert Counter(map(tuple, intervals.resolve_conflicts(fixes).select("file_path", "line_start", "line_end", "ord", "confidence").collect())) == want


@pytest.mark.parametrize(("name", "table"), [("t4_rule_findings", rules.DEFAULT_RULES), ("t5_sast_findings", rules.SAST_RULES)])
def test_rules_against_plain_matching(spark, name, table):
    """Rule findings of all texts against a loop over texts, rules and matches."""
    files = [(f["doc_id"], f["language"], f["content"]) for f in tables.files(spark, SF).collect()]
    risky = "x = 1\npassword = 'abcdefgh1'\nh = MD5(x)\nopen(a + b)\npickle.loads(x); eval(x)\nrequests.get(u + v)\nos.system(a + b)\n@app.route('/')\n# TODO: later\nfoo.innerHTML = a + b\ncursor.execute('select ' + x)\n"
    planted = [(-1 - k, lang, risky) for k, lang in enumerate(("python", "JavaScript", "java", "go", "rust", None))]

    def plain(rows):
        found = Counter()
        for i, language, content in rows:
            for r in (r for r in table if r.enabled and (not r.languages or language and language.lower() in r.languages)):
                flags = re.IGNORECASE * (not r.case_sensitive) | (re.MULTILINE | re.DOTALL) * r.multiline
                for m in re.finditer(r.pattern, content or "", flags):
                    found[i, r.id, content.count("\n", 0, m.start()) + 1, m[0]] += 1
        return found

    key = ("doc_id", "rule_id", "line_start", "matched")
    assert Counter(tuple(r[c] for c in key) for r in QUERIES[name](spark, SF).collect()) == plain(files)
    df = spark.createDataFrame(planted, "doc_id long, language string, content string")
    got = Counter(tuple(r[c] for c in key) for r in rules.RulesEngine(table).scan(df, keep=("doc_id", "language")).collect())
    assert got == plain(planted) and sum(got.values()) >= 10


def test_policies_are_kept(spark):
    text = policy.dump_policies([{"id": "b", "name": "B", "action": "warn", "priority": 1}, {"id": "a", "name": "A", "action": "block", "priority": 5, "branches": ["main"]}], "json")
    first = policy.load_policies(text, "json")
    assert [p["id"] for p in first] == ["a", "b"] and policy.load_policies(policy.dump_policies(first)) == first
    new = policy.dump_policies([{"id": "a", "name": "other", "action": "warn"}, {"id": "c", "name": "C", "action": "warn"}])
    assert {p["id"]: p["name"] for p in policy.import_policies(first, new)} == {"a": "A", "b": "B", "c": "C"}
    assert {p["id"]: p["name"] for p in policy.import_policies(first, new, replace=True)} == {"a": "other", "b": "B", "c": "C"}


def test_chat_messages_of_equal_order(spark, tmp_path):
    """Findings alike in severity, order and tie: the first in the table is the worst, as ``arg_min`` keeps it."""

    def lines(path, order, parts):
        rows = ", ".join(f"({order}, {p}, 1)" for p in parts)
        oracle.duckdb.sql(f"""COPY (SELECT o::BIGINT AS l_orderkey, p::BIGINT AS l_partkey, 2::BIGINT AS l_suppkey, n::INTEGER AS l_linenumber, 2.0::DOUBLE AS l_quantity, 5.0::DOUBLE AS l_extendedprice,
          0.05::DOUBLE AS l_discount, 0.01::DOUBLE AS l_tax, 'A' AS l_returnflag, 'O' AS l_linestatus FROM (VALUES {rows}) v(o, p, n)) TO '{path}' (FORMAT parquet)""")

    query = "k5_chat_messages"
    one, two = tmp_path / "one", tmp_path / "two"
    (two / "lineitem.parquet").mkdir(parents=True)
    one.mkdir()
    lines(one / "lineitem.parquet", 7, [38, 1, 20, 12, 39, 5, 11])
    df = QUERIES[query](spark, str(one))
    assert [r["worst"] for r in df.collect()] == ["src/mod38/f2.go:39"]
    oracle.compare(df, ORACLES[query], str(one))
    # In two files, of which Spark reads the larger, later one first.
    lines(two / "lineitem.parquet" / "part-0.parquet", 7, [38, 1])
    lines(two / "lineitem.parquet" / "part-1.parquet", 7, [11] * 5 + list(range(3000)))
    assert [(r["total"], r["shown"], r["worst"]) for r in QUERIES[query](spark, str(two)).collect()] == [(3007, 5, "src/mod38/f2.go:39")]


def test_messages_of_equal_order_agree(spark):
    """Which findings are shown does not hang on the order in which equals arrive."""
    schema = "review_id int, severity string, file_path string, line_start int, message string, ord int"
    rows = [(1, "high", f"f{k}.py", k, "m", 1) for k in range(8)]
    both = [sinks.messages(spark.createDataFrame(r, schema).coalesce(1), ["review_id"], ["ord"]).first()["payload"] for r in (rows, rows[::-1])]
    assert both[0] == both[1] and [f'"f{k}.py:{k}"' in both[0] for k in range(8)] == [True] * 5 + [False] * 3
