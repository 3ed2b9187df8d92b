"""Changing tables against a plain model, whatever the order, the compactions and the writers."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from gristmill.sources.changing import ChangingTable

COLUMNS = "name string, part long, status string, size long"


def table(spark, path):
    return ChangingTable(spark, str(path), COLUMNS, ["name", "part"])


def rows_of(t, **options):
    return sorted((tuple(r) for r in t.read(**options).collect()), key=repr)


def plain(changes):
    """Rows from (op, at, batch, name, part, status, size)."""
    out = {}
    for key in {c[3:5] for c in changes}:
        own = [c for c in changes if c[3:5] == key]
        gone = max((c[1:3] for c in own if c[0] == "D"), default=(-100, ""))
        live = [c for c in own if c[0] != "D" and c[1:3] > gone]
        if live:
            made = min((c for c in live if c[0] == "C"), key=lambda c: c[1:3], default=None)
            puts = sorted((c for c in live if c[0] == "P"), key=lambda c: c[1:3])
            out[key] = [next((c[i] for c in reversed(puts) if c[i] is not None), made[i] if made else None) for i in (5, 6)]
    return sorted(((*k, *v) for k, v in out.items()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_against_a_plain_model(spark, tmp_path, seed):
    r, t, changes = random.Random(seed), table(spark, tmp_path), []
    assert rows_of(t) == []
    times = r.sample(range(1000), 12)  # batches arrive in any order
    for k, at in enumerate(times):
        op, name = r.choice("PPPCD"), f"b{k:02}"
        keys = r.sample([(n, p) for n in ("x", "y", None) for p in (1, 2, None)], r.randrange(1, 8))
        rows = [(*key, r.choice(["open", "shut", None]), r.choice([1, 2, None])) for key in keys]
        changes += [(op, at, name, *row) for row in rows]
        df = spark.createDataFrame(rows, COLUMNS)
        t.write(df if op != "D" else df.select("name", "part"), op, at=at, batch=name)
        if k in (3, 7):
            t.compact()
        if k in (2, 5, 8, 11):
            assert rows_of(t) == plain(changes)
    t.write(df if op != "D" else df.select("name", "part"), op, at=at, batch=name)  # run again
    assert rows_of(t) == plain(changes)
    t.compact()
    t.compact()
    assert rows_of(t) == plain(changes)
    # What a batch of an older time brings later still finds its place.
    late = [("C", -5, "late", "z", 1, "old", 7), ("P", -5, "late2", "x", 1, "older", 9)]
    for op, at, name, *row in late:
        t.write(spark.createDataFrame([tuple(row)], COLUMNS), op, at=at, batch=name)
    assert rows_of(t) == plain(changes + late)


def test_get_or_create_at_once_leaves_one_row(spark, tmp_path):
    t = table(spark, tmp_path)
    found, start = [], threading.Barrier(3)

    def run(k):
        own = table(spark, tmp_path)
        start.wait()
        rows = spark.createDataFrame([("p", 1, f"writer {k}", k)], COLUMNS)
        found.append([tuple(x) for x in own.get_or_create(rows).collect()])

    threads = [threading.Thread(target=run, args=(k,)) for k in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    state = rows_of(t)
    assert len(state) == 1 and all(len(f) == 1 for f in found)
    before = len(t._committed("log"))
    again = t.get_or_create(spark.createDataFrame([("p", 1, "later", 9)], COLUMNS)).collect()
    assert [tuple(x) for x in again] == state and len(t._committed("log")) == before


def test_update_delete_expire_and_batches_that_did_not_end(spark, tmp_path):
    t = table(spark, tmp_path)
    second = 1_000_000
    t.put(spark.createDataFrame([("a", 1, "open", 1), ("b", 1, "open", 2), ("c", 1, "open", 3)], COLUMNS), at=100 * second)
    t.put(spark.createDataFrame([("a", 1, "shut")], "name string, part long, status string"), at=200 * second)
    assert rows_of(t) == [("a", 1, "shut", 1), ("b", 1, "open", 2), ("c", 1, "open", 3)]
    now = F.timestamp_seconds(F.lit(260))
    assert rows_of(t, ttl_seconds=100, now=now) == [("a", 1, "shut", 1)] and len(rows_of(t, ttl_seconds=160, now=now)) == 3
    t.delete_where("size = 2", at=300 * second)
    t.create(spark.createDataFrame([("b", 1, "new", 9), ("c", 1, "new", 9)], COLUMNS), at=400 * second)
    assert rows_of(t) == [("a", 1, "shut", 1), ("b", 1, "new", 9), ("c", 1, "open", 3)]
    # A writer that was lost: its folder has rows, but no end.
    name = t.put(spark.createDataFrame([("a", 1, "half", 5)], COLUMNS), batch="lost")
    (tmp_path / "log" / name / "_SUCCESS").unlink()
    assert rows_of(t)[0] == ("a", 1, "shut", 1)
    with pytest.raises(ValueError):
        t.write(spark.createDataFrame([("a", 1)], "name string, part long"), "X")


def test_a_batch_that_arrives_while_compacting_stays(spark, tmp_path):
    t = table(spark, tmp_path)
    t.put(spark.createDataFrame([("a", 1, "one", 1)], COLUMNS), at=1)
    folded = t._folded

    def slow(log):
        table(spark, tmp_path).put(spark.createDataFrame([("a", 1, "two", None)], COLUMNS), at=2)
        return folded(log)

    t._folded = slow
    t.compact()
    assert rows_of(t) == [("a", 1, "two", 1)] and len(t._committed("base")) == 1


def test_store_rows_change(spark, tmp_path):
    from gristmill.sources.store import Store

    s = Store(spark, str(tmp_path))
    s.append("findings", spark.createDataFrame([("f1", "low", "open"), ("f2", "high", "open")], "finding_id string, severity string, status string"))
    s.update("findings", spark.createDataFrame([("f2", "resolved"), ("f9", "resolved")], "finding_id string, status string"), batch="one")
    s.update("findings", spark.createDataFrame([("f2", "resolved"), ("f9", "resolved")], "finding_id string, status string"), batch="one")
    assert sorted((r["finding_id"], r["severity"], r["status"]) for r in s.read("findings").collect()) == [("f1", "low", "open"), ("f2", "high", "resolved")]
    threads = [threading.Thread(target=lambda: Store(spark, str(tmp_path)).project("p")) for _ in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert s.read("projects").count() == 1
    rows = [(f"f{k}", "accept", k % 5) for k in range(30)]
    s.append("feedback", spark.createDataFrame(rows, "finding_id string, feedback_type string, day int").selectExpr("finding_id", "feedback_type", "cast(date_add(date'2024-01-01', day) AS timestamp_ntz) AS stored_at"))
    s.export_feedback(f"{tmp_path}/out")
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().split("\n") if x]
    import json

    got = [(json.loads(x)["stored_at"], json.loads(x)["finding_id"]) for x in lines]
    assert len(got) == 30 and got == sorted(sorted(got, key=lambda x: x[1]), key=lambda x: x[0], reverse=True)
