"""The stream of adjustments against the whole feedback, whatever the batches."""

import random

from pyspark.sql import functions as F

from gristmill.operators import learning
from gristmill.streaming import adjustments

FEEDBACK = "rule_id string, severity string, feedback_type string"


def feedback(seed, n):
    r = random.Random(seed)
    kind = {"good": "accept accept accept accept accept reject", "bad": "reject reject reject accept skip", "odd": "accept modify skip", None: "reject"}
    rules = ["good", "bad", "odd", "rare", None] + ["hot"] * 3
    rows = []
    for _ in range(n):
        rule = r.choice(rules)
        rows.append((rule, r.choice(["high", "low", "medium", None, "low"]) if rule != "odd" else None, r.choice(kind.get(rule, "accept reject modify skip").split())))
    return rows


def state(spark, root):
    return sorted(map(tuple, adjustments.adjustments_table(spark, root).read().collect()))


def test_any_split_gives_the_whole(spark, tmp_path):
    rows = feedback(1, 400)
    want = sorted(map(tuple, learning.rule_adjustments(spark.createDataFrame(rows, FEEDBACK)).collect()))
    root, at, r = str(tmp_path), 0, random.Random(2)
    stream = lambda: spark.readStream.schema(FEEDBACK).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    for size in (1, 7, 150, 400):  # files arrive between runs of the stream
        part = rows[at : at + size]
        at += size
        spark.createDataFrame(part, FEEDBACK).repartition(r.choice([1, 2])).write.mode("append").parquet(f"{root}/in")
        run = adjustments.start(stream(), f"{root}/out", f"{root}/checkpoint")
        run.awaitTermination()
        assert run.exception() is None
        now = learning.rule_adjustments(spark.createDataFrame(rows[:at], FEEDBACK))
        assert state(spark, f"{root}/out") == sorted(map(tuple, now.collect()))
    assert state(spark, f"{root}/out") == want and len(want) == 5
    # Started again with nothing new, and a batch that is put a second time.
    adjustments.start(stream(), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    table = adjustments.adjustments_table(spark, f"{root}/out")
    last = table._committed("log")[-2]
    rows_again = spark.read.parquet(f"{root}/out/log/{last}")
    again = spark.createDataFrame(rows_again.collect(), rows_again.schema)
    table.put(again.drop("_op", "_batch"), at=F.col("_at"), batch=last)
    table.compact()
    assert state(spark, f"{root}/out") == want


def test_quiet_rules_are_forgotten(spark, tmp_path):
    import time

    root = str(tmp_path)
    stream = lambda: spark.readStream.schema(FEEDBACK).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    for rule in ("first", "second", "third"):
        spark.createDataFrame([(rule, "low", "accept")] * 6, FEEDBACK).coalesce(1).write.mode("append").parquet(f"{root}/in")
        adjustments.start(stream(), f"{root}/out", f"{root}/checkpoint", quiet_ms=1).awaitTermination(60)
        time.sleep(0.05)
    left = {r[0] for r in state(spark, f"{root}/out")}
    assert "third" in left and "first" not in left
