"""Adjustments of rules kept up to date as feedback arrives.

Each task adds up its feedback by rule and severity before the shuffle, so a rule that gets a third of all
feedback sends a few rows. The state of a rule is its counts and how often each severity was seen; after
any split of the feedback into batches it gives what ``learning.rule_adjustments`` gives for all of it. A rule
that gets no feedback for some time may be forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.learning import adjusted
from ..sources.changing import ChangingTable

_PARTIAL = "rule_id string, severity string, total long, accepts long, rejects long"
_STATE = "rule_id string, total long, accepts long, rejects long, mode string"
ADJUSTMENTS = "rule_id string, total long, accept_rate double, reject_rate double, suppress boolean, original_severity string, adjusted_severity string, multiplier double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kind = b.column("feedback_type")
        one = lambda k: pc.cast(pc.fill_null(pc.equal(kind, k), False), pa.int64())
        rows = pa.table({"rule_id": b.column("rule_id"), "severity": b.column("severity"), "total": pa.array([1] * b.num_rows, pa.int64()), "accepts": one("accept"), "rejects": one("reject")})
        sums = rows.group_by(["rule_id", "severity"]).aggregate([(c, "sum") for c in ("total", "accepts", "rejects")])
        yield from sums.select(["rule_id", "severity", "total_sum", "accepts_sum", "rejects_sum"]).rename_columns(["rule_id", "severity", "total", "accepts", "rejects"]).to_batches()


class RuleState(StatefulProcessor):
    """Counts of a rule, and a timer that forgets it after ``quiet_ms`` without feedback (never, if None)."""

    def __init__(self, quiet_ms: int | None = None) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "total long, accepts long, rejects long")
        self.levels = handle.getMapState("levels", "severity string", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        sums = [*self.counts.get()] if self.counts.exists() else [0, 0, 0]
        for b in rows:
            for k, c in enumerate(("total", "accepts", "rejects")):
                sums[k] += int(b[c].sum())
            for level, n in b.dropna(subset=["severity"]).groupby("severity")["total"].sum().items():
                seen = self.levels.getValue((level,))[0] if self.levels.containsKey((level,)) else 0
                self.levels.updateValue((level,), (seen + int(n),))
        self.counts.update(tuple(sums))
        if self.quiet_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        mode = min(((-n[0], level[0]) for level, n in self.levels.iterator()), default=(0, None))[1]
        yield pd.DataFrame({"rule_id": [key[0]], "total": [sums[0]], "accepts": [sums[1]], "rejects": [sums[2]], "mode": [mode]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.counts.clear()
        self.levels.clear()
        yield pd.DataFrame({"rule_id": [key[0]], "total": [0], "accepts": [0], "rejects": [0], "mode": [None]})

    def close(self) -> None:
        pass


def rule_states(feedback: DataFrame, quiet_ms: int | None = None) -> DataFrame:
    """The state of each rule that a batch of the stream ``feedback`` (rule_id, severity, feedback_type) touches; feedback without a rule has none."""
    rows = feedback.where("rule_id IS NOT NULL").select("rule_id", "severity", "feedback_type").mapInArrow(_partial, _PARTIAL)
    return rows.groupBy("rule_id").transformWithStateInPandas(RuleState(quiet_ms), _STATE, "Update", "None" if quiet_ms is None else "ProcessingTime")


def adjustments_table(spark: SparkSession, root: str) -> ChangingTable:
    return ChangingTable(spark, root, ADJUSTMENTS, ["rule_id"])


def start(feedback: DataFrame, root: str, checkpoint: str, least: int = 5, quiet_ms: int | None = None):
    """Keep the table of adjustments under ``root`` up to date; returns the running query, which takes what is there, or with ``quiet_ms`` one batch of it, and ends.

    A batch of the stream is a batch of the table with its number, so one that runs again after a failure changes nothing.
    """
    spark = feedback.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    table = adjustments_table(spark, root)

    def put(states: DataFrame, number: int) -> None:
        states = states.persist()
        try:
            table.put(adjusted(states, least), at=2 * number, batch=f"stream-{number:012}")
            table.delete(states.where("total = 0").select("rule_id"), at=2 * number + 1, batch=f"forgotten-{number:012}")
        finally:
            states.unpersist()

    # With timers Spark never runs out of batches, so such a run takes one.
    run = {"availableNow": True} if quiet_ms is None else {"once": True}
    return rule_states(feedback, quiet_ms).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**run).start()
