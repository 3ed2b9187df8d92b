"""Tables whose rows change: put, create if absent, delete, expire, on any file system that Spark reaches.

A change is a row: its key, what to do, when, and new values. Every write is a batch in a folder of its own,
which counts once Spark has committed it (``_SUCCESS``); so writers need no lock, a batch written again under its
name changes nothing, and readers see whole batches only. The state of a key follows from its changes, whatever
the order in which batches arrived. ``compact`` writes the state as a new base that names the batches it holds; a
batch that arrives meanwhile is not named and so stays in force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A change: P puts values, C creates the row if it is not there, D deletes it.
_CHANGE = "_op string, _at long, _batch string"


class ChangingTable:
    """A table under ``root`` with ``columns`` (a DDL string) and unique ``key`` columns.

    Values are put column by column: a null in a put leaves the column as it is. A key is there from its first put or
    create after its last delete. Of several creates the first counts, and puts win over creates. At equal
    times batches go by name. Null keys are keys like others.
    """

    def __init__(self, spark: SparkSession, root: str, columns: str, key: list[str]) -> None:
        self.spark, self.root, self.key = spark, root.rstrip("/"), list(key)
        self.schema = StructType.fromDDL(columns)
        self.values = [f.name for f in self.schema if f.name not in key]

    # Files

    def _committed(self, kind: str) -> list[str]:
        """Names of the whole batches or bases, in order; one listing of folders, whose number compaction bounds."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(path, "*/_SUCCESS")) or []
        return sorted(s.getPath().getParent().getName() for s in done)

    def exists(self) -> bool:
        """Whether there is any change."""
        return bool(self._committed("log") or self._committed("base"))

    def _read(self, kind: str, names: list[str], schema: str | StructType) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{kind}/{n}" for n in names])

    @property
    def _changes_schema(self) -> StructType:
        return StructType([*self.schema.fields, *StructType.fromDDL(_CHANGE).fields])

    # Changes

    def write(self, rows: DataFrame, op: str = "P", at: Column | int | None = None, batch: str | None = None) -> str:
        """Add a batch of changes: ``rows`` has the key and any of the columns. ``at`` is a time in microseconds, now if not given.

        A batch with the name of one that is there replaces it, so a job that runs again does no more. Of several rows of
        a key in a batch that have the same time, the greatest value of each column counts.
        """
        if op not in ("P", "C", "D"):
            raise ValueError(f"unknown change {op!r}")
        name = batch or uuid.uuid4().hex
        when = at if isinstance(at, Column) else F.lit(at) if at is not None else F.unix_micros(F.current_timestamp())
        have = set(rows.columns)
        cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]
        out = rows.select(*cols, F.lit(op).alias("_op"), when.cast("long").alias("_at"), F.lit(name).alias("_batch"))
        out.write.mode("overwrite").parquet(f"{self.root}/log/{name}")
        return name

    def put(self, rows: DataFrame, **options) -> str:
        return self.write(rows, "P", **options)

    def create(self, rows: DataFrame, **options) -> str:
        return self.write(rows, "C", **options)

    def delete(self, rows: DataFrame, **options) -> str:
        """Rows name the keys that go."""
        return self.write(rows, "D", **options)

    def delete_where(self, condition: Column | str, **options) -> str:
        """Delete all rows of the present state that fit."""
        return self.delete(self.read().where(condition).select(*self.key), **options)

    # State

    def _log(self) -> tuple[DataFrame, list[str]]:
        """All changes in force: the newest base, which is changes too, and the batches that it does not hold."""
        batches, bases = self._committed("log"), self._committed("base")
        if not bases:
            return self._read("log", batches, self._changes_schema), batches
        held = {r[0] for r in self._read("base", [f"{bases[-1]}/held"], "batch string").collect()}
        rest = [b for b in batches if b not in held]
        return self._read("base", [f"{bases[-1]}/rows"], self._changes_schema).unionByName(self._read("log", rest, self._changes_schema)), sorted(held | set(batches))

    def _same(self, rows: DataFrame) -> tuple[DataFrame, Column]:
        """``rows`` with its key columns renamed, and that they are those of the other side."""
        same = F.lit(True)
        for i, k in enumerate(self.key):
            rows, same = rows.withColumnRenamed(k, f"_k{i}"), same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return rows, same

    def _winners(self, log: DataFrame) -> DataFrame:
        """Of each key that is there: ``_put``, the last put; ``_made``, the first create, with its values; and of each column the last put of it.

        Two aggregations that combine before they shuffle, however many changes a key has.
        """
        order = F.struct("_at", "_batch")
        gone, same = self._same(log.where("_op = 'D'").groupBy(*self.key).agg(F.max(order).alias("_gone")))
        live = log.where("_op <> 'D'").join(gone, same, "left").where(F.col("_gone").isNull() | (order > F.col("_gone")))
        put, made = F.col("_op") == "P", F.col("_op") == "C"
        of = [F.max(F.when(put & F.col(c).isNotNull(), F.struct("_at", "_batch", F.col(c).alias("value")))).alias(f"_last_{c}") for c in self.values]
        return live.groupBy(*self.key).agg(F.max(F.when(put, order)).alias("_put"), F.min(F.when(made, F.struct("_at", "_batch", *self.values))).alias("_made"), *of)

    def _state(self, log: DataFrame) -> DataFrame:
        """All columns of each key that is there, and ``_at``, when it was last put, or created."""
        cols = [F.col(c) if c in self.key else F.coalesce(F.col(f"_last_{c}.value"), F.col(f"_made.{c}")).alias(c) for c in self.schema.fieldNames()]
        return self._winners(log).select(*cols, F.coalesce("_put._at", "_made._at").alias("_at"))

    def read(self, ttl_seconds: int | None = None, now: Column | None = None) -> DataFrame:
        """The present rows; with ``ttl_seconds`` only those that were last put, or created, so long ago at most."""
        state = self._state(self._log()[0])
        if ttl_seconds is not None:
            clock = F.unix_micros(now if now is not None else F.current_timestamp())
            state = state.where(clock - F.col("_at") <= ttl_seconds * 1_000_000)
        return state.select(*[f.name for f in self.schema])

    def get_or_create(self, rows: DataFrame, **options) -> DataFrame:
        """The rows of these keys, created with these values where they are not there; two that do so at once find the same."""
        known, same = self._same(self.read().select(*self.key))
        new = rows.join(known, same, "left_anti")
        if not new.isEmpty():
            self.create(new, **options)
        asked, same = self._same(rows.select(*self.key).distinct())
        return self.read().join(asked, same, "left_semi")

    def compact(self) -> None:
        """Write the state as a new base. What is deleted stays known until then; batches that arrive meanwhile stay in force."""
        log, held = self._log()
        number = max((int(b.split("-")[0]) for b in self._committed("base")), default=0) + 1
        name = f"{number:012}-{uuid.uuid4().hex[:8]}"
        base = f"{self.root}/base/{name}"
        self._folded(log).write.parquet(f"{base}/rows")
        self.spark.createDataFrame([(b,) for b in held], "batch string").write.parquet(f"{base}/held")
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{base}/_SUCCESS")
        done.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(done).close()

    def _folded(self, log: DataFrame) -> DataFrame:
        """The fewest changes that stand for ``log``, with their times, so that late ones find their place: one create a key, the puts that some column is from, the last delete."""
        w = self._winners(log)
        names = self.schema.fieldNames()
        lasts = [F.col(f"_last_{c}") for c in self.values]
        times = F.array_distinct(F.array_compact(F.array("_put", *[F.when(x.isNotNull(), F.struct(x["_at"].alias("_at"), x["_batch"].alias("_batch"))) for x in lasts])))
        puts = w.withColumn("_t", F.explode(times))
        here = lambda x: (x["_at"] == F.col("_t._at")) & (x["_batch"] == F.col("_t._batch"))
        puts = puts.select(*[F.col(c) if c in self.key else F.when(here(F.col(f"_last_{c}")), F.col(f"_last_{c}.value")).alias(c) for c in names], F.lit("P").alias("_op"), "_t._at", "_t._batch")
        made = w.where("_made IS NOT NULL").select(*[F.col(c) if c in self.key else F.col(f"_made.{c}").alias(c) for c in names], F.lit("C").alias("_op"), "_made._at", "_made._batch")
        gone = log.where("_op = 'D'").groupBy(*self.key).agg(F.max(F.struct("_at", "_batch")).alias("_t"))
        gone = gone.select(*[F.col(f.name) if f.name in self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema], F.lit("D").alias("_op"), "_t._at", "_t._batch")
        return puts.unionByName(made).unionByName(gone)
