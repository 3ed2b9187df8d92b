"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, VT, FF, CR (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of ids and flags that are broadcast at most (about 100 MB in an executor), and bytes that a task of a shuffle gets.
SMALL_ROWS = 2_000_000
TASK_BYTES = 64 << 20

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset and everything runs on this machine (tests, a laptop) a temporary folder is
    made and removed at exit; on a cluster it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="gristmill-")
            atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
        base = f"file://{_own_dirs[app]}"
    return f"{base.rstrip('/')}/gristmill-{app}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


_recorded: list[list[DataFrame]] = []


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """All tables that ``store`` makes meanwhile, to be dropped when what was made of them is stored."""
    made: list[DataFrame] = []
    _recorded.append(made)
    try:
        yield made
    finally:
        _recorded.remove(made)


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    for made in _recorded:
        made.append(out)
    return out


def _file_system(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables made by ``store`` that nothing will read any more."""
    for df in tables:
        fs, path = _file_system(df.sparkSession, df.stored_at)
        fs.delete(path, True)


def stored_bytes(df: DataFrame) -> int:
    """Size of a table made by ``store``."""
    fs, path = _file_system(df.sparkSession, df.stored_at)
    return int(fs.getContentSummary(path).getLength())


def small_side(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df``, a stored table of a few short columns, for the smaller side of a join.

    Up to ``most`` rows it is broadcast; beyond, both sides are shuffled and merged.
    """
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def bound_batches(spark: SparkSession) -> None:
    """Make ready for Python workers: they find this package, and get few rows at a time.

    Texts may be long, and a batch is held whole on both sides.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH"))))
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 500), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def word_count(text: str = "text"):
    """Number of words of a text column; null counts as empty."""
    return count_runs(text, r"\x20\x09-\x0D")


def count_runs(text: str, apart: str):
    """Number of runs of characters that are not in the class ``apart``; null counts as empty.

    Each run becomes one character, with what stands around it: no array of words is built.
    """
    one = F.regexp_replace(F.col(text), F.lit(f"[{apart}]*+[^{apart}]++[{apart}]*+"), F.lit("x"))
    return F.when(F.col(text).rlike(f"[^{apart}]"), F.length(one)).otherwise(0).cast("long")


def width(spark: SparkSession, size: int = 0, least: int = 8) -> int:
    """How many partitions a shuffle of about ``size`` bytes has: the session's, or more where a task would get over TASK_BYTES."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-size // TASK_BYTES))
