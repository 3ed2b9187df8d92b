"""Answers of a language model as a data source: ``spark.read.format("model_answers")``.

Requests are a Parquet folder (id, prompt); each row group is a partition and is read by one task. An answer is
written to a log before it is handed on, one small file named by the hash of model and prompt, put in its
place by a rename; a task that runs again, after a lost executor or in another job, finds it there and does not ask
again. The log is on any file system that Arrow reaches by its address.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "id string, answer string, error string, attempts int, asked boolean"


class Refused(Exception):
    """Raised by a provider for a request that will not succeed however often it is sent."""


@dataclass
class RowGroup(InputPartition):
    path: str
    group: int


def _place(address: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(address if "://" in address else f"file://{address}")


class AnswerLog:
    """Answers by the hash of what was asked."""

    def __init__(self, address: str) -> None:
        self.fs, self.root = _place(address)

    def _path(self, key: str) -> str:
        return f"{self.root}/{key[:2]}/{key}.json"

    def get(self, key: str) -> str | None:
        try:
            with self.fs.open_input_stream(self._path(key)) as f:
                return json.loads(f.read())["answer"]
        except FileNotFoundError:
            return None

    def put(self, key: str, answer: str) -> None:
        path = self._path(key)
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as f:
            f.write(json.dumps({"answer": answer}).encode())
        self.fs.move(part, path)  # whole or not at all; of two writers the last stays


def asked_once(prompt: str, model: str, provider: Callable[[str, str], str], log: AnswerLog, retries: int, wait: float) -> tuple[str | None, str | None, int, bool]:
    """Answer, error, attempts, and whether the provider was asked; errors pass after ``retries`` more attempts, each after twice the wait."""
    key = hashlib.sha256(f"{model}\0{prompt}".encode("utf-8", "surrogatepass")).hexdigest()
    if (known := log.get(key)) is not None:
        return known, None, 0, False
    for attempt in range(1, retries + 2):
        try:
            answer = provider(model, prompt)
        except Refused as e:
            return None, str(e), attempt, True
        except Exception as e:  # noqa: BLE001 - whatever the provider's client raises
            if attempt > retries:
                return None, f"{type(e).__name__}: {e}", attempt, True
            time.sleep(wait * 2 ** (attempt - 1))
        else:
            log.put(key, answer)
            return answer, None, attempt, True
    raise AssertionError


class ModelAnswers(DataSource):
    """Options: ``requests`` and ``log`` (addresses), ``provider`` (module:function of model and prompt), ``model``, ``retries`` (3), ``wait`` (seconds before the second attempt, 1)."""

    @classmethod
    def name(cls) -> str:
        return "model_answers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        missing = [k for k in ("requests", "log", "provider") if not options.get(k)]
        if missing:
            raise ValueError(f"option {', '.join(missing)} is missing")
        self.options = options

    def partitions(self) -> list[RowGroup]:
        """Only footers are read here; the requests are read by the tasks."""
        system, root = _place(self.options["requests"])
        found = system.get_file_info(arrow_fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == arrow_fs.FileType.Directory else [system.get_file_info(root)]
        paths = sorted(f.path for f in found if f.path.endswith(".parquet"))
        return [RowGroup(p, g) for p in paths for g in range(pq.ParquetFile(p, filesystem=system).num_row_groups)]

    def read(self, partition: RowGroup | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no request at all
            return
        o = self.options
        module, _, function = o["provider"].partition(":")
        provider, log = getattr(importlib.import_module(module), function), AnswerLog(o["log"])
        rows = pq.ParquetFile(partition.path, filesystem=_place(o["requests"])[0]).read_row_group(partition.group, ["id", "prompt"])
        shape = pa.schema([("id", pa.string()), ("answer", pa.string()), ("error", pa.string()), ("attempts", pa.int32()), ("asked", pa.bool_())])
        for k, prompt in zip(rows.column("id").cast(pa.string()).to_pylist(), rows.column("prompt").to_pylist(), strict=True):
            made = asked_once(prompt or "", o.get("model", ""), provider, log, int(o.get("retries", 3)), float(o.get("wait", 1)))
            yield pa.RecordBatch.from_pylist([dict(zip(shape.names, (k, *made), strict=True))], shape)


def ask_model(spark: SparkSession, requests: DataFrame, root: str, provider: str, model: str = "", rows_each: int = 1000, **options) -> DataFrame:
    """``id, answer, error, attempts, asked`` for each row of ``requests`` (id, prompt): null prompts are empty; a request that fails in the end has an error.

    Requests are written under ``root``, at most ``rows_each`` to a file and so to a task; answers are logged there and serve later calls with the same root.
    """
    spark.dataSource.register(ModelAnswers)
    folder = f"{root}/requests-{uuid.uuid4().hex[:12]}"
    requests.selectExpr("cast(id AS string) AS id", "coalesce(prompt, '') AS prompt").write.option("maxRecordsPerFile", rows_each).parquet(folder)
    read = spark.read.format("model_answers").option("requests", folder).option("log", f"{root}/answers").option("provider", provider).option("model", model)
    for k, v in options.items():
        read = read.option(k, str(v))
    return read.load()
