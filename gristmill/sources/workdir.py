"""The folder for tables that a job makes on its way."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def work_dir(spark: SparkSession, label: str) -> str:
    """A new name in the folder that driver and executors share, ``spark.checkpoint.dir`` of the session.

    Where that is unset and everything runs on this machine a temporary folder is made, and removed at exit.
    """
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="gristmill-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        base = f"file://{_own[app]}"
    return f"{base.rstrip('/')}/gristmill-{app}/{label}-{uuid.uuid4().hex[:12]}"
