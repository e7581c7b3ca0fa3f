"""Written intermediate tables: lineage and plans end there, and a lost executor costs no more than its own tasks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which the driver and all executors share. Where it is unset, an own temporary folder, but only on a
    local master: elsewhere other machines would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        own = tempfile.mkdtemp(prefix="sievemark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN[sc.applicationId] = Path(own).as_uri()
    return _OWN[sc.applicationId]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{folder(spark)}/sievemark-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, rows: int = 0) -> DataFrame:
    """``rows``: of a file at most (0: any number), so that the work on them spreads however few partitions wrote them."""
    path = new_path(df.sparkSession, tag)
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
