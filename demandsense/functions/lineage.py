"""Cut a long plan: write the rows once and go on from the written table.

Used where a result is read several times or a plan would otherwise grow with each step.  Tables go to
the shared folder of ``spark.checkpoint.dir``.  Only a local session may do without it: there one process
writes and reads, so a temporary folder (removed at exit) is enough.  On several machines such a folder
would leave each executor's rows on its own disk, so a missing setting is an error.
"""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_unset: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    path = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if path:
        return path
    master = spark.sparkContext.master or ""
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"{SETTING} must name a folder that all executors share (master {master})")
    app = spark.sparkContext.applicationId
    if app not in _unset:
        _unset[app] = tempfile.mkdtemp(prefix="demandsense-")
        atexit.register(shutil.rmtree, _unset[app], ignore_errors=True)
    return _unset[app]


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, read back from a table written now."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
