"""Tables that cut lineage: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_dir(pid: int) -> str:
    """On a single machine without ``spark.checkpoint.dir``: a folder that goes with the process."""
    path = tempfile.mkdtemp(prefix="plexicount-")
    atexit.register(lambda: os.getpid() == pid and shutil.rmtree(path, ignore_errors=True))
    return f"file://{path}"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the folder given to ``setCheckpointDir``.
    Where neither is set a session on one machine gets its own; a cluster has to name one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    given = context._jsc.sc().getCheckpointDir()
    if not found and given.isDefined():
        return given.get().rstrip("/")
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_dir(os.getpid())
    if given.isEmpty():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; the folder's owner clears it."""
    return f"{shared_dir(spark)}/plexicount/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.  What is read later survives
    the loss of any executor and is never computed twice."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more, such as the rounds of a loop."""
    for df in tables:
        path = getattr(df, "_staged_at", None)
        if path:
            jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
