"""The folder for checkpoints, and folders in it for tables between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_checkpoints(spark: SparkSession) -> None:
    """Uses the cluster's folder, spark.checkpoint.dir.  Where none is set, a session with a local master gets a folder of
    this machine, as in tests; on a cluster that would be out of the executors' reach, so it is an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not (context.master or "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


#: Folders that this process has named, and that ``clear`` deletes.
_NAMED: list[str] = []


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name in the shared folder that nothing has yet."""
    shared_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}.{kind}"
    _NAMED.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Deletes the tables that were written between steps; results that still read them must be done with."""
    jvm = spark._jvm
    while _NAMED:
        path = jvm.org.apache.hadoop.fs.Path(_NAMED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
