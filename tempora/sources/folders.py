"""Where tables go that more than one machine must see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where none is named, a session of one machine gets a folder of that machine;
    on a cluster this is an error, since a local folder holds only some of the parts.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def _hadoop(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it goes when the driver ends, or with clear_scratch()."""
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    path, fs = _hadoop(spark, folder)
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return folder


def new_folder(spark: SparkSession, name: str = "table") -> str:
    """A path in the scratch folder that nothing else uses."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all that this application wrote to its scratch folder; no result still to be read may depend on it."""
    path, fs = _hadoop(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    fs.delete(path, True)
