"""Tables written once in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one machine."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    master = spark.sparkContext.master
    if master != "local" and not master.startswith(("local[", "local-")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


def fresh_path(spark: SparkSession, prefix: str = "staged") -> str:
    """A new path in the shared folder that goes when the session ends."""
    path = f"{shared_dir(spark)}/quillspark-{spark.sparkContext.applicationId}/{prefix}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, safe against lost executors."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a staged table that no reader needs any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
