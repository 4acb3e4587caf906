"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one machine."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    if not spark.sparkContext.master.startswith(("local[", "local-")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


def stage(df: DataFrame) -> DataFrame:
    """Writes ``df`` once as a Parquet table in the shared folder and reads it back.

    Cuts the lineage, so that a lost executor costs no recomputation and
    every reader sees the same rows.  The table goes when the session ends.
    Nothing needs the shuffle files behind it any more; Spark removes them
    once the driver has collected their handles, so that is asked for here.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm, jsc = spark._jvm, spark.sparkContext._jsc
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(target)
    jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, key: str) -> DataFrame:
    """As ``stage``, in buckets of ``key``: later joins and groupings on it move only their other side."""
    spark = df.sparkSession
    name = f"quillspark_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/quillspark-{spark.sparkContext.applicationId}/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(spread(df), key).sortBy(key).saveAsTable(name)
    jvm, jsc = spark._jvm, spark.sparkContext._jsc
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(target)
    jvm.System.gc()
    return spark.table(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(text: str = "text"):
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def position(df: DataFrame, name: str) -> int:
    """Place of a column, named in any letter case as Spark allows."""
    return [c.lower() for c in df.columns].index(name.lower())


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores where ``df`` has such a column already."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def spread(df: DataFrame, floor: int = 1) -> int:
    """Number of shuffle partitions of the session, at least ``floor``."""
    return max(floor, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, doc_id, text) with a long ``rid`` that is unique and the same in every scan.

    The id itself where it is an integer, never null and never repeated; else
    the rows are numbered in the order of their ids, null ids last and equal
    ones in input order, and written once.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    if docs.schema[doc_id].dataType.typeName() in ("byte", "short", "integer", "long"):
        odd = docs.groupBy(F.col(doc_id).alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or k is null")
        if odd.isEmpty():
            return rows.select(F.col("doc_id").cast("long").alias("rid"), "doc_id", "text")
    return stage(_in_order(rows, "doc_id", "rid")).select("rid", "doc_id", "text")


def _in_order(rows: DataFrame, doc_id: str, name: str) -> DataFrame:
    """Adds numbers that grow with the id, and for equal or null ones with the place in the input: sorted parts are numbered one after the other."""
    place = free_name(rows, "place_in_input")
    ordered = rows.withColumn(place, F.monotonically_increasing_id()).orderBy(F.asc_nulls_last(doc_id), place).drop(place)
    return ordered.withColumn(name, F.monotonically_increasing_id())


def numbered(docs: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, str]:
    """All columns of ``docs`` and a long row number under a free name, the same in every scan.

    The number is the id where that is an integer, never null and never
    repeated; else rows are numbered as in ``keyed`` and written once.
    """
    name = free_name(docs, "row_number")
    if docs.schema[doc_id].dataType.typeName() in ("byte", "short", "integer", "long"):
        odd = docs.groupBy(F.col(doc_id).alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or k is null")
        if odd.isEmpty():
            return docs.withColumn(name, F.col(doc_id).cast("long")), name
    return stage(_in_order(docs, doc_id, name)), name
