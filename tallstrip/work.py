"""The shared work folder, and tables settled in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local run has a folder of
    its own; on a cluster there is no such folder, so that is an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="tallstrip-"))
    return _own_folder[0]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{work_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def settle(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write df to a Parquet table in the shared folder and read it back: lineage ends here, and survives lost executors.
    The table goes with discard(), or when the driver's JVM ends."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.parquet(path)
    jvm_path, files = _file_system(spark, path)
    files.deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tallstrip_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the table behind a settled frame that nothing needs any more."""
    path = getattr(df, "tallstrip_path", None)
    if path:
        jvm_path, files = _file_system(df.sparkSession, path)
        files.delete(jvm_path, True)
