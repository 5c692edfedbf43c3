"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where that is unset a local one is made, on a
    local master only: on a cluster the executors would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not base:
        base = context.getCheckpointDir()
        if not base:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="strandline-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/strandline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as compressed Parquet to the shared folder and read back. The files stay, as a lazy result may read
    them at any time; `clear_stored` removes those of a session."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Remove the files of tables that were written to the shared folder for a step and that nothing reads any more; a
    folder elsewhere stays."""
    for df in frames:
        spark = df.sparkSession
        base = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/strandline/{spark.sparkContext.applicationId}")
        files = base.getFileSystem(spark._jsc.hadoopConfiguration())
        own = files.makeQualified(base).toUri().getPath()
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
            if path.getParent().toUri().getPath() == own:
                files.delete(path, True)


def clear_stored(spark: SparkSession) -> None:
    """Remove what `stored` and the archives wrote under the shared folder, and the catalog's entries of bucketed tables
    there; no result that reads it may be in use."""
    for t in spark.catalog.listTables():
        if t.name.startswith("strandline_"):
            spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/strandline/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, taken: list[str]) -> str:
    """name, with as many underscores before it as it takes to differ from all columns in `taken`, in any case."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = "_" + name
    return name
