"""Cutting lineage at the folder that all executors share, and the small helpers that go with it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the checkpoint folder of the running context or of the session's settings.
    A session whose master is on this machine may do without, as tests do; then it is a temporary one. A cluster may not."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="arbor-shared-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows, written as a table in the shared folder and read again, so that nothing before has to be computed again."""
    path = f"{shared_folder(df.sparkSession)}/arbor-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark can write to, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``cut`` wrote and that nothing reads any more."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if folder.rsplit("/", 1)[1].startswith("arbor-"):
                delete(table.sparkSession, folder)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have in any case: ``name`` with as many underscores before it as that takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
