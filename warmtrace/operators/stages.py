"""Cutting a plan where several later steps read the same rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, which goes with the process.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            named = tempfile.mkdtemp(prefix="warmtrace-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there.

    The steps that follow scan only the columns they use, and a lost executor
    costs no recomputation of what came before.
    """
    path = f"{shared_folder(df.sparkSession)}/stages/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> bool:
    """Delete all tables that operators wrote for this application; call it once its results are read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/stages")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
