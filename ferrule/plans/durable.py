"""Cutting the lineage of iterative jobs in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """Write once under ``spark.checkpoint.dir`` and scan the result.

    Where that is unset, a session of one machine gets a temporary folder; on a
    cluster this is an error, since executors would not see each other's files.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ferrule-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a written table that nothing reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        if path.getName().startswith("written-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
