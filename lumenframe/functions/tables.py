"""Intermediate tables of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def held(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the folder of spark.checkpoint.dir, reread. Only a local master may go without the setting."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        spark.conf.set("spark.checkpoint.dir", at := "file://" + tempfile.mkdtemp(prefix="lumenframe-"))
    path = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(df: DataFrame) -> None:
    """Deletes the files of a table made by held()."""
    files = df.inputFiles()
    if files:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
