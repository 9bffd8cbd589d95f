"""Tables that a plan needs several times, written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names, deleted when the application ends.

    Only a local master may leave the setting empty, as tests do: it gets a temporary folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    path = f"{at.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table: computed once, and of no lineage that a lost executor could bring back. Shuffle files of this step go at once."""
    path = f"{shared_path(df.sparkSession, what)}/table"
    before = df.sparkSession.conf.get(_CLEAN_SHUFFLES)
    try:
        df.sparkSession.conf.set(_CLEAN_SHUFFLES, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        df.sparkSession.conf.set(_CLEAN_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
