"""Tables stored between the steps of a query, in the shared folder of the session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder of this application below ``spark.checkpoint.dir``, or below the warehouse where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{at.rstrip('/')}/readloom-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _forget_at_exit(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_MARKED: set[str] = set()


def _folder(spark: SparkSession) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _forget_at_exit(spark: SparkSession) -> None:
    """Have the folder deleted when the driver ends."""
    if (at := scratch_dir(spark)) not in _MARKED:
        fs, path = _folder(spark)
        fs.deleteOnExit(path)
        _MARKED.add(at)


def clean(spark: SparkSession) -> None:
    """Delete what this application has stored; results not yet read are lost."""
    fs, path = _folder(spark)
    fs.delete(path, True)
    _MARKED.discard(scratch_dir(spark))
