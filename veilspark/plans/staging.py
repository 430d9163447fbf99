"""Written intermediate results that outlive a lost executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is not set, a folder in the warehouse serves: the cluster shares that too.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


_STAGED: list[str] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """*df* written once as Parquet and read back, for plans that use it twice."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_staged(spark: SparkSession) -> None:
    """Delete what this process staged.  Staged hits hold raw values."""
    hadoop = spark._jsparkSession.sessionState().newHadoopConf()
    while _STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(hadoop).delete(path, True)
