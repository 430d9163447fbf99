"""A session with the settings the jobs here expect.

Anything the cluster already sets wins; only correctness-neutral defaults are
filled in.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, *, partitions: int = 8, memory: str = "16g") -> SparkSession:
    """For tests and the bench.  On a cluster use the session it provides."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veilspark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", str(4 * 1024 * 1024))
        .config("spark.sql.files.openCostInBytes", str(256 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
