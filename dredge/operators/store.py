"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, or its warehouse where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (found or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder, which goes when the session's JVM ends.

    Lineage ends here, so a lost executor costs tasks; and a join with it is one of two plain shuffles,
    of which adaptive execution can split a hot key.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
