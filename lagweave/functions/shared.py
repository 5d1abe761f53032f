"""Tables that end a plan's lineage, written once to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset a folder in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return found.rstrip("/") if found else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def settled(df: DataFrame, what: str) -> DataFrame:
    """df, computed once and read back from files: lost executors cost no recomputation of what went before."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
