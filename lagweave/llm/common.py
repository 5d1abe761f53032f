"""Shared folder, materialised tables and word splitting for the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------------------------
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# -----------------------------------------------------------------------------------------------

#: bytes -> bytes: A-Z to a-z; 0-9, a-z and every byte from 0x80 stay; all else becomes a blank.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: The characters that ALNUM blanks, for F.translate.
BLANKED = "".join(chr(c) for c in range(128) if ALNUM[c] == 32)
#: Bytes of an Arrow batch of texts under small_batches.
BATCH_BYTES = "4m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset one in the warehouse."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there and survives lost executors.

    Unlike an unpersisted checkpoint this computes df once.
    """
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, limit: str = BATCH_BYTES) -> Iterator[None]:
    """Arrow batches of what runs meanwhile have about so many bytes, as those of Spark's default size, filled with
    texts, take memory several times over in Java and Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, limit)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where df has columns of these names."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        out.append(n)
    return out


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """A row number for joins; stable only once the result is materialised, so materialise it."""
    return df.withColumn(name, F.monotonically_increasing_id())


def ascii_lower(col):
    """Lower-case A-Z alone, as bytes.lower does."""
    return F.translate(col, UPPER, LOWER)
