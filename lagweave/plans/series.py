"""Daily and hourly series from the star-schema tables: exposure x, outcome y, integer time t."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lags import spine


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_number(d):
    return F.datediff(d, F.lit("1995-01-01").cast("date"))


def ship_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, t, y, x): line items per day shipped, and their mean quantity; days without any have y 0 and x NULL."""
    d = F.to_date("l_shipdate")
    got = table(spark, sf_dir, "lineitem").groupBy(d.alias("d")).agg(F.count("*").alias("y"), F.avg("l_quantity").alias("x"))
    full = spine(got.select(day_number(F.col("d")).alias("t"), "y", "x"), "t")
    return full.select(F.date_add(F.lit("1995-01-01").cast("date"), F.col("t")).alias("d"), "t", F.coalesce("y", F.lit(0)).alias("y"), "x")


def region_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r_name, d, t, y, x): orders per region and day, and their mean price in thousands."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    where = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(where, F.col("c_nationkey") == F.col("n_nationkey"))
    got = joined.groupBy("r_name", F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("y"), (F.avg("o_totalprice") / 1000).alias("x"))
    full = spine(got.select("r_name", day_number(F.col("d")).alias("t"), "y", "x"), "t", ["r_name"])
    return full.select("r_name", F.date_add(F.lit("1995-01-01").cast("date"), F.col("t")).alias("d"), "t", F.coalesce("y", F.lit(0)).alias("y"), "x")


def event_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, t, y, x): events per type and hour since 1970, and their mean value; no rows for empty hours."""
    hour = (F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type", hour.alias("t")).agg(F.count("*").alias("y"), F.avg("value").alias("x"))
