"""Readers with declared schemas for daily series, trials and curves in CSV, and partitioned sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: columns of the datasets that can be loaded ------------------------------------------
SCHEMAS = {
    "chicago": "date date, time int, year int, month int, doy int, dow int, death int, cvd int, resp int, temp double, dptp double, rhum double, pm10 double, o3 double",
    "drug": "id int, out double, sex string, day1_7 double, day8_14 double, day15_21 double, day22_28 double",
    "nested": "id int, case int, age int, riskset int, " + ", ".join(f"exp{a} double" for a in range(15, 65, 5)),
    "regions": "_row int, date date, regnames string, tmean double, death int",
    "cities": "cityAbb string, cityName string, State string, Date string, TMean double, Death int, DOW string",
    "curves": "temperature double, rr_fit double, rr_low double, rr_high double, mmt double",
}
DOSES = ("day1_7", "day8_14", "day15_21", "day22_28")
# --------------------------------------------------------------------------------------------------------


def read_csv(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A dataset by name; NaN becomes NULL."""
    if name not in SCHEMAS:
        raise ValueError(f"name: one of {sorted(SCHEMAS)}")
    df = spark.read.schema(SCHEMAS[name]).csv(path, header=True, nanValue="NaN", nullValue="NA")
    return df.select(*(F.nanvl(c, F.lit(None)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def load_dataset(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """'chicago', 'drug' or 'nested' from <folder>/<name>.csv."""
    if name not in ("chicago", "drug", "nested"):
        raise ValueError("name: chicago, drug or nested")
    return read_csv(spark, name, f"{folder}/{name}.csv")


def dose_history(drug: DataFrame, name: str = "history") -> DataFrame:
    """The 28 daily doses of a trial, latest day first (lag 0), from weekly ones."""
    days = F.flatten(F.array(*(F.array_repeat(F.col(c), 7) for c in reversed(DOSES))))
    return drug.withColumn(name, days)


def period_history(nested: DataFrame, name: str = "history") -> DataFrame:
    """Exposures of the ten five-year periods, latest first."""
    return nested.withColumn(name, F.array(*(F.col(f"exp{a}") for a in range(60, 10, -5))))


def city_series(cities: DataFrame) -> DataFrame:
    """Complete rows of all cities with a date."""
    got = cities.withColumn("d", F.coalesce(F.try_to_timestamp("Date", F.lit("yyyyMMdd")), F.try_to_timestamp("Date", F.lit("yyyy-MM-dd"))).cast("date"))
    return got.where("d is not null and TMean is not null and Death is not null")


def summary_columns(x: str, y: str) -> list[Column]:
    return [F.count("*").alias("n_days"), F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.avg(x).alias("x_mean"), F.sum(y).alias("total")]


def city_summary(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    return df.groupBy(by).agg(*summary_columns(x, y))


def with_names(df: DataFrame, key: str, names: DataFrame | dict[str, str], name: str) -> DataFrame:
    """df with the column name from a map of key, a dict or a table (key, name); rows that it does not have are left out."""
    table = df.sparkSession.createDataFrame(list(names.items()), f"{key} string, {name} string") if isinstance(names, dict) else names.select(key, name)
    return df.join(table, key)


def read_curves(spark: SparkSession, path: str, prefix: str = "curve_") -> DataFrame:
    """Curves of a folder of <prefix><Region>.csv, with the region from the file name."""
    df = spark.read.schema(SCHEMAS["curves"]).csv(path, header=True, pathGlobFilter=f"{prefix}*.csv")
    stem = F.regexp_extract("_metadata.file_name", rf"{prefix}(.*)\.csv", 1)
    return df.select("*", F.when(stem.startswith("Yorkshire"), "Yorkshire & Humber").otherwise(F.regexp_replace(stem, "_", " ")).alias("region"))


def write_by(df: DataFrame, by: str, path: str, fmt: str = "parquet") -> None:
    """A folder per value of by; csv with a header, or parquet."""
    writer = df.write.mode("overwrite").partitionBy(by)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)
