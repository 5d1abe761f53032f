import numpy as np
from pyspark.sql import functions as F

from lagweave.functions.bases import BasisSpec, lag_basis
from lagweave.operators.crossbasis import CrossBasis
from lagweave.sources import tables
from lagweave.streaming import histories


def test_csv_sources(spark, tmp_path):
    (tmp_path / "chicago.csv").write_text("date,time,year,month,doy,dow,death,cvd,resp,temp,dptp,rhum,pm10,o3\n1987-01-01,1,1987,1,1,5,130,65,13,-0.28,31.5,95,26.9,4.3\n1987-01-02,2,1987,1,2,6,150,73,14,NaN,29.9,88,,5.1\n")
    df = tables.load_dataset(spark, "chicago", str(tmp_path))
    a, b = df.orderBy("date").collect()
    assert a.temp == -0.28 and b.temp is None and b.pm10 is None and str(a.date) == "1987-01-01"
    (tmp_path / "drug.csv").write_text("id,out,sex,day1_7,day8_14,day15_21,day22_28\n1,50,M,0,1,2,3\n")
    h = tables.dose_history(tables.load_dataset(spark, "drug", str(tmp_path))).first().history
    assert len(h) == 28 and h[:8] == [3.0] * 7 + [2.0]
    (tmp_path / "nested.csv").write_text("id,case,age,riskset," + ",".join(f"exp{a}" for a in range(15, 65, 5)) + "\n1,1,81,3," + ",".join(map(str, range(10))) + "\n")
    assert tables.period_history(tables.load_dataset(spark, "nested", str(tmp_path))).first().history[:2] == [9.0, 8.0]


def test_unknown_dataset(spark):
    for f in (lambda: tables.load_dataset(spark, "x", "/"), lambda: tables.read_csv(spark, "x", "/")):
        try:
            f()
            raise AssertionError
        except ValueError:
            pass


def test_cities_curves_and_sinks(spark, tmp_path):
    (tmp_path / "c.csv").write_text("cityAbb,cityName,State,Date,TMean,Death,DOW\nchic,Chicago,IL,19870102,1.5,100,5\nchic,Chicago,IL,1987-01-03,,90,6\nny,New York,NY,19870102,3,200,5\n")
    s = tables.city_series(tables.read_csv(spark, "cities", str(tmp_path / "c.csv")))
    assert {(r.cityAbb, str(r.d)) for r in s.collect()} == {("chic", "1987-01-02"), ("ny", "1987-01-02")}
    tables.write_by(s, "cityAbb", str(tmp_path / "out"), "csv")
    tables.write_by(s, "cityAbb", str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2 and (tmp_path / "out" / "cityAbb=ny").exists()
    for n in ("North_East", "Yorkshire_&_Humber"):
        (tmp_path / "curves").mkdir(exist_ok=True)
        (tmp_path / "curves" / f"curve_{n}.csv").write_text("temperature,rr_fit,rr_low,rr_high,mmt\n1.0,1.1,1.0,1.2,17\n")
    assert {r.region for r in tables.read_curves(spark, str(tmp_path / "curves")).collect()} == {"North East", "Yorkshire & Humber"}
    assert tables.city_summary(s, "State", "TMean", "Death").count() == 2


def test_stream_of_days_gives_the_batch_cross_basis(spark, tmp_path):
    x = np.random.default_rng(0).normal(10, 3, 30)
    days = [("a", t, float(x[t])) for t in range(30)]
    late = [days[i] for i in (*range(10), *range(11, 20))], [days[10], *days[20:]]
    (tmp_path / "in").mkdir()
    cb = CrossBasis(BasisSpec("poly", 2, scale=20.0), lag_basis(4, "poly", degree=1), (0, 4))
    stream = spark.readStream.schema("g string, t long, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for i, part in enumerate(late):
        spark.createDataFrame(part, "g string, t long, x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = histories.histories(stream, "g", "t", "x", 4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).withColumn("known", F.size(F.filter("history", lambda v: v.isNotNull())))
    last = cb.matrix(got.groupBy("g", "t").agg(F.max_by("history", "known").alias("history")), "history")
    want = {r.t: r.v2_l2 for r in cb.series(spark.createDataFrame(days, "g string, t long, x double"), "x", "t", ["g"]).collect()}
    mine = {r.t: r.v2_l2 for r in last.collect()}
    assert mine.keys() == want.keys() and all((a is None) == (want[t] is None) and (a is None or abs(a - want[t]) < 1e-9) for t, a in mine.items())
