import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators import learners
from millrace.streaming import online


@pytest.fixture()
def stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("ab"[i % 2], t0 + dt.timedelta(minutes=7 * i), float(i), "xy"[i % 2], "q" if i % 3 else "r") for i in range(60)]
    schema = "g string, ts timestamp, v double, f string, label string"
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), spark.createDataFrame(rows, schema)


def drain(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_windows_and_sessions(stream):
    s, batch = stream
    got = drain(online.windowed(s, "ts", "1 hour", "1 day", ["g"], "v"), "complete", "w1")
    want = online.windowed(batch, "ts", "1 hour", "1 day", ["g"], "v")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.agg(F.sum("n")).first()[0] == 60
    assert online.sessions(batch, "ts", "20 minutes", "1 day", ["g"], "v").count() == 2


def test_thinning(stream):
    s, _ = stream
    got = drain(online.thin(s, "g", "ts", 3600.0), "append", "t1").collect()
    for g in "ab":
        t = sorted(r["t"] for r in got if r["g"] == g)
        assert len(t) > 3 and all(b - a >= 3600 for a, b in zip(t, t[1:]))


def test_running_covariance_and_level(stream):
    s, batch = stream
    got = drain(online.running_covariance(s.withColumn("w", F.col("v") * 2 + 1), "g", "v", "w"), "update", "c1")
    last = got.groupBy("g").agg(F.max_by("covariance", "n").alias("c")).collect()
    want = {r["g"]: r["c"] for r in batch.groupBy("g").agg(F.covar_samp(F.col("v"), F.col("v") * 2 + 1).alias("c")).collect()}
    assert all(r["c"] == pytest.approx(want[r["g"]]) for r in last)
    lev = drain(online.level_filter(s, "g", "ts", "v", 1.0, 1.0), "update", "l1")
    assert lev.count() == 6 and lev.agg(F.max("level")).first()[0] > 50


def test_online_naive_bayes(stream, tmp_path):
    s, batch = stream
    nb = online.OnlineNaiveBayes(["f", "g"], "label")
    q = s.writeStream.foreachBatch(nb.update).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    whole = learners.NaiveBayes(["f", "g"], "label").fit(batch).model
    assert sorted(map(tuple, nb.learner.model["counts"])) == sorted(map(tuple, whole["counts"]))
    before = nb.to_json()
    nb.update(batch, nb.seen)
    assert nb.to_json() == before
