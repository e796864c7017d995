"""Operators that work by positions and blocks, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import cluster, columns, distributions, evaluate, filters, generate, ordered, recommend, sampling, stats, transforms
from millrace.operators.ordering import medians


def test_medians_by_every_way(spark):
    rng = np.random.default_rng(3)
    x = [None if i % 11 == 0 else float(v) for i, v in enumerate(rng.normal(size=5001))]
    rows = [(i, v, i % 3, None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, x double, k int, n double")
    want = {"id": 2500.0, "x": float(np.median([v for v in x if v is not None])), "k": 1.0, "n": None}
    for most in (100_000, 0):
        assert medians(df, ["id", "x", "k", "n"], most) == pytest.approx(want)
    assert medians(df.limit(0), ["x"]) == {"x": None}
    assert medians(df.filter("id in (1, 2)"), ["id"]) == {"id": 1.5}
    assert stats.col_stats(df.limit(0).select("id", "x")).count() == 2
    assert {r["column"]: r["median"] for r in stats.profile(df.select("id", "x")).collect()} == pytest.approx({"id": 2500.0, "x": want["x"]})


def test_autocovariance_over_block_edges(spark):
    rng = np.random.default_rng(5)
    n = 70_000
    x = np.cumsum(rng.normal(size=n)) % 7
    df = spark.createDataFrame(list(enumerate(x.tolist())), "i int, x double")
    got = {r["lag"]: r["value"] for r in ordered.autocovariance(df, ["i"], "x", 5).collect()}
    d = x - x.mean()
    assert got == pytest.approx({k: float((d[:-k] * d[k:]).mean()) for k in range(1, 6)})


def test_drop_random_values_blanks_the_smallest_hashes(spark):
    df = spark.range(500).select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 2).alias("y"))
    out = filters.drop_random_values(df, 0.3, ["id"], ["x", "y"], 7)
    assert out.agg((F.count_if(F.col("x").isNull()) + F.count_if(F.col("y").isNull())).alias("n")).first()["n"] == 300
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, filters.drop_random_values(df.repartition(3), 0.3, ["id"], ["x", "y"], 7).collect()), key=str)


def test_noise_does_not_depend_on_batches(spark):
    a = distributions.noise(spark, 10_000, "gaussian", 4).toPandas().sort_values("id")["value"].to_numpy()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "77")
    try:
        b = distributions.noise(spark, 10_000, "gaussian", 4).toPandas().sort_values("id")["value"].to_numpy()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (a == b).all() and len(set(a)) == 10_000


def test_random_fill_draws_present_values(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else f"v{i}", float(i) if i % 2 else None, None) for i in range(4000)], "id int, s string, x double, n string")
    out = sampling.fill_missing(df, ["s", "x", "n"], random=True, seed=1)
    assert out.columns == df.columns and out.count() == 4000
    rows = {r["id"]: r for r in out.collect()}
    assert all(r["s"] == f"v{i}" for i, r in rows.items() if i % 4) and all(r["n"] is None for r in rows.values())
    drawn = {r["s"] for i, r in rows.items() if i % 4 == 0}
    assert len(drawn) > 500 and drawn <= {f"v{i}" for i in range(4000) if i % 4} and {r["x"] for r in rows.values()} <= {float(i) for i in range(1, 4000, 2)}


def test_impute_takes_any_key(spark):
    df = spark.createDataFrame([(10_000_000_000 + i, float(i), None if i % 5 == 0 else 2.0 * i) for i in range(40)], "k bigint, a double, b double")
    out = {r["k"]: r for r in transforms.impute(df, "k", ["a", "b"]).collect()}
    assert len(out) == 40 and all(r["b"] is not None for r in out.values()) and abs(out[10_000_000_007]["b"] - 14.0) < 1e-9
    assert transforms.impute(df.withColumn("k", F.col("k").cast("string")), "k", ["a", "b"]).count() == 40


def test_transduction_weighs_given_and_new_labels(spark):
    rows = [(i, float(i), "a" if i == 0 else "b" if i == 19 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, x double, label string")
    got = {r["id"]: r["label"] for r in cluster.neighbour_transduction(df, "id", ["x"], "label", 3).collect()}
    assert got[0] == "a" and got[19] == "b" and set(got.values()) == {"a", "b"}
    for f in (cluster.neighbour_transduction, cluster.constrained_linkage, cluster.graph_cut_transduction):
        with pytest.raises(ValueError):
            f(df, "id", ["x"], "label", limit=5)


def test_classes_in_one_scan(spark, tmp_path):
    df = spark.createDataFrame([(i, "xyz"[i % 3] if i % 4 else None) for i in range(40)], "id int, kind string")
    parts = sampling.split_class(df, "kind")
    assert list(parts) == [None, "x", "y", "z"] and sum(p.count() for p in parts.values()) == 40
    assert list(sampling.split_class(df.limit(0), "kind")) == []
    sampling.write_classes(df, "kind", str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert sorted(map(tuple, back.select("id", "kind").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    with pytest.raises(ValueError):
        sampling.split_class(df, "kind", limit=3)
    with pytest.raises(ValueError):
        columns.used_values(df, "kind", limit=2)
    assert columns.used_values(df, "kind", limit=3) == ["x", "y", "z"]


def test_sampled_curve_is_that_of_all_points(spark):
    rng = np.random.default_rng(8)
    rel = rng.random(3000) < 0.3
    score = np.round(rng.normal(size=3000) + rel, 2)
    df = spark.createDataFrame([(i, float(s), "p" if r else "n") for i, (s, r) in enumerate(zip(score, rel))], "id int, s double, y string")

    class Given:
        def fit(self, df):
            return self

        def predict(self, df):
            return df.withColumn("score", F.col("s"))

    got = evaluate.cross_precision_recall(Given, df, "y", "p", lambda p: p, ["id"], reps=1, samples=21)
    half = F.pmod(F.xxhash64("id", F.lit(0)), F.lit(2))
    curves = []
    for side in (1, 0):
        p = df.filter(half == side).withColumn("r", (F.col("y") == "p").cast("int"))
        curves.append([(x["recall"], x["precision"]) for x in evaluate.precision_recall(p, "s", "r").collect()])
    assert len(curves[0]) > 200 and np.array(got) == pytest.approx(np.array(evaluate.mean_curve(curves, 21)))


def test_boosted_sends_the_smaller_side(spark):
    r = spark.createDataFrame([(u, i, float(u + 2 * i)) for u in range(3) for i in range(40) if (u + i) % 5], "user int, item int, rating double")
    items = spark.createDataFrame([(i, float(i)) for i in range(40)], "item int, p double")
    for a in (r, r.filter("user < 1")):
        got = recommend.predict_boosted(a, items, a.select("user", "item"), ["p"])
        assert got.count() == a.count() and got.filter("prediction is null").count() == 0


def test_grid_walk(spark):
    got = [tuple(r) for r in generate.grid_walk(spark, 4001, 4, 3, seed=5, block=512).orderBy("id").collect()]
    assert [r[0] for r in got] == list(range(4001)) and got[0][1:3] == (2, 1)
    move = {0: (-1, 0), 1: (1, 0), 2: (0, -1), 3: (0, 1)}
    for a, b in zip(got, got[1:]):
        assert (a[1] + move[a[3]][0], a[2] + move[a[3]][1]) == b[1:3]
    # a cell is visited in proportion to its ways out
    n = np.zeros((3, 4))
    for r in got:
        n[r[2], r[1]] += 1
    ways = np.array([[2, 3, 3, 2], [3, 4, 4, 3], [2, 3, 3, 2]])
    assert np.abs(n / n.sum() - ways / ways.sum()).max() < 0.03
    assert got == [tuple(r) for r in generate.grid_walk(spark, 4001, 4, 3, seed=5, block=512).orderBy("id").collect()]
    assert generate.grid_walk(spark, 0, 4, 3).count() == 0
    with pytest.raises(ValueError):
        generate.grid_walk(spark, 10, 1, 1)


def test_sparse_medoids_against_all_choices(spark):
    rng = np.random.default_rng(2)
    m = np.where(rng.random((14, 9)) < 0.5, rng.normal(size=(14, 9)), 0)
    m[:7, 0] += 6
    m[7:, 1] += 6
    m[13] = 0
    i, j = np.nonzero(m)
    t = spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(i, j)] + [(13, 0, 0.0), (0, 2, None)], "row bigint, key bigint, value double")
    got, med = cluster.sparse_k_medoids(t, 2)
    norm = np.linalg.norm(m, axis=1)
    d = 1 - m @ m.T / np.maximum(np.outer(norm, norm), 1e-300)
    np.fill_diagonal(d, 0)
    cost = lambda c: d[:, list(c)].min(1).sum()
    assert cost(med) == pytest.approx(min(cost((a, b)) for a in range(14) for b in range(a)))
    assert {r["row"]: r["cluster"] for r in got.collect()} == {a: int(d[a, med].argmin()) for a in range(14)}
    assert cluster.sparse_k_medoids(t.limit(0), 2)[1] == []
    with pytest.raises(ValueError):
        cluster.sparse_k_medoids(t, 2, limit=3)
