"""Queries on larger and repeated tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.operators import cluster, distance, recommend
from millrace.sources import tables


def test_top_k_breaks_ties_by_event(spark, tmp_path):
    rows = [(i, i % 3, float(i // 30 % 2)) for i in range(600)]
    x = spark.createDataFrame(rows[::-1], "event_id bigint, user_id bigint, value double")
    x.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in entry.queries()["top_k_events"](spark, str(tmp_path)).collect())
    want = [(u, e, v, k) for u in range(3) for k, (v, e) in enumerate(sorted(((v, e) for e, w, v in rows if w == u), key=lambda r: (-r[0], r[1]))[:3], 1)]
    assert got == sorted(want)


def test_baseline_of_all_pairs_moves_no_pair(spark, tmp_path):
    spark.createDataFrame([(o, o % 7) for o in range(60)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(i % 60, i % 11, float(i % 13)) for i in range(300)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        x = entry.queries()["recommend_baseline"](spark, str(tmp_path))
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.split("CartesianProduct")[0]
        got = {(r["user"], r["item"]): r["prediction"] for r in x.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rates: dict = {}
    for o, i, q in lines:
        rates.setdefault(i, {}).setdefault(o % 7, []).append(q)
    want = {i: np.mean([np.mean(v) for v in m.values()]) for i, m in rates.items()}
    assert len(got) == 7 * 11 and all(p == pytest.approx(want[i], abs=1e-6) for (_, i), p in got.items())


def test_medoids_of_more_rows_than_one_matrix(spark):
    rng = np.random.default_rng(5)
    few = [(i, float(v)) for i, v in enumerate(rng.normal(size=300).round(2))]
    x = spark.createDataFrame([(i + 300 * c, v) for c in range(20) for i, v in few], "id bigint, v double")
    got, med = cluster.k_medoids(x, "id", ["v"], 3)
    v = np.array([r[1] for r in few])
    assert max(med) < 300 and got.count() == 6000
    assert med == cluster.k_medoids(spark.createDataFrame(few, "id bigint, v double"), "id", ["v"], 3)[1]
    assert med == cluster.k_medoids(x, "id", ["v"], 3, limit=10)[1]  # in the tasks
    assert med == cluster._medoids((v[:, None] - v) ** 2, 3)
    y = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.normal(size=5200))], "id bigint, v double")
    assert cluster.k_medoids(y, "id", ["v"], 3)[0].count() == 5200


@pytest.mark.parametrize("n", [40, 2200])
def test_single_linkage_is_the_spanning_tree_cut(spark, n):
    rng = np.random.default_rng(6)
    v = np.r_[rng.normal(size=(n // 2, 2)).round(2), rng.normal(8, 0.01, size=(n - n // 2, 2)).round(4), [[8.5, 8.5]]]
    v = np.r_[v, v[: n // 4]]
    x = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(v)] + [(10**6, None, 1.0)], "id bigint, x double, y double")
    got = {r["id"]: r["cluster"] for r in cluster.single_linkage(x, "id", ["x", "y"], 6).collect()}
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    # Prim's tree: cutting its five longest edges, one less for the row with a null, leaves the groups
    near, tree, todo = d[0].copy(), [], np.ones(len(v), bool)
    at, todo[0] = np.zeros(len(v), int), False
    while todo.any():
        j = int(np.where(todo, near, np.inf).argmin())
        tree.append((near[j], int(at[j]), j))
        todo[j] = False
        at[d[j] < near], near = j, np.minimum(near, d[j])
    keep = sorted(tree)[: len(tree) - 4]
    group = list(range(len(v)))
    for _, a, b in keep:
        a, b = group[a], group[b]
        group = [a if g == b else g for g in group]
    sets = lambda pairs: {frozenset(i for i, g in pairs if g == k) for _, k in pairs}
    assert len(got) == len(v) + 1 and sets(list(got.items())) == sets(list(enumerate(group)) + [(10**6, -1)])
    assert [got[i] for i in sorted(got)][0] == 0


def test_single_linkage_of_many_copies(spark):
    x = spark.range(51_000).select(F.col("id").alias("k"), (F.col("id") % 100 * F.col("id") % 100).cast("double").alias("v"))
    got = cluster.single_linkage(x, "k", ["v"], 5)
    assert got.count() == 51_000 and got.select("cluster").distinct().count() == 5


def test_sparse_json_in_files(spark, tmp_path, monkeypatch):
    cells = [(i, (i * 7 + j) % 50, (i + j) / 3) for i in range(0, 900, 2) for j in range(i % 5)]
    t = spark.createDataFrame(cells, "row int, key int, value double")
    tables.write_sparse_json(t, f"{tmp_path}/m", 900, 50)
    text = "".join(p.read_text() for d in ("0-head", "1-rows", "2-end") for p in sorted((tmp_path / "m" / d).glob("part-*")))
    assert json.loads(text) == json.loads(tables.sparse_to_json(t, 900, 50))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got, default, cols = tables.read_sparse_json(spark, f"{tmp_path}/m")
        assert sorted(map(tuple, got.collect())) == sorted(cells) and (default, cols) == (0.0, 50)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    monkeypatch.setattr(tables, "sparse_to_json", None)  # nothing is gathered
    sf = "/root/testdata/sf0.001"
    assert entry.queries()["sparse_json_round_trip_ratings"](spark, sf).count() > 0


def test_sparse_similarity_moves_no_pair(spark, monkeypatch):
    monkeypatch.setattr(distance._meetings, "__defaults__", (40,))  # several blocks
    rng = np.random.default_rng(7)
    cells = {(int(r), int(k)): float(v) for r, k, v in zip(rng.integers(0, 60, 400), rng.zipf(1.5, 400) % 30, rng.integers(-3, 4, 400))}
    a = spark.createDataFrame([(r, k, v) for (r, k), v in cells.items()], "row int, key int, value double")
    b = a.filter("row % 3 = 0").select("row", "key", (F.col("value") + 1).alias("value"))
    for metric in ("cosine", "euclid"):
        for y in (a, b):
            x = distance.sparse_similarity(a, y, metric)
            assert "Join" not in x._jdf.queryExecution().executedPlan().toString()
            got = {(r[0], r[1]): (r[2], r[3]) for r in x.collect()}
            other = cells if y is a else {(r, k): v + 1 for (r, k), v in cells.items() if r % 3 == 0}
            meet: dict = {}
            for (r, k), v in cells.items():
                for (q, m), w in other.items():
                    if k == m:
                        meet.setdefault((r, q), []).append((v, w))
            want = {}
            for pair, vs in meet.items():
                v, w = np.array(vs).T
                n, d = np.sqrt((v * v).sum() * (w * w).sum()), ((v - w) ** 2).sum()
                want[pair] = ((v * w).sum() / n if n else 0.0) if metric == "cosine" else (1 / d if d else 1e12), len(vs)
            assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)


def test_users_who_rated_meet_without_moving_pairs(spark, monkeypatch):
    monkeypatch.setattr(distance._meetings, "__defaults__", (60,))  # several blocks
    rng = np.random.default_rng(8)
    cells = {(int(u), int(i)): float(v) for u, i, v in zip(rng.integers(0, 50, 500), rng.zipf(1.5, 500) % 40, rng.integers(-2, 5, 500))}
    r = spark.createDataFrame([(u, i, v) for (u, i), v in cells.items()], "user int, item int, rating double")
    x = recommend.predict_users_rated(r, 3)
    assert "Join" not in x._jdf.queryExecution().executedPlan().toString()
    got = {(u, i): p for u, i, p in x.collect()}
    want = {(u, i): p for u, i, p in recommend.predict_users(r, r.select("user", "item"), 3).collect()}
    assert got.keys() == want.keys() == cells.keys() and all(got[c] == pytest.approx(want[c]) for c in want)
