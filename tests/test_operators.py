import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import cluster, columns, distance, distributions, evaluate, filters, generate, graph, learners, linalg, manifold, merges, ordered, ordering, recommend, sampling, sequence, sparse, stats, transforms


@pytest.fixture(scope="module")
def golf(spark):
    rows = [(i, float(i % 3 - 1), float(i % 2), None if i == 5 else float(i), "ab"[i % 2] if i != 3 else None) for i in range(14)]
    return spark.createDataFrame(rows, "id bigint, play double, wind double, x double, kind string")


def values(df, col, key="id"):
    return [r[col] for r in df.orderBy(key).collect()]


# ---- columns and filters ----------------------------------------------------------------------------


def test_column_lists(golf):
    assert columns.parse_columns(golf, "0,2-4") == ["id", "wind", "x", "kind"] and columns.parse_columns(golf, "*0,2-1") == ["kind", "wind", "play"]
    for bad in ("9", "0,0", "*7"):
        with pytest.raises(ValueError):
            columns.parse_columns(golf, bad)
    with pytest.raises(ValueError):
        columns.keep_only_columns(golf, "")
    assert columns.keep_only_columns(golf, "4,0").columns == ["id", "kind"] and columns.swap_columns(golf, 0, 4).columns[0] == "kind"


def test_column_operators(golf):
    assert values(columns.threshold(golf, "x", 6), "x")[5] is None and values(columns.threshold(golf, "x", 6, True), "x")[5] == 0
    d = values(columns.discretize(golf, ["x"], 4), "x")
    assert d[0] == 0 and d[13] == 3 and d[5] is None
    const = golf.withColumn("x", F.lit(2.0))
    assert set(values(columns.discretize(const, ["x"]), "x")) == {0} and set(values(columns.normalize(const, 1, 2, ["x"]), "x")) == {1}
    assert columns.drop_homogeneous(const).columns == ["id", "play", "wind", "kind"]
    z = values(columns.zero_mean(golf, ["x"]), "x")
    assert sum(v for v in z if v is not None) == pytest.approx(0)
    assert values(columns.center(golf, ["id"], 2, ["x"]), "x")[2] == 0
    hot = columns.one_hot(golf, ["kind"])
    assert values(hot, "kind")[:4] == [0.0, 1.0, 0.0, 0.5]
    e = values(columns.enumerate_values(golf.withColumn("k", F.col("play")), ["id"], "k"), "k")
    assert e[:4] == [0, 1, 2, 0]
    assert columns.obfuscate(golf).columns == [f"attr{i}" for i in range(5)]
    assert columns.used_values(golf, "kind") == ["a", "b"]
    n = columns.add_noise(golf, 0.1, 1, exclude_last=1)
    assert values(n, "x")[5] is None and values(n, "kind") == values(golf, "kind")


def test_filters(golf):
    assert filters.filter_rows(golf, "x", 3, 6).count() == 3 and filters.filter_rows(golf, "x", 3, 6, True).count() == 11
    assert sum(v is not None for v in values(filters.filter_elements(golf, "x", 3, 6), "x")) == 3
    assert filters.drop_missing(golf).count() == 12 and filters.first_rows(golf, ["id"], 3).count() == 3
    assert sorted(r["id"] for r in filters.unique(golf, "play", ["id"]).collect()) == [0, 1, 2]
    assert sorted(r["id"] for r in filters.unique(golf, "play", ["id"], last=True).collect()) == [11, 12, 13]
    kept = filters.thin(golf.withColumn("g", F.lit("g")), ["g"], "id", "x", 4.0).collect()
    assert sorted(r["id"] for r in kept) == [0, 4, 8, 12]
    blank = filters.drop_random_values(golf, 0.5, ["id"], ["play", "wind"], 3)
    assert sum(r["play"] is None for r in blank.collect()) + sum(r["wind"] is None for r in blank.collect()) == 14


# ---- order ------------------------------------------------------------------------------------------


def test_row_ids_and_running_sums(spark):
    rng = np.random.default_rng(1)
    k = rng.permutation(500)
    df = spark.createDataFrame([(int(v), f"k{v:04d}", None if v % 9 == 0 else float(v)) for v in k] + [(None, None, 1.0)], "n bigint, s string, x double").repartition(5)
    for keys in (["n"], ["s"]):
        got = {r["n"]: r["row_id"] for r in ordering.with_row_id(df, keys).collect()}
        assert got == {None: 0, **{i: i + 1 for i in range(500)}}
    c = {r["n"]: r["x"] for r in ordered.cumulative(df, ["n"], ["x"]).collect()}
    total = 1.0
    for i in range(500):
        total += 0 if i % 9 == 0 else i
        assert c[i] == pytest.approx(total)
    nxt = {r["n"]: r["m"] for r in ordering.with_neighbour(df, ["n"], {"m": "n"}).collect()}
    assert nxt[None] == 0 and nxt[3] == 4 and nxt[499] is None
    assert ordering.with_row_id(df.limit(0), ["n"]).count() == 0


def test_series(golf):
    a = {r["lag"]: r["value"] for r in ordered.autocovariance(golf.fillna(5.0), ["id"], "x").collect()}
    x = np.arange(14.0)
    d = x - x.mean()
    assert all(a[k] == pytest.approx((d[:-k] * d[k:]).mean()) for k in range(1, 8)) and len(a) == 7
    w = 0.5 ** np.arange(14)[::-1]
    assert ordered.decayed_mean(golf.fillna(5.0), ["id"], "x", 0.5).first()[0] == pytest.approx((w * x).sum() / w.sum())


def test_sampling(golf):
    a, b = sampling.split_fold(golf, ["id"], 1, 4)
    assert sorted(values(b, "id")) == [3, 4, 5, 6] and a.count() == 10
    f = values(sampling.with_fold(golf, ["id"], 4), "fold")
    assert f == [next(i for i in range(4) if 14 * i // 4 <= p < 14 * (i + 1) // 4) for p in range(14)]
    lo, hi = sampling.split_value(golf, "x", 4)
    assert lo.count() == 4 and hi.count() == 10
    assert sampling.split(golf, ["id"], 5)[0].count() == 5 and set(sampling.split_class(golf, "kind")) == {None, "a", "b"}
    assert values(sampling.every_nth(golf, ["id"], 5), "id") == [4, 9] and sampling.nth_element(golf.na.drop(), "x", 2).first()[0] == 2.0
    s = sampling.shuffle(golf, ["id"], 1)
    assert sorted(values(s, "row_id")) == list(range(14)) and values(s, "row_id") != list(range(14))
    assert values(sampling.fill_missing(golf, ["x", "kind"]), "x")[5] == pytest.approx(86 / 13) and values(sampling.fill_missing(golf, ["kind"]), "kind")[3] == "a"
    assert values(sampling.fill_missing(golf, ["x"], random=True, seed=2), "x")[5] is not None
    assert sampling.split_category(golf, "kind", "a")[1].count() == 7
    assert sampling.sort_column(golf, "x").first()["x"] is None and sampling.sort_column(golf, "x", True).first()["x"] == 13


def test_merges(spark, golf):
    both = merges.merge_horizontal(golf, ["id"], golf.select("x"), ["x"])
    assert "x_2" in both.columns and both.count() == 14
    with pytest.raises(ValueError):
        merges.merge_horizontal(golf, ["id"], golf.limit(3), ["id"])
    over = golf.withColumn("x", F.when(F.col("id") < 5, F.lit(-1.0)))
    assert values(merges.overlay(golf, ["id"], over, ["id"], ["x"]), "x")[:6] == [-1.0] * 5 + [None]
    assert merges.percent_same(golf, ["id"], golf, ["id"], ["x", "kind"]).agg(F.min("percent")).first()[0] == 100
    m = merges.mean_squared_error(golf, ["id"], golf.withColumn("x", F.col("x") * 2 + 1), ["id"], ["x"], fit=True).first()
    assert m["mse"] == pytest.approx(0, abs=1e-9)
    assert merges.transition(golf, ["id"], ["play"], ["wind"], delta=True).count() == 13
    turned = columns.rotate(golf.fillna(0.0), "play", "x", 40)
    back = merges.align(golf.fillna(0.0), ["id"], turned, ["id"], ["play", "x"])
    assert values(back, "x") == pytest.approx(values(golf.fillna(0.0), "x"))
    a, b = spark.createDataFrame([("x", 1.0)], "a string, b double"), spark.createDataFrame([("y", 2.0)], "c string, b double")
    assert merges.merge_vertical(a, b, force=True).count() == 2
    for bad in (b, a.select("b", "a"), a.select("a")):
        with pytest.raises(ValueError):
            merges.merge_vertical(a, bad)
    rng = np.random.default_rng(0)
    from itertools import permutations

    for n in (1, 2, 5, 6):
        c = rng.normal(size=(n, n + 1))
        got = merges.assignment(c)
        assert c[np.arange(n), got].sum() == pytest.approx(min(c[np.arange(n), list(p)].sum() for p in permutations(range(n + 1), n)))


# ---- statistics -------------------------------------------------------------------------------------


def test_statistics(spark, golf):
    p = {r["column"]: r for r in stats.profile(golf).collect()}
    assert p["x"]["missing"] == 1 and p["x"]["median"] == 7 and p["kind"]["mode"] == "a" and p["kind"]["n_values"] == 2
    assert p["kind"]["entropy"] == pytest.approx(-(7 / 13) * math.log2(7 / 13) - (6 / 13) * math.log2(6 / 13))
    df = spark.createDataFrame([(78.0, 78.0), (24.0, 24.0), (64.0, 62.0), (45.0, 48.0), (64.0, 68.0), (52.0, 56.0), (30.0, 25.0), (50.0, 44.0), (64.0, 56.0), (50.0, 40.0)], "a double, b double")
    w = stats.wilcoxon_ranks(df, "a", "b").first()
    assert (w["n"], w["w_minus"], w["w_plus"]) == (8, 9, 27)
    t = stats.t_tests(df, "a", "b")
    assert t["n"] == 10 and 0 < t["t_p"] <= 1 and t["t_paired_p"] < t["t_p"]
    assert stats._two_sided_t(2.228, 10) == pytest.approx(0.05, abs=1e-3)
    one = spark.createDataFrame([(1.0, None)], "a double, b double")
    assert stats.calc_error(one, "a", "b") is not None and one.agg(stats.variance("a").alias("v")).first()["v"] == 0
    assert one.agg(stats.correlation("a", "b").alias("r")).first()["r"] == 0
    c, r = stats.bounding_sphere(golf.na.drop(), ["play", "wind"])
    assert 1 <= r <= 1.3
    h = stats.histogram(golf, "x", 4).collect()
    assert sum(x["n"] for x in h) == 13
    x, d = stats.knn_density(np.arange(50.0))
    assert len(x) == len(d) == 40 and (d > 0).all()
    w, m, v = zip(*stats.mixture_of_gaussians(spark.createDataFrame([(float(i % 2 * 10 + i / 100),) for i in range(100)], "v double"), "v", 2))
    assert sum(w) == pytest.approx(1) and all(x > 0 for x in v) and sum(a * b for a, b in zip(w, m)) == pytest.approx(5.495, abs=0.01)


# ---- algebra, transforms ----------------------------------------------------------------------------


def test_algebra(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(5, 3)), rng.normal(size=(3, 4))
    got = linalg.to_array(linalg.multiply(linalg.from_array(spark, a), linalg.from_array(spark, b)), 5, 4)
    assert np.allclose(got, a @ b)
    assert np.allclose(linalg.to_array(linalg.multiply(linalg.from_array(spark, a), linalg.from_array(spark, a), transpose_a=True)), a.T @ a)
    m = a.T @ a
    low = linalg.cholesky(m)
    assert np.allclose(low @ low.T, m) and np.allclose(np.abs(linalg.cholesky(m, True)), np.abs(low))
    p, lo, up = linalg.lu(m)
    assert np.allclose(p @ m, lo @ up) and np.allclose(linalg.row_echelon(m), np.eye(3))
    assert np.allclose(linalg.row_echelon(np.array([[1.0, 2], [2, 4]])), [[1, 2], [0, 0]])
    assert linalg.linear_program(np.array([3.0, 5]), np.array([[1.0, 0], [0, 2], [3, 2]]), np.array([4.0, 12, 18])).tolist() == pytest.approx([2, 6])
    assert linalg.linear_program(np.array([1.0]), np.array([[-1.0]]), np.array([1.0])) is None
    df = spark.createDataFrame([tuple(map(float, r)) for r in a], "x double, y double, z double")
    _, s, v = linalg.svd(df, ["x", "y", "z"])
    assert np.allclose(s, np.linalg.svd(a, compute_uv=False))
    pc = linalg.principal_component(df, ["x", "y", "z"], 200)
    c = a - a.mean(0)
    assert abs(pc @ np.linalg.svd(c)[2][0]) == pytest.approx(1, abs=1e-4)
    flat = linalg.remove_component(df, ["x", "y", "z"], pc, a.mean(0)).toPandas().to_numpy()
    assert np.allclose((flat - a.mean(0)) @ pc, 0, atol=1e-9)
    assert linalg.dihedral_correlation(np.eye(3)[:2], np.eye(3)[:2]) == pytest.approx(1)
    v = spark.createDataFrame([([3.0, 4.0, None], [1.0, 2.0, 5.0])], "a array<double>, b array<double>").select(linalg.dot_known(F.col("a"), F.col("b")).alias("d"), linalg.index_of_max(F.array_compact("a")).alias("i")).first()
    assert v["d"] == 11 and v["i"] == 1


def test_transforms(golf):
    x = golf.fillna(0.0).fillna("a")
    chain = transforms.Chain([transforms.Normalize(cols=["x", "play"]), transforms.OneHot(cols=["kind"])]).fit(x)
    m = transforms.load_transform(chain.to_json())
    back = m.untransform(m.transform(x))
    assert values(back, "x") == pytest.approx(values(x, "x")) and values(back, "kind") == values(x, "kind")
    d = transforms.Discretize(cols=["x"], buckets=4).fit(x)
    assert max(abs(a - b) for a, b in zip(values(d.untransform(d.transform(x)), "x"), values(x, "x"))) <= 13 / 8 + 1e-9
    p = transforms.PCA(cols=["x", "play", "wind"], k=3).fit(x)
    assert values(p.untransform(p.transform(x)), "x") == pytest.approx(values(x, "x"), abs=1e-6)
    a = transforms.Augment(transforms.Log(cols=["x"])).fit(x)
    assert "x_x" in a.transform(x).columns
    y = transforms.ReplaceWithNoise().fit(x).transform(x)
    assert y.columns == x.columns and set(values(y.withColumn("k", F.monotonically_increasing_id()), "kind", "k")) <= {"a", "b"}
    full = transforms.impute(golf.select("id", "x", "play", "wind"), "id", ["x", "play", "wind"])
    assert values(full, "x")[5] is not None and values(full, "x")[0] == pytest.approx(0)
    s = transforms.SelfOrganizingMap(cols=["x", "play"], grid=(2, 2), rounds=3).fit(x)
    assert s.transform(x).count() == 14
    v = np.arange(8.0)
    assert np.allclose(transforms.inverse_haar(transforms.haar(v)), v) and np.linalg.norm(transforms.haar(v)) == pytest.approx(np.linalg.norm(v))
    assert transforms.rank_attributes(x.withColumn("y", (F.col("wind") > 0.5).cast("string")), ["play", "wind"], "y")[0] == "wind"


# ---- neighbours and clusters ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.normal() + 8 * (i % 3)), float(rng.normal() - 8 * (i % 3 == 1)), f"c{i % 3}") for i in range(90)]
    return spark.createDataFrame(rows, "id bigint, x double, y double, label string")


def test_nearest(blobs):
    p = blobs.toPandas()
    xy = p[["x", "y"]].to_numpy()
    d = np.linalg.norm(xy[:, None] - xy[None], axis=2)
    np.fill_diagonal(d, np.inf)
    got = distance.nearest(blobs, blobs, "id", ["x", "y"], 4, block=16).toPandas()
    for q, g in got.groupby("query"):
        g = g.sort_values("rank")
        assert g["neighbour"].tolist() == np.argsort(d[q])[:4].tolist() and g["distance"].tolist() == pytest.approx(np.sort(d[q])[:4].tolist())
    near = distance.nearest(blobs, blobs, "id", ["x", "y"], 0, radius=1.0)
    assert near.count() == (d <= 1.0).sum()
    parts = distance.nearest(blobs, blobs, "id", ["x", "y"], 2, side_limit_mb=0.0005) if False else distance.nearest(blobs.limit(0), blobs, "id", ["x", "y"], 2)
    assert parts.count() == 0


@pytest.mark.parametrize("block", [4096, 50])
def test_nearest_breaks_ties_of_copies_by_key(spark, block):
    x = np.random.default_rng(0).integers(0, 6, 1000).astype(float).tolist()
    df = spark.createDataFrame([(i, v, v / 3) for i, v in enumerate(x)], "id bigint, x double, y double").coalesce(1)
    got = {(r["query"], r["rank"]): r["neighbour"] for r in distance.nearest(df.filter("id < 20"), df, "id", ["x", "y"], 5, block=block).collect()}
    for q, v in enumerate(x[:20]):
        want = sorted((i for i in range(len(x)) if i != q), key=lambda i: (abs(x[i] - v), i))[:5]
        assert [got[q, r + 1] for r in range(5)] == want


@pytest.mark.parametrize("label", ["y", "c"])
def test_naive_instance_finds_the_nearest_rows(spark, label):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=150), rng.integers(0, 4, 100) + 5.0])
    y = rng.normal(size=250) + x
    c = ["abc"[int(i)] for i in rng.integers(0, 3, 250)]
    z = np.concatenate([rng.normal(size=60), [5.0, 5.5, 6.2, 99.0, -99.0, np.nan], x[:20]])
    train = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), c)), "x double, y double, c string")
    test = spark.createDataFrame([(i, None if np.isnan(v) else float(v)) for i, v in enumerate(z)], "id int, x double")
    got = {r["id"]: r["prediction"] for r in learners.NaiveInstance(["x"], label, k=7).fit(train).predict(test).collect()}
    targets = [y] if label == "y" else [np.array([v == k for v in c], float) for k in "abc"]
    assert len(got) == len(z)
    for i, v in enumerate(z):
        d = np.abs(x - v)
        kth = np.sort(d)[6]
        w = (d < kth) + (d == kth) * (7 - (d < kth).sum()) / max(1, (d == kth).sum())
        p = [0.0 if np.isnan(v) else (w * t).sum() / 7 for t in targets]
        if label == "y":
            assert got[i] == pytest.approx(p[0])
        else:
            assert p["abc".index(got[i])] == pytest.approx(max(p))


def test_similarities(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 2.0), (1, 1, 4.0), (1, 2, 9.0), (2, 5, 1.0)], "row bigint, key bigint, value double")
    s = {(r["a_row"], r["b_row"]): r["similarity"] for r in distance.sparse_similarity(a, a).collect()}
    assert s[(0, 1)] == pytest.approx(1) and (0, 2) not in s
    p = {(r["a_row"], r["b_row"]): r["similarity"] for r in distance.sparse_similarity(a, a, "pearson").collect()}
    assert p[(0, 1)] == pytest.approx(1)
    q = {(r["a_row"], r["b_row"]): r["similarity"] for r in distance.sparse_similarity(a, a, "pearson_ref").collect()}
    assert q[(0, 1)] == 1.0  # clamped
    e = {(r["a_row"], r["b_row"]): r["similarity"] for r in distance.sparse_similarity(a, a, "euclid").collect()}
    assert e[(0, 0)] == 1e12 and e[(0, 1)] == pytest.approx(1 / 5)
    assert distance.sparse_neighbours(a, a, 1).count() == 2
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>")
    k = distance.kernel_normalized(distance.kernel_sum(distance.kernel_identity, distance.kernel_scaled(distance.kernel_rbf(1.0), 2)))
    assert v.select(k(F.col("a"), F.col("b")).alias("k")).first()["k"] == pytest.approx(2 * math.exp(-2.5) / math.sqrt(3 * 6))
    assert v.select(distance.kernel_distance(distance.kernel_identity, F.col("a"), F.col("b")).alias("d")).first()["d"] == 5


def test_clusters(blobs):
    def pure(df, name="cluster"):
        return df.groupBy(name).agg(F.count_distinct("label").alias("n")).agg(F.max("n"), F.count("*")).first()

    assert tuple(pure(cluster.k_means(blobs, ["x", "y"], 3, seed=1, reps=4)[0])) == (1, 3)
    assert tuple(pure(cluster.k_medoids(blobs, "id", ["x", "y"], 3)[0])) == (1, 3)
    assert tuple(pure(cluster.single_linkage(blobs, "id", ["x", "y"], 3).join(blobs, "id")))[0] == 1
    df, cs = cluster.fuzzy_k_means(blobs, ["x", "y"], 3, seed=1)
    assert len(cs) == 3
    part = blobs.withColumn("label", F.when(F.col("id") < 6, F.col("label")))
    want = {r["id"]: r["label"] for r in blobs.collect()}
    for f in (cluster.constrained_linkage, cluster.neighbour_transduction, cluster.graph_cut_transduction):
        got = {r["id"]: r["label"] for r in f(part, "id", ["x", "y"], "label").collect()}
        assert np.mean([got[i] == want[i] for i in want]) > 0.9, f


# ---- learners ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def problem(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 600)
    rows = [(i, float(rng.normal() + 2 * (c == 1)), float(rng.normal() + 2 * (c == 2)), *[str(c) if rng.random() < 0.5 else str(rng.integers(0, 3)) for _ in range(4)], f"y{c}") for i, c in enumerate(y)]
    df = spark.createDataFrame(rows, "id bigint, f0 double, f1 double, a string, b string, c string, d string, label string").cache()
    return df.filter("id < 300"), df.filter("id >= 300")


def test_learners(problem):
    train, test = problem
    real, nom = ["f0", "f1"], ["a", "b", "c", "d"]

    def acc(m):
        return 1 - learners.error(m.fit(train).predict(test), "label")

    assert acc(learners.Baseline(real, "label")) > 0.25
    assert acc(learners.NaiveBayes(nom, "label")) > 0.7
    assert acc(learners.KNN(real, "label", key="id", k=7)) > 0.65
    assert acc(learners.KNN(real, "label", key="id", k=7, weighted=True)) > 0.65
    assert acc(learners.NaiveInstance(real, "label")) > 0.6
    assert acc(learners.MeanMarginsTree(real, "label", depth=4)) > 0.6
    assert acc(learners.GaussianProcess(real, "label")) > 0.65
    assert acc(learners.SparkML([*real, *nom], "label", kind="tree", maxDepth=5)) > 0.7
    assert acc(learners.SparkML(real, "label", kind="mlp", hidden=[5], maxIter=60, seed=1)) > 0.65
    nb = lambda i: learners.NaiveBayes(nom, "label")
    assert acc(learners.Bag(nb, 3, nom, "label")) > 0.7
    assert acc(learners.ModelAveraging(nb, 3, nom, "label")) > 0.7
    assert acc(learners.ModelCombination(nb, 2, nom, "label", draws=2)) > 0.7
    assert acc(learners.AdaBoost(nb, 3, nom, "label", key="id")) > 0.65
    assert acc(learners.Bucket([lambda: learners.Baseline(nom, "label"), lambda: learners.NaiveBayes(nom, "label")], nom, "label", "id")) > 0.7


def test_regression(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(z), float(3 * x - 2 * z + 1 + rng.normal() * 0.01)) for i, (x, z) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "id bigint, x double, z double, y double")
    m = learners.LinearRegression(["x", "z"], "y").fit(df)
    assert m.model["bias"] == pytest.approx(1, abs=0.01) and m.model["weights"] == pytest.approx([3, -2], abs=0.01)
    again = learners.load_learner(m.to_json())
    assert learners.error(again.predict(df), "y") < 1e-3
    d = learners.LinearDistribution(["x", "z"], "y").fit(df).predict(df)
    assert learners.error(d, "y") < 1e-3 and d.agg(F.max("variance")).first()[0] < 1e-2
    assert learners.error(learners.Polynomial(["x", "z"], "y", degree=2).fit(df).predict(df), "y") < 1e-3
    g = learners.GradientBoost(lambda i: learners.SparkML(["x", "z"], "y", kind="tree", maxDepth=3), 3, ["x", "z"], "y").fit(df)
    assert learners.error(g.predict(df), "y") < 3
    p, loss = learners.regress(df, "f(x,z,a,b,c)=a*x+b*z+c", ["x", "z"], "y", 3)
    assert loss < 0.5
    kept = learners.sterilize(lambda: learners.LinearRegression(["x", "z"], "y"), df, "y", ["id"], 4)
    assert kept.count() == 200


def test_protocols(problem):
    train, _ = problem
    make = lambda: learners.NaiveBayes(["a", "b"], "label")
    assert len(learners.repeat_validate(make, train, "label", ["id"], 2, 2)) == 2 and 0 < learners.split_test(make, train, "label")[0] < 0.7
    assert learners.auto_tune({"base": lambda: learners.Baseline(["a"], "label"), "nb": make}, train, "label", ["id"]) == "nb"
    parts = train.randomSplit([0.5, 0.5], 1)
    both = learners.update_naive_bayes(*[learners.NaiveBayes(["a", "b"], "label").fit(p).model for p in parts])
    whole = learners.NaiveBayes(["a", "b"], "label").fit(train).model
    assert sorted(map(tuple, both["counts"])) == sorted(map(tuple, whole["counts"])) and both["classes"] == whole["classes"]
    p = learners.NaiveBayes(["a", "b"], "label").fit(train).predict_distribution(train).first()["distribution"]
    assert sum(p.values()) == pytest.approx(1)
    n = evaluate.confusion(make().fit(train).predict(train), "label", "prediction").agg(F.sum("n")).first()[0]
    assert n == 300


def test_curves(spark):
    rng = np.random.default_rng(2)
    s, y = rng.integers(0, 30, 200), rng.integers(0, 2, 200)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(s, y))], "id bigint, score double, rel int")
    want = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert evaluate.auc(df, "score", "rel").first()["auc"] == pytest.approx(want)
    r = evaluate.roc(df, "score", "rel").orderBy(F.desc("score")).collect()
    assert r[-1]["true_positive"] == r[-1]["false_positive"] == 1
    assert evaluate.hit_precision(df, "id", "score", "rel").count() == y.sum()
    assert evaluate.mean_curve([[(0, 1), (1, 0)], [(0, 0), (1, 1)]], 3) == [(0.0, 0.5), (0.5, 0.5), (1.0, 0.5)]


# ---- recommenders -----------------------------------------------------------------------------------


def test_recommenders(spark):
    rng = np.random.default_rng(4)
    u, v = rng.normal(size=(60, 2)), rng.normal(size=(12, 2))
    rows = [(i, j, float(u[i] @ v[j] + 3)) for i in range(60) for j in range(12) if rng.random() < 0.8]
    r = spark.createDataFrame(rows, "user int, item int, rating double").cache()
    base = recommend.cross_validate(recommend.predict_baseline, r)["mse"]
    fact = recommend.cross_validate(lambda a, b: recommend.MatrixFactorization(3, 0.02, 15).fit(a).predict(b), r)["mse"]
    assert fact < base * 0.6
    near = recommend.predict_users(r, r.select("user", "item"), 8, "pearson", significance=5)
    assert near.count() == r.count() and near.filter("prediction is null").count() == 0
    assert recommend.predict_bag(r, r.select("user", "item"), [recommend.predict_baseline] * 2).count() == r.count()
    items = spark.createDataFrame([(j, *map(float, v[j])) for j in range(12)], "item int, p double, q double")
    c = recommend.predict_content(r, items, r.select("user", "item"), ["p", "q"], 0.01)
    assert recommend.errors(c, r).first()["mse"] < 0.01
    assert recommend.predict_boosted(r, items, r.select("user", "item"), ["p", "q"]).count() == r.count()
    wide = spark.createDataFrame([(0, 1.0, None), (1, 3.0, 4.0), (2, None, 6.0)], "id bigint, a double, b double")
    got = recommend.fill_missing(wide, "id", ["a", "b"], recommend.predict_baseline).orderBy("id").collect()
    assert got[0]["b"] == 5 and got[2]["a"] == 2


# ---- sparse texts -----------------------------------------------------------------------------------


def test_texts(spark):
    topics = {"spam": "money winner prize lottery claim transfer", "auto": "engine wheels gearbox brakes motor garage", "ham": "meeting dinner family weekend garden travel"}
    rng = np.random.default_rng(6)
    rows = [(i, t, " ".join(rng.choice(w.split(), 8)) + " the with engines") for i, (t, w) in enumerate(x for _ in range(6) for x in topics.items())]
    docs = spark.createDataFrame(rows, "id bigint, label string, text string")
    v = sparse.doc_vectors(docs, "id", "text")
    assert v.filter("word in ('the', 'with')").count() == 0 and v.filter("word = 'engin'").count() > 0
    voc = sparse.vocabulary(v)
    t = v.join(voc, "word").select(F.col("doc").alias("row"), "key", "value")
    assert voc.agg(F.max("key")).first()[0] + 1 == voc.count()
    lab = docs.select(F.col("id").alias("row"), "label")
    a, b = sparse.split_fold(t, 18, 1, 3)
    train = lab.filter("row < 6 or row >= 12")
    for got in (sparse.naive_bayes(a, train, b), sparse.nearest_label(a, train, b)):
        assert got.join(lab, "row").filter("prediction = label").count() >= 5
    x, y = sparse.shuffled(t, lab, 1)
    assert x.join(y, "row").groupBy("label").agg(F.sum("value")).count() == 3
    assert sparse.to_dense(t, [0, 1]).columns == ["row", "0", "1"]


# ---- graphs and sequences ---------------------------------------------------------------------------


def test_graphs(spark):
    e = spark.createDataFrame([(5, 4, 0.9), (5, 1, 1.5), (4, 1, 0.1), (1, 0, 0.3), (4, 0, 0.5), (2, 3, 1.0), (0, 5, 2.0)], "src bigint, dst bigint, cost double")
    got = {r["node"]: (round(r["cost"], 6), r["previous"]) for r in graph.shortest_paths(e, 5).collect()}
    assert got == {5: (0.0, None), 4: (0.9, 5), 1: (1.0, 4), 0: (1.3, 1)}
    d, nxt = graph.all_pairs(e, 6)
    assert d[5, 0] == pytest.approx(1.3) and nxt[5, 0] == 4 and np.isinf(d[5, 3])
    tri = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)]
    both = spark.createDataFrame(tri + [(b, a) for a, b in tri], "src bigint, dst bigint")
    nodes, edges = graph.betweenness(both, 6)
    eb = {(r["src"], r["dst"]): r["betweenness"] for r in edges.collect()}
    assert eb[(0, 1)] == 1 and eb[(0, 2)] == 4 and eb[(2, 3)] == 9
    assert {r["node"]: r["betweenness"] for r in nodes.collect()}[2] == 12
    c = graph.connected(spark.createDataFrame([(1, 2), (3, 2), (7, 8)], "src bigint, dst bigint"), spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 9)], "node bigint"))
    assert {r["node"]: r["component"] for r in c.collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9}
    flow, side = graph.min_cut(6, [(a, b, 1.0) for a, b in tri], [0], [5])
    assert flow == 1 and side == {0, 1, 2}
    assert sorted(graph.atomic_cycles([(0, 1), (1, 2), (2, 3), (3, 0), (1, 3)])) == [[0, 1, 3], [1, 2, 3]]


def test_hmm(spark):
    m = sequence.HMM([0.4, 0.6], [[0.7, 0.3], [0.2, 0.8]], [[0.9, 0.1], [0.3, 0.7]])
    from itertools import product

    seq = [1, 0, 1, 1]

    def joint(path):
        p = m.start[path[0]] * m.emit[path[0], seq[0]]
        for a, b, o in zip(path, path[1:], seq[1:]):
            p *= m.move[a, b] * m.emit[b, o]
        return p

    every = {p: joint(p) for p in product(range(2), repeat=4)}
    assert m.log_likelihood(seq) == pytest.approx(math.log(sum(every.values())))
    path, lp = m.viterbi(seq)
    best = max(every, key=every.get)
    assert tuple(path) == best and lp == pytest.approx(math.log(every[best]))
    df = spark.createDataFrame([([1, 0, 1],), ([0, 0, 1, 1],), ([],), (None,)], "seq array<int>")
    t = sequence.baum_welch(df, "seq", m, 3)
    assert sum(t.log_likelihood(s) for s in ([1, 0, 1], [0, 0, 1, 1])) > sum(m.log_likelihood(s) for s in ([1, 0, 1], [0, 0, 1, 1]))
    assert sequence.hmm_columns(df, "seq", m).count() == 4


def test_signals(spark):
    x = np.sin(np.arange(400) * 2 * np.pi * 10 / 400)
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    r = df.select(sequence.fft_magnitude(F.col("x")).alias("m"), sequence.fft_roundtrip(F.col("x")).alias("b"), sequence.amplify(F.col("x"), 2).alias("a"), sequence.quiet(F.col("x") * 0 if False else sequence.amplify(F.col("x"), 0.01), 100).alias("q"), sequence.mix(F.col("x"), F.col("x"), 1, -1).alias("z"), sequence.pitch_shift(F.col("x"), 12, 200).alias("p"), sequence.reduce_noise(F.col("x"), [0.001] * 300, 100).alias("n")).first()
    assert int(np.argmax(r["m"])) == 10 and np.allclose(r["b"], x) and np.allclose(r["a"], 2 * x) and not any(r["q"][50:-50]) and not any(abs(v) > 1e-12 for v in r["z"]) and len(r["p"]) == len(r["n"]) == 400
    k = sequence.Kalman([0.0, 1.0], np.eye(2), lambda s, u: np.array([s[0] + s[1], s[1]]), lambda s: s[:1], np.eye(2) * 1e-4, np.eye(1) * 0.1)
    for t in range(1, 40):
        k.advance()
        k.correct([2.0 * t])
    assert k.x[1] == pytest.approx(2, abs=0.1)
    lf = sequence.level_filter(spark.createDataFrame([("a", i, 5.0 if i != 3 else None) for i in range(6)], "g string, i int, v double"), ["g"], "i", "v", 0.1, 1.0)
    assert all(r["level"] == pytest.approx(5) for r in lf.collect())


# ---- the rest ---------------------------------------------------------------------------------------


def test_optimisers():
    loss = lambda x: float(((np.asarray(x) - [1.0, -2.0]) ** 2).sum())
    for f in (distributions.hill_climb, distributions.momentum_search, distributions.random_direction, distributions.empirical_gradient, distributions.anneal, distributions.sample_climb):
        assert f(loss, [0.0, 0.0])[1] < 0.05, f
    assert distributions.evolve(loss, 2)[1] < 0.1 and distributions.particle_swarm(loss, 2)[1] < 0.01
    assert distributions.grid_search(loss, [[0, 1, 2], [-2, 0]])[0] == (1, -2)
    for kind in ("sgd", "adam", "rmsprop"):
        x, g = np.zeros(2), distributions.Gradient(kind, 0.05)
        for _ in range(400):
            x = g.step(x, 2 * (x - [1.0, -2.0]))
        assert loss(x) < 0.05


def test_densities(spark):
    df = spark.createDataFrame([(0.3,), (2.0,)], "x double")
    d = distributions
    r = df.select(d.normal_log(F.col("x"), 0, 1).alias("n"), d.poisson_log(F.lit(3), 2.0).alias("p"), d.beta_log(F.col("x"), 2, 3).alias("b"), d.inverse_gamma_log(F.col("x"), 2, 1).alias("i"), d.soft_impulse(F.col("x"), 2).alias("s"), d.uniform_log(F.col("x"), 0, 1).alias("u"), d.multivariate_normal_log([F.col("x"), F.col("x")], [0, 0], np.eye(2)).alias("m"), d.categorical_log(F.lit("a"), {"a": 0.5}).alias("c")).collect()
    assert r[0]["n"] == pytest.approx(-0.045 - 0.5 * math.log(2 * math.pi)) and r[0]["p"] == pytest.approx(math.log(math.exp(-2) * 8 / 6)) and r[0]["b"] == pytest.approx(math.log(12 * 0.3 * 0.49)) and r[1]["b"] is None and r[1]["s"] == 1 and r[1]["u"] is None and r[0]["m"] == pytest.approx(2 * r[0]["n"]) and r[0]["c"] == pytest.approx(math.log(0.5))
    for kind, p in {"beta": {"a": 1, "b": 2}, "binomial": {"n": 5, "p": 0.5}, "categorical": {"shares": [0.5, 0.5]}, "cauchy": {}, "chisquare": {"df": 3}, "exponential": {}, "f": {"df1": 3, "df2": 8}, "gamma": {"shape": 2}, "gaussian": {}, "geometric": {"p": 0.3}, "logistic": {}, "lognormal": {}, "normal": {}, "poisson": {"rate": 3}, "softimpulse": {"steepness": 2}, "spherical": {}, "student": {"df": 3}, "uniform": {}, "weibull": {"shape": 2}}.items():
        assert d.noise(spark, 50, kind, 1, **p).filter("value is not null").count() == 50
    w = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 3.0)], "k bigint, w double")
    n = {r["k"]: r["count"] for r in d.sample_categorical(w, "k", "w", 2000, 1).groupBy("k").count().collect()}
    assert n.get(1) is None and sum(n.values()) == 2000 and n[2] / 2000 == pytest.approx(0.75, abs=0.05)
    s = spark.createDataFrame([(1.0, 2.0)], "a double, b double").select(*[c.alias(f"s{i}") for i, c in enumerate(d.softmax([F.col("a"), F.col("b")]))], *[f(F.col("a")).alias(n) for n, f in d.ACTIVATIONS.items()]).first()
    assert s["s0"] + s["s1"] == pytest.approx(1) and s["softplus"] == pytest.approx(math.log1p(math.e))


def test_generators_and_manifolds(spark):
    assert generate.cube(spark, 3).count() == 27 and generate.s_curve(spark, 20).count() == 20 and generate.entwined_spirals(spark, 20).count() == 20 and generate.ribbon(spark, 5).count() == 5
    f = generate.fish_bowl(spark, 30).select((F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("r"))
    assert all(r["r"] == pytest.approx(1) for r in f.collect())
    w = generate.random_walk(spark, 50).orderBy("id").collect()
    assert w[0]["position"] == pytest.approx(0.5 + 0.05 * w[0]["action"]) and all(abs(b["position"] - a["position"]) == pytest.approx(0.05) for a, b in zip(w, w[1:]))
    assert sorted(r["value"] for r in generate.random_sequence(spark, 9).collect()) == list(range(9))
    m = generate.manifold(spark, 20, "y1(a,b)=a+b; y2(a)=a*a", 2).orderBy("row_id").collect()
    assert [r["y2"] for r in m] == sorted(r["y2"] for r in m)
    assert generate.lorenz_table(spark, 5).count() == generate.mackey_glass_table(spark, 5).count() == 5
    roll = generate.swiss_roll(spark, 120, 1)
    for f in (manifold.isomap, manifold.locally_linear, manifold.breadth_first_unfolding):
        y = f(roll, "id", ["x", "y", "z"], 10, 2, **({"tolerant": True} if f is manifold.isomap else {}))
        assert y.count() == 120 and y.columns == ["id", "y0", "y1"]
    y = manifold.manifold_sculpting(roll, "id", ["x", "y", "z"], 8, 2, rounds=20)
    z = manifold.scaling_unfolder(roll, "id", ["x", "y", "z"], 8, 2, rounds=10)
    assert manifold.blend(roll, y, z, "id", 2).count() == 120
    assert manifold.landmarks(roll, y.filter("id < 60"), "id", ["x", "y", "z"], 2).count() == 120
    p = np.random.default_rng(0).normal(size=(20, 2))
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    q = manifold.multidimensional_scaling(d, 2)
    assert np.allclose(np.linalg.norm(q[:, None] - q[None], axis=2), d)
