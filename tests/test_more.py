import numpy as np
import pytest

from millrace.operators import bayes, graph, learners, linalg, sparse


def test_cycles():
    ring = [(i, (i + 1) % 12) for i in range(12)]
    assert set(graph.shortcut_edges(ring, 8)) == set(ring) and graph.shortcut_edges([(0, 1), (1, 2), (2, 0), (2, 3)], 8) == []
    left = graph.cycle_cut([(a, b, float(a)) for a, b in ring], 8)
    assert len(left) == 11 and (11, 0, 11.0) not in left


def test_bayes_net():
    n = bayes.BayesNet(1)
    n.constant("v", 1.0)
    n.density("m", "normal", 0.0, 100.0, start=0.0)
    for i, x in enumerate((4.0, 5.0, 6.0)):
        n.density(f"x{i}", "normal", "m", "v")
        n.observe(f"x{i}", x)
    n.function("twice", lambda m: 2 * m, "m")
    s = n.sample(["m", "twice"], 3000)
    assert s[:, 0].mean() == pytest.approx(5, abs=0.15) and s[:, 0].var() == pytest.approx(1 / 3, abs=0.1) and np.allclose(s[:, 1], 2 * s[:, 0])
    c = bayes.BayesNet(2)
    c.categorical("rain", lambda: [0.8, 0.2])
    c.categorical("wet", lambda r: [0.9, 0.1] if r == 0 else [0.2, 0.8], "rain")
    c.observe("wet", 1)
    assert c.sample(["rain"], 3000)[:, 0].mean() == pytest.approx(0.16 / 0.24, abs=0.05)


def test_sparse_svd(spark):
    rng = np.random.default_rng(3)
    m = np.where(rng.random((30, 12)) < 0.4, rng.normal(size=(30, 12)), 0)
    m[:, 3] *= 4
    m[:, 7] *= 2.5
    i, j = np.nonzero(m)
    t = spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(i, j)], "row bigint, key bigint, value double")
    s, v = sparse.svd(t, k=2, rounds=12)
    want = np.linalg.svd(m)
    assert s == pytest.approx(want[1][:2], rel=0.03) and abs(v[0] @ want[2][0]) > 0.97
    assert linalg.trace(linalg.identity(spark, 4)).first()["trace"] == 4


def test_landmarks(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(rng.normal() + 3 * (i % 2)), f"k{i % 2}") for i in range(80)], "id bigint, x double, label string")
    got = learners.landmarks(df, ["x"], "label", "id")
    assert got["tree"] > 0.8 and got["neighbours"] > 0.8 and set(got) == {"baseline", "naive_bayes", "stump", "tree", "margins", "neighbours"}
