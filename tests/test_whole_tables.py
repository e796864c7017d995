"""Queries against their SQL without its id filters: every row of the tables counts."""

import os

import numpy as np
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return lambda q: c.execute(q).fetchall()


def rows(spark, name):
    return sorted(tuple(r) for r in entry.queries()[name](spark, SF).collect())


def same(got, want):
    want = sorted(want)
    assert len(got) == len(want) and all(g == pytest.approx(w, rel=1e-6, abs=2e-6) for g, w in zip(got, want))


# ---- trade ------------------------------------------------------------------------------------------

TRADE = "SELECT c_nationkey, s_nationkey, 1000.0 / count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2"


def test_trade_counts_all_orders(spark, sql):
    edges = sql(TRADE)
    same(rows(spark, "incident_trade"), [e for e in edges if 3 in e[:2]])
    d = np.full((25, 25), np.inf)
    np.fill_diagonal(d, 0)
    for i, j, c in edges:
        d[i, j] = min(d[i, j], c)
    for k in range(25):
        d = np.minimum(d, d[:, k, None] + d[k])
    same(rows(spark, "all_pairs_trade"), [(i, j, d[i, j]) for i in range(25) for j in range(25) if np.isfinite(d[i, j])])
    same(rows(spark, "shortest_paths_trade"), [(j, d[0, j]) for j in range(25) if np.isfinite(d[0, j])])


# ---- ratings ----------------------------------------------------------------------------------------

RATINGS = "(SELECT o_custkey AS u, l_partkey AS i, avg(l_quantity) AS r FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"


def whole(name):
    """The query's SQL with ratings of all customers and real parts."""
    from millrace.plans import queries

    text = queries.ORACLES[name]
    assert queries._RATE in text or RATINGS in text
    return text.replace(queries._RATE, RATINGS)


@pytest.mark.parametrize("name", ["sparse_cosine_ratings", "sparse_euclid_ratings", "recommend_baseline", "recommend_users", "sparse_transpose_ratings", "sub_matrix_ratings"])
def test_ratings_of_all_orders(spark, sql, name):
    same(rows(spark, name), sql(whole(name)))


def test_recommenders_see_all_ratings(spark, sql):
    want = sorted(r[:2] for r in sql("SELECT u, i FROM " + RATINGS))
    for name in ("recommend_users", "recommend_factorization", "recommend_clusters"):
        assert [r[:2] for r in rows(spark, name)] == want


# ---- matching and functions -------------------------------------------------------------------------


def test_matching_takes_all_rows(spark, sql):
    mean = lambda t, c: sql(f"SELECT {c}_nationkey, avg({c}_acctbal) FROM {t} GROUP BY 1 ORDER BY 1")
    a, b = mean("supplier", "s"), mean("customer", "c")
    cost = (np.array([x for _, x in a])[:, None] - np.array([x for _, x in b])) ** 2
    got = rows(spark, "bipartite_matching_suppliers")
    few, many = sorted((sorted(x for _, x in a), sorted(x for _, x in b)), key=len)
    best = np.zeros(len(many) + 1)  # one number a row: some best matching keeps the order
    for x in few:
        new = np.full(len(many) + 1, np.inf)
        for j, y in enumerate(many):
            new[j + 1] = min(new[j], best[j] + (x - y) ** 2)
        best = new
    assert len(got) == len(few) and sum(r[2] for r in got) == pytest.approx(best[-1])
    at, to = {k: i for i, (k, _) in enumerate(a)}, {k: i for i, (k, _) in enumerate(b)}
    assert all(c == pytest.approx(cost[at[i], to[j]]) for i, j, c in got)


def test_gamma_of_all_nations(spark):
    import math

    same(rows(spark, "gamma_nation"), [(i, math.gamma(i + 1.5) / 10.0**i, math.lgamma(i + 1.5)) for i in range(25)])
