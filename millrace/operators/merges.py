"""Positional joins and merges: row i of one table meets row i of the other."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import nominal, numeric
from .ordering import with_neighbour, with_row_id


def zipped(a: DataFrame, a_keys: list[str], b: DataFrame, b_keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with their position in ``__i``; their sizes must agree."""
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} and {m} rows")
    return with_row_id(a, a_keys, "__i"), with_row_id(b, b_keys, "__i")


def merge_horizontal(a: DataFrame, a_keys: list[str], b: DataFrame, b_keys: list[str]) -> DataFrame:
    """The columns of a and then those of b, row by row; a name both have gets ``_2`` in b."""
    x, y = zipped(a, a_keys, b, b_keys)
    y = y.toDF(*[c if c == "__i" or c not in a.columns else f"{c}_2" for c in y.columns])
    return x.join(y, "__i").drop("__i")


def overlay(base: DataFrame, base_keys: list[str], over: DataFrame, over_keys: list[str], cols: list[str]) -> DataFrame:
    """Each cell from ``over`` where that is not null, else from ``base``."""
    x, y = zipped(base, base_keys, over, over_keys)
    y = y.select("__i", *[F.col(c).alias(f"__{c}") for c in cols])
    return x.join(y, "__i").select([F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in base.columns])


def add(a: DataFrame, a_keys: list[str], b: DataFrame, b_keys: list[str], cols: list[str]) -> DataFrame:
    x, y = zipped(a, a_keys, b, b_keys)
    y = y.select("__i", *[F.col(c).alias(f"__{c}") for c in cols])
    return x.join(y, "__i").select([(F.col(c) + F.col(f"__{c}")).alias(c) if c in cols else F.col(c) for c in a.columns])


def _pairs(a, a_keys, b, b_keys, cols):
    x, y = zipped(a, a_keys, b, b_keys)
    return x.select("__i", *[F.col(c).alias(f"a_{c}") for c in cols]).join(y.select("__i", *[F.col(c).alias(f"b_{c}") for c in cols]), "__i")


def mean_squared_error(a: DataFrame, a_keys: list[str], b: DataFrame, b_keys: list[str], cols: list[str], fit: bool = False) -> DataFrame:
    """Per column the sum of squared differences over all rows; pairs with a null add nothing but count.
    ``fit`` first maps b onto a by least squares."""
    p = _pairs(a, a_keys, b, b_keys, cols)
    if fit:
        r = p.agg(*[f(f"a_{c}", f"b_{c}").alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("s", F.regr_slope), ("o", F.regr_intercept))]).first()
        p = p.withColumns({f"b_{c}": F.col(f"b_{c}") * F.lit(r[f"s{i}"] or 0.0) + F.lit(r[f"o{i}"] or 0.0) for i, c in enumerate(cols)})
    got = p.agg(*[(F.coalesce(F.sum(F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), 2)), F.lit(0.0)) / F.count(F.lit(1))).alias(c) for c in cols])
    return got.unpivot([], cols, "column", "mse")


def squared_distance(a: DataFrame, a_keys: list[str], b: DataFrame, b_keys: list[str], cols: list[str]) -> DataFrame:
    """The sum over all cells; mean and root mean square divide by rows, not cells."""
    d = sum((F.pow(F.coalesce(F.col(f"a_{c}") - F.col(f"b_{c}"), F.lit(0)), 2) for c in cols), F.lit(0.0))
    got = _pairs(a, a_keys, b, b_keys, cols).agg(F.sum(d).alias("sum"), F.count(F.lit(1)).alias("n"))
    return got.select("sum", (F.col("sum") / F.col("n")).alias("mean"), F.sqrt(F.col("sum") / F.col("n")).alias("rms"))


def percent_same(a: DataFrame, a_keys: list[str], b: DataFrame, b_keys: list[str], cols: list[str]) -> DataFrame:
    """Per column the percentage of equal cells; null equals null."""
    got = _pairs(a, a_keys, b, b_keys, cols).agg(*[(F.avg(F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")).cast("double")) * 100).alias(c) for c in cols])
    return got.unpivot([], cols, "column", "percent")


def column_differences(a: DataFrame, a_keys: list[str], b: DataFrame, b_keys: list[str], cols: list[str]) -> DataFrame:
    """Per column sums of squared and absolute differences; for nominal ones both count mismatches."""
    text = set(nominal(a))
    p, out = _pairs(a, a_keys, b, b_keys, cols), []
    for c in cols:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        d2, d1 = (F.when(x != y, 1.0).otherwise(0.0),) * 2 if c in text else (F.pow(x - y, 2), F.abs(x - y).cast("double"))
        out += [F.sum(d2).alias(f"{c}__sq"), F.sum(d1).alias(f"{c}__abs")]
    r = p.agg(*out)
    return r.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__sq").alias("squared"), F.col(f"{c}__abs").alias("absolute")) for c in cols])).alias("r")).select("r.*")


def align(a: DataFrame, a_keys: list[str], b: DataFrame, b_keys: list[str], cols: list[str]) -> DataFrame:
    """Rotate b onto a about their means (least squares, no reflection). One aggregation gives the d x d
    cross-covariance; only that reaches the driver."""
    p = _pairs(a, a_keys, b, b_keys, cols)
    n = len(cols)
    r = p.agg(*[F.avg(f"{s}_{c}").alias(f"{s}{i}") for i, c in enumerate(cols) for s in "ab"], *[F.covar_pop(f"b_{x}", f"a_{y}").alias(f"c{i}_{j}") for i, x in enumerate(cols) for j, y in enumerate(cols)]).first()
    h = np.array([[r[f"c{i}_{j}"] for j in range(n)] for i in range(n)])
    u, _, vt = np.linalg.svd(h)
    d = np.diag([1.0] * (n - 1) + [np.sign(np.linalg.det(u @ vt)) or 1.0])
    rot = u @ d @ vt  # row vectors: (b - mean b) rot + mean a
    out = [sum(((F.col(c) - F.lit(r[f"b{i}"])) * F.lit(float(rot[i, j])) for i, c in enumerate(cols)), F.lit(r[f"a{j}"])).alias(cols[j]) for j in range(n)]
    return b.select(*[c for c in b.columns if c not in cols], *out)


def transition(df: DataFrame, keys: list[str], actions: list[str], state: list[str], delta: bool = False) -> DataFrame:
    """Row i: actions, state, and the state of row i + 1 (or the change to it). One row fewer."""
    nxt = with_neighbour(df.withColumn("__here", F.lit(1)), keys, {**{f"next_{c}": c for c in state}, "__there": "__here"})
    nxt = nxt.filter("__there = 1")
    return nxt.select(*actions, *state, *[(F.col(f"next_{c}") - F.col(c) if delta else F.col(f"next_{c}")).alias(f"{'delta' if delta else 'next'}_{c}") for c in state])


def aggregate_columns(tables: dict[str, tuple[DataFrame, list[str]]], col: str) -> DataFrame:
    """One column of several tables side by side, by position, under the tables' names."""
    out = None
    for name, (df, keys) in tables.items():
        x = with_row_id(df, keys, "row_id").select("row_id", F.col(col).alias(name))
        out = x if out is None else out.join(x, "row_id", "full")
    return out


def aggregate_rows(tables: dict[str, tuple[DataFrame, list[str]]], row: int) -> DataFrame:
    """The row at one position of each table, stacked."""
    out = None
    for name, (df, keys) in tables.items():
        x = with_row_id(df, keys, "__i").filter(F.col("__i") == row).drop("__i").select(F.lit(name).alias("table"), "*")
        out = x if out is None else out.unionByName(x)
    return out


def merge_vertical(a: DataFrame, b: DataFrame, force: bool = False) -> DataFrame:
    """All rows of both, by position of the columns; names must match unless forced, kinds always."""
    if len(a.columns) != len(b.columns):
        raise ValueError("different numbers of columns")
    if not force and a.columns != b.columns:
        raise ValueError("different column names")
    num = set(numeric(a)), set(numeric(b))
    for x, y in zip(a.columns, b.columns):
        if (x in num[0]) != (y in num[1]):
            raise ValueError(f"{x} and {y} are of different kinds")
    return a.union(b.toDF(*a.columns))


def assignment(cost: np.ndarray) -> np.ndarray:
    """For each row its column in the one-to-one matching of least total cost (rows <= columns): shortest
    augmenting paths with potentials."""
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    u, v, match = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        match[m], j0 = i, m
        low, via, seen = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while match[j0] >= 0:
            seen[j0] = True
            row = match[j0]
            red = cost[row] - u[row] - v[:m]
            better = ~seen[:m] & (red < low)
            low[better], via[better] = red[better], j0
            free = np.where(seen[:m], np.inf, low)
            j1 = int(free.argmin())
            d = free[j1]
            u[match[seen]] += d
            v[seen] -= d
            low[~seen[:m]] -= d
            j0 = j1
        while j0 != m:
            match[j0], j0 = match[via[j0]], via[j0]
        match[m] = -1
    out = np.full(n, -1)
    for j in range(m):
        if match[j] >= 0:
            out[match[j]] = j
    return out


def bipartite_matching(a: DataFrame, a_key: str, b: DataFrame, b_key: str, cols: list[str], limit: int = 5000) -> DataFrame:
    """One-to-one matching of the rows of a and b with the least total squared distance; both sides have to
    fit on the driver, and more than ``limit`` rows are refused."""
    pa_, pb = a.select(a_key, *cols).limit(limit + 1).toPandas(), b.select(b_key, *cols).limit(limit + 1).toPandas()
    if max(len(pa_), len(pb)) > limit:
        raise ValueError(f"more than {limit} rows")
    pa_, pb = pa_.sort_values(a_key), pb.sort_values(b_key)
    x, y = pa_[cols].to_numpy(float), pb[cols].to_numpy(float)
    c = ((x[:, None, :] - y[None, :, :]) ** 2).sum(2)
    flip = len(x) > len(y)
    m = assignment(c.T if flip else c)
    rows = [(pa_[a_key].iloc[j if flip else i].item(), pb[b_key].iloc[i if flip else j].item(), float(c[(j, i) if flip else (i, j)])) for i, j in enumerate(m.tolist())]
    return a.sparkSession.createDataFrame(rows, f"{a_key}_1 bigint, {b_key}_2 bigint, cost double")
