"""Matrices as triples (i, j, value) where they are large, as arrays on the driver where they are small."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import with_row_id

#: The largest side of a matrix that is gathered on the driver.
SMALL = 4000


def to_triples(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(i, j, value) of a table: i in the order of the keys, j the column's place. Nulls are left out."""
    x = with_row_id(df, keys, "i")
    return x.select("i", F.posexplode(F.array(*[F.col(c).cast("double") for c in cols])).alias("j", "value")).filter("value is not null").select("i", F.col("j").cast("bigint").alias("j"), "value")


def transpose(t: DataFrame) -> DataFrame:
    return t.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")


def multiply(a: DataFrame, b: DataFrame, transpose_a: bool = False, transpose_b: bool = False) -> DataFrame:
    """The product of two triple tables: one join on the inner index, one aggregation."""
    a = transpose(a) if transpose_a else a
    b = transpose(b) if transpose_b else b
    x = a.select(F.col("i"), F.col("j").alias("k"), F.col("value").alias("x")).join(b.select(F.col("i").alias("k"), F.col("j"), F.col("value").alias("y")), "k")
    return x.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b.select("i", "j", -F.col("value"))).groupBy("i", "j").agg(F.sum("value").alias("value"))


def trace(t: DataFrame) -> DataFrame:
    return t.filter("i = j").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("trace"))


def identity(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("value"))


def scale_rows(t: DataFrame, factors: DataFrame) -> DataFrame:
    """factors: (i, factor)."""
    return t.join(factors, "i").select("i", "j", (F.col("value") * F.col("factor")).alias("value"))


def to_array(t: DataFrame, rows: int | None = None, cols: int | None = None) -> np.ndarray:
    """A small matrix on the driver; refuses sides above ``SMALL``."""
    if rows is None or cols is None:
        r = t.agg(F.max("i").alias("i"), F.max("j").alias("j")).first()
        rows, cols = rows or (r["i"] or 0) + 1, cols or (r["j"] or 0) + 1
    if max(rows, cols) > SMALL:
        raise ValueError(f"{rows} x {cols} is too large for the driver")
    x = t.toArrow()
    out = np.zeros((rows, cols))
    out[x["i"].to_numpy(), x["j"].to_numpy()] = x["value"].to_numpy()
    return out


def from_array(spark, m: np.ndarray) -> DataFrame:
    i, j = np.indices(m.shape)
    return spark.createDataFrame(pa.table({"i": i.ravel().astype(np.int64), "j": j.ravel().astype(np.int64), "value": m.ravel().astype(float)}))


def gram(df: DataFrame, cols: list[str], center: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """(X'X or covariance sum, means, rows) by one aggregation of d (d + 1) / 2 sums; rows with a null are skipped."""
    d = len(cols)
    x = df.na.drop(subset=cols)
    pairs = [(a, b) for a in range(d) for b in range(a, d)]
    r = x.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[(F.covar_pop(cols[a], cols[b]) if center else F.avg(F.col(cols[a]).cast("double") * F.col(cols[b]))).alias(f"c{a}_{b}") for a, b in pairs]).first()
    out = np.zeros((d, d))
    for a, b in pairs:
        out[a, b] = out[b, a] = (r[f"c{a}_{b}"] or 0.0) * r["n"]
    return out, np.array([r[f"m{i}"] or 0.0 for i in range(d)]), r["n"]


def determinant(m: np.ndarray) -> float:
    return float(np.linalg.det(m))


def cholesky(m: np.ndarray, tolerant: bool = False) -> np.ndarray:
    """The lower factor; tolerant: negative eigenvalues count as 0."""
    if not tolerant:
        return np.linalg.cholesky(m)
    w, v = np.linalg.eigh(m)
    return np.linalg.qr((v * np.sqrt(np.maximum(w, 0))).T)[1].T


def pseudo_inverse(m: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(m)


def row_echelon(m: np.ndarray, eps: float = 1e-9) -> np.ndarray:
    """Reduced row echelon form."""
    m, r = np.array(m, float), 0
    for c in range(m.shape[1]):
        if r == len(m):
            break
        p = r + int(np.abs(m[r:, c]).argmax())
        if abs(m[p, c]) < eps:
            continue
        m[[r, p]] = m[[p, r]]
        m[r] /= m[r, c]
        others = np.arange(len(m)) != r
        m[others] -= np.outer(m[others, c], m[r])
        r += 1
    return m


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.solve(a, b)


def lu(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P, L, U) with P m = L U, by partial pivoting."""
    u, n = np.array(m, float), len(m)
    perm, low = np.eye(n), np.eye(n)
    for k in range(n):
        p = k + int(np.abs(u[k:, k]).argmax())
        u[[k, p]], perm[[k, p]] = u[[p, k]], perm[[p, k]]
        low[[k, p], :k] = low[[p, k], :k]
        if u[k, k]:
            low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    return perm, low, np.triu(u)


def eigenvectors(m: np.ndarray, n: int, largest: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """n (values, vectors as rows) of a symmetric matrix."""
    w, v = np.linalg.eigh(m)
    order = np.argsort(w)[:: -1 if largest else 1][:n]
    return w[order], v[:, order].T


def svd(df: DataFrame, cols: list[str], k: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(rows times the right vectors over the values: u0, u1, ..., values, right vectors as rows) of a tall table: one
    aggregation for X'X, a small decomposition on the driver, one projection."""
    g, _, _ = gram(df, cols)
    w, v = eigenvectors(g, k or len(cols))
    s = np.sqrt(np.maximum(w, 0))
    u = [(sum((F.col(c) * F.lit(float(v[r, i])) for i, c in enumerate(cols)), F.lit(0.0)) / F.lit(float(s[r] or 1.0))).alias(f"u{r}") for r in range(len(s))]
    return df.select("*", *u), s, v


def principal_component(df: DataFrame, cols: list[str], rounds: int = 50, seed: int = 0) -> np.ndarray:
    """The first principal direction about the mean by power iteration, leaving out missing cells. Each round
    is one aggregation of d sums."""
    m = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    x = [F.col(c) - F.lit(m[f"m{i}"]) for i, c in enumerate(cols)]
    v = np.random.default_rng(seed).normal(size=len(cols))
    v /= np.linalg.norm(v)
    for _ in range(rounds):
        dot = sum((F.coalesce(c, F.lit(0.0)) * F.lit(float(a)) for c, a in zip(x, v)), F.lit(0.0))
        r = df.agg(*[F.sum(dot * c).alias(f"s{i}") for i, c in enumerate(x)]).first()
        new = np.array([r[f"s{i}"] or 0.0 for i in range(len(cols))])
        size = np.linalg.norm(new)
        if not size:
            return v
        new /= size
        if np.linalg.norm(new - v) < 1e-12:
            return new
        v = new
    return v


def remove_component(df: DataFrame, cols: list[str], direction: np.ndarray, mean: np.ndarray | None = None) -> DataFrame:
    """Subtract from each row its part along a unit direction about the mean."""
    mean = np.zeros(len(cols)) if mean is None else mean
    d = sum(((F.col(c) - F.lit(float(a))) * F.lit(float(v)) for c, a, v in zip(cols, mean, direction)), F.lit(0.0))
    return df.withColumn("__d", d).withColumns({c: F.col(c) - F.col("__d") * F.lit(float(v)) for c, v in zip(cols, direction)}).drop("__d")


def dihedral_correlation(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine of the largest angle between the spans of the rows of two matrices."""
    q, r = np.linalg.qr(a.T)[0], np.linalg.qr(b.T)[0]
    return float(np.clip(np.linalg.svd(q.T @ r, compute_uv=False).min(), 0, 1))


def linear_program(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """x >= 0 that maximises c x under a x <= b (b >= 0), by the simplex method with Bland's rule; None if unbounded."""
    m, n = a.shape
    t = np.zeros((m + 1, n + m + 1))
    t[:m, :n], t[:m, n : n + m], t[:m, -1], t[m, :n] = a, np.eye(m), b, -np.asarray(c, float)
    basis = list(range(n, n + m))
    while (t[m, :-1] < -1e-12).any():
        col = int(np.flatnonzero(t[m, :-1] < -1e-12)[0])
        up = np.flatnonzero(t[:m, col] > 1e-12)
        if not len(up):
            return None
        ratio = t[up, -1] / t[up, col]
        row = int(min(up[ratio <= ratio.min() + 1e-12], key=lambda r: basis[r]))
        t[row] /= t[row, col]
        for r in range(m + 1):
            if r != row:
                t[r] -= t[r, col] * t[row]
        basis[row] = col
    x = np.zeros(n + m)
    x[basis] = t[:m, -1]
    return x[:n]


# ---- vectors in array columns -----------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_known(a: Column, b: Column) -> Column:
    """Null elements add nothing."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def squared_magnitude(a: Column) -> Column:
    return dot(a, a)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def normalized(a: Column) -> Column:
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), F.sqrt(squared_magnitude(a))))


def index_of_max(a: Column) -> Column:
    """From 0; the first of equal elements."""
    return F.array_position(a, F.array_max(a)) - 1


def index_of_min(a: Column) -> Column:
    return F.array_position(a, F.array_min(a)) - 1
