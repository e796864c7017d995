"""Trainable transforms: ``fit`` learns from a table, ``transform`` applies, ``untransform`` goes back."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import assign, centroid_step
from .columns import numeric, used_values
from .linalg import eigenvectors, gram
from .ordering import with_row_id


class Transform:
    """State is plain data in ``self.state``, so models save as JSON."""

    state: dict

    def __init__(self, **state):
        self.state = state

    def fit(self, df: DataFrame) -> Transform:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def untransform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def to_json(self) -> str:
        return json.dumps({"class": type(self).__name__, "state": self.state})


def load_transform(text: str) -> Transform:
    x = json.loads(text)
    known = {c.__name__: c for c in _all(Transform)}
    if x["class"] == "Chain":
        return Chain([load_transform(t) for t in x["state"]["parts"]])
    return known[x["class"]](**x["state"])


def _all(c):
    return [c, *(y for x in c.__subclasses__() for y in _all(x))]


class Normalize(Transform):
    def fit(self, df):
        cols = self.state.get("cols") or numeric(df)
        r = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("a", F.min), ("z", F.max))]).first()
        self.state |= {"cols": cols, "lo": [float(r[f"a{i}"]) if r[f"a{i}"] is not None else 0.0 for i in range(len(cols))], "hi": [float(r[f"z{i}"]) if r[f"z{i}"] is not None else 1.0 for i in range(len(cols))]}
        return self

    def _each(self, f):
        s = self.state
        a, z = s.get("out", (0.0, 1.0))
        return {c: f(F.col(c), lo, (z - a) / (hi - lo if hi - lo >= 1e-12 else 1.0), a) for c, lo, hi in zip(s["cols"], s["lo"], s["hi"])}

    def transform(self, df):
        return df.withColumns(self._each(lambda x, lo, k, a: (x - F.lit(lo)) * F.lit(k) + F.lit(a)))

    def untransform(self, df):
        return df.withColumns(self._each(lambda x, lo, k, a: (x - F.lit(a)) / F.lit(k) + F.lit(lo)))


class Discretize(Transform):
    """Equal-width buckets; the range is at least 1e-9 and the number of buckets at most max(2, sqrt n) if it
    exceeds n. Back: the middle of the bucket."""

    def fit(self, df):
        cols = self.state.get("cols") or numeric(df)
        r = df.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("a", F.min), ("z", F.max))]).first()
        n = self.state.get("buckets") or max(2, int(math.sqrt(r["n"])))
        n = n if n <= r["n"] else max(2, int(math.sqrt(r["n"])))
        lo = [float(r[f"a{i}"] or 0.0) for i in range(len(cols))]
        self.state |= {"cols": cols, "buckets": n, "lo": lo, "width": [max(1e-9, float(r[f"z{i}"] or 0.0) - lo[i]) for i in range(len(cols))]}
        return self

    def transform(self, df):
        n = self.state["buckets"]
        return df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.floor((F.col(c) - F.lit(lo)) * F.lit(n / w)), F.lit(0)), F.lit(n - 1)).cast("double")) for c, lo, w in zip(self.state["cols"], self.state["lo"], self.state["width"])})

    def untransform(self, df):
        n = self.state["buckets"]
        return df.withColumns({c: (F.col(c) + 0.5) * F.lit(w / n) + F.lit(lo) for c, lo, w in zip(self.state["cols"], self.state["lo"], self.state["width"])})


class Log(Transform):
    def fit(self, df):
        self.state |= {"cols": self.state.get("cols") or numeric(df)}
        return self

    def transform(self, df):
        return df.withColumns({c: F.ln(c) for c in self.state["cols"]})

    def untransform(self, df):
        return df.withColumns({c: F.exp(c) for c in self.state["cols"]})


class PairProducts(Transform):
    """Products x_i x_j for i >= j, at most max_dims of them."""

    def fit(self, df):
        self.state |= {"cols": self.state.get("cols") or numeric(df)}
        return self

    def transform(self, df):
        c = self.state["cols"]
        made = [(F.col(c[i]) * F.col(c[j])).alias(f"{c[i]}*{c[j]}") for i in range(len(c)) for j in range(i + 1)]
        return df.select("*", *made[: self.state.get("max_dims", 10_000)])


class OneHot(Transform):
    """The columns of ``one_hot`` for the values seen in training."""

    def fit(self, df):
        cols = self.state["cols"]
        self.state["values"] = {c: used_values(df, c, self.state.get("limit", 100_000)) for c in cols}
        return self

    def transform(self, df):
        out = []
        for c in df.columns:
            v = self.state["values"].get(c)
            out += [F.col(c)] if v is None else [F.when(F.col(c).isNull(), F.lit(1.0 / max(1, len(v)))).when(F.col(c) == k, F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{c}_{k}") for k in v]
        return df.select(out)

    def untransform(self, df):
        out = df
        for c, v in self.state["values"].items():
            top = F.greatest(*[F.col(f"{c}_{k}") for k in v]) if len(v) > 1 else F.col(f"{c}_{v[0]}")
            back = F.lit(None).cast("string")
            for k in reversed(v):
                back = F.when(F.col(f"{c}_{k}") == top, F.lit(k)).otherwise(back)
            out = out.withColumn(c, back).drop(*[f"{c}_{k}" for k in v])
        return out


class PCA(Transform):
    """Mean and the k directions of largest variance; values are the variances. Training is one aggregation."""

    def fit(self, df):
        cols = self.state.get("cols") or numeric(df)
        about = self.state.get("about_origin", False)
        g, mean, n = gram(df, cols, center=not about)
        w, v = eigenvectors(g / max(1, n - 1), self.state["k"])
        v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]  # the largest part of each is positive
        self.state |= {"cols": cols, "mean": [0.0] * len(cols) if about else mean.tolist(), "values": w.tolist(), "basis": v.tolist()}
        return self

    def transform(self, df):
        s = self.state
        made = [sum(((F.col(c) - F.lit(m)) * F.lit(b) for c, m, b in zip(s["cols"], s["mean"], row)), F.lit(0.0)).alias(f"pc{i}") for i, row in enumerate(s["basis"])]
        return df.select(*[c for c in df.columns if c not in s["cols"]], *made)

    def untransform(self, df):
        s = self.state
        made = [sum((F.col(f"pc{i}") * F.lit(row[j]) for i, row in enumerate(s["basis"])), F.lit(s["mean"][j])).alias(c) for j, c in enumerate(s["cols"])]
        parts = {f"pc{i}" for i in range(len(s["basis"]))}
        return df.select(*[c for c in df.columns if c not in parts], *made)


class ReplaceWithNoise(Transform):
    """Every number becomes normal noise of the column's mean and deviation, every nominal value a random one."""

    def fit(self, df):
        num = numeric(df)
        r = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(num) for k, f in (("m", F.avg), ("d", F.stddev_samp))]).first()
        self.state |= {"num": {c: [r[f"m{i}"] or 0.0, r[f"d{i}"] or 0.0] for i, c in enumerate(num)}, "text": {c: used_values(df, c, self.state.get("limit", 100_000)) for c in df.columns if c not in num}}
        return self

    def transform(self, df):
        seed = self.state.get("seed", 0)
        out = {c: F.lit(m) + F.lit(d) * F.randn(seed + i) for i, (c, (m, d)) in enumerate(self.state["num"].items())}
        out |= {c: F.element_at(F.array(*map(F.lit, v)), (F.floor(F.rand(seed + 1000 + i) * len(v)) + 1).cast("int")) for i, (c, v) in enumerate(self.state["text"].items()) if v}
        return df.withColumns(out)


class Augment(Transform):
    """The input columns and those of another transform."""

    def __init__(self, inner: Transform | None = None, prefix: str = "x_", **state):
        super().__init__(prefix=prefix, inner=inner.to_json() if inner else state.get("inner"))

    def fit(self, df):
        self.state["inner"] = load_transform(self.state["inner"]).fit(df).to_json()
        return self

    def transform(self, df):
        inner, p = load_transform(self.state["inner"]), self.state["prefix"]
        made = df.withColumn("__row", F.struct(*df.columns)).select(F.col("__row").alias("__row"), *df.columns)
        out = inner.transform(made)
        new = [c for c in out.columns if c != "__row"]
        return out.select("__row.*", *[F.col(c).alias(f"{p}{c}") for c in new])


class Chain(Transform):
    def __init__(self, parts: list[Transform] | None = None, **_):
        self.parts = parts or []
        super().__init__()

    def fit(self, df):
        for t in self.parts:
            df = t.fit(df).transform(df)
        return self

    def transform(self, df):
        for t in self.parts:
            df = t.transform(df)
        return df

    def untransform(self, df):
        for t in reversed(self.parts):
            df = t.untransform(df)
        return df

    def to_json(self):
        return json.dumps({"class": "Chain", "state": {"parts": [t.to_json() for t in self.parts]}})


def impute(df: DataFrame, key: str, cols: list[str], rank: int | None = None, seed: int = 0) -> DataFrame:
    """Fill nulls of numeric columns by matrix factorisation over (row, column, value); columns are scaled to
    [0, 1] first. Known cells stay as they are. Rows are numbered first, so keys may be of any type."""
    from pyspark.ml.recommendation import ALS

    norm = Normalize(cols=cols).fit(df)
    x = with_row_id(norm.transform(df), [key, *cols], "__row")
    long = x.select(F.col("__row").cast("int").alias("row"), F.posexplode(F.array(*[F.col(c).cast("double") for c in cols])).alias("col", "value"))
    m = ALS(userCol="row", itemCol="col", ratingCol="value", rank=rank or max(2, min(8, len(cols) // 3)), seed=seed, coldStartStrategy="drop").fit(long.filter("value is not null"))
    filled = m.transform(long.filter("value is null")).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.col("prediction").cast("double")))).alias("m"))
    out = x.join(filled, F.col("__row") == F.col("row"), "left")
    out = out.select([F.coalesce(F.col(c).cast("double"), F.col("m")[F.lit(i)], F.lit(0.5)).alias(c) if (i := cols.index(c) if c in cols else -1) >= 0 else F.col(c) for c in df.columns])
    return norm.untransform(out)


def rank_attributes(df: DataFrame, cols: list[str], label: str, seed: int = 0) -> list[str]:
    """Columns from most to least useful: train a linear classifier on scaled columns, drop the one whose
    largest weight is smallest, repeat."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    x = StringIndexer(inputCol=label, outputCol="__y").fit(df).transform(Normalize(cols=cols).fit(df).transform(df)).cache()
    left, out = list(cols), []
    while len(left) > 1:
        m = LogisticRegression(featuresCol="__f", labelCol="__y", regParam=1e-3, maxIter=30).fit(VectorAssembler(inputCols=left, outputCol="__f", handleInvalid="skip").transform(x))
        w = np.abs(m.coefficientMatrix.toArray()).max(0)
        out.append(left.pop(int(w.argmin())))
    x.unpersist()
    return [*left, *reversed(out)]


class SelfOrganizingMap(Transform):
    """A grid of nodes that learns by batches: each round assigns all rows to their nearest node and moves each
    node to the mean of all rows, weighted by a Gaussian over the grid that shrinks. A round is one aggregation."""

    def fit(self, df):
        s = self.state
        cols, (h, w) = s.get("cols") or numeric(df), s.get("grid", (5, 5))
        r = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
        rng = np.random.default_rng(s.get("seed", 0))
        mean, dev = np.array([r[f"m{i}"] for i in range(len(cols))]), np.array([r[f"d{i}"] for i in range(len(cols))])
        nodes = mean + dev * rng.normal(size=(h * w, len(cols)))
        at = np.array([(i // w, i % w) for i in range(h * w)], float)
        far = ((at[:, None] - at[None]) ** 2).sum(2)
        rounds = s.get("rounds", 12)
        for t in range(rounds):
            sigma = max(0.5, max(h, w) / 2 * (0.5 / (max(h, w) / 2)) ** (t / max(1, rounds - 1)))
            got = centroid_step(df, cols, nodes.tolist()).collect()
            n, means = np.zeros(h * w), np.zeros_like(nodes)
            for x in got:
                n[x["cluster"]], means[x["cluster"]] = x["n"], [x[c] for c in cols]
            k = np.exp(-far / (2 * sigma * sigma)) * n[None]
            nodes = (k @ means) / np.maximum(k.sum(1, keepdims=True), 1e-12)
        self.state |= {"cols": cols, "grid": [h, w], "nodes": nodes.tolist()}
        return self

    def transform(self, df):
        w = self.state["grid"][1]
        x = assign(df, self.state["cols"], self.state["nodes"], "node")
        return x.select(*df.columns, F.floor(F.col("node") / w).cast("int").alias("map_row"), (F.col("node") % w).cast("int").alias("map_col"), "sq_distance")


def haar(values: np.ndarray) -> np.ndarray:
    """The orthonormal Haar transform of a series of power-of-two length."""
    x, n = np.array(values, float), len(values)
    if n & (n - 1):
        raise ValueError("the length is no power of two")
    while n > 1:
        a, b = x[:n:2].copy(), x[1:n:2].copy()
        x[: n // 2], x[n // 2 : n] = (a + b) / math.sqrt(2), (a - b) / math.sqrt(2)
        n //= 2
    return x


def inverse_haar(values: np.ndarray) -> np.ndarray:
    x, n = np.array(values, float), 2
    while n <= len(x):
        a, b = x[: n // 2].copy(), x[n // 2 : n].copy()
        x[:n:2], x[1:n:2] = (a + b) / math.sqrt(2), (a - b) / math.sqrt(2)
        n *= 2
    return x

