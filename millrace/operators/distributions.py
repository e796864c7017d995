"""Densities as columns, draws, and optimisers whose loss may be one Spark aggregate."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import lgamma
from .ordering import running


def normal_log(x: Column, mean: float, var: float) -> Column:
    return -F.pow(x - F.lit(mean), F.lit(2.0)) / F.lit(2 * var) - F.lit(0.5 * math.log(2 * math.pi * var))


def uniform_log(x: Column, a: float, b: float) -> Column:
    return F.when((x >= a) & (x <= b), F.lit(-math.log(b - a)))


def poisson_log(k: Column, rate: float) -> Column:
    return k * F.lit(math.log(rate)) - F.lit(rate) - lgamma(k + 1)


def gamma_log(x: Column, shape: float, scale: float) -> Column:
    return F.when(x > 0, F.lit(shape - 1) * F.ln(x) - x / F.lit(scale) - F.lit(math.lgamma(shape) + shape * math.log(scale)))


def inverse_gamma_log(x: Column, shape: float, scale: float) -> Column:
    return F.when(x > 0, F.lit(shape * math.log(scale) - math.lgamma(shape)) - F.lit(shape + 1) * F.ln(x) - F.lit(scale) / x)


def beta_log(x: Column, a: float, b: float) -> Column:
    return F.when((x > 0) & (x < 1), F.lit(a - 1) * F.ln(x) + F.lit(b - 1) * F.ln(1 - x) - F.lit(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))


def soft_impulse(x: Column, steepness: float) -> Column:
    """A step from 0 to 1 over [0, 1], 0.5 at 0.5."""
    y = F.pow((F.lit(1.0) - x) / x, F.lit(steepness))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.lit(1.0) / (y + 1))


def categorical_log(x: Column, shares: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for v, p in shares.items():
        out = F.when(x == v, F.lit(math.log(p))).otherwise(out)
    return out


def multivariate_normal_log(xs: list[Column], mean: list[float], cov: np.ndarray) -> Column:
    inv, d = np.linalg.inv(cov), len(xs)
    q = F.lit(0.0)
    for i in range(d):
        for j in range(d):
            q = q + (xs[i] - F.lit(mean[i])) * (xs[j] - F.lit(mean[j])) * F.lit(float(inv[i, j]))
    return -q / 2 - F.lit(0.5 * (d * math.log(2 * math.pi) + float(np.linalg.slogdet(cov)[1])))


def sample_categorical(weights: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """(draw, key): n weighted draws with replacement: cumulative weights met by uniform numbers in a range join."""
    c = running(weights, [key], {"hi": F.col(weight)})
    total = c.agg(F.max("hi").alias("t")).first()["t"]
    c = c.select(key, (F.col("hi") - F.col(weight)).alias("lo"), "hi")
    u = weights.sparkSession.range(n).select(F.col("id").alias("draw"), (F.rand(seed) * F.lit(total)).alias("u"))
    # a grid of the unit line turns the range join into an equal join
    cell = lambda x: F.floor(x / F.lit(total) * 1024)
    c = c.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    return u.withColumn("cell", cell(F.col("u"))).join(c, "cell").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", key)


def noise(spark: SparkSession, rows: int, kind: str, seed: int = 0, **p) -> DataFrame:
    """(id, value) of so many draws of a distribution, made in parallel. Each block of 4,096 ids has its own seed, so
    reruns agree however the rows are dealt."""
    draw = {
        "beta": lambda g, k: g.beta(p["a"], p["b"], k), "binomial": lambda g, k: g.binomial(p["n"], p["p"], k), "categorical": lambda g, k: g.choice(len(p["shares"]), k, p=p["shares"]),
        "cauchy": lambda g, k: p.get("median", 0) + p.get("scale", 1) * g.standard_cauchy(k), "chisquare": lambda g, k: g.chisquare(p["df"], k), "exponential": lambda g, k: g.exponential(1 / p.get("rate", 1), k),
        "f": lambda g, k: g.f(p["df1"], p["df2"], k), "gamma": lambda g, k: g.gamma(p["shape"], p.get("scale", 1), k), "gaussian": lambda g, k: g.normal(p.get("mean", 0), p.get("dev", 1), k),
        "geometric": lambda g, k: g.geometric(p["p"], k), "logistic": lambda g, k: g.logistic(p.get("mean", 0), p.get("scale", 1), k), "lognormal": lambda g, k: g.lognormal(p.get("mean", 0), p.get("dev", 1), k),
        "normal": lambda g, k: g.normal(p.get("mean", 0), p.get("dev", 1), k), "poisson": lambda g, k: g.poisson(p["rate"], k), "softimpulse": lambda g, k: _impulse(g.random(k), p["steepness"]),
        "spherical": lambda g, k: g.normal(size=k), "student": lambda g, k: g.standard_t(p["df"], k), "uniform": lambda g, k: g.uniform(p.get("a", 0), p.get("b", 1), k), "weibull": lambda g, k: p.get("scale", 1) * g.weibull(p["shape"], k),
    }[kind]

    def run(batches):
        for b in batches:
            i = b.column(0).to_numpy()
            value = np.empty(len(i))
            for block in np.unique(i // 4096):
                at = i // 4096 == block
                value[at] = np.asarray(draw(np.random.default_rng([seed, int(block)]), 4096), float)[i[at] % 4096]
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "value": pa.array(value)})

    return spark.range(rows).mapInArrow(run, "id bigint, value double")


def _impulse(u: np.ndarray, steepness: float) -> np.ndarray:
    return 1 / (1 + ((1 - u) / u) ** (1 / steepness))


# ---- optimisers: loss(vector) -> float --------------------------------------------------------------


def hill_climb(loss, x, step: float = 1.0, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Coordinate steps that grow when they help and shrink when they do not."""
    x, s = np.array(x, float), np.full(len(x), float(step))
    best = loss(x)
    for _ in range(rounds):
        moved = False
        for i in range(len(x)):
            for f in (1.25, 0.8, -0.8, -1.25):
                y = x.copy()
                y[i] += s[i] * f
                v = loss(y)
                if v < best:
                    x, best, moved = y, v, True
                    s[i] *= f
                    break
            else:
                s[i] *= 0.6
        if not moved and np.abs(s).max() < 1e-12:
            break
    return x, best


def anneal(loss, x, dev: float = 1.0, decay: float = 0.999, rounds: int = 5000, seed: int = 0) -> tuple[np.ndarray, float]:
    """Random steps of shrinking size; better ones are taken."""
    g, x = np.random.default_rng(seed), np.array(x, float)
    best = loss(x)
    for _ in range(rounds):
        y = x + g.normal(size=len(x)) * dev
        v = loss(y)
        if v < best:
            x, best = y, v
        dev *= decay
    return x, best


def momentum_search(loss, x, step: float = 0.1, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Greedy axis steps plus what moved the point before."""
    x, speed = np.array(x, float), np.zeros(len(x))
    best = loss(x)
    for _ in range(rounds):
        tries = [x + speed, *(x + speed + s * step * np.eye(len(x))[i] for i in range(len(x)) for s in (-1, 1)), *(x + s * step * np.eye(len(x))[i] for i in range(len(x)) for s in (-1, 1))]
        vs = [loss(t) for t in tries]
        j = int(np.argmin(vs))
        if vs[j] < best:
            speed, x, best = 0.9 * (tries[j] - x), tries[j], vs[j]
            step *= 1.1
        else:
            speed *= 0.5
            step *= 0.6
        if step < 1e-12:
            break
    return x, best


def random_direction(loss, x, rounds: int = 500, seed: int = 0) -> tuple[np.ndarray, float]:
    """Along random directions the step is doubled or halved until it helps no more."""
    g, x = np.random.default_rng(seed), np.array(x, float)
    best = loss(x)
    for _ in range(rounds):
        d = g.normal(size=len(x))
        d /= np.linalg.norm(d)
        s = 1.0
        while s > 1e-12:
            got = [(loss(x + k * s * d), k * s) for k in (1, -1)]
            v, k = min(got)
            if v < best:
                while (w := loss(x + 2 * k * d)) < v:
                    v, k = w, 2 * k
                x, best = x + k * d, v
                break
            s /= 4
    return x, best


def empirical_gradient(loss, x, rate: float = 0.1, rounds: int = 500, eps: float = 1e-5) -> tuple[np.ndarray, float]:
    x = np.array(x, float)
    best = loss(x)
    for _ in range(rounds):
        g = np.array([(loss(x + eps * e) - loss(x - eps * e)) / (2 * eps) for e in np.eye(len(x))])
        while rate > 1e-15 and (v := loss(x - rate * g)) >= best:
            rate /= 2
        if rate <= 1e-15:
            break
        x, best, rate = x - rate * g, v, rate * 1.5
    return x, best


def sample_climb(loss, x, dev: float = 0.1, samples: int = 16, rounds: int = 200, seed: int = 0) -> tuple[np.ndarray, float]:
    """Steps along the slope of a plane through random samples."""
    g, x = np.random.default_rng(seed), np.array(x, float)
    best = loss(x)
    for _ in range(rounds):
        z = g.normal(size=(samples, len(x))) * dev
        v = np.array([loss(x + d) for d in z])
        slope = np.linalg.lstsq(np.c_[z, np.ones(samples)], v, rcond=None)[0][:-1]
        y = x - dev * slope / max(np.linalg.norm(slope), 1e-12)
        j = int(v.argmin())
        w, y = min((loss(y), tuple(y)), (v[j], tuple(x + z[j])))
        if w < best:
            x, best, dev = np.array(y), w, dev * 1.2
        else:
            dev *= 0.7
    return x, best


def evolve(loss, dims: int, population: int = 40, rounds: int = 200, dev: float = 1.0, seed: int = 0) -> tuple[np.ndarray, float]:
    """Tournaments: the loser is replaced by a mix of two winners with a mutation."""
    g = np.random.default_rng(seed)
    x = g.normal(size=(population, dims)) * dev
    v = np.array([loss(r) for r in x])
    for t in range(rounds * population // 4):
        a, b, c = g.choice(population, 3, replace=False)
        a, b, c = sorted((a, b, c), key=lambda i: v[i])
        m = g.random(dims) < 0.5
        y = np.where(m, x[a], x[b]) + g.normal(size=dims) * dev * (0.99 ** (t / 4)) * (g.random(dims) < 0.5)
        x[c], v[c] = y, loss(y)
    i = int(v.argmin())
    return x[i], float(v[i])


def particle_swarm(loss, dims: int, population: int = 30, rounds: int = 200, seed: int = 0) -> tuple[np.ndarray, float]:
    g = np.random.default_rng(seed)
    x, s = g.uniform(-2, 2, (population, dims)), g.normal(size=(population, dims)) * 0.1
    v = np.array([loss(r) for r in x])
    own, own_v = x.copy(), v.copy()
    for _ in range(rounds):
        top = own[own_v.argmin()]
        s = 0.72 * s + 1.49 * g.random(x.shape) * (own - x) + 1.49 * g.random(x.shape) * (top - x)
        x = x + s
        v = np.array([loss(r) for r in x])
        better = v < own_v
        own[better], own_v[better] = x[better], v[better]
    i = int(own_v.argmin())
    return own[i], float(own_v[i])


class Gradient:
    """Steps of stochastic gradient descent with momentum, Adam or RMSProp."""

    def __init__(self, kind: str = "adam", rate: float = 0.01, momentum: float = 0.0):
        self.kind, self.rate, self.momentum, self.t, self.m, self.v = kind, rate, momentum, 0, 0.0, 0.0

    def step(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        if self.kind == "sgd":
            self.m = self.momentum * self.m - self.rate * g
            return x + self.m
        if self.kind == "rmsprop":
            self.v = 0.9 * self.v + 0.1 * g * g
            return x - self.rate * g / (np.sqrt(self.v) + 1e-8)
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        return x - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def grid_search(loss, axes: list[list[float]]) -> tuple[tuple, float]:
    return min(((p, loss(np.array(p, float))) for p in product(*axes)), key=lambda r: r[1])


# ---- activations as columns -------------------------------------------------------------------------

ACTIVATIONS = {
    "identity": lambda x: x, "tanh": F.tanh, "scaled_tanh": lambda x: F.lit(1.7159) * F.tanh(x * 2 / 3), "logistic": lambda x: 1 / (1 + F.exp(-x)), "rectifier": lambda x: F.greatest(x, F.lit(0.0)),
    "leaky_rectifier": lambda x: F.when(x >= 0, x).otherwise(x * 0.01), "softplus": lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))), "bent_identity": lambda x: (F.sqrt(x * x + 1) - 1) / 2 + x,
    "gaussian": lambda x: F.exp(-x * x), "sine": F.sin, "elu": lambda x: F.when(x >= 0, x).otherwise(F.exp(F.least(x, F.lit(0.0))) - 1), "soft_root": lambda x: F.when(x >= 0, F.sqrt(F.abs(x) + 1) - 1).otherwise(1 - F.sqrt(F.abs(x) + 1)),
}


def softmax(xs: list[Column]) -> list[Column]:
    top = F.greatest(*xs) if len(xs) > 1 else xs[0]
    e = [F.exp(x - top) for x in xs]
    total = sum(e, F.lit(0.0))
    return [x / total for x in e]
