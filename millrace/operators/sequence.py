"""Sequences, time series and signals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class HMM:
    """A hidden Markov model: start (s,), move (from, to), emit (state, symbol)."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = (np.array(x, float) for x in (start, move, emit))

    def forward(self, seq) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward probabilities and the scale of each step."""
        a, c = np.empty((len(seq), len(self.start))), np.empty(len(seq))
        for t, o in enumerate(seq):
            v = (self.start if t == 0 else a[t - 1] @ self.move) * self.emit[:, o]
            c[t] = v.sum()
            a[t] = v / c[t] if c[t] else 1.0 / len(v)
        return a, c

    def log_likelihood(self, seq) -> float:
        c = self.forward(seq)[1]
        return float(np.log(c).sum()) if len(seq) and (c > 0).all() else (0.0 if not len(seq) else -math.inf)

    def backward(self, seq, scale) -> np.ndarray:
        b = np.ones((len(seq), len(self.start)))
        for t in range(len(seq) - 2, -1, -1):
            b[t] = self.move @ (self.emit[:, seq[t + 1]] * b[t + 1]) / (scale[t + 1] or 1.0)
        return b

    def viterbi(self, seq) -> tuple[list[int], float]:
        """The likeliest states and their log probability; ties take the higher previous state."""
        if not len(seq):
            return [], 0.0
        with np.errstate(divide="ignore"):
            ls, lm, le = np.log(self.start), np.log(self.move), np.log(self.emit)
        d, back = ls + le[:, seq[0]], []
        n = len(ls)
        for o in seq[1:]:
            x = d[:, None] + lm
            best = n - 1 - x[::-1].argmax(0)
            back.append(best)
            d = x[best, np.arange(n)] + le[:, o]
        s = n - 1 - int(d[::-1].argmax())
        path = [s]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1], float(d[s])

    def expected(self, seq):
        """Expected starts, moves and emissions of one sequence, and its log likelihood."""
        a, c = self.forward(seq)
        g = a * self.backward(seq, c)
        g /= g.sum(1, keepdims=True)
        b = self.backward(seq, c)
        moves = np.zeros_like(self.move)
        for t in range(len(seq) - 1):
            x = a[t][:, None] * self.move * (self.emit[:, seq[t + 1]] * b[t + 1])[None]
            moves += x / (x.sum() or 1.0)
        emits = np.zeros_like(self.emit)
        np.add.at(emits.T, np.asarray(seq), g)
        return g[0], moves, emits, float(np.log(np.maximum(c, 1e-300)).sum())


def baum_welch(df: DataFrame, seq: str, model: HMM, rounds: int = 10) -> HMM:
    """Train on a column of arrays of symbols: each round gathers expected counts per task and adds them up."""
    k, v = model.emit.shape
    for _ in range(rounds):
        now = model

        def run(batches):
            total, n = np.zeros(k + k * k + k * v), 0
            for b in batches:
                for s in b[seq]:
                    if s is not None and len(s):
                        a, m, e, _ = now.expected(np.asarray(s, int))
                        total += np.concatenate([a, m.ravel(), e.ravel()])
                        n += 1
            yield pd.DataFrame({"i": np.arange(len(total)), "x": total})

        r = df.select(seq).mapInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")["x"].to_numpy()
        norm = lambda m: m / np.maximum(m.sum(-1, keepdims=True), 1e-300)
        model = HMM(norm(r[:k]), norm(r[k : k + k * k].reshape(k, k)), norm(r[k + k * k :].reshape(k, v)))
    return model


def hmm_columns(df: DataFrame, seq: str, model: HMM) -> DataFrame:
    """Adds log_likelihood, path and path_log of each sequence."""

    @F.pandas_udf("log_likelihood double, path array<int>, path_log double")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for x in s:
            x = np.asarray([] if x is None else x, int)
            p, lp = model.viterbi(x)
            out.append((model.log_likelihood(x), p, lp))
        return pd.DataFrame(out, columns=["log_likelihood", "path", "path_log"])

    return df.withColumn("__h", run(seq)).select(*df.columns, "__h.*")


class Kalman:
    """Extended Kalman filter; move(x, u), observe(x) and their Jacobians by differences."""

    def __init__(self, x, cov, move, observe, process, noise):
        self.x, self.p = np.array(x, float), np.array(cov, float)
        self.move, self.observe, self.q, self.r = move, observe, np.array(process, float), np.array(noise, float)

    @staticmethod
    def _jacobian(f, x):
        y, out = f(x), []
        for i in range(len(x)):
            h = 1e-6 * max(1.0, abs(x[i]))
            e = x.copy()
            e[i] += h
            out.append((f(e) - y) / h)
        return np.stack(out, 1)

    def advance(self, u=None):
        j = self._jacobian(lambda x: self.move(x, u), self.x)
        self.x, self.p = self.move(self.x, u), j @ self.p @ j.T + self.q

    def correct(self, z):
        j = self._jacobian(self.observe, self.x)
        k = self.p @ j.T @ np.linalg.inv(j @ self.p @ j.T + self.r)
        self.x = self.x + k @ (np.asarray(z, float) - self.observe(self.x))
        self.p = (np.eye(len(self.x)) - k @ j) @ self.p


def level_filter(df: DataFrame, group: list[str], order: str, value: str, process: float, noise: float) -> DataFrame:
    """Adds ``level`` and ``level_var``: a local-level filter over each group's rows in order; rows stream through
    sorted partitions. A null value only advances."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = df.repartition(parts, *group).sortWithinPartitions(*group, order)

    def run(batches):
        now, m, v = None, 0.0, 0.0
        for b in batches:
            lev, var = np.empty(len(b)), np.empty(len(b))
            keys = list(zip(*(b[g] for g in group)))
            for i, (g, z) in enumerate(zip(keys, b[value].astype(float))):
                if g != now:
                    now, m, v = g, (0.0 if z != z else z), noise if z == z else 1e6
                else:
                    v += process
                    if z == z:
                        k = v / (v + noise)
                        m, v = m + k * (z - m), (1 - k) * v
                lev[i], var[i] = m, v
            yield b.assign(level=lev, level_var=var)

    from pyspark.sql.types import DoubleType, StructField, StructType

    return x.mapInPandas(run, StructType([*df.schema.fields, StructField("level", DoubleType()), StructField("level_var", DoubleType())]))


# ---- signals in array columns -----------------------------------------------------------------------


def _arrays(f):
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else [float(v) for v in f(np.asarray(x, float))])

    return run


def fft_magnitude(col: Column) -> Column:
    return _arrays(lambda x: np.abs(np.fft.rfft(x)))(col)


def fft_roundtrip(col: Column) -> Column:
    return _arrays(lambda x: np.fft.irfft(np.fft.rfft(x), len(x)))(col)


def amplify(col: Column, k: float) -> Column:
    return F.transform(col, lambda x: x * F.lit(k))


def mix(a: Column, b: Column, ka: float = 1.0, kb: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) * F.lit(ka) + F.coalesce(y, F.lit(0.0)) * F.lit(kb))


def sine(seconds: float, rate: int, hertz: float, volume: float = 1.0) -> Column:
    n = int(seconds * rate)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(volume) * F.sin(i * F.lit(2 * math.pi * hertz / rate))) if n > 0 else F.array().cast("array<double>")


def silence(seconds: float, rate: int) -> Column:
    return F.array_repeat(F.lit(0.0), int(seconds * rate))


def pitch_shift(col: Column, semitones: float, block: int = 2048) -> Column:
    """Move the spectrum of overlapping blocks by a ratio."""
    ratio = 2 ** (semitones / 12)

    def f(x):
        n, hop = len(x), block // 2
        win, out, weight = np.hanning(block), np.zeros(len(x) + block), np.zeros(len(x) + block)
        pad = np.concatenate([x, np.zeros(block)])
        for at in range(0, n, hop):
            s = np.fft.rfft(pad[at : at + block] * win)
            t = np.zeros_like(s)
            to = np.round(np.arange(len(s)) * ratio).astype(int)
            ok = to < len(s)
            np.add.at(t, to[ok], s[ok])
            out[at : at + block] += np.fft.irfft(t, block) * win
            weight[at : at + block] += win * win
        return (out / np.maximum(weight, 1e-9))[:n]

    return _arrays(f)(col)


def reduce_noise(col: Column, noise: list[float], block: int = 2048, deviations: float = 2.5) -> Column:
    """Set to nothing what a block's spectrum has up to the noise sample's mean + deviations."""
    z = np.asarray(noise, float)
    parts = np.stack([np.abs(np.fft.rfft(z[i : i + block])) for i in range(0, max(1, len(z) - block + 1), block // 2)]) if len(z) >= block else np.abs(np.fft.rfft(z, block))[None]
    limit = parts.mean(0) + deviations * parts.std(0)

    def f(x):
        out = np.zeros(len(x) + block)
        pad, win, weight = np.concatenate([x, np.zeros(block)]), np.hanning(block), np.zeros(len(x) + block)
        for at in range(0, len(x), block // 2):
            s = np.fft.rfft(pad[at : at + block] * win)
            m = np.abs(s)
            out[at : at + block] += np.fft.irfft(s * np.maximum(0, m - limit) / np.maximum(m, 1e-12), block) * win
            weight[at : at + block] += win * win
        return (out / np.maximum(weight, 1e-9))[: len(x)]

    return _arrays(f)(col)


def quiet(col: Column, rate: int, threshold: float = 0.15, seconds: float = 0.1) -> Column:
    """Stretches of at least 2 x ``seconds`` below the threshold become 0, with cosine ramps of ``seconds``."""
    ramp = int(seconds * rate)

    def f(x):
        y, low = x.copy(), np.abs(x) < threshold
        edge = np.flatnonzero(np.diff(np.concatenate(([0], low.view(np.int8), [0]))))
        for a, z in zip(edge[::2], edge[1::2]):
            if z - a >= 2 * ramp and ramp:
                fade = 0.5 + 0.5 * np.cos(np.pi * np.arange(ramp) / ramp)
                y[a : a + ramp] *= fade
                y[z - ramp : z] *= fade[::-1]
                y[a + ramp : z - ramp] = 0
        return y

    return _arrays(f)(col)


def spectrum(col: Column, bins: int) -> Column:
    """Mean magnitude in equal bands of frequency."""
    return _arrays(lambda x: [float(p.mean()) if len(p) else 0.0 for p in np.array_split(np.abs(np.fft.rfft(x)), bins)])(col)
