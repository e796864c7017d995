"""Structured Streaming forms of the operators that keep state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.learners import NaiveBayes, update_naive_bayes


def windowed(df: DataFrame, ts: str, window: str, late: str, group: list[str], value: str, slide: str | None = None) -> DataFrame:
    """(window_start, window_end, group, n, total) over event time; rows later than ``late`` are left out."""
    w = F.window(F.col(ts), window, slide) if slide else F.window(F.col(ts), window)
    x = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(w.alias("w"), *group)
    return x.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *group, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, late: str, group: list[str], value: str) -> DataFrame:
    x = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *group)
    return x.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *group, "n", "total")


def thin(df: DataFrame, group: str, ts: str, gap_seconds: float) -> DataFrame:
    """Keep the first row of each group, then each at least a gap after the last kept; the state is that time.
    Rows of one micro-batch are taken in order of time."""
    kind = dict(df.dtypes)[group]

    def run(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(pdfs)).sort_values("t")
        keep = []
        for t in rows["t"]:
            keep.append(last is None or t - last >= gap_seconds)
            last = t if keep[-1] else last
        state.update((last,))
        yield rows[keep][[group, "t"]]

    x = df.select(group, F.col(ts).cast("timestamp").cast("double").alias("t"))
    return x.groupBy(group).applyInPandasWithState(run, f"{group} {kind}, t double", "last double", "append", "NoTimeout")


def running_covariance(df: DataFrame, group: str, a: str, b: str, decay: float = 1.0) -> DataFrame:
    """(group, n, covariance) after each micro-batch: sums of each batch are added to sums multiplied by ``decay``."""
    kind = dict(df.dtypes)[group]

    def run(key, pdfs, state):
        n, sa, sb, sab = (decay * v for v in state.get) if state.exists else (0.0,) * 4
        for p in pdfs:
            p = p.dropna()
            n, sa, sb, sab = n + len(p), sa + p["a"].sum(), sb + p["b"].sum(), sab + (p["a"] * p["b"]).sum()
        state.update((float(n), float(sa), float(sb), float(sab)))
        cov = n / (n - 1) * (sab / n - sa / n * (sb / n)) if n > 1 else 0.0
        yield pd.DataFrame({group: [key[0]], "n": [float(n)], "covariance": [float(cov)]})

    x = df.select(group, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    return x.groupBy(group).applyInPandasWithState(run, f"{group} {kind}, n double, covariance double", "n double, sa double, sb double, sab double", "update", "NoTimeout")


def level_filter(df: DataFrame, group: str, ts: str, value: str, process: float, noise: float) -> DataFrame:
    """(group, level, level_var) after each micro-batch: a local-level Kalman filter, rows of a batch by time."""
    kind = dict(df.dtypes)[group]

    def run(key, pdfs, state):
        known = state.exists
        m, v = state.get if known else (0.0, 0.0)
        for z in pd.concat(list(pdfs)).sort_values("t")["z"]:
            if z != z:
                v += process
            elif not known:
                m, v, known = z, noise, True
            else:
                v += process
                k = v / (v + noise)
                m, v = m + k * (z - m), (1 - k) * v
        state.update((float(m), float(v)))
        yield pd.DataFrame({group: [key[0]], "level": [float(m)], "level_var": [float(v)]})

    x = df.select(group, F.col(ts).cast("timestamp").cast("double").alias("t"), F.col(value).cast("double").alias("z"))
    return x.groupBy(group).applyInPandasWithState(run, f"{group} {kind}, level double, level_var double", "m double, v double", "update", "NoTimeout")


class OnlineNaiveBayes:
    """Counts of naive Bayes, added up by micro-batch: ``writeStream.foreachBatch(self.update)``."""

    def __init__(self, features: list[str], label: str, ess: float = 0.5):
        self.learner = NaiveBayes(features, label, ess=ess)
        self.seen = -1

    def update(self, batch: DataFrame, epoch: int) -> None:
        if epoch <= self.seen:  # a replayed batch counts once
            return
        new = NaiveBayes(self.learner.features, self.learner.label, **self.learner.options).fit(batch).model
        self.learner.model = new if self.learner.model is None else update_naive_bayes(self.learner.model, new)
        self.seen = epoch

    def to_json(self) -> str:
        return json.dumps({"seen": self.seen, "model": self.learner.model})
