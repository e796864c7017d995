"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over words and word beginnings, trained from confirmed toxic texts and unlabelled
ones. With class prior q, positive risk P+, risk P- of positives taken as negatives and risk U- of
unlabelled ones taken as negatives, it minimises q P+ + max(0, U- - q P-): the negative part is
estimated without negatives and may not fall below zero; a step that would is turned around.

The classifier is fitted on a bounded sample of labelled rows (``max_positive``, ``max_unlabelled``);
scores cover every whole text.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import support

_WORD = re.compile(r"[^\W\d_]+")
_BITS = 22
_STEMS = (3, 4, 5, 6)


def _hash(s: str) -> int:
    return zlib.crc32(s.encode()) & ((1 << _BITS) - 1)


class WordFeatures(dict):
    """Feature numbers of a lower-cased word: the word and its beginnings. Bounded memory."""

    def __init__(self, only: set[int] | None = None, limit: int = 400_000):
        self.only, self.limit = only, limit

    def __missing__(self, w: str) -> tuple[int, ...]:
        got = {_hash(w + "$"), *(_hash(w[:n] + "*") for n in _STEMS if n < len(w))}
        got = tuple(got if self.only is None else got & self.only)
        if len(w) <= 40:
            if len(self) >= self.limit:
                self.clear()
            self[w] = got
        return got


def features(text: str | None, words: WordFeatures) -> set[int]:
    """Distinct features of a whole text; none for null or wordless text."""
    return {f for w in set(_WORD.findall((text or "").lower())) for f in words[w]}


class Model:
    """Weights of the selected features, and the bias."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

        self._words: WordFeatures | None = None

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "_words": None}

    def score(self, text: str | None) -> float:
        if self._words is None:
            self._words = WordFeatures(set(self.weights))
        w = self.weights
        z = self.bias + sum(w[f] for f in sorted(features(text, self._words)))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(pos: list[np.ndarray], unl: list[np.ndarray], n: int, prior: float, steps: int = 200, rate: float = 0.1, l2: float = 2e-3) -> tuple[np.ndarray, float, list[float]]:
    """nnPU with the logistic loss and Adam, whole batch. pos, unl: feature numbers (0..n-1) of each text.
    Returns weights and bias, the mean of those of the last quarter of steps, and the risk before each step."""

    def flat(docs):
        return np.repeat(np.arange(len(docs)), [len(d) for d in docs]), (np.concatenate(docs) if docs else np.empty(0, int)).astype(np.int64)

    (pr, pf), (ur, uf) = flat(pos), flat(unl)
    w, b, risks = np.zeros(n + 1), float(np.log(prior / (1 - prior))), []
    w[n] = b
    m, v, mean, late = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1), steps - steps // 4
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        zp = np.bincount(pr, w[pf], len(pos)) + w[n]
        zu = np.bincount(ur, w[uf], len(unl)) + w[n]
        soft = lambda z: np.logaddexp(0, z)
        positive, negative = prior * soft(-zp).mean(), soft(zu).mean() - prior * soft(zp).mean()
        risks.append(positive + max(0.0, negative))
        # d/dz of each part
        gp_plus, gp_minus, gu = -prior * sig(-zp) / len(pos), -prior * sig(zp) / len(pos), sig(zu) / len(unl)
        if negative >= 0:
            gp, gu_ = gp_plus + gp_minus, gu
        else:  # ascend the negative part until it is a risk again
            gp, gu_ = -gp_minus, -gu
        g = np.empty(n + 1)
        g[:n] = np.bincount(pf, gp[pr], n) + np.bincount(uf, gu_[ur], n) + l2 * w[:n]
        g[n] = gp.sum() + gu_.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if t > late:
            mean += (w - mean) / (t - late)
    w = mean if steps > late else w
    return w[:n], float(w[n]), risks


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 12000, n_features: int = 2000, least: int = 3) -> Model | None:
    """docs (doc_id, text), labels (doc_id, toxic): the rows learnt from, and nothing else.

    Positives are up to ``max_positive`` texts labelled 1, unlabelled ones up to ``max_unlabelled`` of all,
    both in hash order of the id. The prior is the share of 1 among the labels. None without a label 1.
    """
    r = labels.filter("toxic in (0, 1)").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k")).first()
    if not r["k"]:
        return None
    prior = min(0.9, max(1e-4, r["k"] / r["n"]))
    spread = F.xxhash64(F.col("doc_id"), F.lit(29))
    pos = labels.filter("toxic = 1 and doc_id is not null").select("doc_id").distinct().orderBy(spread, "doc_id").limit(max_positive).withColumn("kind", F.lit(1))
    unl = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64(F.col("doc_id"), F.lit(31)), "doc_id").limit(max_unlabelled).withColumn("kind", F.lit(0))
    wanted = F.broadcast(pos.union(unl))  # at most max_positive + max_unlabelled rows

    def extract(batches):
        words = WordFeatures()
        for b in batches:
            rows = [sorted(features(t.as_py(), words)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], ["kind", "f"])

    work = support.Scratch(docs.sparkSession)
    sample = work.keep(docs.select("doc_id", "text").join(wanted, "doc_id").select("kind", "text").mapInArrow(extract, "kind int, f array<int>"), "toxic-sample")
    n = {x["kind"]: x["n"] for x in sample.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        work.drop_all()
        return None
    counts = sample.select("kind", F.explode("f").alias("f")).groupBy("f").agg(F.sum("kind").alias("p"), F.sum(1 - F.col("kind")).alias("u")).filter(F.col("p") >= min(least, n[1]))
    rp, ru = F.col("p") / n[1], F.col("u") / n[0]
    z = (rp - ru) / F.sqrt(F.greatest(ru, F.lit(0.5 / n[0])) * (1.0 / n[1] + 1.0 / n[0]))
    chosen = [x["f"] for x in counts.select("f", F.abs(z).alias("z")).orderBy(F.desc("z"), "f").limit(n_features).collect()]
    number = {f: i for i, f in enumerate(sorted(chosen))}
    keep = docs.sparkSession.sparkContext.broadcast(number)

    def reduce_(batches):
        num = keep.value
        for b in batches:
            rows = [[num[f] for f in d if f in num] for d in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], ["kind", "f"])

    rows = sample.mapInArrow(reduce_, "kind int, f array<int>").toArrow()
    kinds, lists = rows.column(0).to_pylist(), rows.column(1).to_pylist()
    order = sorted(range(len(kinds)), key=lambda i: (kinds[i], lists[i]))  # reruns sum in one order
    by = {k: [np.array(lists[i], np.int64) for i in order if kinds[i] == k] for k in (0, 1)}
    w, b, _ = train(by[1], by[0], len(number), prior)
    work.drop_all()
    return Model({f: float(w[i]) for f, i in number.items()}, b)


def score(docs: DataFrame, model: Model | None, prior: float = 0.0) -> DataFrame:
    """doc_id, score of every row; without a model the score is ``prior``."""

    def run(batches):
        for b in batches:
            s = [model.score(t.as_py()) if model else prior for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")


def held_out_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Learn from rows outside the held-out fold, score all: doc_id, held_out, score, predicted.

    Null and empty texts get the score of no feature; of long ones all words count. A null id is not held out
    and not learnt from. Repeated ids are scored row by row. An empty table gives an empty result; other
    columns are not read, so clashing names do not matter.
    """
    learn = fold(F.col("doc_id")) != 2
    model = fit(docs.filter(learn).select("doc_id", "text"), labels.filter(learn).select("doc_id", "toxic"))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
