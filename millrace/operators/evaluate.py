"""Evaluation of predictions and scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running


def confusion(df: DataFrame, target: str, predicted: str) -> DataFrame:
    """(target, predicted, n); rows of unknown target or prediction are skipped."""
    return df.filter(F.col(target).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(target).alias("target"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def sum_errors(df: DataFrame, target: str, predicted: str, nominal: bool = False) -> DataFrame:
    """Sums of squared and absolute errors; for nominal labels both count mismatches."""
    x = df.filter(F.col(target).isNotNull())
    d = F.when(F.col(target).eqNullSafe(F.col(predicted)), 0.0).otherwise(1.0) if nominal else (F.col(target) - F.col(predicted)).cast("double")
    return x.agg(F.sum(d * d).alias("sum_squared"), F.sum(F.abs(d)).alias("sum_absolute"), F.count(F.lit(1)).alias("n"))


def _by_score(df: DataFrame, score: str, relevant: str) -> DataFrame:
    """(score, n, r): one row a distinct score, so that equal scores count together and windows stay short."""
    return df.filter(F.col(score).isNotNull()).groupBy((-F.col(score)).alias("neg")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(relevant).cast("double")).alias("r"))


def precision_recall(df: DataFrame, score: str, relevant: str) -> DataFrame:
    """(score, precision, recall) down the scores. relevant: 0/1, or a share of relevance in [0, 1]."""
    x = running(_by_score(df, score, relevant), ["neg"], {"cn": F.col("n"), "cr": F.col("r")})
    total = F.lit(df.filter(F.col(score).isNotNull()).agg(F.sum(F.col(relevant).cast("double")).alias("t")).first()["t"])
    return x.select((-F.col("neg")).alias("score"), (F.col("cr") / F.col("cn")).alias("precision"), F.try_divide(F.col("cr"), total).alias("recall"))


def hit_precision(df: DataFrame, key: str, score: str, relevant: str) -> DataFrame:
    """(hit, precision): at the h-th relevant row (from 0) the value (found - 1) / (total - 1), and 1 at the first
    row. Ties in score go by key."""
    x = running(df.filter(F.col(score).isNotNull()).select(key, relevant, (-F.col(score)).alias("neg")), ["neg", key], {"total": F.lit(1), "found": F.col(relevant).cast("int")})
    x = x.filter(F.col(relevant) == 1)
    p = F.when(F.col("total") == 1, F.lit(1.0)).otherwise((F.col("found") - 1) / (F.col("total") - 1))
    return x.select((F.col("found") - 1).alias("hit"), p.alias("precision"))


def roc(df: DataFrame, score: str, relevant: str) -> DataFrame:
    """(score, true_positive, false_positive) rates down the distinct scores."""
    x = running(_by_score(df, score, relevant), ["neg"], {"cn": F.col("n"), "cr": F.col("r")})
    t = df.filter(F.col(score).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(relevant).cast("double")).alias("r")).first()
    pos, neg = t["r"] or 0.0, t["n"] - (t["r"] or 0.0)
    return x.select((-F.col("neg")).alias("score"), F.try_divide(F.col("cr"), F.lit(pos)).alias("true_positive"), F.try_divide(F.col("cn") - F.col("cr"), F.lit(neg)).alias("false_positive"))


def auc(df: DataFrame, score: str, relevant: str) -> DataFrame:
    """Area under the ROC curve by trapezoids, ties halved; null without both kinds. Rank sums over distinct
    scores, so no window holds all rows."""
    x = running(_by_score(df, score, relevant), ["neg"], {"br": F.col("r")}, inclusive=False)
    f = F.col("n") - F.col("r")
    pairs = F.sum(f * (F.col("br") + F.col("r") / 2))
    return x.agg(F.try_divide(pairs, F.sum("r") * F.sum(f)).alias("auc"))


def mean_curve(curves: list[list[tuple[float, float]]], samples: int = 100) -> list[tuple[float, float]]:
    """Curves resampled linearly at equal steps of x in [0, 1] and averaged."""
    x = np.linspace(0, 1, samples)
    ys = [np.interp(x, *map(np.array, zip(*sorted(c)))) for c in curves if c]
    return list(zip(x.tolist(), np.mean(ys, axis=0).tolist()))


def cross_precision_recall(make, df: DataFrame, label: str, positive, score, keys: list[str], reps: int = 5, samples: int = 100) -> list[tuple[float, float]]:
    """For each rep, halves of a shuffled order score one another; the mean of the 2 x reps curves. ``score``
    makes the score column of a prediction. Of each curve only the ends of every step of recall reach the driver,
    which are all that the resampling looks at."""
    curves = []
    for r in range(reps):
        half = F.pmod(F.xxhash64(*keys, F.lit(r)), F.lit(2))
        parts = df.filter(half == 0), df.filter(half == 1)
        for a, b in (parts, parts[::-1]):
            p = score(make().fit(a).predict(b)).withColumn("__rel", (F.col(label) == positive).cast("int"))
            at = F.struct("recall", "precision")
            ends = precision_recall(p, "score", "__rel").filter("recall is not null").groupBy(F.floor(F.col("recall") * (samples - 1)).alias("__step")).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
            curves.append([tuple(e) for x in ends.collect() for e in (x["lo"], x["hi"])])
    return mean_curve(curves, samples)


def top_k(df: DataFrame, group: list[str], score: str, k: int, ties: list[str] | None = None) -> DataFrame:
    """The k rows of the highest score of each group; equal scores go by ``ties``, or else in no order."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), *(ties or []))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
