"""Aggregations, statistics and significance tests. Nulls are skipped unless said otherwise."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import incomplete_beta
from .columns import nominal, numeric
from .ordering import medians, running, with_row_id


def col_stats(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, min, max, mean, median), in one scan and those of the medians."""
    cols = cols or numeric(df)
    mid = medians(df, cols)
    r = df.agg(*[f(F.col(c)).cast("double").alias(f"{c}__{k}") for c in cols for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("median", lambda _, m=mid[c]: F.max(F.lit(m).cast("double"))))])
    return r.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{k}").alias(k) for k in ("min", "max", "mean", "median")]) for c in cols])).alias("r")).select("r.*")


def weighted_mean(x: str, w: str) -> Column:
    return F.try_divide(F.sum(F.when(F.col(x).isNotNull(), F.col(x) * F.col(w))), F.sum(F.when(F.col(x).isNotNull(), F.col(w))))


def variance(x: str) -> Column:
    """Sample variance; 0 for fewer than two values."""
    return F.coalesce(F.var_samp(x), F.lit(0.0))


def centroid(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or numeric(df)
    return df.agg(*[F.avg(c).alias(c) for c in cols])


def array_centroid(df: DataFrame, col: str, group: list[str] | None = None) -> DataFrame:
    """(group, pos, value): mean vector of an array column."""
    x = df.select(*(group or []), F.posexplode(col).alias("pos", "value"))
    return x.groupBy(*(group or []), "pos").agg(F.avg(F.col("value").cast("double")).alias("value"))


def squared_magnitude(x: str) -> Column:
    return F.sum(F.col(x) * F.col(x))


def sum_squared_distance(df: DataFrame, cols: list[str], point: list[float]) -> DataFrame:
    return df.agg(F.sum(sum((F.pow(F.col(c) - F.lit(p), 2) for c, p in zip(cols, point)), F.lit(0.0))).alias("sum_squared_distance"))


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n) of every value of several columns, in one scan."""
    x = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("r")).select("r.*")
    return x.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def entropy(df: DataFrame, cols: list[str], group: list[str] | None = None) -> DataFrame:
    """(group, column, entropy in bits, mode, share of the mode). Equal counts: the smaller value."""
    g = group or []
    x = df.select(*g, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("r")).select(*g, "r.*").filter("value is not null")
    n = x.groupBy(*g, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    # sum p log2(1/p) = log2 N - (sum n log2 n) / N, one pass over the counts
    return n.groupBy(*g, "column").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"), F.max(F.struct(F.col("n"), F.lit(0))).getField("n").alias("top"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"), F.sum("n").alias("total")).select(*g, "column", F.greatest("entropy", F.lit(0.0)).alias("entropy"), "mode", (F.col("top") / F.col("total")).alias("mode_share"))


def baseline(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, value): the mean of a number, the commonest value of a nominal column."""
    cols = cols or df.columns
    num = [c for c in cols if c in set(numeric(df))]
    text = [c for c in cols if c in set(nominal(df))]
    parts = []
    if num:
        parts.append(df.agg(*[F.avg(c).alias(c) for c in num]).unpivot([], num, "column", "mean").select("column", "mean", F.lit(None).cast("string").alias("mode")))
    if text:
        parts.append(entropy(df, text).select("column", F.lit(None).cast("double").alias("mean"), "mode"))
    out = parts[0]
    return out.union(parts[1]) if len(parts) > 1 else out


def information(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The sum of entropies of nominal and variances of numeric columns."""
    cols = cols or df.columns
    num, text = [c for c in cols if c in set(numeric(df))], [c for c in cols if c in set(nominal(df))]
    v = df.agg(sum((variance(c) for c in num), F.lit(0.0)).alias("x"))
    e = entropy(df, text).agg(F.coalesce(F.sum("entropy"), F.lit(0.0)).alias("x")) if text else None
    return (v.union(e) if e is not None else v).agg(F.sum("x").alias("information"))


def count_unique(df: DataFrame, col: str, cap: int | None = None) -> DataFrame:
    """Distinct values, null as one of them, up to ``cap``."""
    n = F.count_distinct(col) + F.max(F.col(col).isNull().cast("int"))
    return df.agg((F.least(n, F.lit(cap)) if cap else n).cast("bigint").alias("n_unique"))


def has_missing(df: DataFrame) -> DataFrame:
    any_ = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0)) > 0
    return df.agg(F.coalesce(F.bool_or(any_), F.lit(False)).alias("any_missing"))


def correlation(a: str, b: str, about_origin: bool = False) -> Column:
    """Pearson over complete pairs, 0 if degenerate; ``about_origin`` does not centre."""
    if about_origin:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        r = F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x) * F.sum(y * y)))
    else:
        r = F.corr(a, b)
    return F.coalesce(F.when(~F.isnan(r), r), F.lit(0.0))


def covariance(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(a, b, covariance) of all pairs, in one aggregation over complete pairs."""
    cols = cols or numeric(df)
    pairs = [(x, y) for i, x in enumerate(cols) for y in cols[i:]]
    r = df.agg(*[F.covar_samp(x, y).alias(f"c{i}") for i, (x, y) in enumerate(pairs)])
    both = [(x, y, i) for i, (x, y) in enumerate(pairs)] + [(y, x, i) for i, (x, y) in enumerate(pairs) if x != y]
    return r.select(F.explode(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{i}").alias("covariance")) for x, y, i in both])).alias("r")).select("r.*")


def weighted_covariance(df: DataFrame, a: str, b: str, w: str) -> DataFrame:
    """sum w^2 (a - mean a)(b - mean b) / max(1e-6, sum w - 1), means weighted."""
    r = df.agg(weighted_mean(a, w).alias("a"), weighted_mean(b, w).alias("b")).first()
    return df.agg((F.sum(F.col(w) * F.col(w) * (F.col(a) - F.lit(r["a"])) * (F.col(b) - F.lit(r["b"]))) / F.greatest(F.lit(1e-6), F.sum(w) - 1)).alias("covariance"))


def _two_sided_t(t: float, v: float) -> float:
    return incomplete_beta(v / (v + t * t), v / 2, 0.5)


def t_tests(df: DataFrame, a: str, b: str) -> dict:
    """Two-sample statistic |mean b - mean a| / sqrt((var a + var b) / n), v = 2n - 2, also with both columns
    divided by their mean first; and the real paired test."""
    d = F.col(a) - F.col(b)
    r = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.avg(d).alias("md"), F.var_samp(d).alias("vd")).first()
    n = r["n"]
    out = {"n": n}
    for name, (ma, mb, va, vb) in {"t": (r["ma"], r["mb"], r["va"], r["vb"]), "t_normalized": (1.0, 1.0, r["va"] / r["ma"] ** 2, r["vb"] / r["mb"] ** 2) if r["ma"] and r["mb"] else (0, 0, 1, 1)}.items():
        t = abs(mb - ma) / math.sqrt((va + vb) / n) if va + vb else 0.0
        out |= {name: t, f"{name}_p": _two_sided_t(t, 2 * n - 2)}
    t = r["md"] / math.sqrt(r["vd"] / n) if r["vd"] else 0.0
    return out | {"t_paired": t, "t_paired_p": _two_sided_t(t, n - 1)}


def wilcoxon_ranks(df: DataFrame, a: str, b: str, tol: float = 0.0) -> DataFrame:
    """(n, w_minus, w_plus): signed rank sums of a - b, differences up to ``tol`` dropped, ties at their
    average rank. Ranks come from counts of equal differences, so one window over distinct differences,
    in two levels, replaces a sort of all rows."""
    d = df.select((F.col(a) - F.col(b)).cast("double").alias("d")).filter(F.abs("d") > tol)
    per = d.groupBy(F.abs("d").alias("m")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    r = running(per, ["m"], {"before": F.col("c")}, inclusive=False)
    rank = F.col("before") + (F.col("c") + 1) / 2
    return r.agg(F.sum("c").alias("n"), F.coalesce(F.sum(rank * (F.col("c") - F.col("up"))), F.lit(0.0)).alias("w_minus"), F.coalesce(F.sum(rank * F.col("up")), F.lit(0.0)).alias("w_plus"))


def wilcoxon_p(n: int, w: float) -> float:
    """Two-sided, by the normal approximation."""
    mean, sd = n * (n + 1) / 4, math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return 1.0 - math.erf(abs(w - mean) / sd / math.sqrt(2)) if sd else 1.0


def significance(df: DataFrame, a: str, b: str, tol: float = 0.001) -> DataFrame:
    """One row: medians, means, deviations, how often a is less, same, greater, t tests, Wilcoxon."""
    d = F.col(a) - F.col(b)
    mid = medians(df, [a, b])
    r = df.agg(F.max(F.lit(mid[a])).alias("median_a"), F.max(F.lit(mid[b])).alias("median_b"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.stddev_samp(a).alias("dev_a"), F.stddev_samp(b).alias("dev_b"), F.count_if(d < -tol).alias("less"), F.count_if(F.abs(d) <= tol).alias("same"), F.count_if(d > tol).alias("greater")).first().asDict()
    w = wilcoxon_ranks(df, a, b, tol).first()
    n = w["n"] or 0
    r |= t_tests(df, a, b) | {"w_minus": w["w_minus"], "w_plus": w["w_plus"], "wilcoxon_p": wilcoxon_p(n, min(w["w_minus"], w["w_plus"])) if n else 1.0}
    return df.sparkSession.createDataFrame([tuple(r.values())], ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'double'}" for k, v in r.items()))


def profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, kind, n, missing, mean, dev, median, min, max, n_values, entropy, mode, mode_pct) of each column:
    one scan for all numbers, one for all nominal columns."""
    cols = cols or df.columns
    num, text = [c for c in cols if c in set(numeric(df))], [c for c in cols if c in set(nominal(df))]
    fields = "column string, kind string, n bigint, missing bigint, mean double, dev double, median double, min double, max double, n_values bigint, entropy double, mode string, mode_pct double"
    names = [x.split()[0] for x in fields.split(", ")]
    out = None
    if num:
        mid = medians(df, num)
        agg = df.agg(F.count(F.lit(1)).alias("__n"), *[e.alias(f"{c}__{k}") for c in num for k, e in (("k", F.count(c)), ("mean", F.avg(c)), ("dev", F.sqrt(variance(c))), ("median", F.max(F.lit(mid[c]).cast("double"))), ("min", F.min(c)), ("max", F.max(c)))])
        out = agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit("real").alias("kind"), F.col(f"{c}__k").alias("n"), (F.col("__n") - F.col(f"{c}__k")).alias("missing"), *[F.col(f"{c}__{k}").cast("double").alias(k) for k in ("mean", "dev", "median", "min", "max")], F.lit(None).cast("bigint").alias("n_values"), F.lit(None).cast("double").alias("entropy"), F.lit(None).cast("string").alias("mode"), F.lit(None).cast("double").alias("mode_pct")) for c in num])).alias("r")).select("r.*")
    if text:
        n = value_counts(df, text)
        c = F.col("n")
        some = F.col("value").isNotNull()
        t = n.groupBy("column").agg(F.coalesce(F.sum(F.when(some, c)), F.lit(0)).alias("k"), F.coalesce(F.sum(F.when(~some, c)), F.lit(0)).alias("missing"), F.count("value").alias("n_values"), F.sum(F.when(some, c * F.log2(c))).alias("x"), F.max(F.when(some, c)).alias("top"), F.min_by("value", F.struct(F.when(some, F.lit(0)).otherwise(F.lit(1)), -c, F.col("value"))).alias("mode"))
        none = F.lit(None).cast("double")
        t = t.select("column", F.lit("nominal").alias("kind"), F.col("k").alias("n"), "missing", *[none.alias(k) for k in ("mean", "dev", "median", "min", "max")], "n_values", F.greatest(F.log2("k") - F.col("x") / F.col("k"), F.lit(0.0)).alias("entropy"), "mode", (F.col("top") * 100 / F.col("k")).alias("mode_pct"))
        out = t.select(names) if out is None else out.select(names).union(t.select(names))
    return out


def calc_error(df: DataFrame, a: str, b: str, kind: str = "SSE") -> Column:
    """SSE, MAPE (a fraction of a) or RMSE as an aggregate; rows of null a are skipped."""
    d = F.col(a) - F.col(b)
    if kind == "SSE":
        return F.sum(d * d)
    if kind == "RMSE":
        return F.sqrt(F.avg(d * d))
    if kind == "MAPE":
        return F.avg(F.abs(F.try_divide(d, F.col(a))))
    raise ValueError(kind)


def histogram(df: DataFrame, col: str, bins: int | None = None, group: list[str] | None = None) -> DataFrame:
    """(bin, lo, hi, n, likelihood): equal bins over median +- 4 deviations clipped to the range; by default
    floor(sqrt n) of them, at least 1. Values outside are left out."""
    mid = medians(df, [col])[col]
    r = df.agg(F.count(col).alias("n"), F.max(F.lit(mid)).alias("m"), F.stddev_samp(col).alias("d"), F.min(col).alias("a"), F.max(col).alias("z")).first()
    if not r["n"]:
        return df.sparkSession.createDataFrame([], "bin bigint, lo double, hi double, n bigint, likelihood double")
    d = r["d"] or 0.0
    lo, hi = max(r["a"], r["m"] - 4 * d), min(r["z"], r["m"] + 4 * d)
    k = bins or max(1, math.floor(math.sqrt(r["n"])))
    width = (hi - lo) / k or 1.0
    x = df.filter(F.col(col).between(lo, hi)).select(F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(k - 1)).cast("bigint").alias("bin"))
    return x.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).select("bin", (F.lit(lo) + F.col("bin") * width).alias("lo"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("hi"), "n", (F.col("n") / F.lit(r["n"] * width)).alias("likelihood"))


def nominal_histogram(df: DataFrame, col: str) -> DataFrame:
    n = df.filter(F.col(col).isNotNull()).count()
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg((F.count(F.lit(1)) / F.lit(float(max(1, n)))).alias("share"))


def knn_density(values: np.ndarray, laplace: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(x, density) of a short series: k / ((x[i+k] - x[i] + laplace) n) with k = max(5, n / 5)."""
    x = np.sort(values[~np.isnan(values)])
    n = len(x)
    k = max(5, n // 5)
    if n <= k:
        return np.empty(0), np.empty(0)
    width = x[k:] - x[:-k] + laplace
    return (x[k:] + x[:-k]) / 2, k / (np.maximum(width, 1e-300) * n)


def meta_features(df: DataFrame, label: str) -> DataFrame:
    """One row of what describes a learning problem: log sizes, arity, shares of kinds, missing, label entropy."""
    feats = [c for c in df.columns if c != label]
    num, text = [c for c in feats if c in set(numeric(df))], [c for c in feats if c in set(nominal(df))]
    p = {r["column"]: r for r in profile(df, feats + [label]).collect()}
    n = max(1, p[label]["n"] + p[label]["missing"])
    arity = [p[c]["n_values"] for c in text]
    ranges = [p[c]["max"] - p[c]["min"] for c in num if p[c]["max"] is not None]
    row = {"log_rows": math.log(n), "log_columns": math.log(max(1, len(feats))), "log_rows_per_column": math.log(n / max(1, len(feats))), "portion_real": len(num) / max(1, len(feats)), "portion_nominal": len(text) / max(1, len(feats)), "mean_arity": float(np.mean(arity)) if arity else 0.0, "max_arity": float(max(arity, default=0)), "range_deviation": float(np.std(ranges)) if ranges else 0.0, "any_missing": float(any(p[c]["missing"] for c in feats)), "portion_missing": sum(p[c]["missing"] for c in feats) / (n * max(1, len(feats))), "label_entropy": p[label]["entropy"] or 0.0, "label_top_share": (p[label]["mode_pct"] or 0.0) / 100}
    return df.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))


def bounding_sphere(df: DataFrame, cols: list[str], rounds: int = 64) -> tuple[list[float], float]:
    """An approximate smallest enclosing ball: the centre steps towards the farthest row, 1/(i+1) of the way.
    Each round is one aggregation whose result is one row."""
    first = df.select(cols).first()
    c = np.array([float(x) for x in first])
    dist = lambda p: sum((F.pow(F.col(k) - F.lit(float(v)), 2) for k, v in zip(cols, p)), F.lit(0.0))
    for i in range(1, rounds + 1):
        far = df.agg(F.max_by(F.array(*[F.col(k).cast("double") for k in cols]), F.struct(dist(c), *cols)).alias("p")).first()["p"]
        c = c + (np.array(far) - c) / (i + 1)
    r = df.agg(F.sqrt(F.max(dist(c))).alias("r")).first()["r"]
    return c.tolist(), r


def decayed_covariance(df: DataFrame, keys: list[str], cols: list[str], decay: float) -> DataFrame:
    """Covariance with history multiplied by ``decay`` at each row: row i of n weighs decay^(n - 1 - i). Counts
    and sums are kept by pair over complete pairs; n/(n-1) (E[xy] - E[x] E[y])."""
    rows = with_row_id(df, keys, "__i")
    n = rows.agg(F.max("__i").alias("m")).first()["m"]
    w = F.pow(F.lit(decay), F.lit(n) - F.col("__i"))
    pairs = [(x, y) for i, x in enumerate(cols) for y in cols[i:]]
    out = []
    for x, y in pairs:
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        k, sx, sy, sxy = (F.sum(F.when(both, w * v)) for v in (F.lit(1.0), F.col(x), F.col(y), F.col(x) * F.col(y)))
        out.append((k / (k - 1) * (sxy / k - sx / k * (sy / k))).alias(f"{x}__{y}"))
    r = rows.agg(*out)
    return r.select(F.explode(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"{x}__{y}").alias("covariance")) for x, y in pairs])).alias("r")).select("r.*")


def mixture_of_gaussians(df: DataFrame, col: str, k: int, seed: int = 0, iterations: int = 100):
    """Kernels (weight, mean, variance) of a one-dimensional mixture by EM."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    m = GaussianMixture(k=k, seed=seed, maxIter=iterations).fit(VectorAssembler(inputCols=[col], outputCol="features", handleInvalid="skip").transform(df))
    return [(w, float(g.mean[0]), float(g.cov.toArray()[0, 0])) for w, g in zip(m.weights, m.gaussians)]


def average_rank(df: DataFrame, group: list[str], col: str) -> DataFrame:
    """Rank of each row's value in its group, ties at their mean."""
    w = Window.partitionBy(*group).orderBy(col)
    tie = Window.partitionBy(*group, col)
    return df.withColumn("average_rank", F.rank().over(w) + (F.count(F.lit(1)).over(tie) - 1) / 2)
