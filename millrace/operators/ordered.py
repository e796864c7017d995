"""Operators over the order of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running, with_row_id


def cumulative(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Columns replaced by their running sums in the order of the keys; null adds nothing."""
    out = running(df, keys, {f"__c_{c}": F.col(c) for c in cols})
    return out.select([F.col(f"__c_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def autocovariance(df: DataFrame, keys: list[str], col: str, lags: int | None = None, normalized: bool = False) -> DataFrame:
    """(lag, value): mean of (x[i] - m)(x[i + lag] - m) over the n - lag pairs, for lags 1 to min(256, n / 2);
    divided by the variance on request. Positions are dealt in blocks that also get the first rows of the next block;
    a block's sums are made at once, so a row moves once and no task holds the series."""
    x = with_row_id(df.select(*dict.fromkeys([*keys, col])), keys, "__i").select(F.col("__i").alias("i"), F.col(col).cast("double").alias("x"))
    r = x.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")).first()
    top = min(256, r["n"] // 2) if lags is None else min(lags, r["n"] - 1)
    if top < 1:
        return df.sparkSession.createDataFrame([], "lag int, value double")
    size = max(65_536, 4 * top)
    block, inner = F.floor(F.col("i") / size).cast("bigint"), F.col("i") % size
    own, ahead = F.array(block), F.array(block, block - 1)
    rows = x.select("i", (F.col("x") - F.lit(r["m"])).alias("d"), F.explode(F.when((inner < top) & (block > 0), ahead).otherwise(own)).alias("block"))

    def sums(key, pdf):
        i = pdf["i"].to_numpy() - key[0] * size
        d, some = np.zeros(size + top), np.zeros(size + top)
        v = pdf["d"].to_numpy(dtype=float)
        d[i], some[i] = np.nan_to_num(v), ~np.isnan(v)
        lag = np.arange(1, top + 1)
        return pd.DataFrame({"lag": lag, "s": [d[:size] @ d[k : size + k] for k in lag], "n": [some[:size] @ some[k : size + k] for k in lag]})

    parts = rows.groupBy("block").applyInPandas(sums, "lag int, s double, n double")
    got = parts.groupBy("lag").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("value"))
    return got.withColumn("value", F.col("value") / F.lit(r["v"])) if normalized else got


def decayed_mean(df: DataFrame, keys: list[str], col: str, decay: float, group: list[str] | None = None) -> DataFrame:
    """Mean weighted by decay^age, the last row of age 0."""
    if group:
        age = F.row_number().over(Window.partitionBy(*group).orderBy(*[F.col(k).desc() for k in keys])) - 1
        x = df.withColumn("__age", age)
    else:
        x = with_row_id(df, keys, "__i")
        n = x.agg(F.max("__i").alias("m")).first()["m"]
        x = x.withColumn("__age", F.lit(n) - F.col("__i"))
    w = F.when(F.col(col).isNotNull(), F.pow(F.lit(decay), F.col("__age")))
    return x.groupBy(*(group or [])).agg((F.sum(w * F.col(col)) / F.sum(w)).alias("decayed_mean"))
