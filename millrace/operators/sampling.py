"""Sorting, limits, sampling, splits and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import numeric
from .ordering import with_row_id
from .stats import baseline


def sort_column(df: DataFrame, col: str, descending: bool = False) -> DataFrame:
    """Nulls first ascending, last descending."""
    return df.orderBy(F.col(col).desc_nulls_last() if descending else F.col(col).asc_nulls_first())


def nth_element(df: DataFrame, col: str, k: int) -> DataFrame:
    """The value of rank k (from 0)."""
    return with_row_id(df.select(col), [col], "__i").filter(F.col("__i") == k).select(col)


def reverse_rows(df: DataFrame, keys: list[str], name: str = "row_id") -> DataFrame:
    """Rows with their position from the end."""
    x = with_row_id(df, keys, name)
    n = x.count()
    return x.withColumn(name, F.lit(n - 1) - F.col(name))


def shuffle(df: DataFrame, keys: list[str], seed: int = 0, name: str = "row_id") -> DataFrame:
    """Rows with a position of a pseudorandom permutation; reruns agree."""
    x = df.withColumn("__h", F.xxhash64(*keys, F.lit(seed)))
    return with_row_id(x, ["__h", *keys], name).drop("__h")


def sample_rows(df: DataFrame, p: float, seed: int = 0) -> DataFrame:
    return df.sample(withReplacement=False, fraction=p, seed=seed)


def every_nth(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows n - 1, 2n - 1, ... in the order of the keys."""
    return with_row_id(df, keys, "__i").filter((F.col("__i") + 1) % n == 0).drop("__i")


def split(df: DataFrame, keys: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    """The first n rows, and the rest."""
    x = with_row_id(df, keys, "__i")
    return x.filter(F.col("__i") < n).drop("__i"), x.filter(F.col("__i") >= n).drop("__i")


def split_fold(df: DataFrame, keys: list[str], i: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(train, test): rows [n i / k, n (i + 1) / k) are the test fold."""
    x = with_row_id(df, keys, "__i")
    n = x.count()
    test = (F.col("__i") >= n * i // k) & (F.col("__i") < n * (i + 1) // k)
    return x.filter(~test).drop("__i"), x.filter(test).drop("__i")


def with_fold(df: DataFrame, keys: list[str], k: int, name: str = "fold") -> DataFrame:
    """The contiguous fold of each row: the i with n i / k <= position < n (i + 1) / k."""
    x = with_row_id(df, keys, "__i")
    n = x.count()
    ends = [n * (i + 1) // k for i in range(k)]
    fold = F.lit(k - 1)
    for i in range(k - 2, -1, -1):
        fold = F.when(F.col("__i") < ends[i], F.lit(i)).otherwise(fold)
    return x.withColumn(name, fold).drop("__i")


def split_class(df: DataFrame, col: str, drop: bool = False, limit: int = 10_000) -> dict:
    """A table for each value of a column, null first; more than ``limit`` values are refused. Each table is a filter
    of its own: to write all of them in one scan, take ``write_classes``."""
    values = [r[0] for r in df.select(col).distinct().limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"more than {limit} values; write_classes takes any number")
    values.sort(key=lambda v: (v is not None, v if v is not None else 0))
    return {v: (lambda x: x.drop(col) if drop else x)(df.filter(F.col(col).eqNullSafe(F.lit(v)))) for v in values}


def write_classes(df: DataFrame, col: str, path: str) -> None:
    """A folder of Parquet files for each value of a column, in one scan; rows of a large class stay spread."""
    df.write.mode("overwrite").partitionBy(col).parquet(path)


def split_value(df: DataFrame, col: str, v: float) -> tuple[DataFrame, DataFrame]:
    """Rows below v and rows of at least v; nulls go to the larger side (the first if equal)."""
    r = df.agg(F.count_if(F.col(col) < v).alias("a"), F.count_if(F.col(col) >= v).alias("b")).first()
    low, high = F.col(col) < v, F.col(col) >= v
    null = F.col(col).isNull()
    return (df.filter(low | null), df.filter(high)) if r["a"] >= r["b"] else (df.filter(low), df.filter(high | null))


def split_category(df: DataFrame, col: str, value: str) -> tuple[DataFrame, DataFrame]:
    same = F.coalesce(F.col(col) == value, F.lit(False))
    return df.filter(same), df.filter(~same)


def bootstrap(df: DataFrame, fraction: float = 1.0, seed: int = 0) -> DataFrame:
    return df.sample(withReplacement=True, fraction=fraction, seed=seed)


def fill_missing(df: DataFrame, cols: list[str] | None = None, random: bool = False, seed: int = 0) -> DataFrame:
    """Nulls become the mean or the commonest value, or the value of a random row that has one: present values are
    numbered, and each null meets one by a drawn number. A column without values stays as it is."""
    cols = cols or df.columns
    num = set(numeric(df))
    if not random:
        b = {r["column"]: r["mean"] if r["column"] in num else r["mode"] for r in baseline(df, cols).collect()}
        return df.withColumns({c: F.coalesce(F.col(c).cast("double") if c in num else F.col(c), F.lit(b.get(c))) for c in cols})
    out = df
    for i, c in enumerate(cols):
        there = with_row_id(df.filter(F.col(c).isNotNull()).select(F.col(c).alias("__v")), ["__v"], "__p")
        n = there.count()
        if n:
            null = out.filter(F.col(c).isNull()).withColumn("__p", F.floor(F.rand(seed + i) * n))
            null = null.join(there, "__p").select([F.col("__v").alias(c) if k == c else F.col(k) for k in df.columns])
            out = out.filter(F.col(c).isNotNull()).unionByName(null)
    return out
