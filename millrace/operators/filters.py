"""Filters and predicates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import with_row_id


def _inside(col: str, lo: float, hi: float) -> Column:
    return F.coalesce(F.col(col).between(lo, hi), F.lit(False))


def filter_rows(df: DataFrame, col: str, lo: float, hi: float, invert: bool = False) -> DataFrame:
    """Rows inside [lo, hi]; nulls go. Inverted: rows outside, and nulls stay."""
    keep = _inside(col, lo, hi)
    return df.filter(~keep if invert else keep)


def filter_elements(df: DataFrame, col: str, lo: float, hi: float, invert: bool = False) -> DataFrame:
    """Cells outside [lo, hi] (inverted: inside) become null."""
    keep = _inside(col, lo, hi)
    return df.withColumn(col, F.when(~keep if invert else keep, F.col(col)))


def drop_missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=cols)


def first_rows(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    return df.orderBy(*keys).limit(n)


def unique(df: DataFrame, col: str, keys: list[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each value."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c != col]
    row = F.struct(*[F.col(c) for c in rest])
    got = df.groupBy(col).agg(pick(row, F.struct(*keys)).alias("__r"))
    return got.select(*[F.col(col) if c == col else F.col(f"__r.{c}") for c in df.columns])


def duplicate_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of two or more values, with all values sorted."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(value)).alias("values")).filter("n >= 2")


def thin(df: DataFrame, group: list[str], order: str, col: str, gap: float, keys: list[str] | None = None) -> DataFrame:
    """Sequential thinning inside each group: keep the first row, then each whose value is at least ``gap``
    above the last one kept. Rows of a null value are dropped. Rows stream through sorted partitions, so a
    group is never held as a whole."""
    names = df.columns
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.filter(F.col(col).isNotNull()).withColumn("__x", F.col(col).cast("double")).repartition(parts, *group).sortWithinPartitions(*group, order, *(keys or []))
    at = [names.index(g) for g in group]

    def run(batches):
        now, last = None, None
        for b in batches:
            x = b.column(len(names)).to_numpy()
            ids = list(zip(*(b.column(i).to_pylist() for i in at)))
            keep = np.zeros(len(x), bool)
            for i, (g, v) in enumerate(zip(ids, x)):
                if g != now or v - last >= gap:
                    keep[i], now, last = True, g, v
            yield b.filter(pa.array(keep)).select(names)

    return rows.mapInArrow(run, df.schema)


def drop_random_values(df: DataFrame, p: float, keys: list[str], cols: list[str], seed: int = 0) -> DataFrame:
    """Blank exactly floor(p x cells) of the cells: those of the smallest hashes of (row, column, seed), found by their
    positions in ranges of the hash."""
    rows = with_row_id(df, keys, "__i")
    k = int(p * rows.count() * len(cols))
    long = rows.select("__i", F.explode(F.array(*[F.lit(c) for c in cols])).alias("c")).withColumn("h", F.xxhash64("__i", "c", F.lit(seed)))
    gone = with_row_id(long, ["h", "__i", "c"], "__p").filter(F.col("__p") < k).groupBy("__i").agg(F.collect_set("c").alias("gone"))
    out = rows.join(gone, "__i", "left")
    return out.select([F.when(~F.coalesce(F.array_contains("gone", c), F.lit(False)), F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def rank_in(df: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k).drop("__k")

