"""Row order. Rows of a DataFrame have none, so each order-dependent operator names a key.

Positions and running sums are made in two levels: rows go to ranges of the first key, are ordered
inside their range, and get the totals of the ranges before it. No task ever holds the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "__bucket"


def as_number(df: DataFrame, key: str) -> Column:
    """A monotone number for the values of a column, to cut ranges with."""
    kind = df.schema[key].dataType
    if isinstance(kind, T.NumericType):
        return F.col(key).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(key).cast("timestamp").cast("double")
    if isinstance(kind, T.BooleanType):
        return F.col(key).cast("int").cast("double")
    head = F.rpad(F.hex(F.substring(F.encode(F.col(key).cast("string"), "UTF-8"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def with_bucket(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Adds the ordinal of the key's range; nulls are in range 0, before all others."""
    n = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = as_number(df, key)
    cuts: list[float] = []
    if n > 1:
        got = df.agg(F.percentile_approx(x, [i / n for i in range(1, n)], 10_000).alias("b")).first()["b"]
        cuts = sorted(set(got or []))

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x <= F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return df.withColumn(BUCKET, F.when(x.isNull(), F.lit(0)).otherwise(tree(0, len(cuts))).cast("int"))


def _orders(keys: list[str]) -> list[Column]:
    return [F.col(k).asc_nulls_first() for k in keys]


def running(df: DataFrame, keys: list[str], sums: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """Adds for each name the running sum of its column over the order of the keys; null adds nothing."""
    rows = with_bucket(df, keys[0])
    names = {n: f"__v{i}" for i, n in enumerate(sums)}
    rows = rows.withColumns({names[n]: F.coalesce(c.cast("double") if not _whole(df, c) else c.cast("bigint"), F.lit(0)) for n, c in sums.items()})
    w = Window.partitionBy(BUCKET).orderBy(*_orders(keys)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    totals = rows.groupBy(BUCKET).agg(*[F.sum(v).alias(v) for v in names.values()])
    over = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    before = totals.select(BUCKET, *[F.coalesce(F.sum(v).over(over), F.lit(0)).alias(f"{v}b") for v in names.values()])
    out = rows.withColumns({f"{v}w": F.coalesce(F.sum(v).over(w), F.lit(0)) for v in names.values()}).join(F.broadcast(before), BUCKET)
    return out.select(*df.columns, *[(F.col(f"{v}w") + F.col(f"{v}b")).alias(n) for n, v in names.items()])


def _whole(df: DataFrame, c: Column) -> bool:
    return isinstance(df.select(c).schema[0].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def with_row_id(df: DataFrame, keys: list[str], name: str = "row_id") -> DataFrame:
    """Adds 0, 1, 2, ... in the order of the keys (nulls first); equal keys in any order."""
    return running(df, keys, {name: F.lit(1)}, inclusive=False)


def medians(df: DataFrame, cols: list[str], most: int = 100_000) -> dict[str, float | None]:
    """The exact median of each column, null without values. Approximate quantiles around the middle bound it in one
    scan, a second counts what lies below and between. What lies between is gathered in a third if it is at most ``most``
    values a column, else found by positions over its distinct values."""
    x = df.select([F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    names = x.columns
    r = x.agg(*[F.count(c).alias(f"{c}n") for c in names], *[F.percentile_approx(c, [0.4995, 0.5005], 10_000).alias(f"{c}q") for c in names]).first()
    n = {c: r[f"{c}n"] for c in names}
    bounds = {c: tuple(r[f"{c}q"]) for c in names if n[c]}
    if not bounds:
        return dict.fromkeys(cols)
    between = {c: F.col(c).between(F.lit(a), F.lit(z)) for c, (a, z) in bounds.items()}
    r = x.agg(*[F.count_if(F.col(c) < F.lit(a)).alias(f"{c}b") for c, (a, _) in bounds.items()], *[F.count_if(between[c]).alias(f"{c}m") for c in bounds]).first()
    below, inside = {c: r[f"{c}b"] for c in bounds}, {c: r[f"{c}m"] for c in bounds}
    middle = {c: ((n[c] - 1) // 2, n[c] // 2) for c in bounds}
    hit = {c: below[c] <= middle[c][0] and middle[c][1] < below[c] + inside[c] for c in bounds}
    got = {c: bounds[c][0] for c in bounds if hit[c] and bounds[c][0] == bounds[c][1]}
    few = [c for c in bounds if c not in got and hit[c] and inside[c] <= most]
    if few:
        r = x.agg(*[F.sort_array(F.collect_list(F.when(between[c], F.col(c)))).alias(c) for c in few]).first()
        got |= {c: (r[c][middle[c][0] - below[c]] + r[c][middle[c][1] - below[c]]) / 2 for c in few}
    for c in bounds:
        if c not in got:
            k = [m - (below[c] if hit[c] else 0) for m in middle[c]]
            per = x.filter(between[c] if hit[c] else F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("k"))
            at = running(per, ["v"], {"before": F.col("k")}, inclusive=False)
            holds = [F.max(F.when((F.col("before") <= i) & (F.lit(i) < F.col("before") + F.col("k")), F.col("v"))) for i in k]
            a, z = at.agg(holds[0].alias("a"), holds[1].alias("z")).first()
            got[c] = (a + z) / 2
    return {c: got.get(f"c{i}") for i, c in enumerate(cols)}


def with_neighbour(df: DataFrame, keys: list[str], values: dict[str, str], offset: int = 1) -> DataFrame:
    """Adds for each new name the value of a column ``offset`` rows later (earlier if negative); by a join
    on the position, so the whole order needs no single task."""
    rid = "__rid"
    rows = with_row_id(df, keys, rid)
    other = rows.select((F.col(rid) - offset).alias(rid), *[F.col(c).alias(n) for n, c in values.items()])
    return rows.join(other, rid, "left").drop(rid)
