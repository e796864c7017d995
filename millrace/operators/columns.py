"""Projections and column operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import with_row_id


def parse_columns(df: DataFrame, spec: str) -> list[str]:
    """Column names of a list such as ``0,2-5,*0``: zero-based, ``*k`` counts from the right, ``5-2`` runs
    backwards. A repeated or unknown column is an error."""
    n = len(df.columns)

    def one(s: str) -> int:
        i = n - 1 - int(s[1:]) if s.startswith("*") else int(s)
        if not 0 <= i < n:
            raise ValueError(f"no column {s}")
        return i

    out: list[int] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        ends = part.split("-")
        if len(ends) == 1:
            out.append(one(part))
        else:
            a, z = one(ends[0]), one(ends[1])
            out += list(range(a, z + 1) if a <= z else range(a, z - 1, -1))
    if len(set(out)) != len(out):
        raise ValueError("a column is listed twice")
    return [df.columns[i] for i in out]


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def nominal(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def keep_only_columns(df: DataFrame, spec: str) -> DataFrame:
    wanted = set(parse_columns(df, spec))
    if not wanted:
        raise ValueError("no column is kept")
    return df.select([c for c in df.columns if c in wanted])


def drop_columns(df: DataFrame, spec: str) -> DataFrame:
    return df.drop(*parse_columns(df, spec))


def reorder_columns(df: DataFrame, spec: str) -> DataFrame:
    return df.select(parse_columns(df, spec))


def swap_columns(df: DataFrame, a: int, b: int) -> DataFrame:
    c = list(df.columns)
    c[a], c[b] = c[b], c[a]
    return df.select(c)


def drop_homogeneous(df: DataFrame) -> DataFrame:
    """Drop columns of at most one distinct non-null value. One scan finds them."""
    r = df.agg(*[F.min(c).alias(f"a{i}") for i, c in enumerate(df.columns)], *[F.max(c).alias(f"z{i}") for i, c in enumerate(df.columns)]).first()
    return df.select([c for i, c in enumerate(df.columns) if r[f"a{i}"] != r[f"z{i}"]])


def add_index(df: DataFrame, keys: list[str], start: float = 0, increment: float = 1, name: str = "index") -> DataFrame:
    rows = with_row_id(df, keys, "__i")
    return rows.select((F.lit(start) + F.col("__i") * F.lit(increment)).alias(name), *df.columns)


def add_category(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.select(F.lit(value).alias(name), *df.columns)


def _over(df: DataFrame, cols: list[str], f) -> DataFrame:
    return df.select([f(F.col(c)).alias(c) if c in set(cols) else F.col(c) for c in df.columns])


def scale(df: DataFrame, cols: list[str], k: float) -> DataFrame:
    return _over(df, cols, lambda c: c * F.lit(k))


def shift(df: DataFrame, cols: list[str], k: float) -> DataFrame:
    return _over(df, cols, lambda c: c + F.lit(k))


def power(df: DataFrame, cols: list[str], e: float) -> DataFrame:
    return _over(df, cols, lambda c: F.pow(c, F.lit(e)))


def multiply_scalar(df: DataFrame, k: float) -> DataFrame:
    return scale(df, numeric(df), k)


def threshold(df: DataFrame, col: str, v: float, null_as_zero: bool = False) -> DataFrame:
    """1 above v, 0 up to v; null stays null unless ``null_as_zero``."""
    c = F.col(col)
    t = F.when(c <= v, F.lit(0.0)).when(c > v, F.lit(1.0))
    return df.withColumn(col, F.coalesce(t, F.lit(0.0)) if null_as_zero else t)


def _bounds(df: DataFrame, cols: list[str]) -> dict[str, tuple]:
    r = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("a", F.min), ("z", F.max))], F.count(F.lit(1)).alias("n")).first()
    return {c: (r[f"a{i}"], r[f"z{i}"]) for i, c in enumerate(cols)} | {"": (r["n"], None)}


def discretize(df: DataFrame, cols: list[str], buckets: int | None = None) -> DataFrame:
    """Equal-width buckets 0..n-1 between minimum and maximum; by default max(2, floor(sqrt(rows + 0.5)))
    of them. Null stays null, a constant column is bucket 0."""
    b = _bounds(df, cols)
    n = buckets or max(2, math.floor(math.sqrt(b[""][0] + 0.5)))

    def cut(name: str) -> Column:
        lo, hi = b[name]
        if lo is None or hi == lo:
            return F.when(F.col(name).isNotNull(), F.lit(0.0))
        x = F.floor((F.col(name) - F.lit(lo)) * F.lit(float(n)) / F.lit(hi - lo)).cast("double")
        return F.when(F.col(name).isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(float(n - 1))))

    return df.withColumns({c: cut(c) for c in cols})


def normalize(df: DataFrame, lo: float = 0.0, hi: float = 1.0, cols: list[str] | None = None) -> DataFrame:
    """Min-max to [lo, hi]; a range under 1e-12 counts as 1."""
    cols = numeric(df) if cols is None else cols
    b = _bounds(df, cols)

    def f(c: str) -> Column:
        a, z = b[c]
        if a is None:
            return F.col(c).cast("double")
        width = z - a if z - a >= 1e-12 else 1.0
        return (F.col(c) - F.lit(a)) * F.lit((hi - lo) / width) + F.lit(lo)

    return df.withColumns({c: f(c) for c in cols})


def normalize_magnitude(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Each row to unit L2 length; a zero row gives nulls."""
    cols = cols or numeric(df)
    m = F.sqrt(sum((F.coalesce(F.col(c), F.lit(0)) * F.coalesce(F.col(c), F.lit(0)) for c in cols), F.lit(0.0)))
    return df.withColumn("__m", m).withColumns({c: F.try_divide(F.col(c).cast("double"), F.col("__m")) for c in cols}).drop("__m")


def zero_mean(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or numeric(df)
    r = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return df.withColumns({c: F.col(c) - F.lit(r[f"m{i}"]) for i, c in enumerate(cols)})


def center(df: DataFrame, keys: list[str], row: int, cols: list[str] | None = None) -> DataFrame:
    """Subtract the row at a position from all rows."""
    cols = cols or [c for c in numeric(df) if c not in keys]
    rows = with_row_id(df, keys, "__i")
    r = rows.filter(F.col("__i") == row).select(cols).first()
    if r is None:
        raise ValueError(f"no row {row}")
    return df.withColumns({c: F.col(c) - F.lit(r[c]) for c in cols})


def rotate(df: DataFrame, x: str, y: str, degrees: float) -> DataFrame:
    a = math.radians(degrees)
    c, s = F.lit(math.cos(a)), F.lit(math.sin(a))
    return df.withColumns({x: F.col(x) * c - F.col(y) * s, y: F.col(x) * s + F.col(y) * c})


def geodistance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance by the haversine formula; null if any part is null."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def one_hot(df: DataFrame, cols: list[str], max_values: int = 12, lo: float = 0.0, hi: float = 1.0, keep_nulls: bool = False) -> DataFrame:
    """Nominal columns to numbers: one value is ``lo``, two are 0/1 (null: the middle), up to max_values a
    column each (null: the mean share), more the rank of the value. Values rank by text."""
    out = []
    values = {c: sorted(r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().limit(100_001).collect()) for c in cols}
    for c in df.columns:
        v = values.get(c)
        x = F.col(c)
        if v is None or not v:
            out.append(x)
        elif len(v) == 1:
            out.append(F.lit(lo).alias(c))
        elif len(v) == 2:
            mid = F.lit(None) if keep_nulls else F.lit((lo + hi) / 2)
            out.append(F.when(x == v[0], F.lit(lo)).when(x == v[1], F.lit(hi)).otherwise(mid).cast("double").alias(c))
        elif len(v) < max_values:
            gap = F.lit(None).cast("double") if keep_nulls else F.lit((hi - lo) / len(v) + lo)
            out += [F.when(x.isNull(), gap).when(x == k, F.lit(hi)).otherwise(F.lit(lo)).alias(f"{c}_{k}") for k in v]
        else:
            codes = F.create_map(*[y for i, k in enumerate(v) for y in (F.lit(k), F.lit(float(i)))])
            out.append(codes[x].alias(c))
    return df.select(out)


def enumerate_values(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """The rank of each value by its first appearance in the order of the keys."""
    rows = with_row_id(df, keys, "__i")
    first = with_row_id(rows.groupBy(col).agg(F.min("__i").alias("__at")), ["__at"], "__code")
    out = rows.alias("r").join(first.alias("f"), F.col(f"r.{col}").eqNullSafe(F.col(f"f.{col}")))
    return out.select([F.col("f.__code").cast("double").alias(c) if c == col else F.col(f"r.{c}") for c in df.columns])


def obfuscate(df: DataFrame) -> DataFrame:
    """Columns named attr0, attr1, ..., nominal values replaced by their rank."""
    named = one_hot(df, nominal(df), max_values=0) if nominal(df) else df
    return named.toDF(*[f"attr{i}" for i in range(len(named.columns))])


def used_values(df: DataFrame, col: str, limit: int = 1_000_000) -> list:
    """The values a nominal column really has, ascending; more than ``limit`` are refused."""
    values = [r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"more than {limit} values")
    return sorted(values)


def add_noise(df: DataFrame, dev: float, seed: int = 0, exclude_last: int = 0) -> DataFrame:
    cols = [c for c in (df.columns[:-exclude_last] if exclude_last else df.columns) if c in set(numeric(df))]
    return df.withColumns({c: F.col(c) + F.lit(dev) * F.randn(seed + i) for i, c in enumerate(cols)})


def transpose(df: DataFrame, keys: list[str], cols: list[str], limit: int = 2000) -> DataFrame:
    """Rows to columns c0, c1, ... in the order of the keys; for tables of up to ``limit`` rows."""
    rows = with_row_id(df, keys, "__i")
    n = rows.count()
    if n > limit:
        raise ValueError(f"{n} rows would become columns; the limit is {limit}")
    long = rows.unpivot("__i", cols, "column", "value")
    return long.groupBy("column").pivot("__i", list(range(n))).agg(F.first("value")).toDF("column", *[f"c{i}" for i in range(n)])
