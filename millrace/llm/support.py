"""What the operators share: scratch tables in the cluster's shared folder, ordering and prefix sums."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fallback only for sessions without spark.checkpoint.dir (tests on one machine).
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines see: spark.checkpoint.dir, else one folder of our own for local tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut lineage: write to the shared folder and read back; survives the loss of any executor."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: Tables that results still read; they go when the process ends.
_later: dict[str, list[str]] = {}


def later(spark: SparkSession, path: str) -> None:
    """Delete a table when the process ends, if its session still runs then."""
    app = spark.sparkContext.applicationId
    if app not in _later:
        _later[app] = []

        def clean():
            sc = spark.sparkContext
            if sc._jsc is not None and sc.applicationId == app:
                for p in _later[app]:
                    delete(spark, p)

        atexit.register(clean)
    _later[app].append(path)


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``written``, for a table that the result reads: it goes when the process ends."""
    out, path = written(df, name)
    later(df.sparkSession, path)
    return out, path


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python workers ``rows`` at a time, unless the session asks for fewer: a batch of long
    documents then takes some MB, not hundreds."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= rows:
        spark.conf.set(name, str(rows))


class Scratch:
    """Tables that live as long as the with-block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out, path = written(df, name)
        self.paths.append(path)
        return out

    def drop_all(self) -> None:
        for p in self.paths:
            delete(self.spark, p)
        self.paths = []


@contextmanager
def scratch(spark: SparkSession):
    s = Scratch(spark)
    try:
        yield s
    finally:
        s.drop_all()


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending cut points of an integer key; needs one pass over that column only."""
    got = df.agg(F.percentile_approx(F.col(key).cast("bigint"), [i / n for i in range(1, n)], 10_000).alias("b")).first() if n > 1 else None
    return sorted(set(got["b"])) if got and got["b"] else []


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """Ordinal of the range that holds the key: how many bounds lie strictly below it, by binary search;
    null is in the lowest."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key <= F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(key.isNull(), F.lit(0)).otherwise(tree(0, len(bounds))).cast("int")


def prefix_sum(df: DataFrame, group: list[str], order: str, value: str, out: str, parts: int | None = None, ties: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over rows of the group that come before (order, ties).

    Two levels, so that no task takes a whole group: rows go to (group, range of the key); the
    subtotals of those ranges are summed up in a window over groups x ranges rows only.
    """
    spark = df.sparkSession
    bounds = range_bounds(df, order, parts or shuffle_partitions(spark))
    b, before = "__bucket", "__before"
    rows = df.withColumn(b, bucket_of(F.col(order), bounds))
    within = Window.partitionBy(*group, b).orderBy(F.col(order).asc_nulls_first(), *(ties or [])).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)))
    sums = df.withColumn(b, bucket_of(F.col(order), bounds)).groupBy(*group, b).agg(F.sum(value).alias("__sub"))
    over = Window.partitionBy(*group).orderBy(b) if group else Window.orderBy(b)
    sums = sums.select(*group, b, F.coalesce(F.sum("__sub").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    on = [rows[b] == sums[b], *[rows[g].eqNullSafe(sums[g]) for g in group]]
    joined = rows.join(sums, on)
    return joined.select(*[rows[c] for c in rows.columns if c not in (b, out)], (rows[out] + sums[before]).alias(out))
