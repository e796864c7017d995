"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import support

_CHUNK = 2_000_000


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n members' component under links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links u-v as links of each node to the smallest of its component."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    at = at.ravel()
    root = nodes[forest(len(nodes), at[: len(u)], at[len(u) :])]
    own = root != nodes
    return nodes[own], root[own]


def _contract(batches):
    """The links of a task, some millions at a time, as stars."""
    us, vs, n = [], [], 0
    for b in batches:
        us.append(b.column(0).to_numpy(zero_copy_only=False))
        vs.append(b.column(1).to_numpy(zero_copy_only=False))
        n += b.num_rows
        if n >= _CHUNK:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(np.concatenate(us), np.concatenate(vs))], ["u", "v"])
            us, vs, n = [], [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(np.concatenate(us), np.concatenate(vs))], ["u", "v"])


def components(links: DataFrame, a: str = "a", b: str = "b", last: int = 1_000_000, max_rounds: int = 60) -> DataFrame:
    """links (a, b: bigint, any order, repeats and loops allowed) -> node, component for every node with a
    link to another: component is the smallest node reachable. Links with a null end count for nothing.

    Each task first turns its own links into stars. While more than ``last`` links are left, a round ties
    every node to the least neighbour of its neighbours (large star), then to its own least one (small
    star): grouped minima and joins of one row a node, so a hub is split by the skew join; the link table
    never grows and is written to the shared folder after each round. Up to ``last`` links (16 MB at most)
    are settled by one task.
    """
    spark = links.sparkSession
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")  # of a null and an end both are that end
    e, path = support.written(e.mapInArrow(_contract, "u bigint, v bigint"), "edges")
    for _ in range(max_rounds):
        if e.count() <= last:
            out, done = support.kept(e.coalesce(1).mapInArrow(_contract, "u bigint, v bigint"), "stars")
            support.delete(spark, path)
            e = out
            break
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        large = e.join(low.withColumnRenamed("u", "w"), e["v"] == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v")
        new, at = support.written(small.mapInArrow(_contract, "u bigint, v bigint").distinct(), "edges")
        support.delete(spark, path)
        e, path = new, at
        ends = e.select(F.col("u").alias("node"), "v", F.lit(1).alias("up")).union(e.select(F.col("v").alias("node"), F.lit(None).cast("bigint"), F.lit(0)))
        if not ends.groupBy("node").agg(F.max("up").alias("x"), F.min("up").alias("y"), F.min("v").alias("lo"), F.max("v").alias("hi")).filter("x <> y or lo <> hi").limit(1).count():
            support.later(spark, path)
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
