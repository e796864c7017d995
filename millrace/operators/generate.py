"""Synthetic tables, made in parallel from ``spark.range``; reruns agree."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import Functions
from ..functions.special import lorenz, mackey_glass
from .ordering import running, with_row_id


def uniform(n: int, seed: int, *tags: int):
    """Uniform numbers by the hash of (id, seed, tag): the same in every rerun and partitioning."""
    return [F.pmod(F.xxhash64("id", F.lit(seed), F.lit(t)), F.lit(1 << 52)) / float(1 << 52) for t in tags]


def swiss_roll(spark: SparkSession, n: int, seed: int = 0, cutout: bool = False) -> DataFrame:
    u, v = uniform(n, seed, 1, 2)
    t = F.sqrt(u * 8 + 1) * 1.5 * math.pi
    x = spark.range(n).select("id", (t * F.cos(t)).alias("x"), (v * 12).alias("y"), (t * F.sin(t)).alias("z"), t.alias("t"))
    return x.filter(~(F.col("y").between(4, 8) & F.col("t").between(8, 11))) if cutout else x


def s_curve(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    u, v = uniform(n, seed, 1, 2)
    t = (u - 0.5) * 3 * math.pi
    return spark.range(n).select("id", F.sin(t).alias("x"), (v * 2).alias("y"), (F.when(t >= 0, 1 - F.cos(t)).otherwise(F.cos(t) - 1)).alias("z"), t.alias("t"))


def entwined_spirals(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    (u,) = uniform(n, seed, 1)
    t, side = F.sqrt(u) * 4 * math.pi, (F.col("id") % 2) * 2 - 1
    return spark.range(n).select("id", (side * t * F.cos(t)).alias("x"), (side * t * F.sin(t)).alias("y"), (F.col("id") % 2).cast("string").alias("label"))


def fish_bowl(spark: SparkSession, n: int, seed: int = 0, opening: float = 0.25) -> DataFrame:
    u, v = uniform(n, seed, 1, 2)
    z, a = u * (2 - opening) - 1, v * 2 * math.pi
    r = F.sqrt(1 - z * z)
    return spark.range(n).select("id", (r * F.cos(a)).alias("x"), (r * F.sin(a)).alias("y"), z.alias("z"))


def cube(spark: SparkSession, per_side: int) -> DataFrame:
    """The points of a grid on the unit cube."""
    s = F.lit(float(max(1, per_side - 1)))
    return spark.range(per_side**3).select("id", ((F.col("id") % per_side) / s).alias("x"), (F.floor(F.col("id") / per_side) % per_side / s).alias("y"), (F.floor(F.col("id") / per_side**2) / s).alias("z"))


def ribbon(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """A ribbon that crosses itself."""
    u, v = uniform(n, seed, 1, 2)
    t = u * 2 * math.pi
    return spark.range(n).select("id", F.sin(t).alias("x"), (v * 0.5).alias("y"), (F.sin(2 * t)).alias("z"), t.alias("t"))


def random_walk(spark: SparkSession, n: int, step: float = 0.05, seed: int = 0) -> DataFrame:
    """(id, action, position): steps of +-step from 0.5; a running sum in two levels."""
    (u,) = uniform(n, seed, 1)
    x = spark.range(n).select("id", F.when(u < 0.5, -1).otherwise(1).alias("action"))
    return running(x, ["id"], {"s": F.col("action")}).select("id", "action", (F.lit(0.5) + F.col("s") * step).alias("position"))


def grid_walk(spark: SparkSession, n: int, width: int, height: int, start: tuple[int, int] | None = None, seed: int = 0, block: int = 65_536, limit: int = 50_000_000) -> DataFrame:
    """(id, x, y, action): a walk over a grid, at first in the middle; actions 0 to 3 go left, right, up and down,
    each as likely as any other that stays on the grid.

    Steps are dealt in blocks. A first pass follows each block from every cell, so that the driver can chain the
    blocks by one number a cell (at most ``limit`` numbers together); a second pass walks each block from its start."""
    cells, blocks = width * height, -(-n // block)
    x0, y0 = start or (width // 2, height // 2)
    if cells < 2:
        raise ValueError("a walk needs two cells")
    if not (0 <= x0 < width and 0 <= y0 < height):
        raise ValueError("the start is off the grid")
    if cells * blocks > limit:
        raise ValueError(f"{cells} cells by {blocks} blocks; the limit is {limit}")
    steps = ((-1, 0), (1, 0), (0, -1), (0, 1))
    ways = [[(a, (y + dy) * width + x + dx) for a, (dx, dy) in enumerate(steps) if 0 <= x + dx < width and 0 <= y + dy < height] for y in range(height) for x in range(width)]
    many = np.array([len(w) for w in ways])
    goal = np.array([[g for _, g in w] + [0] * (4 - len(w)) for w in ways])
    draws = lambda b: np.random.Generator(np.random.Philox(key=seed, counter=b << 64)).random(min(block, n - b * block))

    def ends(batches):
        for pdf in batches:
            for b in pdf["id"].tolist():
                at = np.arange(cells)
                for u in draws(b):
                    at = goal[at, (u * many[at]).astype(int)]
                yield pd.DataFrame({"id": [b], "ends": [at.tolist()]})

    begin, at = [], y0 * width + x0
    last = dict(map(tuple, spark.range(blocks - 1, numPartitions=blocks - 1).mapInPandas(ends, "id bigint, ends array<bigint>").collect())) if blocks > 1 else {}
    for b in range(blocks):
        begin.append(at)
        at = last[b][at] if b in last else at

    def walk(batches):
        for pdf in batches:
            for b in pdf["id"].tolist():
                c, seen, acts = begin[b], [], []
                for u in draws(b).tolist():
                    a, to = ways[c][int(u * len(ways[c]))]
                    seen.append(c)
                    acts.append(a)
                    c = to
                seen = np.array(seen)
                yield pd.DataFrame({"id": b * block + np.arange(len(seen)), "x": seen % width, "y": seen // width, "action": acts})

    return spark.range(blocks, numPartitions=max(1, blocks)).mapInPandas(walk, "id bigint, x bigint, y bigint, action int")


def grid_observations(walk: DataFrame, table: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The walk with the row of the table (numbered by its keys, ``width`` rows a line of the grid) seen at each step."""
    rows = with_row_id(table, keys, "__cell")
    return walk.withColumn("__cell", F.col("y") * width + F.col("x")).join(rows, "__cell").drop("__cell")


def random_sequence(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(position, value): the numbers 0..n-1 in pseudorandom order."""
    x = spark.range(n).select(F.col("id").alias("value"), F.xxhash64("id", F.lit(seed)).alias("h"))
    return with_row_id(x, ["h", "value"], "position").select("position", "value")


def manifold(spark: SparkSession, n: int, text: str, params: int, seed: int = 0) -> DataFrame:
    """y1, y2, ... of uniform parameters in [0, 1], rows numbered by the first parameter."""
    fs = Functions(text)
    x = spark.range(n).select("id", *[u.alias(f"p{i}") for i, u in enumerate(uniform(n, seed, *range(params)))])
    x = with_row_id(x, ["p0", "id"], "row_id")
    names = sorted((f for f in fs.defs if f[0] == "y" and f[1:].isdigit()), key=lambda f: int(f[1:]))
    return x.select("row_id", *[fs.apply(f, [F.col(f"p{i}") for i in range(len(fs.defs[f][0]))]).alias(f) for f in names])


def equation_table(spark: SparkSession, text: str, lo: float, hi: float, steps: int) -> DataFrame:
    """(x, f1, f2, ...) at equal steps."""
    fs = Functions(text)
    x = spark.range(steps + 1).select((F.lit(lo) + F.col("id") * ((hi - lo) / steps)).alias("x"))
    return x.select("x", *[fs.apply(f, [F.col("x")]).alias(f) for f in fs.defs])


def lorenz_table(spark: SparkSession, n: int, dt: float = 0.01) -> DataFrame:
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(lorenz(n, dt))], "t bigint, x double, y double, z double")


def mackey_glass_table(spark: SparkSession, n: int, tau: int = 17) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(mackey_glass(n, tau))], "t bigint, x double")
