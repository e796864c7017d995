"""Embedding near-duplicates by lattice hashing.

Vectors of equal direction are nearly equal; each table projects the unit vectors onto 8 random
orthonormal directions, scales and shifts them and takes the nearest point of the E8 lattice as cell. A
vector stands in its home cell and looks into neighbouring cells as well (the best point of the other
coset, and the cell beyond the nearest face). Vectors that meet in a cell are compared exactly, in
double precision. Equal vectors are merged first. A cell of more than ``block`` rows is split into a
grid of blocks, each pair of blocks a task of its own, so no pair is lost and no task grows with a cell.

Each pair counts in the first table in which it meets, so no table of all pairs is made: per task only
link counts and a spanning forest leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import support
from .components import components
from .components import forest as _forest
from .kernels import U64, mix


def e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest E8 point of each row of 8 coordinates and the best point of the other coset, doubled."""

    def d8(v):
        r = np.rint(v)
        odd = np.flatnonzero(np.abs(r.sum(1)) % 2 == 1)
        if len(odd):
            e = v[odd] - r[odd]
            j = np.abs(e).argmax(1)
            r[odd, j] += np.where(e[np.arange(len(odd)), j] >= 0, 1.0, -1.0)
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    near = (((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None]
    return (2 * np.where(near, a, b)).astype(np.int64), (2 * np.where(near, b, a)).astype(np.int64)


class Tables:
    """``n`` random projections of vectors of ``dim`` components (at least 8 after zero padding)."""

    def __init__(self, dim: int, n: int, scale: float, seed: int):
        rng, self.dim = np.random.default_rng(seed), max(8, dim)
        self.q = [np.linalg.qr(rng.normal(size=(self.dim, 8)))[0] * scale * (self.dim / 64) ** 0.5 for _ in range(n)]
        self.shift = rng.uniform(0, 1, (n, 8))

    def cells(self, unit: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Hashes (rows, tables, 3): home cell and two neighbours; a neighbour equal to home is repeated home."""
        if unit.shape[1] < self.dim:
            unit = np.pad(unit, ((0, 0), (0, self.dim - unit.shape[1])))
        out = np.empty((len(unit), len(self.q), 3), U64)
        for t, q in enumerate(self.q):
            x = unit @ q + self.shift[t]
            home, other = e8(x)
            beyond, _ = e8(home / 2 + 2.2 * (x - home / 2))
            for k, p in enumerate((home, other, beyond)):
                h = mix(groups.astype(U64) + U64(t * 0x9E3779B9 + 1))
                for j in range(8):
                    h = mix(h + p[:, j].astype(U64))
                out[:, t, k] = h
        return out


def near(df: DataFrame, threshold: float = 0.98, tables: int = 12, scale: float = 8.0, block: int = 2048, seed: int = 5) -> DataFrame:
    """vec_id, embedding, label -> vec_id, n_links, component_id, kept for every row.

    Only vectors of equal label (of any type) and equal length are compared. A vector without id or label,
    null, empty, zero, or with null or non-finite components links with nothing; its component is its own
    id. Rows that repeat an id count as vectors of their own. An empty table gives an empty result.

    Of random pairs of cosine 0.98 exactly, the least that link, the tables find 0.999 and more in 8 to 1,024
    dimensions (tests/llm/test_operators.py).
    """
    spark = df.sparkSession
    with support.scratch(spark) as work:
        return support.kept(_near(df, threshold, tables, scale, block, seed, work), "near")[0]


def _near(df: DataFrame, threshold: float, tables: int, scale: float, block: int, seed: int, work: support.Scratch) -> DataFrame:
    spark = df.sparkSession
    kind = "float" if df.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    # + 0.0 makes -0.0 and 0.0 one; floats stay floats until they are compared
    rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.transform("embedding", lambda x: x.cast(kind) + F.lit(0.0).cast(kind)).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("ok", valid)
    # grp stands for a label and a length, node for a distinct vector's smallest id in it
    reps = rows.filter("ok").groupBy("label", "v").agg(F.min("vec_id").alias("key"), F.count(F.lit(1)).alias("n"))
    reps = reps.withColumn("grp", F.xxhash64(F.col("label").cast("string"), F.size("v")))
    reps = reps.withColumn("node", F.xxhash64("grp", "key"))
    reps = work.keep(reps, "vectors")
    make = {"n": tables, "scale": scale, "seed": seed}
    home_at = np.tile(np.array([True, False, False]), tables)

    def by_length(column) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, rows, vectors in double precision) of a list column."""
        sizes = np.diff(column.offsets.to_numpy())
        flat, first = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()[:-1]
        out = []
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            out.append((int(d), at, flat[first[at][:, None] + np.arange(d)]))
        return out

    def hashed(batches):
        made: dict[int, Tables] = {}
        for b in batches:
            grp, node = b.column(1).to_numpy(), b.column(0).to_numpy()
            for d, at, v in by_length(b.column(2)):
                t = made.setdefault(d, Tables(d, **make))
                c = t.cells(v / np.linalg.norm(v, axis=1, keepdims=True), grp[at])
                flat = c.reshape(len(at), -1)
                keep = np.ones(flat.shape, bool)
                keep[:, ~home_at] = (c[:, :, 1:] != c[:, :, :1]).reshape(len(at), -1)
                keep[:, 2::3] &= flat[:, 2::3] != flat[:, 1::3]
                r, k = np.nonzero(keep)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(flat[r, k].view(np.int64)), "node": pa.array(node[at[r]]), "tab": pa.array((k // 3).astype(np.int32)), "home": pa.array(home_at[k])})

    cells = work.keep(reps.select("node", "grp", "v").mapInArrow(hashed, "cell bigint, node bigint, tab int, home boolean"), "cells")
    many = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.count_if("home").alias("homes")).filter("m > 1 and homes > 0").select("cell", F.ceil(F.col("m") / block).cast("int").alias("grid"))
    met = cells.join(many, "cell").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("grid")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("grid") - 1)))
    met = met.select("cell", "node", "tab", "home", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    met = met.join(reps.select("node", "grp", "n", "v"), "node").select(F.xxhash64("cell", "lo", "hi").alias("task"), "cell", "tab", "home", (F.col("mine") == F.col("hi")).alias("upper"), (F.col("lo") != F.col("hi")).alias("cross"), "node", "grp", "n", "v")
    met = met.repartition(support.shuffle_partitions(spark), "task").sortWithinPartitions("task", "cell", "grp")

    def verify(batches):
        made: dict[int, Tables] = {}

        def solve(x, v):
            """x: columns of whole tasks, in order; v: their vectors, all of one length."""
            task, cell, tab, home, upper, cross, node, grp, n = x
            unit = v / np.linalg.norm(v, axis=1, keepdims=True)
            codes = made.setdefault(v.shape[1], Tables(v.shape[1], **make)).cells(unit, grp)
            cuts = np.flatnonzero(np.concatenate(([True], (task[1:] != task[:-1]) | (cell[1:] != cell[:-1]) | (grp[1:] != grp[:-1]), [True])))
            A, B = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi - lo < 2 or not home[lo:hi].any():
                    continue
                c = unit[lo:hi] @ unit[lo:hi].T
                ok = np.triu(c >= threshold, 1) & (home[lo:hi, None] | home[None, lo:hi])
                if cross[lo]:
                    ok &= upper[lo:hi, None] != upper[None, lo:hi]
                i, j = np.nonzero(ok)
                A.append(i + lo)
                B.append(j + lo)
            if not A:
                return None
            a, b = np.concatenate(A), np.concatenate(B)
            a, b = np.where(node[a] < node[b], a, b), np.where(node[a] < node[b], b, a)
            # met[t]: home of one is a cell of the other
            ha, hb = codes[a][:, :, :1], codes[b][:, :, :1]
            meets = (ha == codes[b]).any(2) | (hb == codes[a]).any(2)
            new = meets.argmax(1) == tab[a]
            # the same table may show a pair twice, in either home: count it in the home of the smaller node
            twice = (ha[np.arange(len(a)), tab[a]] == codes[b][np.arange(len(a)), tab[a]]).any(1)
            new &= ~twice | home[a]
            a, b = a[new], b[new]
            if not len(a):
                return None
            un, inv = np.unique(node, return_inverse=True)
            inv = inv.ravel()
            links = np.bincount(inv[a], n[b], len(un)) + np.bincount(inv[b], n[a], len(un))
            root = _forest(len(un), inv[a], inv[b])
            on = np.flatnonzero(links)
            return pa.RecordBatch.from_pydict({"node": pa.array(un[on]), "links": pa.array(links[on].astype(np.int64)), "root": pa.array(un[root[on]])})

        def solved(held):
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            x = [whole.column(i).to_numpy(zero_copy_only=False) for i in range(9)]
            for _, at, v in by_length(whole.column(9)):
                if (got := solve([c[at] for c in x], v)) is not None:
                    yield got

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            task = b.column(0).to_numpy()
            if held and held[-1].column(0)[-1].as_py() != task[0]:
                yield from solved(held)
                held = []
            last = int(np.searchsorted(task, task[-1]))  # the last task may go on in the next batch
            if last:
                yield from solved([*held, b.slice(0, last)])
                held = []
            held.append(b.slice(last))
        if held:
            yield from solved(held)

    found = work.keep(met.mapInArrow(verify, "node bigint, links bigint, root bigint"), "links")
    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    per = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = reps.select("label", "v", "key", "node", "n").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = named.groupBy("component").agg(F.min("key").alias("component_id"))
    done = named.join(low, "component").join(per, "node", "left")
    done = done.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    good = rows.filter("ok").join(done, ["label", "v"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter("not ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
