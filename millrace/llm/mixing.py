"""Mixing sources to target weights.

The words of a source, documents in id order, are packed into blocks of ``block`` words; only its last
block may be shorter. The mix has one slot for each block it takes. Slots are dealt to output shards of
``shard_slots`` slots. Each shard draws how many slots each source gets, a multinomial draw with the quotas'
shares; what a source has drawn beyond its quota over all shards goes to the sources that are short, so that
each gets exactly its quota. Shards are drawn in the tasks, from seeds of their own.
The j-th slot of a source takes block perm(j mod blocks) of pass j div blocks, where perm is a
pseudorandom permutation of the source's block numbers (a Feistel network walked until it falls inside
the range), so each pass takes a block at most once. Slots and blocks meet in a join on
(source, block number), which no hot source can skew.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import support

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], max_epochs: float = 3.0) -> list[float]:
    """Shares of the total by weight, none above max_epochs x size; the excess goes to the others by
    weight until none is above. Sources without words get 0."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w > max_epochs * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = float(max_epochs * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def quota(size: int, target: float, block: int, max_epochs: int) -> int:
    """Slots that take about ``target`` words of a source of ``size`` words; never above max_epochs passes."""
    if size == 0:
        return 0
    n, whole = -(-size // block), int(target // size)
    return min(max_epochs * n, whole * n + round((target - whole * size) / size * n))


class Draws:
    """The multinomial draws of the shards, any of them by number, and their correction.

    Shard h has ``shard_slots`` slots (the last the rest) and draws how many each source gets, with the
    sources' shares of all slots as probabilities, from a generator seeded by (seed, h). Over all shards a
    source then has about its quota; its slots beyond the quota go, in order, to the sources short of theirs.
    """

    def __init__(self, quotas: list[int], shard_slots: int, seed: int):
        self.quotas, self.each, self.seed = np.array(quotas, np.int64), shard_slots, seed
        self.total = int(self.quotas.sum())
        self.shards = -(-self.total // shard_slots)
        self.p = self.quotas / max(1, self.total)

    def counts(self, shard: int) -> np.ndarray:
        n = min(self.each, self.total - shard * self.each)
        return np.random.default_rng([self.seed, shard]).multinomial(n, self.p)

    def settle(self, drawn: np.ndarray) -> None:
        """drawn: slots of each source over all shards."""
        over, short = np.maximum(0, drawn - self.quotas), np.maximum(0, self.quotas - drawn)
        self.before, self.ends, self.drawn = np.cumsum(over) - over, np.cumsum(short), drawn

    def slots(self, s: int, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(source, number of the slot within it) of the n slots from ``first`` on that were drawn for s."""
        j, source = np.arange(first, first + n), np.full(n, s, np.int64)
        out = j >= self.quotas[s]
        rank = self.before[s] + j[out] - self.quotas[s]
        to = np.searchsorted(self.ends, rank, "right")
        source[out] = to
        j[out] = self.quotas[to] - (self.ends[to] - rank)
        return source, j


def permute(x: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A pseudorandom permutation of range(n), evaluated at x."""
    from .kernels import U64, mix

    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    low = U64((1 << half) - 1)

    def once(v):
        left, right = v >> U64(half), v & low
        for r in range(rounds):
            left, right = right, left ^ (mix(right + U64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64))) & low)
        return (left << U64(half)) | right

    v = once(np.asarray(x, U64))
    while (out := v >= U64(n)).any():
        v[out] = once(v[out])
    return v.astype(np.int64)


class Mix:
    """docs: doc_id, size, source number s, first word ``at`` within the source. sources: the plan.
    slots: (shard, s, epoch, block) as drawn."""

    def __init__(self, docs: DataFrame, plan: list[dict], slots: DataFrame, block: int):
        self.docs, self.plan, self.slots, self.block = docs, plan, slots, block

    def pieces(self) -> DataFrame:
        """(doc_id, s, at, block, lo, hi): the words [lo, hi) of a document that lie in a block; (s, at) tells rows apart even if ids repeat."""
        d, n = self.docs.filter("size > 0"), self.block
        b = d.select("doc_id", "s", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / n), F.floor((F.col("at") + F.col("size") - 1) / n))).alias("block"))
        return b.select("doc_id", "s", "at", "block", F.greatest(F.lit(0), F.col("block") * n - F.col("at")).alias("lo"), F.least(F.col("size"), (F.col("block") + 1) * n - F.col("at")).alias("hi"))

    def taken(self) -> DataFrame:
        """Slots joined with blocks by index: (doc_id, s, at, shard, epoch, block, lo, hi)."""
        # merged, never broadcast: the planner takes the slots, made from a short table, for few
        return self.slots.join(self.pieces().hint("merge"), ["s", "block"]).select("doc_id", "s", "at", "shard", "epoch", "block", "lo", "hi")


def mix(df: DataFrame, block: int = 64, shard_slots: int = 4096, max_epochs: int = 3, seed: int = 17, weights=None, most_sources: int = 1_000_000) -> Mix:
    """Plan and draw the mix of a table with doc_id, text, source.

    Sources are ordered by code point, null last; ``weights(i, name)`` is the weight of the i-th, by
    default 1, 2, 3, 1, ... Null and empty texts have no words and are never taken. Documents of a source
    are ordered by (doc_id, hash of the text), null ids first; equal rows follow one another. An empty table
    gives an empty mix; other columns are not read. Whole texts are counted. The source table (name, words)
    and each source's number of drawn slots reach the driver; more than ``most_sources`` sources are refused.
    Reruns give the same mix.
    """
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64("text").alias("row"))
    docs, _ = support.kept(docs, "mix-docs")
    rows = docs.groupBy("source").agg(F.sum("size").alias("n")).limit(most_sources + 1).collect()
    if len(rows) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    share = [float(weights(i, r["source"])) if weights else i % 3 + 1 for i, r in enumerate(rows)]
    goal = targets([r["n"] for r in rows], share, max_epochs)
    plan = [{"s": i, "source": r["source"], "source_size": r["n"], "target": t, "blocks": -(-r["n"] // block), "quota": quota(r["n"], t, block, max_epochs)} for i, (r, t) in enumerate(zip(rows, goal))]
    names = spark.createDataFrame([(p["s"], p["source"], p["source_size"], p["target"]) for p in plan], "s int, source string, source_size bigint, target double")
    small = F.broadcast(names) if len(plan) <= 100_000 else names
    docs = docs.join(small, docs["source"].eqNullSafe(names["source"])).select("doc_id", "row", docs["source"], "size", "s", "source_size", "target")
    docs = support.prefix_sum(docs, ["s"], "doc_id", "size", "at", ties=["row", "size"])
    draws = Draws([p["quota"] for p in plan], shard_slots, seed)
    blocks = np.array([p["blocks"] for p in plan], np.int64)
    # runs of shards: a run is drawn in one task, first to count, then to number the slots from where the run starts
    run = max(16, -(-draws.shards // 100_000))
    runs = spark.range(0, -(-draws.shards // run), 1, max(1, min(support.shuffle_partitions(spark), -(-draws.shards // run))))

    def count(batches):
        for b in batches:
            for r in b.column(0).to_pylist():
                n = sum(draws.counts(h) for h in range(r * run, min(draws.shards, (r + 1) * run)))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"run": pa.array(np.full(len(at), r)), "s": pa.array(at.astype(np.int32)), "n": pa.array(n[at])})

    counted = spark.createDataFrame([], "run bigint, s int, n bigint")
    if draws.shards:
        counted, _ = support.kept(runs.mapInArrow(count, "run bigint, s int, n bigint"), "mix-draws")
    drawn = np.zeros(len(plan), np.int64)
    for r in counted.groupBy("s").agg(F.sum("n").alias("n")).collect():  # one row a source
        drawn[r["s"]] = r["n"]
    draws.settle(drawn)
    starts = counted.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.groupBy("run").agg(F.collect_list(F.struct("s", "first")).alias("starts"))

    def slots(batches):
        for b in batches:
            for r, given in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                first = np.zeros(len(blocks), np.int64)
                for x in given:
                    first[x["s"]] = x["first"]
                for h in range(r * run, min(draws.shards, (r + 1) * run)):
                    n = draws.counts(h)
                    got = [draws.slots(int(s), int(first[s]), int(n[s])) for s in np.flatnonzero(n)]
                    first += n
                    source, j = (np.concatenate(x) for x in zip(*got))
                    m, block_, epoch = blocks[source], np.empty(len(j), np.int64), j // blocks[source]
                    for s in np.unique(source):
                        for e in np.unique(epoch[source == s]):
                            at = (source == s) & (epoch == e)
                            block_[at] = permute(j[at] % m[at], int(blocks[s]), seed * 1_000_003 + int(s) * 101 + int(e))
                    yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(len(j), h)), "s": pa.array(source.astype(np.int32)), "epoch": pa.array(epoch.astype(np.int32)), "block": pa.array(block_)})

    drawn = starts.mapInArrow(slots, "shard bigint, s int, epoch int, block bigint")
    return Mix(docs, plan, drawn, block)


def summary(m: Mix) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken."""
    got = m.taken().groupBy("s", "at").agg(F.sum(F.col("hi") - F.col("lo")).alias("sum"))
    out = m.docs.join(got, ["s", "at"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("sum", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("taken"))


def mixed_documents(df: DataFrame, m: Mix) -> DataFrame:
    """The mix as documents: the columns of df, one row for each pass over a source that takes words of the
    document. A pass that takes all words keeps the text as it is, one that takes some keeps the stretches
    from first to last word taken, a line each. n_chars, if there, is the new length."""
    word = re.compile(WORD)
    got = m.taken().groupBy("doc_id", "s", "at", "epoch").agg(F.sum(F.col("hi") - F.col("lo")).alias("__n"), F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("__cut"))
    keys = m.docs.select("s", "at", F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("size").alias("__size")).filter("__size > 0")
    got = got.drop("doc_id").join(keys, ["s", "at"]).select("__id", "__row", "epoch", F.when(F.col("__n") < F.col("__size"), F.col("__cut")).alias("__cut"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, cuts: pd.Series) -> pd.Series:
        def one(t, c):
            if c is None:
                return t
            at, runs = [x.span() for x in word.finditer(t)], []
            for x in c:
                if runs and runs[-1][1] == x["lo"]:
                    runs[-1][1] = x["hi"]
                else:
                    runs.append([x["lo"], x["hi"]])
            return "\n".join(t[at[a][0] : at[z - 1][1]] for a, z in runs)

        return pd.Series([one(*x) for x in zip(text, cuts)], dtype=object)

    rows = df.withColumn("__row", F.xxhash64("text"))
    twice = keys.groupBy("__id", "__row").count().filter("count > 1").limit(1).count()
    if twice:  # repeated rows each have their own place in the mix
        rows = rows.dropDuplicates(["doc_id", "__row"])
    out = rows.join(got, rows["doc_id"].eqNullSafe(got["__id"]) & (rows["__row"] == got["__row"]))
    out = out.select(*[df[c] for c in df.columns if c != "text"], cut(rows["text"], "__cut").alias("text"))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))
    return out.select(*df.columns)
