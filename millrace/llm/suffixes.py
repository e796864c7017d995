"""Suffix-array dedup: cut every byte that a 200-byte string covers which also starts elsewhere.

Equal 200-byte strings hold the same 64-byte gram of least hash at the same place, so each string start
is owned by one anchor: the leftmost least gram of the string. Anchors (one in some 70 bytes) are dealt
by gram; a gram that stands once in all texts needs no more. Anchors of one gram whose whole owned
stretch is equal repeat as a whole. Where stretches of one gram differ, their suffixes behind the gram
and their reversed prefixes before it are sorted by deep-shallow sorting: multikey quicksort over 8-byte
symbols to a shallow depth, then blind tries for the groups that are still equal. Adjacent common
prefix lengths give the classes of contexts equal to each depth, and a string start repeats if another
stretch is in its class on both sides.

A gram with more than ``hot`` different stretches is not gathered: its string starts are counted one by
one by 128-bit hash, with partial sums before the shuffle. A text that stands more than once is cut as a
whole; of its copies each task takes one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import support
from .kernels import U64, mix, prefix_hash, span_hash

LENGTH, GRAM = 200, 64
_STEP = 1 << 18  # bytes handled at once; positions in them fit into the low 20 bits of a key
_SHALLOW = 2  # symbols of 8 bytes


# ---- anchors ---------------------------------------------------------------------------------------


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts together no longer than 2^20 bytes: (text number, gram hash, stretch hash, anchor, first
    start, last start), positions within the concatenation."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
    n = len(data) - gram + 1
    if n <= 0 or not (sizes >= length).any():
        return tuple(np.empty(0, np.int64) for _ in range(6))
    h = prefix_hash(data)
    at = np.arange(n)
    g = span_hash(h, at, at + gram)
    key = (g & ~U64((1 << 20) - 1)) | at.astype(U64)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    count = np.maximum(0, sizes - length + 1)
    starts = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    owner = (key[starts] & U64((1 << 20) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), count)
    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (text[1:] != text[:-1]))))
    last = np.concatenate((new[1:], [len(starts)])) - 1
    lo, hi, a = starts[new], starts[last], owner[new]
    stretch = mix(span_hash(h, lo, hi + length) + mix(((a - lo) * 4096 + hi - lo).astype(U64)))
    return text[new], g[a].view(np.int64), stretch.view(np.int64), a, lo, hi


def pieces_of(raw: bytes, length: int):
    """(offset, bytes) of a text in steps, so that every string start is in exactly one of them."""
    for o in range(0, max(1, len(raw) - length + 1), _STEP // 2):
        yield o, raw[o : o + _STEP // 2 + length - 1]


# ---- deep-shallow sorting --------------------------------------------------------------------------


def deep_shallow(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of equally long byte strings (rows), group by group."""
    words = rows.view(">u8").astype(U64)
    order = np.argsort(group, kind="stable")
    rank_group = group[order]
    alive = np.arange(len(order))
    for d in range(min(_SHALLOW, words.shape[1])):
        # one pass of multikey quicksort over all groups at once: order by this symbol, go on inside equal ones
        w = words[order[alive], d]
        o = np.lexsort((w, rank_group[alive]))
        order[alive] = order[alive][o]
        w, gr = w[o], rank_group[alive]
        new = np.concatenate(([True], (w[1:] != w[:-1]) | (gr[1:] != gr[:-1])))
        ids = np.cumsum(new) - 1
        big = np.bincount(ids)[ids] > 1
        rank_group = rank_group.copy()
        rank_group[alive] = ids + d * len(order) * 2 + len(order)
        alive = alive[big]
        if not len(alive):
            return order
    cuts = np.flatnonzero(np.concatenate(([True], rank_group[alive][1:] != rank_group[alive][:-1], [True])))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        at = alive[lo:hi]
        order[at] = blind_trie(rows, order[at])
    return order


def blind_trie(rows: np.ndarray, members: np.ndarray) -> list[int]:
    """Members in the order of their rows. Inner nodes keep only the depth at which children differ and
    the children's bytes; a new string walks down blindly to some leaf, is compared with that leaf once,
    and is put where the two part."""
    raw = [rows[m].tobytes() for m in members]
    size = rows.shape[1]
    root: list | int = 0  # a leaf: the number of a member; a node: [depth, {byte: child}, a leaf below]
    same: dict[int, list[int]] = {}
    for i in range(1, len(raw)):
        s, node = raw[i], root
        while not isinstance(node, int):
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else node[2]
        t = raw[node]
        if s == t:
            same.setdefault(node, []).append(i)
            continue
        x = int.from_bytes(s, "big") ^ int.from_bytes(t, "big")
        part = size - (x.bit_length() + 7) // 8
        parent, node = None, root
        while not isinstance(node, int) and node[0] < part:
            parent, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == part:
            node[1][s[part]] = i
            continue
        inner = [part, {s[part]: i, t[part]: node}, i]
        if parent is None:
            root = inner
        else:
            parent[1][s[parent[0]]] = inner
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            out += [int(members[j]) for j in (node, *same.get(node, ()))]
        else:
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
    return out


def _classes(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and, for each place but the first, the common prefix with the row before (-1 over groups)."""
    order = deep_shallow(rows, group)
    x = rows[order]
    differ = x[1:] != x[:-1]
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    common[group[order][1:] != group[order][:-1]] = -1
    return order, common


def repeated(group: np.ndarray, left: list[bytes], right: list[bytes], span: np.ndarray, sure: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each stretch and each count s of bytes before its gram: does its string with s bytes before the
    gram stand in another stretch of the group too? Bool (stretches, length - gram + 1).

    span: last start minus first start; a stretch owns s from len(left) - span to len(left). sure: stretches
    that stand twice themselves; their strings count as repeated anyway.
    """
    n, deep = len(group), length - gram
    wide = -(-max(deep, 8) // 8) * 8

    def matrix(parts):
        out = np.zeros((n, wide), np.uint8)
        for i, p in enumerate(parts):
            out[i, : len(p)] = np.frombuffer(p, np.uint8)
        return out

    back = np.array([len(p) for p in left])
    ahead = np.array([len(p) for p in right])
    lo, lc = _classes(matrix([p[::-1] for p in left]), group)
    ro, rc = _classes(matrix(right), group)
    dup = np.zeros((n, deep + 1), bool)
    lcls, rcls = np.empty(n, np.int64), np.empty(n, np.int64)
    for s in range(deep + 1):
        own = np.flatnonzero((back >= s) & (back - span <= s) & (ahead >= deep - s))
        if not len(own):
            continue
        lcls[lo] = np.concatenate(([0], np.cumsum(lc < s)))
        rcls[ro] = np.concatenate(([0], np.cumsum(rc < deep - s)))
        # group boundaries split classes even at depth 0, by the common length -1
        both = lcls[own] * (n + 1) + rcls[own]
        _, inv, cnt = np.unique(both, return_inverse=True, return_counts=True)
        dup[own, s] = (cnt[inv.ravel()] > 1) | sure[own]
    return dup


# ---- the operator ----------------------------------------------------------------------------------


def _text_key(text: Column, twice: list[int]) -> Column:
    """A number for each different text; ``twice`` are the hashes that two texts share."""
    h = F.xxhash64(text, F.lit(11))
    return F.when(h.isin(*twice), F.xxhash64(text, F.lit(-11))).otherwise(h) if twice else h


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = 4096) -> tuple[DataFrame, list[int]]:
    """docs (text) -> (t, lo, hi) arrays per text key t: the covered byte stretches, in any order and
    overlapping; and what ``_text_key`` needs. Texts of fewer than ``length`` bytes have none."""
    spark = docs.sparkSession
    parts = support.shuffle_partitions(spark)
    long = docs.filter(F.octet_length("text") >= length)
    texts = long.select(_text_key(F.col("text"), []).alias("t"), F.xxhash64("text", F.lit(-11)).alias("more"), F.octet_length("text").alias("size")).groupBy("t", "more").agg(F.count(F.lit(1)).alias("c"), F.first("size").alias("size"))
    texts, _ = support.kept(texts, "texts")
    # texts of one hash: some at 10^10 texts, none below; the other hash is their key then
    twice = [r["t"] for r in texts.groupBy("t").count().filter("count > 1").select("t").collect()]
    keyed = long.select(_text_key(F.col("text"), twice).alias("t"), "text")
    copied = texts.filter("c > 1").select((F.when(F.col("t").isin(*twice), F.col("more")).otherwise(F.col("t")) if twice else F.col("t")).alias("t"), F.lit(0).cast("bigint").alias("lo"), F.col("size").cast("bigint").alias("hi"))

    def find(batches):
        """Anchors of a task. What repeats inside the task is settled here: one row of each (g, h) goes on
        marked ``sure``, the others only carry their own stretch and are dealt evenly."""
        kept, n, seen = [], 0, set()
        for b in batches:
            held, keys, offs, size = [], [], [], 0

            def flush():
                text, g, stretch, a, lo, hi = anchors(held, length, gram)
                base = np.concatenate(([0], np.cumsum([len(x) for x in held])[:-1]))
                pos = a - base[text] + np.array(offs)[text]
                kept.append((g, stretch, np.array(keys)[text], (pos << 18) | ((a - lo) << 10) | ((hi - lo) << 2)))
                return len(g)

            for t, raw in zip(b.column(0).to_pylist(), b.column(1)):
                if t in seen:
                    continue
                seen.add(t)
                for o, part in pieces_of(raw.as_py().encode(), length):
                    if size + len(part) >= _STEP:
                        n += flush()
                        held, keys, offs, size = [], [], [], 0
                    held.append(part)
                    keys.append(t)
                    offs.append(o)
                    size += len(part)
            if held:
                n += flush()
            if n > 400_000:
                yield settled(kept)
                kept, n = [], 0
        if n:
            yield settled(kept)

    def settled(kept):
        g, h, t, p = (np.concatenate(x) for x in zip(*kept))
        order = np.lexsort((p, t, h, g))
        g, h, t, p = g[order], h[order], t[order], p[order]
        same = np.concatenate(([False], (g[1:] == g[:-1]) & (h[1:] == h[:-1])))
        p = p | np.where(same, 2, np.where(np.concatenate((same[1:], [False])), 1, 0))
        spread = mix(t.view(U64) + mix(p.view(U64))).view(np.int64)
        fresh = ~same | np.concatenate(([True], (t[1:] != t[:-1]) | (p[1:] >> 2 != p[:-1] >> 2)))  # copies of one text say the same
        return pa.RecordBatch.from_pydict({"g": pa.array(np.where(same, spread, g)[fresh]), "h": pa.array(np.where(same, spread, h)[fresh]), "t": pa.array(t[fresh]), "p": pa.array(p[fresh])})

    found = keyed.mapInArrow(find, "g bigint, h bigint, t bigint, p bigint")
    by_g, by_h = Window.partitionBy("g"), Window.partitionBy("g", "h")
    own = F.col("p").bitwiseAND(2) > 0
    same = found.repartition(parts, "g").withColumn("c", F.count(F.lit(1)).over(by_h) + F.max(F.col("p").bitwiseAND(1)).over(by_h)).withColumn("i", F.row_number().over(by_h.orderBy("t", "p")))
    same = same.withColumn("least", F.min("c").over(by_g)).withColumn("one", F.min("h").over(by_g) == F.max("h").over(by_g)).withColumn("v", F.sum((F.col("i") == 1).cast("int")).over(by_g))
    same = same.filter((F.col("c") > 1) | own | ~F.col("one")).select("g", "h", "t", F.shiftright("p", 2).alias("p"), ((F.col("c") > 1) | own).alias("whole"), (~own & ~F.col("one") & (F.col("least") == 1) & (F.col("i") == 1)).alias("ask"), (F.col("v") > hot).alias("hot"))
    same, _ = support.kept(same, "anchors")
    pos, back, span = F.shiftright("p", 16), F.shiftright("p", 8).bitwiseAND(255), F.col("p").bitwiseAND(255)
    whole = same.filter("whole").select("t", (pos - back).alias("lo"), (pos - back + span + length).alias("hi"))
    asked = same.filter("ask").groupBy("t").agg(F.collect_list(F.struct("g", "h", "p", "whole", "hot")).alias("asked"))

    def fetch(batches):
        """The bytes around each gram that is asked for; of copies one a task."""
        seen: set[int] = set()
        for b in batches:
            out = {k: [] for k in ("g", "h", "t", "p", "whole", "hot", "left", "right")}
            for t, raw, asked_ in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                if t in seen:
                    continue
                seen.add(t)
                data = raw.as_py().encode()
                for x in asked_:
                    at, before, more = x["p"] >> 16, x["p"] >> 8 & 255, x["p"] & 255
                    for k in ("g", "h", "p", "whole", "hot"):
                        out[k].append(x[k])
                    out["t"].append(t)
                    out["left"].append(data[at - before : at])
                    out["right"].append(data[at + gram : at - before + more + length])
            yield pa.RecordBatch.from_pydict({k: pa.array(v, {"whole": pa.bool_(), "hot": pa.bool_(), "left": pa.binary(), "right": pa.binary()}.get(k, pa.int64())) for k, v in out.items()})

    kinds = "g bigint, h bigint, t bigint, p bigint, whole boolean, hot boolean, left binary, right binary"
    got = keyed.join(asked, "t").select("t", "text", "asked").mapInArrow(fetch, kinds)
    got, _ = support.kept(got, "stretches")

    def intervals(dup, t, p, out):
        edge = np.diff(np.pad(dup, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        r, a = np.nonzero(edge == 1)
        _, z = np.nonzero(edge == -1)
        at = p[r] >> 16
        out.append((t[r], at - (z - 1), at - a + length))  # s counts backwards from the gram

    def sort(batches):
        held, n = [], 0  # a gram has ``hot`` different stretches at most

        def solve(x):
            x = x[~x.duplicated(["g", "h"]).to_numpy()]  # copies of one text are fetched once a task
            g = np.unique(x["g"].to_numpy(), return_inverse=True)[1].ravel()
            if len(x) < 2:
                return None
            p, out = x["p"].to_numpy(), []
            dup = repeated(g, list(x["left"]), list(x["right"]), p & 255, x["whole"].to_numpy(), length, gram)
            intervals(dup, x["t"].to_numpy(), p, out)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in out[0]], ["t", "lo", "hi"])

        for b in batches:
            held.append(b.to_pandas())
            n += len(held[-1])
            if n > 20_000:
                x = pd.concat(held, ignore_index=True)
                last = int(np.searchsorted(x["g"].to_numpy(), x["g"].to_numpy()[-1]))
                if last and (r := solve(x[:last])) is not None:
                    yield r
                held, n = [x[last:].drop_duplicates(["g", "h"])], 0
                n = len(held[0])
        if n and (r := solve(pd.concat(held, ignore_index=True))) is not None:
            yield r

    some = got.filter("not hot").repartition(parts, "g").sortWithinPartitions("g").mapInArrow(sort, "t bigint, lo bigint, hi bigint")

    def single(batches):
        """A row for each string start of a hot gram's stretches, with its 128-bit hash."""
        for b in batches:
            out = []
            for g, h, t, p, sure, left, right in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 6, 7))):
                for s in range(len(left) - (p & 255), len(left) + 1):
                    d = hashlib.blake2b(left[len(left) - s :] + right[: length - gram - s], digest_size=16).digest()
                    out.append((g, s, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), h, t, p, sure))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if i == 7 else pa.int64()) for i, c in enumerate(zip(*out) if out else [[]] * 8)], ["g", "s", "x", "y", "h", "t", "p", "sure"])

    one = got.filter("hot").dropDuplicates(["g", "h"]).mapInArrow(single, "g bigint, s bigint, x bigint, y bigint, h bigint, t bigint, p bigint, sure boolean")
    again = one.groupBy("g", "s", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.bool_or("sure").alias("any")).filter("n > 1 or any").drop("n", "any")
    at = F.shiftright("p", 16)
    singles = one.join(again, ["g", "s", "x", "y"]).select("t", (at - F.col("s")).alias("lo"), (at - F.col("s") + length).alias("hi"))
    # copies of one text have one key: its stretches are kept once
    spans = whole.union(some).union(singles).union(copied).groupBy("t").agg(F.collect_set(F.struct("lo", "hi")).alias("x"))
    return spans.select("t", F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi")), twice


def covered(size: int, lo, hi) -> np.ndarray:
    """Which of the bytes lie in one of the stretches."""
    d = np.zeros(size + 1, np.int32)
    np.add.at(d, np.asarray(lo, np.int64), 1)
    np.add.at(d, np.asarray(hi, np.int64), -1)
    return np.cumsum(d[:-1]) > 0


def _joined(df: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    spans, twice = repeated_spans(df.select("text"), length, gram, hot)
    return df.withColumn("__t", _text_key(F.col("text"), twice)).join(spans.select(F.col("t").alias("__t"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi")), "__t", "left")


def digest(df: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; null text is empty, repeated rows
    repeat each other, a null id stays, an empty table gives an empty result, other columns are not read.
    Whole texts are searched, long ones in steps of 2^17 bytes that overlap."""

    def run(batches):
        for b in batches:
            out = []
            for text, lo, hi in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                raw = (text.as_py() or "").encode()
                if lo is None:
                    out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                    continue
                gone = covered(len(raw), lo, hi)
                spans = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
                out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
            c = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _joined(df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), length, gram, hot)
    return rows.select("doc_id", "text", "__lo", "__hi").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def clean(df: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = 4096) -> DataFrame:
    """The table with repeated bytes cut out of ``text``. Characters that are cut in the middle go as a
    whole; null text stays null, repeated rows lose what they share, and other columns stay as they are."""

    cols = df.columns
    at, n = cols.index("text"), len(cols)

    def run(batches):
        for b in batches:
            texts = []
            for t, lo, hi in zip(b.column(at).to_pylist(), b.column(n).to_pylist(), b.column(n + 1).to_pylist()):
                if t is not None and lo is not None:
                    raw = t.encode()
                    t = np.frombuffer(raw, np.uint8)[~covered(len(raw), lo, hi)].tobytes().decode("utf-8", "ignore")
                texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.column(i).type) if i == at else b.column(i) for i in range(n)], b.schema.names[:n])

    return _joined(df, length, gram, hot).select(*cols, "__lo", "__hi").mapInArrow(run, df.schema)


def brute(texts: dict, length: int = LENGTH) -> dict:
    """id -> mask of removed bytes, by counting every string; for tests."""
    from collections import Counter

    raw = {i: (t or "").encode() for i, t in texts.items()}
    n = Counter(r[p : p + length] for r in raw.values() for p in range(len(r) - length + 1))
    out = {}
    for i, r in raw.items():
        lo = [p for p in range(len(r) - length + 1) if n[r[p : p + length]] > 1]
        out[i] = covered(len(r), lo, [p + length for p in lo])
    return out
