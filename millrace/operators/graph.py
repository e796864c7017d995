"""Graphs as edge tables (src, dst, cost)."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shortest_paths(edges: DataFrame, source: int, max_rounds: int = 10_000) -> DataFrame:
    """(node, cost, previous) from a source: rounds of relaxation until nothing falls; each round is one join of
    the nodes that just improved and one aggregation. Ties take the smaller previous node. Lineage is cut every
    few rounds if a checkpoint folder is set."""
    spark = edges.sparkSession
    e = edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), F.col("cost").cast("double").alias("cost")).cache()
    best = spark.createDataFrame([(source, 0.0, None)], "node bigint, cost double, previous bigint")
    front = best
    for i in range(max_rounds):
        step = front.select(F.col("node").alias("src"), F.col("cost").alias("base")).join(e, "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct((F.col("base") + F.col("cost")).alias("c"), F.col("src").alias("p"))).alias("m"))
        new = step.select("node", F.col("m.c").alias("cost"), F.col("m.p").alias("previous"))
        old = best.select("node", F.col("cost").alias("had"))
        front = new.join(old, "node", "left").filter(F.col("had").isNull() | (F.col("cost") < F.col("had"))).select("node", "cost", "previous")
        front = _cut(front)
        if front.limit(1).count() == 0:
            break
        best = _cut(best.join(front.select("node"), "node", "left_anti").unionByName(front))
    e.unpersist()
    return best


def _cut(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    if sc.master.startswith("local"):
        return df.sparkSession.createDataFrame(df.toArrow()) if df.columns else df
    raise RuntimeError("set spark.checkpoint.dir")


def all_pairs(edges: DataFrame, nodes: int, limit: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """(cost, next hop) of all pairs of nodes 0..nodes-1 (Floyd-Warshall over whole rows); infinity and -1 where no path is."""
    if nodes > limit:
        raise ValueError(f"more than {limit} nodes")
    d, nxt = np.full((nodes, nodes), np.inf), np.full((nodes, nodes), -1)
    for s, t, c in edges.select("src", "dst", "cost").collect():
        if c < d[s, t]:
            d[s, t], nxt[s, t] = c, t
    np.fill_diagonal(d, np.minimum(np.diag(d), 0))
    for k in range(nodes):
        via = d[:, k : k + 1] + d[k : k + 1]
        better = via < d
        d[better] = via[better]
        nxt[better] = np.broadcast_to(nxt[:, k : k + 1], d.shape)[better]
    return d, nxt


def betweenness(edges: DataFrame, nodes: int, limit_edges: int = 5_000_000) -> tuple[DataFrame, DataFrame]:
    """((node, betweenness), (src, dst, betweenness)) of a directed graph without weights: a breadth-first search
    and a backward pass from each source, sources dealt to tasks, the adjacency on each machine."""
    spark = edges.sparkSession
    rows = edges.select("src", "dst").distinct().limit(limit_edges + 1).collect()
    if len(rows) > limit_edges:
        raise ValueError("too many edges")
    out: dict[int, list[int]] = {}
    for s, t in rows:
        out.setdefault(s, []).append(t)
    shared = spark.sparkContext.broadcast(out)

    def run(batches):
        adj = shared.value
        for b in batches:
            node_sum: dict[int, float] = {}
            edge_sum: dict[tuple[int, int], float] = {}
            for s in b.column(0).to_pylist():
                dist, paths, before, order = {s: 0}, {s: 1.0}, {}, []
                queue = deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for w in adj.get(v, ()):
                        if w not in dist:
                            dist[w] = dist[v] + 1
                            queue.append(w)
                        if dist[w] == dist[v] + 1:
                            paths[w] = paths.get(w, 0.0) + paths[v]
                            before.setdefault(w, []).append(v)
                down = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before.get(w, ()):
                        c = paths[v] / paths[w] * (1 + down[w])
                        edge_sum[(v, w)] = edge_sum.get((v, w), 0.0) + c
                        down[v] += c
                    if w != s:
                        node_sum[w] = node_sum.get(w, 0.0) + down[w]
            n, e = list(node_sum.items()), list(edge_sum.items())
            yield pa.RecordBatch.from_pydict({"src": pa.array([None] * len(n) + [k[0] for k, _ in e], pa.int64()), "dst": pa.array([k for k, _ in n] + [k[1] for k, _ in e], pa.int64()), "b": pa.array([v for _, v in n] + [v for _, v in e], pa.float64())})

    got = spark.range(nodes).mapInArrow(run, "src bigint, dst bigint, b double").groupBy("src", "dst").agg(F.sum("b").alias("betweenness"))
    return got.filter("src is null").select(F.col("dst").alias("node"), "betweenness"), got.filter("src is not null")


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, edges in both directions, by labels that spread until they rest."""
    label = nodes.select(F.col("node").cast("bigint").alias("node"), F.col("node").cast("bigint").alias("component"))
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct().toDF("src", "dst").cache()
    while True:
        low = both.join(label.select(F.col("node").alias("src"), "component"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("m"))
        new = _cut(label.join(low, "node", "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"), (F.col("m") < F.col("component")).alias("moved")))
        if not new.filter("moved").limit(1).count():
            both.unpersist()
            return new.select("node", "component")
        # jump to the label of the label
        up = new.select(F.col("node").alias("component"), F.col("component").alias("up"))
        label = _cut(new.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")))


def incident(edges: DataFrame, node: int) -> DataFrame:
    return edges.filter((F.col("src") == node) | (F.col("dst") == node))


def min_cut(n: int, edges: list[tuple[int, int, float]], sources: list[int], sinks: list[int]) -> tuple[float, set[int]]:
    """(capacity, nodes on the source side) of a least cut of an undirected graph, by blocking flows over level graphs."""
    s, t = n, n + 1
    to, cap, adj = [], [], [[] for _ in range(n + 2)]

    def link(a, b, c, back):
        adj[a].append(len(to))
        to.append(b)
        cap.append(c)
        adj[b].append(len(to))
        to.append(a)
        cap.append(back)

    for a, b, c in edges:
        link(a, b, c, c)
    for a in sources:
        link(s, a, float("inf"), 0.0)
    for a in sinks:
        link(a, t, float("inf"), 0.0)
    flow = 0.0
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, deque([s])
        while queue:
            v = queue.popleft()
            for e in adj[v]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return flow, {v for v in range(n) if level[v] >= 0}
        at = [0] * (n + 2)
        while True:
            path, v = [], s
            while v != t:
                while at[v] < len(adj[v]) and not (cap[adj[v][at[v]]] > 1e-12 and level[to[adj[v][at[v]]]] == level[v] + 1):
                    at[v] += 1
                if at[v] == len(adj[v]):
                    if not path:
                        break
                    v = to[path.pop() ^ 1]
                    at[v] += 1
                    continue
                path.append(adj[v][at[v]])
                v = to[path[-1]]
            if v != t:
                break
            f = min(cap[e] for e in path)
            for e in path:
                cap[e] -= f
                cap[e ^ 1] += f
            flow += f


def atomic_cycles(edges: list[tuple[int, int]], longest: int = 12) -> list[list[int]]:
    """Cycles of an undirected graph without a chord, each once, from its smallest node."""
    adj: dict[int, set[int]] = {}
    for a, b in edges:
        if a != b:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
    out = []

    def grow(path: list[int]):
        for w in sorted(adj[path[-1]]):
            if w <= path[0] or w in path:
                continue
            inner = adj[w] & set(path[1:-1])
            if inner:
                continue
            if path[0] in adj[w] and len(path) >= 2:
                if path[1] < w:
                    out.append([*path, w])
                continue
            if len(path) + 1 < longest:
                grow([*path, w])

    for v in sorted(adj):
        grow([v])
    return out


def shortcut_edges(edges: list[tuple[int, int]], longest: int = 8) -> list[tuple[int, int]]:
    """Edges of an undirected neighbour graph whose ends are more than ``longest`` - 1 steps apart without them:
    they close a long cycle and are likely shortcuts. Bridges are none."""
    adj: dict[int, set[int]] = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    out = []
    for a, b in edges:
        dist, queue = {a: 0}, deque([a])
        while queue and b not in dist:
            v = queue.popleft()
            for w in adj[v]:
                if w not in dist and {v, w} != {a, b}:
                    dist[w] = dist[v] + 1
                    queue.append(w)
        if b in dist and dist[b] >= longest:
            out.append((a, b))
    return out


def cycle_cut(edges: list[tuple[int, int, float]], longest: int = 8) -> list[tuple[int, int, float]]:
    """The edges left after each long chordless cycle is opened at its longest edge; costs are lengths."""
    left = list(edges)
    while True:
        bad = set(shortcut_edges([(a, b) for a, b, _ in left], longest))
        if not bad:
            return left
        left.remove(max((e for e in left if (e[0], e[1]) in bad), key=lambda e: e[2]))
