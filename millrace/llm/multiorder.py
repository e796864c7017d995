"""N-gram Jaccard join by multiple-global-order filtering.

Two sets of sizes x and y with Jaccard similarity at least t share at least a = ceil(t / (1 + t) (x + y))
members, so under any one order of all tokens their prefixes of size n - ceil(t n) + 1 share a token, and
at least a - max(x - prefix, y - prefix) tokens. Candidates must pass that bound under every one of
several orders before any whole set is sent anywhere.

The first order makes candidates, by an equality join on its prefix tokens. It begins with the tokens of a
fixed part of the hash space (level 0), rare ones first; then come all others by hash, and last those that
a sketch of all documents' tokens (fixed size) finds in more than ``HEAVY`` of the documents. Counts within
level 0 are exact: its tokens are dealt by token once, and what only one set has is dropped there. A set
with a prefix's worth of such lonely tokens links with nothing and is done. The other orders are by hash;
their prefixes travel as bitmaps, as does the whole set: what one bitmap has and the other lacks are at
least so many tokens that the other set lacks, so the bounds tested on them reject no pair that links.

Documents of equal sets are one node. Links inside a component need not all be found: first every node
is compared with leaders it meets, which joins large groups of near copies in some comparisons a member: the
leader met in most prefix tokens, and leaders of equal heads (the first tokens under further orders). Then all pairs that meet in a prefix token, still lie in different
components and pass the filters of all orders are compared. So components are exact, and a group of k near
copies costs some k comparisons, not k squared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import support
from .components import components
from .kernels import U64, mix, shingle_sets

ORDERS = 3
SKETCH_BITS = 22
#: Level 0: this share of the tokens, by hash; a little more than the prefix of a set at 0.8 or more.
LEVEL0 = {80: 0.27, 85: 0.22}
HEAVY = 0.005
#: Heads: sets whose ``HEAD`` first tokens under one of ``HEADS`` further orders agree are likely links.
HEADS, HEAD = 16, 20
#: Words of 64 bits: of the whole set, then of the prefix under each order but the first.
WHOLE, PREFIX = 4, 2
_CHUNK = 1 << 16
_NULL_ID = -(2**63)


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1 if n else 0


def short_prefix(n: int, num: int, den: int) -> int:
    """Of two sets the smaller one shares a token of this prefix with the prefix of the larger one."""
    return n - _need(n, n, num, den) + 1 if n else 0


def order_key(tokens: np.ndarray, k: int) -> np.ndarray:
    """Sort key of tokens under hash order k."""
    return mix(tokens + U64((k + 1) * 0xA24BAED4963EE407 % (1 << 64)))


def sketch_at(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U64(64 - SKETCH_BITS)).astype(np.int64)


def heads(tokens: np.ndarray) -> list[int]:
    """For each further order a hash of the order's number and the first tokens under it."""
    out = []
    for k in range(HEADS):
        key = order_key(tokens, 100 + k)
        first = tokens if len(tokens) <= HEAD else tokens[np.argpartition(key, HEAD - 1)[:HEAD]]
        out.append(int(mix(np.bitwise_xor.reduce(mix(first)) ^ U64(k + 1)).view(np.int64)))
    return out


def _bitmap(tokens: np.ndarray, words: int) -> list[int]:
    bits = np.zeros(64 * words, np.uint8)
    bits[(mix(tokens) % U64(64 * words)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<i8").tolist()


def marks(tokens: np.ndarray, num: int, den: int) -> list[int]:
    """Bitmaps of the whole set and of its prefixes under the orders after the first."""
    p, out = prefix_size(len(tokens), num, den), _bitmap(tokens, WHOLE)
    for k in range(1, ORDERS):
        out += _bitmap(tokens if p >= len(tokens) else tokens[np.argpartition(order_key(tokens, k), p - 1)[:p]], PREFIX)
    return out


def _lacks(x: list[int], y: list[int], lo: int, hi: int) -> int:
    """Tokens of x, at least so many, that y lacks, by words lo..hi of their bitmaps."""
    return sum((x[i] & ~y[i] & (2**64 - 1)).bit_count() for i in range(lo, hi))


def may_link(n: int, x: list[int], m: int, y: list[int], num: int, den: int) -> bool:
    """The filters of all orders but the first on the marks of two sets of n and m members."""
    need = _need(n, m, num, den)
    if need > min(n, m) or _lacks(x, y, 0, WHOLE) > n - need or _lacks(y, x, 0, WHOLE) > m - need:
        return False
    p, q = prefix_size(n, num, den), prefix_size(m, num, den)
    least = max(1, need - max(n - p, m - q))
    ends = [(WHOLE + PREFIX * k, WHOLE + PREFIX * (k + 1)) for k in range(ORDERS - 1)]
    return all(_lacks(x, y, *e) <= p - least and _lacks(y, x, *e) <= q - least for e in ends)


def set_digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed numbers."""
    if not len(tokens):
        return 0, 0
    m = mix(tokens + U64(1))
    x, y = int(np.bitwise_xor.reduce(m)), int(np.add.reduce(mix(m ^ U64(0x5851F42D4C957F2D))))
    h = int(mix(np.array([x ^ (len(tokens) * 0x9E3779B97F4A7C15 & (2**64 - 1))], U64))[0])
    return h - (1 << 64) if h >> 63 else h, y - (1 << 64) if y >> 63 else y


def _need(x: int, y: int, num: int, den: int) -> int:
    return -(-num * (x + y) // (num + den))


def join(df: DataFrame, k: int = 4, num: int = 85, den: int = 100, rounds: int = 1, block: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row: sets of k-word shingles linked at num/den or more.

    Null, empty and wordless texts have no shingles and link with nothing, not even one another; a text
    of fewer than k words is one shingle. Rows that repeat stay, each linked with the others. A null id
    counts as the smallest. An empty table gives an empty result. Other columns are not read. Whole texts
    are read, in batches of 100.
    """
    with support.scratch(df.sparkSession) as work:
        out = _join(df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), k, num, den, rounds, block, work)
        return support.kept(out, "jaccard")[0]


def _join(docs: DataFrame, k: int, num: int, den: int, rounds: int, block: int, work: support.Scratch) -> DataFrame:
    spark = docs.sparkSession
    size, parts = 1 << SKETCH_BITS, support.shuffle_partitions(spark)

    def first_pass(batches):
        """A digest of each set, and at the end this task's counts of all tokens."""
        counts = np.zeros(size, np.uint32)
        for b in batches:
            texts = b.column(1).to_pylist()
            for at in range(0, len(texts), 100):
                sets = shingle_sets(texts[at : at + 100], k)
                dig = [set_digest(s) for s in sets]
                if any(len(s) for s in sets):
                    np.add.at(counts, sketch_at(np.concatenate(sets)), 1)
                m = len(sets)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(at, m), "n": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array([d[0] for d in dig], pa.int64()), "more": pa.array([d[1] for d in dig], pa.int64()), "chunk": pa.nulls(m, pa.int32()), "counts": pa.nulls(m, pa.binary())})
        for c in np.flatnonzero(counts.reshape(-1, _CHUNK).any(1)):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()), "node": pa.nulls(1, pa.int64()), "more": pa.nulls(1, pa.int64()), "chunk": pa.array([c], pa.int32()), "counts": pa.array([counts[c * _CHUNK : (c + 1) * _CHUNK].tobytes()], pa.binary())})

    first = work.keep(docs.mapInArrow(first_pass, "doc_id bigint, n bigint, node bigint, more bigint, chunk int, counts binary"), "sets")
    digests = first.filter("chunk is null").select("doc_id", "n", "node", "more")

    doc = F.coalesce("doc_id", F.lit(_NULL_ID))
    nodes = work.keep(digests.filter("n > 0").groupBy("node", "more").agg(F.min(doc).alias("doc"), F.first("n").alias("n"), F.count(F.lit(1)).alias("c")), "nodes")
    n_docs = nodes.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()["n"]
    # sets of one first half of a digest: the second half is their node then. Some at 10^10 sets, none below.
    twice = {r["node"] for r in nodes.groupBy("node").count().filter("count > 1").select("node").collect()}
    if twice:
        one = F.when(F.col("node").isin(*twice), F.col("more")).otherwise(F.col("node"))
        nodes, digests = nodes.withColumn("node", one), digests.withColumn("node", one)

    def node_of(tokens: np.ndarray) -> int:
        d = set_digest(tokens)
        return d[1] if d[0] in twice else d[0]

    def add_up(batches):
        """The chunks of a task: which counters are heavy, a bit each."""
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for c, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(raw, np.uint32)
                total[c] = total[c] + x if c in total else x.astype(np.uint64)
        for c, x in total.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "heavy": pa.array([np.packbits(x > max(1000, HEAVY * n_docs)).tobytes()], pa.binary())})

    bits = np.zeros(size // 8, np.uint8)
    for r in first.filter("chunk is not null").select("chunk", "counts").repartition(min(parts, size // _CHUNK), "chunk").mapInArrow(add_up, "chunk int, heavy binary").collect():
        bits[r["chunk"] * _CHUNK // 8 : (r["chunk"] + 1) * _CHUNK // 8] = np.frombuffer(r["heavy"], np.uint8)
    heavy_at = spark.sparkContext.broadcast(bits)  # one bit a counter, whatever the input
    share = LEVEL0.get(num * 100 // den, 1.6 * (1 - num / den))
    below = U64(int(min(1.0, share) * (2**64 - 1)))

    def prefixes(batches):
        """All tokens of level 0, and beyond as far as the prefix may reach; each set once a task. reach: how
        far the prefix reaches past the tokens given; short: how much sooner the short prefix ends."""
        heavy, seen = np.unpackbits(heavy_at.value).astype(bool), set()
        for b in batches:
            texts = b.column(1).to_pylist()
            for at in range(0, len(texts), 100):
                names, tokens, levels = [], [], []
                for s in shingle_sets(texts[at : at + 100], k):
                    if not len(s) or (name := node_of(s)) in seen:
                        continue
                    seen.add(name)
                    p, key = prefix_size(len(s), num, den), order_key(s, 0)
                    level = np.where(heavy[sketch_at(s)], 2, np.where(key < below, 0, 1)).astype(np.int8)
                    pick = np.flatnonzero(level == 0)
                    if len(pick) < p:
                        pick = np.lexsort((key, level))[:p]
                    tokens.append(s[pick])
                    levels.append(level[pick])
                    names.append((name, p - len(pick), p - short_prefix(len(s), num, den)))
                if names:
                    each = np.repeat(np.array(names, np.int64), [len(x) for x in tokens], axis=0)
                    yield pa.RecordBatch.from_pydict({"token": pa.array(np.concatenate(tokens).view(np.int64)), "node": pa.array(each[:, 0]), "level": pa.array(np.concatenate(levels)), "reach": pa.array(each[:, 1].astype(np.int32)), "short": pa.array(each[:, 2].astype(np.int32))})

    # dealt by token once: counted, and kept where two different sets have the token
    rows = docs.mapInArrow(prefixes, "token bigint, node bigint, level byte, reach int, short int").repartition(parts, "token")
    each = Window.partitionBy("token")
    common = rows.withColumn("df", F.count(F.lit(1)).over(each)).filter("df > 1").withColumn("lo", F.min("node").over(each)).withColumn("hi", F.max("node").over(each)).filter("lo <> hi").drop("lo", "hi")
    # of the given tokens those that only one set has stand first; equal rows (of other tasks) rank alike
    by = Window.partitionBy("node")
    rank = F.dense_rank().over(by.orderBy("level", "df", "token"))
    live = common.withColumn("rank", rank).withColumn("all", F.max("rank").over(by))
    over = F.col("rank") - F.col("all") - F.col("reach")  # places after the end of the prefix
    live = live.filter(over <= 0).select("token", "node", (over + F.col("short") <= 0).alias("early")).dropDuplicates(["node", "token"])
    live = work.keep(live, "shared")
    live = live.join(live.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("token"), "token")
    live = work.keep(live, "live")
    alive = work.keep(live.select("node").distinct().join(nodes.select("node", "doc"), "node"), "alive")
    few = alive.count() <= 500_000  # 8 MB at most go to all machines; else the texts are joined by shuffle

    def whole(batches):
        seen: set[int] = set()
        for b in (x.slice(at, 100) for x in batches for at in range(0, x.num_rows, 100)):
            got = [(w, s) for w, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist(), k)) if w not in seen and len(s) and node_of(s) == w]
            got = list(dict(got).items())
            seen.update(w for w, _ in got)
            yield pa.RecordBatch.from_pydict({"node": pa.array([w for w, _ in got], pa.int64()), "n": pa.array([len(s) for _, s in got], pa.int64()), "tokens": pa.array([s.tobytes() for _, s in got], pa.binary()), "heads": pa.array([heads(s) for _, s in got], pa.list_(pa.int64())), "marks": pa.array([marks(s, num, den) for _, s in got], pa.list_(pa.int64()))})

    # each live set from one document that has it; rows that repeat that document repeat it once a task
    want = alive.select("doc", F.col("node").alias("want"))
    keyed = docs.select(doc.alias("doc"), "text").join(F.broadcast(want) if few else want, "doc")
    sets = work.keep(keyed.select("want", "text").mapInArrow(whole, "node bigint, n bigint, tokens binary, heads array<bigint>, marks array<bigint>"), "alive-sets")

    def compare(pairs: DataFrame) -> DataFrame:
        """pairs (a, b) -> those that link. The set of a leads, those of b follow; groups are dealt by
        (a, a part of b), so a leader of many followers is copied to many tasks."""
        salt = F.pmod(F.xxhash64("b"), F.lit(16)).cast("int")
        asked = pairs.select("a", salt.alias("salt")).distinct().select(F.col("a").alias("node"), "a", "salt", F.lit(None).cast("bigint").alias("b"))
        asked = asked.union(pairs.select(F.col("b").alias("node"), "a", salt.alias("salt"), "b"))
        both = asked.join(sets.select("node", "marks", "tokens"), "node").select("a", "salt", "b", "marks", "tokens")
        both = both.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

        def run(batches):
            name, lead, lead_marks = None, None, None
            for batch in batches:
                got_a, got_b = [], []
                for a, salt_, b, m, raw in zip(*(c.to_pylist() for c in batch.columns)):
                    s = np.frombuffer(raw, U64)
                    if b is None:
                        name, lead, lead_marks = (a, salt_), s, m
                        continue
                    assert name == (a, salt_)
                    if may_link(len(lead), lead_marks, len(s), m, num, den):
                        common = _shared(lead, s)
                        if den * common >= num * (len(lead) + len(s) - common):
                            got_a.append(a)
                            got_b.append(b)
                yield pa.RecordBatch.from_pydict({"a": pa.array(got_a, pa.int64()), "b": pa.array(got_b, pa.int64())})

        return both.mapInArrow(run, "a bigint, b bigint")

    links, comp = None, None
    first_of = sets.select("node", F.explode("heads").alias("token"))

    def named(rows_: DataFrame) -> DataFrame:
        if comp is None:
            return rows_.withColumn("comp", F.col("node"))
        return rows_.join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")

    for r in range(rounds):
        # buckets with one leader each, another in each round: heads, and at first prefix tokens too
        now = first_of.withColumn("prefix", F.lit(0))
        now = named(now.union(live.select("node", "token", F.lit(1))) if r == 0 else now)
        low = now.groupBy("token").agg(F.min(F.struct(F.xxhash64("node", F.lit(r)).alias("h"), "comp", "node")).alias("low"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token", F.col("low.node").alias("a"), F.col("low.comp").alias("ac"))
        met = now.join(low, "token").filter("comp <> ac").select("node", "a", "prefix").repartition(parts, "node")
        met = met.groupBy("node", "a").agg(F.sum("prefix").alias("c"), F.min("prefix").alias("p"))
        # all leaders of heads; a prefix meets many leaders: the one met most often
        met = met.groupBy("node").agg(F.collect_list(F.when(F.col("p") == 0, F.col("a"))).alias("x"), F.max_by(F.when(F.col("c") > 0, F.col("a")), F.struct("c", "a")).alias("y"))
        met = met.select(F.col("node").alias("b"), F.explode(F.array_distinct(F.array_compact(F.concat("x", F.array("y"))))).alias("a"))
        found = work.keep(compare(met), "links")
        links = found if links is None else links.union(found)
        comp = components(links)
    # the rest: all pairs that meet and lie in different components and pass under every order; a token of more
    # than ``block`` sets is a grid of blocks, each pair of blocks a task of its own
    now = named(live)
    mixed = now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo <> hi").select("token", F.ceil(F.col("m") / block).cast("int").alias("grid"))
    now = now.join(mixed, "token").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("grid")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("grid") - 1)))
    now = now.withColumn("task", F.xxhash64("token", F.least("mine", "other"), F.greatest("mine", "other"))).withColumn("side", F.when(F.col("grid") > 1, F.signum(F.col("mine") - F.col("other"))).otherwise(0).cast("int"))
    now = now.select("node", "task", "side", "comp", "early").join(sets.select("node", "n", "marks"), "node").repartition(parts, "task").sortWithinPartitions("task")

    def meet(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            x = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)] + [b.column(6).flatten().to_numpy().reshape(b.num_rows, -1).view(U64)]
            held = x if held is None else [np.concatenate(p) for p in zip(held, x)]
            last = int(np.searchsorted(held[1], held[1][-1]))  # the last task may go on in the next batch
            yield from _meeting([p[:last] for p in held], num, den)
            held = [p[last:] for p in held]
        if held is not None:
            yield from _meeting(held, num, den)

    pairs = now.select("node", "task", "side", "comp", "early", "n", "marks").mapInArrow(meet, "a bigint, b bigint").distinct()
    last = work.keep(compare(pairs), "links")
    if last.limit(1).count() or comp is None:
        comp = components(last if links is None else links.union(last))
    return _named(digests, nodes, comp)


def _meeting(rows: list[np.ndarray], num: int, den: int):
    """Rows (node, task, side, comp, early, n, marks) in order of task -> pairs of a task that may link."""
    node, task, side, comp, early, n, bits = rows
    cuts = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1], [True])))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if hi - lo < 2 or (comp[lo:hi] == comp[lo]).all():
            continue
        # ascending sizes: the smaller set of a pair stands first and meets by its short prefix
        order = lo + np.lexsort((node[lo:hi], n[lo:hi]))
        m, c, w, sd = n[order], comp[order], bits[order], side[order]
        first = np.flatnonzero(early[order].astype(bool))
        reach = np.searchsorted(m * num, m * den, "right")  # sets up to this one are not too large
        for at in range(0, len(first), 64):
            i = first[at : at + 64]
            j0, j1 = i[0] + 1, int(reach[i].max())
            if j1 <= j0:
                continue
            j = np.arange(j0, j1)
            ok = (j > i[:, None]) & (j < reach[i][:, None]) & (c[i][:, None] != c[j])
            if side[lo:hi].any():
                ok &= sd[i][:, None] != sd[j]
            p, q = np.nonzero(ok)
            p, q = i[p], j[q]
            x, y = m[p], m[q]
            need = -(-num * (x + y) // (num + den))
            px, py = x - -(-num * x // den) + 1, y - -(-num * y // den) + 1
            least = np.maximum(1, need - np.maximum(x - px, y - py))
            for k in range(ORDERS):
                cols = slice(0, WHOLE) if k == 0 else slice(WHOLE + PREFIX * (k - 1), WHOLE + PREFIX * k)
                u, v = w[p, cols], w[q, cols]
                most_u, most_v = (x - need, y - need) if k == 0 else (px - least, py - least)
                good = (np.bitwise_count(u & ~v).sum(1) <= most_u) & (np.bitwise_count(v & ~u).sum(1) <= most_v)
                p, q, x, y, need, px, py, least = (z[good] for z in (p, q, x, y, need, px, py, least))
            if len(p):
                yield pa.RecordBatch.from_pydict({"a": pa.array(node[order[p]]), "b": pa.array(node[order[q]])})


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Common members of two ascending arrays of distinct tokens."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _named(digests: DataFrame, nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """Nodes back to documents: the component of each, by its smallest document."""
    known = comp.join(nodes.select("node", "doc"), "node")
    low = known.groupBy("component").agg(F.min("doc").alias("low"))
    per = known.join(low, "component").select("node", "low")
    per = nodes.join(per, "node", "left").select("node", F.nullif(F.coalesce("low", "doc"), F.lit(_NULL_ID)).alias("component_id"))
    full = digests.filter("n > 0").join(per, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(digests.filter("n = 0").select("doc_id", F.lit(0).cast("bigint"), F.col("doc_id")))


def brute(texts: dict, k: int = 4, num: int = 85, den: int = 100) -> dict:
    """id -> (set size, component) by comparing all pairs; for tests."""
    ids = sorted(texts)
    sets = dict(zip(ids, ({*s.tolist()} for s in shingle_sets([texts[i] for i in ids], k))))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def representatives(df: DataFrame, **kw) -> DataFrame:
    """The rows of df whose document is the smallest of its component; rows that repeat id and text are one."""
    found = join(df, **kw)
    keep = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    out = df.join(keep, df["doc_id"].cast("bigint").eqNullSafe(keep["__id"]), "left_semi")
    if found.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        out = out.withColumn("__h", F.xxhash64("text")).dropDuplicates(["doc_id", "__h"]).drop("__h")
    return out
