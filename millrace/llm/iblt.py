"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (lines, and within them sentences; longer ones every ``LONG`` characters),
and each distinct paragraph has a 64-bit digest. A sketch has three rows of ``w`` cells; a digest falls
into one cell of each row, and a cell holds how many digests fell in and the XOR of them; 16 bits of a
digest check the others. Subtracting the sketches of two versions cancels what they share. A cell of the
difference with count +1 or -1 and a fitting check is one digest that only one version has; peeling it
out frees others, until nothing is left or no cell is pure. Then the digests are dealt to more cells
(by their leading bits into buckets with sketches of their own) and it starts again, each failed bucket
with twice the cells. What is peeled are the differing digests; their number gives the likeness.

DataFrame functions only: no Python on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import support

LONG = 240
_ROWS = 3
_WIDTH = 4
_RETRIES = 6


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, in order; none for null or blank text."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\n+|(?<=[.!?])[ \t]+")
    cut = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= LONG, F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{LONG}}}"), F.lit(0)))))
    return F.filter(cut, lambda p: p != "")


def digests(text: Column) -> Column:
    """The ascending distinct digests of a text's paragraphs: 48 hash bits, then 16 that check them, so
    that the XOR of several digests is told from a digest."""
    return F.array_sort(F.array_distinct(F.transform(paragraphs(text), lambda p: let(F.xxhash64(p), lambda h: h.bitwiseAND(~0xFFFF).bitwiseOR(_check(h))))))


def _check(key: Column) -> Column:
    return F.xxhash64(key.bitwiseAND(~0xFFFF), F.lit(7)).bitwiseAND(0xFFFF)


def _mask(key: Column, w: Column, salt: Column) -> Column:
    """Bit j is set if the key falls into cell j of a sketch of 3 rows of w cells (w a power of two, 16 at most)."""

    def bits(h):
        one = F.lit(1).cast("long")
        at = [(F.shiftright(h, 8 * r).bitwiseAND(w - 1)).cast("int") + w * r for r in range(_ROWS)]
        return reduce(lambda x, y: x.bitwiseOR(y), [F.call_function("shiftleft", one, x) for x in at])

    return let(F.xxhash64(key, salt), bits)


def sketch(keys: Column, w: Column, salt: Column) -> Column:
    """Array of 3w cells (n, k)."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"))

    def cells(marked):
        return F.transform(F.sequence(F.lit(0), w * _ROWS - 1), lambda j: F.aggregate(marked, zero, lambda c, q: F.when(F.getbit(q["m"], j) == 1, F.struct((c["n"] + 1).alias("n"), c["k"].bitwiseXOR(q["k"]).alias("k"))).otherwise(c)))

    return let(F.transform(keys, lambda k: F.struct(k.alias("k"), _mask(k, w, salt).alias("m"))), cells)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k")))


def peel(cells: Column, w: Column, salt: Column, most: Column) -> Column:
    """The differing digests as array of (k, n: +1 only left, -1 only right); null if peeling gets stuck.
    ``most`` bounds the steps."""
    kind = "array<struct<k:bigint,n:int>>"

    def step(s, _):
        pure = F.get(F.filter(s["cells"], lambda c: ((c["n"] == 1) | (c["n"] == -1)) & (c["k"].bitwiseAND(0xFFFF) == _check(c["k"]))), F.lit(0))

        def apply(q):
            p, m = q["p"], q["m"]
            less = F.transform(s["cells"], lambda c, j: F.when(F.getbit(m, j) == 1, F.struct((c["n"] - p["n"]).alias("n"), c["k"].bitwiseXOR(p["k"]).alias("k"))).otherwise(c))
            more = F.concat(s["out"], F.array(F.struct(p["k"].alias("k"), p["n"].alias("n"))))
            return F.when(p.isNull(), F.struct(s["cells"].alias("cells"), s["out"].alias("out"), F.lit(False).alias("go"))).otherwise(F.struct(less.alias("cells"), more.alias("out"), F.lit(True).alias("go")))

        return F.when(s["go"], let(let(pure, lambda p: F.struct(p.alias("p"), _mask(p["k"], w, salt).alias("m"))), apply)).otherwise(s)

    def finish(s):
        return F.when(F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0)), s["out"])

    return let(cells, lambda cs: F.aggregate(F.sequence(F.lit(0), most), start_of(cs, kind), step, finish))


def start_of(cells: Column, kind: str) -> Column:
    return F.struct(cells.alias("cells"), F.array().cast(kind).alias("out"), F.lit(True).alias("go"))


def _bucketed(keys: Column, bits: Column) -> Column:
    """2^bits arrays of keys, by leading bits; in two steps, so that the work is n sqrt(n) at most."""
    half = (bits / 2).cast("int")

    def lead(k, b):
        return F.when(b == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", k, F.lit(64) - b))

    def groups(ks, upto, low):
        # keys whose bits [64 - upto, 64 - upto + low) are each number of range(2^low)
        return F.transform(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), low) - 1), lambda g: F.filter(ks, lambda k: lead(k, upto).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), low) - 1) == g))

    return F.flatten(F.transform(groups(keys, half, half), lambda part: groups(part, bits, bits - half)))


def differing(a: Column, b: Column, fa: Column, fb: Column) -> Column:
    """How many digests only one of two digest arrays has, by peeling; fa and fb are their sketches of the
    stored width, tried first. Then a bucket for every two digests, each tried with 3x4 cells, then 3x8,
    then 3x16 cells dealt anew. Should the last of these fail as well, the digests are compared one by one."""
    w0 = F.lit(_WIDTH)
    stored = F.size(peel(subtract(fa, fb), w0, F.lit(0), F.lit(_WIDTH * _ROWS)))

    def one(pair):
        def attempt(acc, i):
            def at(w):
                return F.coalesce(F.size(peel(subtract(sketch(pair["x"], w, i), sketch(pair["y"], w, i)), w, i, F.size(pair["x"]) + F.size(pair["y"]))), F.lit(-1))

            return F.when(acc >= 0, acc).otherwise(let(F.least(F.call_function("shiftleft", w0, i), F.lit(16)), at))

        empty = F.when((F.size(pair["x"]) == 0) & (F.size(pair["y"]) == 0), F.lit(0)).otherwise(F.lit(-1))
        return F.aggregate(F.sequence(F.lit(0), F.lit(_RETRIES)), empty, attempt)

    bits = F.ceil(F.log2(F.greatest(F.size(a), F.size(b), F.lit(2)) / 2)).cast("int")

    def larger(bits_):
        pairs = F.zip_with(_bucketed(a, bits_), _bucketed(b, bits_), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        return F.aggregate(F.transform(pairs, one), F.lit(0), lambda s, n: F.when((s >= 0) & (n >= 0), s + n).otherwise(F.lit(-1)), lambda s: F.when(s >= 0, s))

    exact = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    return let(stored, lambda s: F.when(s >= 0, s).otherwise(F.coalesce(let(bits, larger), exact)))


def differences(a: Column, b: Column) -> Column:
    """The digests only one of two digest arrays has, as array of (k, n: +1 only in a, -1 only in b), by the
    same sketches and retries as ``differing``."""

    def one(pair):
        def attempt(acc, i):
            w = F.least(F.call_function("shiftleft", F.lit(_WIDTH), i), F.lit(16))
            return F.coalesce(acc, let(w, lambda v: peel(subtract(sketch(pair["x"], v, i), sketch(pair["y"], v, i)), v, i, F.size(pair["x"]) + F.size(pair["y"]))))

        return F.aggregate(F.sequence(F.lit(0), F.lit(_RETRIES)), F.lit(None).cast("array<struct<k:bigint,n:int>>"), attempt)

    def found(bits):
        pairs = F.zip_with(_bucketed(a, bits), _bucketed(b, bits), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        return F.flatten(F.transform(pairs, one))  # null if a bucket is

    exact = F.concat(*[F.transform(F.array_except(x, y), lambda k, n=n: F.struct(k.alias("k"), F.lit(n).alias("n"))) for x, y, n in ((a, b, 1), (b, a, -1))])
    bits = F.ceil(F.log2(F.greatest(F.size(a), F.size(b), F.lit(2)) / 2)).cast("int")
    return F.coalesce(let(bits, found), exact)


def likeness(a: Column, b: Column, d: Column) -> Column:
    """Shared over all digests, 1 for two texts without paragraphs."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(1.0)).otherwise((n - d) / (n + d))


def text_of(cells: Column) -> Column:
    """A sketch as a string."""
    return F.concat(F.lit(f"iblt:{_ROWS}x{_WIDTH}:"), F.array_join(F.transform(cells, lambda c: F.concat_ws(".", c["n"].cast("string"), F.lower(F.hex(c["k"])))), ","))


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<c>: the columns of the next row by descending (doc_id, text hash), the first for the last.

    Rows are dealt to ranges of the id (cut points from one pass over ids, many more than partitions so
    that they even out); the largest row of each range is copied to the range above it, so each window
    has what it needs and text is shuffled once.
    """
    spark = df.sparkSession
    keyed = df.withColumn("__h", F.xxhash64("text"))
    bounds = support.range_bounds(df, "doc_id", 6 * support.shuffle_partitions(spark))
    keyed = keyed.withColumn("__b", support.bucket_of(F.col("doc_id"), bounds))
    tops = keyed.groupBy("__b").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.col("__h"))).alias("m")).orderBy("__b").collect()
    if not tops:
        return keyed.select("*", *[F.col(c).alias(f"next_{c}") for c in columns]).drop("__h", "__b")
    # where the top row of each range is needed: the range above, the lowest for the very last
    to = {r["__b"]: tops[(i + 1) % len(tops)]["__b"] for i, r in enumerate(tops)}
    goes = F.create_map(*[x for k, v in to.items() for x in (F.lit(k), F.lit(v))])
    top = F.create_map(*[x for r in tops for x in (F.lit(r["__b"]), F.struct(F.lit(r["m"]["d"]).alias("d"), F.lit(r["m"]["__h"]).alias("h")))])
    is_top = (F.coalesce("doc_id", F.lit(-(2**63))) == top[F.col("__b")]["d"]) & (F.col("__h") == top[F.col("__b")]["h"])
    both = F.when(is_top, F.array(F.struct(F.col("__b").alias("b"), F.lit(0).alias("ghost")), F.struct(goes[F.col("__b")].alias("b"), F.lit(1).alias("ghost")))).otherwise(F.array(F.struct(F.col("__b").alias("b"), F.lit(0).alias("ghost"))))
    rows = keyed.withColumn("__to", F.explode(both)).select("*", F.col("__to.b").alias("__at"), F.col("__to.ghost").alias("__ghost")).drop("__to")
    # dealt explicitly, so that partitions of costly rows are not merged by their bytes
    rows = rows.repartition(support.shuffle_partitions(spark), "__at")
    w = Window.partitionBy("__at").orderBy(F.col("__ghost"), F.col("doc_id").desc_nulls_last(), F.col("__h").desc())
    out = rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return out.filter("__ghost = 0").drop("__h", "__b", "__at", "__ghost")


def versions(df: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text replaces the last third of a text by the beginning of the next document, by descending
    id, null ids last. Null text is empty, whole texts are read. Repeated rows stay; equal (id, text) rows are
    neighbours of each other. An empty table gives an empty result; other columns are not read. Likenesses lie
    from 0 to 1 and are never null.
    """
    d = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("d", digests(F.col("text")))
    w, salt = F.lit(_WIDTH), F.lit(0)
    d = d.withColumn("f", sketch(F.col("d"), w, salt))
    d = with_next(d, ["text", "d", "f"])
    third = F.floor(F.col("n_chars") / 3).cast("int")
    d = d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third), F.substring(F.col("next_text"), F.lit(1), third)))
    d = d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "d", "next_d", "f", "next_f", digests(F.col("edited")).alias("e"))
    d = d.withColumn("fe", sketch(F.col("e"), w, salt))
    d = d.select("*", differing(F.col("d"), F.col("e"), F.col("f"), F.col("fe")).alias("de"), differing(F.col("d"), F.col("next_d"), F.col("f"), F.col("next_f")).alias("dn"))
    return d.select("doc_id", "n_chars", "edited_sha256", text_of(F.col("f")).alias("fingerprint"), text_of(F.col("fe")).alias("edited_fingerprint"), likeness(F.col("d"), F.col("e"), F.col("de")).alias("near_edited"), likeness(F.col("d"), F.col("next_d"), F.col("dn")).alias("near_next"))
