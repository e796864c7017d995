"""Token-ID output as directly addressable codes.

A segment holds the ids of consecutive documents. Ids are cut into chunks of ``chunk_bits`` bits, low
chunk first. Level 0 has one chunk for each id, level l one for each id that needs more than l chunks.
A continuation bitmap per level tells which ids go on, and a rank directory (ones before every 512th
bit) turns a position on one level into its position on the next, so any id is read without decoding
its neighbours.

Layout, little-endian: ``DAC1``, u8 chunk bits, u8 levels, u64 ids; then for each level u64 entries,
the chunks (u8 or u16 each), the bitmap (8 a byte, low bit first), the directory (u64 each).

Files: one Parquet row a segment (part, seq, doc_ids, doc_tokens, n_tokens, payload), written by
Spark's committed writer, so a lost executor leaves no half segment and any file system serves.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import support

_EVERY = 512
SEGMENT = "part int, seq int, doc_ids array<bigint>, doc_tokens array<bigint>, n_tokens bigint, payload binary"


def pack(ids: np.ndarray, chunk_bits: int = 8) -> bytes:
    """The segment of an array of non-negative ids below 2^32."""
    if chunk_bits not in (8, 16):
        raise ValueError("chunk_bits is 8 or 16")
    rest, levels, kind = np.asarray(ids, np.uint32), [], np.uint8 if chunk_bits == 8 else np.uint16
    while True:
        chunks = (rest & np.uint32((1 << chunk_bits) - 1)).astype(kind)
        more = (rest >> np.uint32(chunk_bits)) > 0
        bits = np.packbits(more, bitorder="little")
        ones = np.concatenate(([0], np.cumsum(more)))[: len(more) + 1 : _EVERY].astype("<u8")
        levels.append(struct.pack("<Q", len(rest)) + chunks.tobytes() + bits.tobytes() + ones.tobytes())
        if not more.any():
            break
        rest = rest[more] >> np.uint32(chunk_bits)
    return b"DAC1" + struct.pack("<BBQ", chunk_bits, len(levels), len(ids)) + b"".join(levels)


class Segment:
    """Random access to and bulk decoding of one packed segment."""

    def __init__(self, payload: bytes):
        magic, self.bits, n_levels, self.n = payload[:4], payload[4], payload[5], struct.unpack_from("<Q", payload, 6)[0]
        if magic != b"DAC1":
            raise ValueError("not a segment")
        at, wide, self.levels = 14, self.bits // 8, []
        for _ in range(n_levels):
            (m,) = struct.unpack_from("<Q", payload, at)
            at += 8
            chunks = np.frombuffer(payload, np.uint8 if wide == 1 else "<u2", m, at)
            at += m * wide
            bits = np.frombuffer(payload, np.uint8, (m + 7) // 8, at)
            at += len(bits)
            ones = np.frombuffer(payload, "<u8", m // _EVERY + 1, at)
            at += 8 * len(ones)
            self.levels.append((chunks, bits, ones))
        if at != len(payload):
            raise ValueError("the segment is cut or too long")

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out, shift = 0, 0
        for chunks, bits, ones in self.levels:
            out |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return out
            first = i // _EVERY * _EVERY
            i = int(ones[i // _EVERY]) + int(np.unpackbits(bits[first // 8 : i // 8 + 1], bitorder="little")[: i - first].sum())
            shift += self.bits
        raise ValueError("the last level goes on")

    def decode(self) -> np.ndarray:
        out, where = np.zeros(self.n, np.uint32), None
        for k, (chunks, bits, _) in enumerate(self.levels):
            part = chunks.astype(np.uint32) << np.uint32(k * self.bits)
            if where is None:
                out |= part
            else:
                out[where] |= part
            on = np.unpackbits(bits, bitorder="little", count=len(chunks)).astype(bool)
            where = np.flatnonzero(on) if where is None else where[on]
        return out


#: Texts of these characters alone are the same before and after Unicode normalisation, and lower-casing
#: keeps each a single character of its kind.
_ODD = re.compile("[^\\t\\n\\r -~\u00a1-\u00ac\u00ae-\u00ff]")
_LETTER, _NUMBER = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
#: The words that the tokenizer's own pattern makes of such a text (fixed value).
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the
    others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordEncoder(dict):
    """The library's ids of texts, as bytes of u32: {word: ids}.

    For byte-level tokenizers that lower-case and split a text into words of letters, single digits and
    marks. Texts of plain characters are split here and each distinct word goes through the library's merges
    once; other texts go through the library piece by piece between blanks. A text that holds the string of an
    added token goes through the library as a whole, which gives that token's id. What is known is kept in two
    generations of ``limit`` words each, so memory is bounded. ``CHECK`` compares both ways on a sample.
    """

    CHECK = "The don't, it's I'LL x1990 25.5% (a-b) \u00c9t\u00e9 \u00fcber\u00b2 \u00bc\u00b5 \u00ab\u00e9\u00bb ## ''s '"

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.tok, self.limit, self.old = Tokenizer.from_file(path), limit, {}
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added), re.IGNORECASE).search if added else lambda text: None
        self.model, alphabet = self.tok.model, byte_alphabet()
        self.bytes = {chr(b): "".join(alphabet[x] for x in chr(b).encode()) for b in range(256)}
        if self.encode(self.CHECK) != np.array(self._ids(self.CHECK), "<u4").tobytes():
            raise ValueError("this tokenizer splits texts in another way")

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            plain = word if word.isascii() else "".join(map(self.bytes.__getitem__, word))
            got = np.array([t.id for t in self.model.tokenize(plain)], "<u4").tobytes()
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got

    def encode(self, text: str) -> bytes:
        if self.added(text) is not None:
            return np.array(self._ids(text), "<u4").tobytes()
        if _ODD.search(text) is None:
            return b"".join(map(self.__getitem__, _WORDS.findall(text.lower())))
        parts = []
        for piece in text.replace("\n", " ").split(" "):
            if _ODD.search(piece) is None:
                parts += map(self.__getitem__, _WORDS.findall(piece.lower()))
            else:
                parts.append(np.array(self._ids(piece), "<u4").tobytes())
        return b"".join(parts)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One a worker process, so later tasks find the pieces of earlier ones."""
    return WordEncoder(path)


def write(df: DataFrame, out: str, tokenizer: str, eos: int = 2, segment_tokens: int = 1 << 20, chunk_bits: int = 8, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Encode every text and write the segments to ``out``, documents in ascending id order.

    A null text is empty, an empty one is just ``eos``; rows with a null id come first; rows with equal
    ids keep all copies, ordered by text. An empty table gives no segment. Other columns are not read, whole
    texts are. A segment closes at the first
    document end past ``segment_tokens``; the text goes through one shuffle, range-partitioned by id.
    """
    n = parts or support.shuffle_partitions(df.sparkSession)
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        enc, end, part = encoder(tokenizer), np.array([eos], "<u4").tobytes(), TaskContext.get().partitionId()
        seq, ids, sizes, held, total = 0, [], [], [], 0

        def segment():
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "doc_tokens": pa.array([sizes], pa.list_(pa.int64())), "n_tokens": pa.array([total], pa.int64()), "payload": pa.array([pack(np.frombuffer(b"".join(held), "<u4"), chunk_bits)], pa.binary())})

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                got = enc.encode(t.as_py()) + end
                ids.append(i)
                sizes.append(len(got) // 4)
                held.append(got)
                total += sizes[-1]
                if total >= segment_tokens:
                    yield segment()
                    seq, ids, sizes, held, total = seq + 1, [], [], [], 0
        if ids:
            yield segment()

    rows.mapInArrow(run, SEGMENT).write.mode("overwrite").option("compression", "none").parquet(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a document, from the files alone: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it: segment totals are summed within a part, part
    totals over parts, so no window holds more rows than there are parts or segments of a part.
    """
    segs = spark.read.schema(SEGMENT).parquet(path)
    sizes = segs.select("part", "seq", "n_tokens")
    within = sizes.withColumn("inner", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    per = per.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("outer"))
    first = within.join(per, "part").select("part", "seq", (F.col("inner") + F.col("outer")).alias("first"))

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                docs = np.array(b.column(3)[r].as_py(), np.int64)
                ids = memoryview(Segment(b.column(4)[r].as_py()).decode().astype("<u4").tobytes())
                ends = np.cumsum(docs)
                crc = [zlib.crc32(ids[4 * a : 4 * z]) for a, z in zip(ends - docs, ends)]
                k = len(docs)
                yield pa.RecordBatch.from_pydict({"part": pa.array([b.column(0)[r].as_py()] * k, pa.int32()), "seq": pa.array([b.column(1)[r].as_py()] * k, pa.int32()), "doc_id": b.column(2)[r].values, "local": pa.array(ends - docs), "n_tokens": pa.array(docs), "ids_crc32": pa.array(crc, pa.int64())})

    docs = segs.select("part", "seq", "doc_ids", "doc_tokens", "payload").mapInArrow(run, "part int, seq int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(first, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(pos) -> (pos, token): looks single ids up by global position; each touches one segment and
    ``levels`` chunks of it. Positions outside the file and null ones give no row, repeated ones a row each."""
    segs = spark.read.schema(SEGMENT).parquet(path)
    per = segs.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("outer"))
    meta = segs.select("part", "seq", "n_tokens", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("inner")).join(per, "part")
    meta = meta.select("part", "seq", "n_tokens", (F.col("inner") + F.col("outer")).alias("first"))
    # positions and segments meet by blocks of 2^20 positions, so the join has an equality and deals out
    block = 20
    spans = meta.filter("n_tokens > 0").withColumn("block", F.explode(F.sequence(F.shiftright("first", block), F.shiftright(F.col("first") + F.col("n_tokens") - 1, block))))
    asked = positions.select(F.col("pos").cast("bigint").alias("pos")).withColumn("block", F.shiftright("pos", block))
    hit = asked.join(spans, "block").filter((F.col("pos") >= F.col("first")) & (F.col("pos") < F.col("first") + F.col("n_tokens")))
    hit = hit.groupBy("part", "seq").agg(F.collect_list(F.struct("pos", (F.col("pos") - F.col("first")).alias("at"))).alias("want"))

    def run(batches):
        for b in batches:
            for want, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = Segment(payload)
                yield pa.RecordBatch.from_pydict({"pos": pa.array([w["pos"] for w in want], pa.int64()), "token": pa.array([s[w["at"]] for w in want], pa.int64())})

    return hit.join(segs, ["part", "seq"]).select("want", "payload").mapInArrow(run, "pos bigint, token bigint")


def ids_of(path: str, texts: list[str]) -> list[list[int]]:
    """The ids this module writes for the texts, without the end id."""
    enc = WordEncoder(path)
    return [np.frombuffer(enc.encode(t), "<u4").tolist() for t in texts]
