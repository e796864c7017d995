"""SentencePiece encoding and decoding by a streaming Viterbi search.

The best segmentation under additive piece scores. Characters are read one after the other; only the
scores of the last ``longest piece`` boundaries are kept. A boundary that every surviving backpointer
path runs through is final, so all ids up to it are committed and their backpointers forgotten. Such a
boundary is certain wherever no piece of the vocabulary can span it (before a blank that follows another
character, before a mark that follows a letter, and on both sides of a character that stands in no longer
piece); texts are read in chunks between these, and the ids of short chunks are remembered in two
generations. Elsewhere the live paths are traced back.

Scores come from the model file. A model whose pieces were made by merging is searched with the same
scores, so ids equal those of the library when it loads that vocabulary as a unigram model.
"""

from __future__ import annotations

import math
import re
import string
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANK = "▁"
_UNKNOWN_PENALTY = 10.0


class Pieces:
    """The vocabulary of a model file (identity normalisation only)."""

    def __init__(self, path: str | None = None, proto: bytes | None = None, remember: int = 250_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        m.ParseFromString(proto)
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("only identity normalisation that keeps white space is supported")
        self.dummy, kinds = n.add_dummy_prefix, pb.ModelProto.SentencePiece
        self.text = [p.piece for p in m.pieces]
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == kinds.BYTE}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.control = {i for i, p in enumerate(m.pieces) if p.type == kinds.CONTROL}
        self.unk = next(i for i, p in enumerate(m.pieces) if p.type == kinds.UNKNOWN)
        usable = [(p.piece, p.score, i) for i, p in enumerate(m.pieces) if p.type == kinds.NORMAL]
        if any(p.type == kinds.USER_DEFINED for p in m.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.ids = {t: (s, i) for t, s, i in usable}
        self.unk_score = min(s for _, s, _ in usable) - _UNKNOWN_PENALTY
        self.longest = max(len(t) for t, _, _ in usable)
        #: score of each piece, and minus infinity for what only begins one
        self.begins = {t[:n]: -math.inf for t, _, _ in usable for n in range(1, len(t))} | {t: s for t, s, _ in usable}
        pairs = {t[i : i + 2] for t, _, _ in usable for i in range(len(t) - 1)}
        self.cuts_before_blank = not any(a != _BLANK and b == _BLANK for a, b in pairs)
        inside = {c for x in pairs for c in x}
        own = re.escape("".join(c for c in "\n\t\r" if c not in inside))
        letters = "".join(c for c in map(chr, range(0x41, 0x100)) if c.isalpha())
        after = re.escape("".join(c for c in string.punctuation if not any(x + c in pairs for x in letters)))
        stop = f"{_BLANK}{own}"
        cut = f"[^{stop}{letters}]*+[{letters}]++(?=[{after}])|" if after else ""
        self.chunk = re.compile((f"[{own}]|" if own else "") + f"{_BLANK}*+(?:{cut}[^{stop}]+)|{_BLANK}+", re.S)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.remember = remember

    def _emit(self, s: str, a: int, z: int) -> list[int]:
        got = self.ids.get(s[a:z])
        if got:
            return [got[1]]
        return [self.byte[b] for b in s[a:z].encode()] if self.byte else [self.unk]

    def viterbi(self, s: str) -> list[int]:
        """Ids of one chunk. The earliest start wins among equal scores.

        Boundaries are numbered from the last committed one. A start offers its score plus that of each
        piece to the piece's end; scores before the current start are forgotten with the next commit.
        """
        out: list[int] = []
        base, n, longest, begins, low = 0, len(s), self.longest, self.begins, -math.inf
        score, back = [0.0], [0]
        reach = 0  # the furthest boundary offered to
        for start in range(n):
            k = start - base
            if k and k == reach or k > 4 * longest:  # nothing spans this boundary, or it is time to look for a common one
                cut = k if k == reach else self._common(back, k, reach + 1)
                if cut:
                    out += self._walk(s, base, back, cut)
                    score, back = score[cut:], [b - cut if b >= cut else min(b, 0) for b in back[cut:]]
                    base, k, reach = base + cut, k - cut, reach - cut
            here, to = score[k], min(n, start + longest)
            if to - base >= len(score):
                more = to - base + 1 - len(score)
                score += [low] * more
                back += [-1] * more
            at = k
            for end in range(start + 1, to + 1):
                v = begins.get(s[start:end])
                if v is None:
                    break
                at += 1
                v += here
                if v > score[at]:
                    score[at], back[at] = v, k
                    if at > reach:
                        reach = at
            if s[start] not in self.ids:
                v = here + self.unk_score
                if v > score[k + 1]:
                    score[k + 1], back[k + 1] = v, k
                    if k + 1 > reach:
                        reach = k + 1
        return out + self._walk(s, base, back, n - base)

    @staticmethod
    def _common(back, k, upto) -> int:
        """The last boundary that the paths of all live boundaries (those from k on) share."""
        live = {x for x in range(k, upto) if back[x] >= 0}
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(back[top])
        at = live.pop()
        return at if at < k else back[at]

    def _walk(self, s, base, back, at) -> list[int]:
        ends = []
        while at:
            ends.append((back[at], at))
            at = back[at]
        return [i for a, z in reversed(ends) for i in self._emit(s, base + a, base + z)]

    def __getitem__(self, chunk: str) -> bytes:
        got = self.known.get(chunk)
        if got is None:
            got = self.old.get(chunk)
            if got is None:
                got = np.array(self.viterbi(chunk), "<u4").tobytes()
            if len(chunk) <= 64:
                if len(self.known) >= self.remember:
                    self.old, self.known = self.known, {}
                self.known[chunk] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; an empty one has none."""
        if not text:
            return np.empty(0, np.uint32)
        s = (_BLANK if self.dummy else "") + text.replace(" ", _BLANK)
        chunks = self.chunk.findall(s) if self.cuts_before_blank else [s]
        return np.frombuffer(b"".join(map(self.__getitem__, chunks)), "<u4")

    def decode(self, ids) -> str:
        """The text of the ids; bytes that are not UTF-8 become U+FFFD, control ids nothing."""
        out, held = [], bytearray()
        for i in map(int, ids):
            if i in self.of_byte:
                held.append(self.of_byte[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i not in self.control:
                out.append(" ⁇ " if i == self.unk else self.text[i].replace(_BLANK, " "))
        if held:
            out.append(held.decode("utf-8", "replace"))
        s = "".join(out)
        return s[1:] if self.dummy and s[:1] == " " else s

    def decode_fast(self, ids: np.ndarray) -> str:
        """decode() by table: bytes of each piece joined, for valid ids without control or unknown ones."""
        if not hasattr(self, "_raw"):
            self._raw = [bytes([self.of_byte[i]]) if i in self.of_byte else b"" if i in self.control else " ⁇ ".encode() if i == self.unk else t.replace(_BLANK, " ").encode() for i, t in enumerate(self.text)]
        s = b"".join(map(self._raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return s[1:] if self.dummy and s[:1] == " " else s


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One a worker process, so later tasks find the chunks of earlier ones."""
    return Pieces(path)


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text. Null and empty texts have no ids; repeated rows stay;
    other columns are dropped."""

    def run(batches):
        p = pieces(model)
        for b in batches:
            got = [p.encode(t.as_py() or "") for t in b.column(1)]
            ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
            flat = np.concatenate(got).astype(np.int32) if got else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decoded(ids: Column, model: str) -> Column:
    """The text of an array of ids; null for null."""

    @F.pandas_udf("string")
    def run(parts: pd.Series) -> pd.Series:
        p = pieces(model)
        return parts.map(lambda x: None if x is None else p.decode(x))

    return run(ids)


def digest(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids_crc32, round_trip): encodes every whole text, decodes the ids again and says
    whether the text came back (a text with U+2581 does not: the format writes blanks with it)."""

    def run(batches):
        p = pieces(model)
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            got = [p.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(g) for g in got], pa.int64()), pa.array([zlib.crc32(g.tobytes()) for g in got], pa.int64()), pa.array([p.decode_fast(g) == t for g, t in zip(got, texts)], pa.bool_())],
                ["doc_id", "n_ids", "ids_crc32", "round_trip"],
            )

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, n_ids bigint, ids_crc32 bigint, round_trip boolean")
