"""numpy kernels over the UTF-8 bytes of a batch of texts."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_P, _PI = 0x9E3779B97F4A7C55, pow(0x9E3779B97F4A7C55, -1, 1 << 64)
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit over all others."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[:1] = 1
    out[1:] = U64(base)
    return np.multiply.accumulate(out)


class Powers:
    """p^i and p^-i modulo 2^64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.empty(0, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = _powers(_P, n), _powers(_PI, n)
        return self.up, self.down


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = sum of (byte + 1) p^k over k in [i, j)."""
    up, _ = POWERS.get(len(data) + 1)
    h = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of each byte string [lo, hi); equal strings have equal hashes wherever they stand."""
    _, down = POWERS.get(len(h))
    return mix((h[hi] - h[lo]) * down[lo] + (hi - lo).astype(U64))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not white space."""
    edge = np.diff(np.concatenate(([0], (~SPACES[data]).view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """For each text its sorted distinct hashes of k consecutive lower-cased words; the whole sequence
    is the one shingle of a shorter text, and a text without words has none."""
    raw = [(t or "").encode() for t in texts]
    data = LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)] if raw else np.empty(0, np.uint8)
    if not len(data):
        return []
    ends_at = np.cumsum([len(x) + 1 for x in raw])
    lo, hi = words(data)
    wh = span_hash(prefix_hash(data), lo, hi)
    cut = np.searchsorted(lo, ends_at)
    n = np.diff(np.concatenate(([0], cut)))
    out, at = [], 0
    acc = np.zeros(max(0, len(wh) - k + 1), U64)
    for j in range(k):
        acc = mix(acc + wh[j : j + len(acc)] + U64(j + 1)) if len(acc) else acc
    for c in n:
        if c >= k:
            out.append(np.unique(acc[at : at + c - k + 1]))
        elif c:
            x = np.zeros(1, U64)
            for j in range(c):
                x = mix(x + wh[at + j] + U64(j + 1))
            out.append(mix(x + U64(int(c) * 0xD1B54A32D192ED03 % (1 << 64))))
        else:
            out.append(np.empty(0, U64))
        at += c
    return out
