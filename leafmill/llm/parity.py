"""Shingle sets of texts and their parity sketches."""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import xxhash

from leafmill.llm.frequency import MASK

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_64 = (1 << 64) - 1
#: Words that a worker remembers the hashes of before it starts anew.
REMEMBERED = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams.

    ASCII letters are lower-cased and words are what ASCII white space separates; a text with fewer
    words than ``width`` is one shingle of all of them, one without words has none.
    """

    def __init__(self, width: int):
        self.width = width
        self.known: dict[bytes, int] = {}

    def __call__(self, raw: bytes) -> np.ndarray:
        words = raw.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        get = self.known.get
        if len(self.known) > REMEMBERED:
            self.known.clear()
        hashes = []
        for w in words:
            h = get(w)
            if h is None:
                h = self.known[w] = xxhash.xxh3_64_intdigest(w)
            hashes.append(h)
        h = np.array(hashes, dtype=np.uint64)
        k = min(self.width, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = mix(out * _A + h[i : len(h) - k + 1 + i])
        return np.unique(out)


class Bands:
    """Size bands, and parity sketches in as many parts as a band needs.

    For sets of sizes a and b with Jaccard similarity p/q at least, the symmetric difference has at most
    (q - p)(a + b)/(q + p) elements. Each token flips one bit of a sketch, so that two sketches'
    Hamming distance is no more than that, and of ``spare`` + 1 parts beyond the largest such number
    ``spare`` + 1 agree. A set belongs to the band of its size, and as a guest to the next one if it is
    large enough for a partner there.

    The sketches that are joined by part have 2**32 bits a part, nearly all 0: a part is named by the
    exclusive or of the hashes of its odd bits, to which a bit that is flipped twice adds nothing.

    Of the parts in which two similar sets agree, the rarest is the rarest for both, so each set may
    leave out its ``spare`` most frequent parts, in one order of all parts. Parts without tokens are the
    most frequent in that order: they are left out first, and ``spare`` is chosen so that a set hardly
    ever has more of them.
    """

    def __init__(self, p: int, q: int, ratio: float = 1.4):
        self.p, self.q = p, q
        self.ratio = max(ratio, 1.02 * q / p)
        self.starts = [1]
        self.spares: dict[int, int] = {}

    def _start(self, band: int) -> int:
        while len(self.starts) <= band:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * self.ratio) + 1))
        return self.starts[band]

    def of(self, n: int) -> list[int]:
        self._start(0)
        while self.starts[-1] <= n:
            self._start(len(self.starts))
        out = [bisect_right(self.starts, n) - 1]
        while n * self.q >= self._start(out[-1] + 1) * self.p:
            out.append(out[-1] + 1)
        return out

    def differ(self, sizes: int) -> int:
        """How many elements two similar sets of these sizes together can differ in."""
        return (self.q - self.p) * sizes // (self.q + self.p)

    def most(self, band: int) -> int:
        """How many parts of a band's sketches two similar sets can differ in."""
        return self.differ(2 * (self._start(band + 1) - 1))

    def spare(self, band: int) -> int:
        """0.3 of ``most``, and four standard deviations above the expected number of empty parts."""
        found = self.spares.get(band)
        if found is None:
            most, least = self.most(band), max(1.0, self._start(band) * self.p / self.q)
            found = int(0.3 * most) + 4
            while found <= 3 * most + 30:
                empty = (most + 1 + found) * math.exp(-least / (most + 1 + found))
                if found >= empty + 4 * math.sqrt(empty + 1):
                    break
                found += 2
            self.spares[band] = found
        return found

    def keys(self, shingles: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """For each of the set's bands the 48-bit keys of its parts, and how many of the most frequent may go."""
        out = []
        for band in self.of(len(shingles)) if len(shingles) else []:
            most = self.most(band)
            if most == 0:
                continue  # only equal sets are similar enough at such sizes
            spare = self.spare(band)
            n = most + 1 + spare
            h = mix(shingles + np.uint64((band + 1) * int(_B) & _64))
            part = ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, bits = part[order], mix(h[order] & np.uint64(0xFFFFFFFF))
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            named = np.zeros(n, np.uint64)
            named[part[starts]] = np.bitwise_xor.reduceat(bits, starts)
            names = np.arange(n, dtype=np.uint64) * _C + np.uint64(band * int(_A) & _64)
            key = mix(mix(names) ^ named) & MASK
            empty = n - len(starts)
            if empty <= spare:
                out.append((key[part[starts]], spare - empty))
            else:  # no full part may go, and ``spare`` of the empty ones do
                bare = np.ones(n, bool)
                bare[part[starts]] = False
                out.append((np.concatenate([key[part[starts]], np.sort(key[bare])[: empty - spare]]), 0))
        return out


def sketch(shingles: np.ndarray) -> bytes:
    """A parity sketch of at least two bits a shingle; its size is a power of two, 64 at least."""
    bits = max(64, 1 << int(2 * max(1, len(shingles)) - 1).bit_length())
    parity = np.bincount((mix(shingles ^ _B) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Differing bits of two sketches, the longer one folded to the shorter one's size."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())
