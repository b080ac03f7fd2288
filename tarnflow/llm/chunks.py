"""Content-defined chunking of texts with a gear rolling hash."""
from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Characters under the gear hash: a 64-bit gear hash forgets a character after 64 shifts.
WINDOW = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2^64
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64's finish)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(1)
def gear_table() -> np.ndarray:
    """A random 64-bit number for every code point."""
    return mix((np.arange(0x110000, dtype=np.uint64) + _U(1)) * _ODD)


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i = 0..n."""
    inverse = pow(_BASE, -1, 2**64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n + 1, _U(b))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Chunked:
    """Cuts and substring digests of a block of texts, laid end to end.

    The gear hash at a place covers the WINDOW characters that start there. A cut is a place whose hash is the least
    among `spread` successive places of one text (the last such place in a tie), so any spread + WINDOW - 1
    characters that two texts have in common hold a cut that both texts make, at the same characters; cuts are at
    most `spread` apart, and an insertion moves only the cuts around it. Texts shorter than that have none.
    """

    def __init__(self, texts: list[str], spread: int):
        joined = "".join(texts)
        self.code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(t) for t in texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(length)])
        n = len(self.code)
        value = gear_table()[self.code]
        room = 1 << max(10, n.bit_length())
        self._up, self._down = _powers(room)
        self._sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * self._up[:n], dtype=np.uint64)])
        self.text, self.cut = self._cuts(value, length, spread)

    def _cuts(self, value: np.ndarray, length: np.ndarray, spread: int) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        n, places = len(value), len(value) - WINDOW + 1
        if places < spread:
            return none
        h, w = value, 1
        while w < WINDOW:  # the gear hash of 2w characters from those of w: shift one, add the other
            h = (h[: n - 2 * w + 1] << _U(w)) + h[w : n - w + 1]
            w *= 2
        # least hash of `spread` successive places: prefix and suffix minima of blocks (van Herk)
        rows = -(-places // spread)
        padded = np.full(rows * spread, _U(2**64 - 1))
        padded[:places] = h
        block = padded.reshape(rows, spread)
        ahead = np.minimum.accumulate(block, axis=1).ravel()
        behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        spans = places - spread + 1
        least = np.minimum(behind[:spans], ahead[spread - 1 : spread - 1 + spans])
        # spans that lie in one text
        usable = length - (WINDOW + spread - 1) + 1
        has = usable > 0
        inside = np.zeros(spans + 1, np.int8)
        inside[self.start[:-1][has]] += 1
        np.add.at(inside, np.minimum((self.start[:-1] + usable)[has], spans), -1)
        inside = np.cumsum(inside[:spans]) > 0
        enters = h[spread - 1 : spread - 1 + spans] == least
        fresh = inside.copy()
        fresh[1:] &= (least[1:] != least[:-1]) | enters[1:] | ~inside[:-1]
        first = np.zeros(spans, bool)
        first[self.start[:-1][has]] = True
        at = np.flatnonzero(fresh | (first & inside))
        cut = at + spread - 1
        search = np.flatnonzero(~enters[at])
        for k in range(0, len(search), 4096):
            s = at[search[k : k + 4096]]
            view = h[s[:, None] + np.arange(spread)[::-1]]
            cut[search[k : k + 4096]] = s + spread - 1 - np.argmin(view, axis=1)
        text = np.searchsorted(self.start, at, side="right") - 1
        both = np.unique(text * (n + 1) + cut)
        return both // (n + 1), both % (n + 1)

    def digest(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit digests (as int64) of the substrings [begin, end) of the block; equal texts, equal digests."""
        poly = (self._sum[end] - self._sum[begin]) * self._down[begin]
        return mix(poly ^ mix((end - begin).astype(np.uint64) * _ODD)).view(np.int64)
