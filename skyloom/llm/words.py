"""Words of whole texts as hashes, computed on the UTF-8 bytes of a batch at once.

A word is a run of bytes other than space and the controls 0x09 to 0x0D, unchanged.
Those bytes stand for themselves in UTF-8, so this equals splitting the text.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
#: Odd random constants of the hashes. They are the same on every executor.
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
SEEDS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_U33, _M1, _M2 = np.uint64(33), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

#: Bytes of text whose words are hashed at once.
SLICE = 1_000_000

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which close numbers end far apart."""
    x = x ^ (x >> _U33)
    x = x * _M1
    x = x ^ (x >> _U33)
    x = x * _M2
    return x ^ (x >> _U33)


def powers(base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        held = np.ones(max(n, 1024), dtype=np.uint64)
        held[1:] = base
        held = np.multiply.accumulate(held)
        _powers[int(base)] = held
    return held[:n]


class Words:
    """Words of a string array: spans of bytes, hashes, and the first word of every text.

    Null texts have no words.
    """

    def __init__(self, texts):
        import pyarrow as pa

        texts = texts.cast(pa.large_string())
        n = len(texts)
        if texts.null_count:
            texts = texts.fill_null("")
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
        lo = ends[0]
        self.data = np.frombuffer(data, dtype=np.uint8)[lo : ends[-1]] if data is not None else np.empty(0, np.uint8)
        self.text_at = ends - lo
        b = self.data
        inside = np.ones(len(b) + 2, dtype=bool)
        inside[0] = inside[-1] = False
        np.logical_and(b != 32, (b < 9) | (b > 13), out=inside[1:-1])
        opens = inside[1:-1] & ~inside[:-2]
        firsts = self.text_at[:-1][np.diff(self.text_at) > 0]
        opens[firsts] |= inside[1:-1][firsts]
        self.begin = np.flatnonzero(opens)
        closes = inside[1:-1] & ~inside[2:]
        lasts = self.text_at[1:][np.diff(self.text_at) > 0] - 1
        closes[lasts] |= inside[1:-1][lasts]
        self.end = np.flatnonzero(closes) + 1
        #: Words of text i are first[i] .. first[i + 1].
        self.first = np.searchsorted(self.begin, self.text_at)
        self.hash = self._hashes(inside[1:-1])

    def _hashes(self, inside: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.begin), np.uint64)
        # In slices, since an array of 8 bytes a byte of text is needed several times.
        at = np.append(np.searchsorted(self.begin, np.arange(0, len(self.data), SLICE)), len(self.begin))
        for a, b in zip(at[:-1], at[1:], strict=True):
            if a == b:
                continue
            begin, length = self.begin[a:b], self.end[a:b] - self.begin[a:b]
            lo, starts = begin[0], np.cumsum(length) - length
            # Bytes of words are exactly the spans, in order.
            places = np.flatnonzero(inside[lo : self.end[b - 1]])
            inner = np.arange(len(places)) - np.repeat(starts, length)
            value = BYTE_CODES[self.data[lo : self.end[b - 1]][places]] * powers(BASE, int(length.max()) + 1)[inner]
            out[a:b] = mix(np.add.reduceat(value, starts) ^ (length.astype(np.uint64) * BASE))
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def runs(self, k: int, seed: int) -> np.ndarray:
        """Hashes of the k words from each word on; runs past a text's end are not told apart."""
        h = mix(self.hash ^ SEEDS[seed])
        n = len(h) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = np.zeros(n, dtype=np.uint64)
        odd = SEEDS[seed + 1]
        for i in range(k):  # Horner's rule, so that order counts
            out = out * odd + h[i : i + n]
        return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours, by doubling."""
    n, have, out = len(x) - w + 1, 1, x
    if n <= 0:
        return x[:0]
    while have * 2 <= w:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[w - have : w - have + n])
