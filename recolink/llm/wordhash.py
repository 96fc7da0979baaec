"""Hashes of word sequences: every run of k words of a text in a few vector operations."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240229)
#: A random 64-bit value per byte, and an odd base with its inverse modulo 2**64.
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_RANDOM.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and doubled when it is too short."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * len(have) if have is not None else 1 << 16)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if size <= 1 << 24:
            _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of a text, joined by one blank (``joined``), with the place of each."""

    def __init__(self, text: str | None):
        self.words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes.split() splits at just these blanks
        self.joined = b" ".join(self.words)
        raw = np.frombuffer(self.joined, np.uint8)
        blanks = np.flatnonzero(raw == 32)
        self.starts = np.concatenate([[0], blanks + 1]) if self.words else np.empty(0, np.int64)
        self.ends = np.concatenate([blanks, [len(raw)]]) if self.words else np.empty(0, np.int64)
        self._raw, self._sums = raw, None

    def __len__(self) -> int:
        return len(self.words)

    def spans(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the words from each number in first to that in last; equal runs have equal hashes wherever they stand."""
        size = len(self._raw)
        if self._sums is None:
            self._sums = np.zeros(size + 1, np.uint64)
            np.cumsum(_BYTE[self._raw] * _power(_BASE, size), out=self._sums[1:])
        start = self.starts[first]
        return mixed((self._sums[self.ends[last]] - self._sums[start]) * _power(_INVERSE, size)[start])

    def grams(self, k: int) -> np.ndarray:
        """The hash of each run of k words."""
        n = len(self.words) - k + 1
        return self.spans(np.arange(n), np.arange(k - 1, k - 1 + n)) if n > 0 else np.empty(0, np.uint64)

    def span(self, first: int, k: int) -> bytes:
        """The k words from the given one on, joined."""
        return self.joined[self.starts[first] : self.ends[first + k - 1]]
