"""NumPy kernels over batches of UTF-8 texts: words are runs of bytes other than 0x20 and 0x09-0x0D."""

from __future__ import annotations

import numpy as np

_CHUNK = 1 << 20
_LONG = 8 << 20
_SPACE = b" \t\n\x0b\x0c\r"


def fmix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64 bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """64-bit hashes of all words of many texts at once, by prefix sums of a polynomial over the bytes."""

    def __init__(self, fold: bool = True):
        grid = np.arange(256, dtype=np.uint64)
        self.table = fmix(grid + np.uint64(0x9E3779B97F4A7C15))
        if fold:
            self.table[65:91] = self.table[97:123]
        self.space = np.zeros(256, bool)
        self.space[list(_SPACE)] = True
        self.base = 0x5851F42D4C957F2D
        self.grow(_CHUNK + 1)

    def grow(self, n: int) -> None:
        for name, base in (("power", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def __call__(self, texts: list[bytes]):
        """Yields (index of the first text, hashes, word starts, word ends, text of each word, byte offset of each text)."""
        at = 0
        while at < len(texts):
            if len(texts[at]) > _LONG:
                yield at, *self._long(texts[at])
                at += 1
                continue
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < _CHUNK) and len(texts[end]) <= _LONG:
                size += len(texts[end]) + 1
                end += 1
            yield at, *self._chunk(texts[at:end])
            at = end

    def _chunk(self, texts: list[bytes]):
        joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        n = len(joined)
        if n > len(self.power):
            self.grow(n + 1)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        offsets = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        gap = self.space[joined]
        inside = np.concatenate(([False], ~gap)).view(np.int8)
        turn = np.diff(np.concatenate((inside, np.zeros(1, np.int8))))
        starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[joined] * self.power[:n], out=sums[1:])
        hashes = fmix((sums[ends] - sums[starts]) * self.inverse[starts])
        owner = np.searchsorted(offsets, starts, "right") - 1
        return hashes, starts - offsets[owner], ends - offsets[owner], owner, len(texts)

    def _long(self, text: bytes):
        """One very long text, by segments that end in white space, so that memory stays bounded."""
        parts, at = [], 0
        while at < len(text):
            end = min(at + _LONG, len(text))
            while end < len(text) and text[end] not in _SPACE:
                end += 1
            h, s, e, _, _ = self._chunk([text[at:end]])
            parts.append((h, s + at, e + at))
            at = end
        h, s, e = (np.concatenate(x) for x in zip(*parts))
        self.grow(_CHUNK + 1)
        return h, s, e, np.zeros(len(h), np.int64), 1


_MULT = (0x9FB21C651E98DF25, 0xA24BAED4963EE407, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def shingle_sets(hasher: WordHasher, texts: list[bytes], k: int):
    """For each text, in order, the sorted distinct hashes of its k-word shingles.

    A text with fewer than k words has its whole word sequence as its one shingle; one without
    words has none.
    """
    for _, h, _, _, owner, n_texts in hasher(texts):
        counts = np.bincount(owner, minlength=n_texts)
        n = len(h)
        if n >= k:
            full = np.full(n - k + 1, k * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
            for j in range(k):
                full += (h[j : n - k + 1 + j] ^ np.uint64(_MULT[(j + 3) % 6])) * np.uint64(_MULT[j % 6] + 2 * (j // 6))
            full = fmix(full)
        at = 0
        for c in counts.tolist():
            if c >= k:
                s = np.sort(full[at : at + c - k + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif c:
                x = np.uint64(c)
                for j in range(c):
                    x = fmix(np.array([x ^ h[at + j]]) + np.uint64(_MULT[0]))[0]
                yield np.array([x], np.uint64)
            else:
                yield h[:0]
            at += c


def coordinate_keys(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed multipliers and masks of n min-wise coordinates."""
    seed = np.arange(1, n + 1, dtype=np.uint64)
    return fmix(seed * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1), fmix(seed * np.uint64(0xBF58476D1CE4E5B9))


def signature(shingles: np.ndarray, mult: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """For each coordinate the least 32-bit hash of the shingles (of long sets in blocks)."""
    low = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(low, ((shingles[at : at + 4096, None] ^ mask) * mult).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)
