"""Masks and label pictures of one image: windows, distances, regions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def box(mask: np.ndarray, radius: int, low: bool) -> np.ndarray:
    """Least or greatest value of square windows, clipped at the border."""
    pick = np.minimum if low else np.maximum
    for axis in (0, 1):
        out = mask.copy()
        for k in range(1, min(radius, mask.shape[axis] - 1) + 1):
            a, b = (slice(k, None), slice(None, -k)) if axis == 0 else ((slice(None), slice(k, None)), (slice(None), slice(None, -k)))
            out[a] = pick(out[a], mask[b])
            out[b] = pick(out[b], mask[a])
        mask = out
    return mask


def opened(mask: np.ndarray, radius: int) -> np.ndarray:
    return mask if radius <= 0 else box(box(mask, radius, True), radius, False)


def distance(mask: np.ndarray) -> np.ndarray:
    """Steps to the nearest unmarked pixel, -1 if there is none."""
    if mask.all():
        return np.full(mask.shape, -1, np.int64)
    out = np.where(mask, np.int32(1 << 29), np.int32(0))
    for axis in (1, 0):
        at = np.arange(mask.shape[axis], dtype=np.int32)
        at = at if axis == 1 else at[:, None]
        ahead = np.minimum.accumulate(out - at, axis=axis) + at
        back = np.flip(np.minimum.accumulate(np.flip(out + at, axis), axis=axis), axis) - at
        out = np.minimum(ahead, back)
    return out.astype(np.int64)


@dataclass
class Regions:
    """4-connected regions of equal values as runs of rows, in scan order; root is the number of each run's region.

    Regions are numbered by their first pixel; first is its flat index.
    """

    shape: tuple[int, int]
    y: np.ndarray
    start: np.ndarray
    end: np.ndarray
    root: np.ndarray
    first: np.ndarray

    @property
    def n(self) -> np.ndarray:
        return np.bincount(self.root, self.end - self.start, len(self.first)).astype(np.int64)

    def boxes(self) -> np.ndarray:
        """min_x, min_y, max_x, max_y of each region."""
        out = np.tile(np.array([[1 << 30], [1 << 30], [-1], [-1]]), (1, len(self.first)))
        for k, (pick, values) in enumerate(((np.minimum, self.start), (np.minimum, self.y), (np.maximum, self.end - 1), (np.maximum, self.y))):
            pick.at(out[k], self.root, values)
        return out

    def touching(self) -> np.ndarray:
        """Whether each region has a pixel on the border."""
        low_x, low_y, high_x, high_y = self.boxes()
        return (low_x == 0) | (low_y == 0) | (high_x == self.shape[1] - 1) | (high_y == self.shape[0] - 1)

    def pixels(self) -> tuple[np.ndarray, np.ndarray]:
        """(flat index, region) of every pixel, in scan order."""
        size = self.end - self.start
        at = np.repeat(self.y * self.shape[1] + self.start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return at, np.repeat(self.root, size)

    def paint(self, values: np.ndarray, empty=-1) -> np.ndarray:
        """A picture with each region's value."""
        values = np.asarray(values)
        out = np.full(self.shape[0] * self.shape[1], empty, values.dtype if values.dtype == bool else np.int64)
        at, region = self.pixels()
        out[at] = values[region]
        return out.reshape(self.shape)

    def members(self) -> list[np.ndarray]:
        """The flat indices of each region's pixels, in scan order."""
        at, region = self.pixels()
        # Numbers of 16 bits are sorted by their digits.
        order = np.argsort(region.astype(np.uint16) if len(self.first) <= 1 << 16 else region, kind="stable")
        return np.split(at[order], np.cumsum(self.n)[:-1]) if len(self.first) else []


def regions(values: np.ndarray) -> Regions:
    """Regions of a mask, or of equal values from 0 on of a label picture (below 0: no region).

    Rows are cut into runs; runs that overlap a run of their value in the row above are joined, all
    at once: roots hook onto lower roots and paths are halved until nothing changes.
    """
    h, w = values.shape
    flat = values.reshape(-1)
    new = np.ones(h * w, bool)
    np.not_equal(flat[1:], flat[:-1], out=new[1:])
    new[:: max(w, 1)] = True
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], h * w)
    value = flat[begin].astype(np.int64) - (values.dtype == bool)
    keep = value >= 0
    begin, stop, value = begin[keep], stop[keep], value[keep]
    y, start = begin // w, begin % w
    end = stop - y * w
    # The runs of the row above that overlap a run stand next to each other.
    low, high = np.searchsorted(stop, begin - w, "right"), np.searchsorted(begin, stop - w, "left")
    many = np.maximum(0, high - low)
    below = np.repeat(np.arange(len(begin)), many)
    above = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
    same = value[above] == value[below]
    above, below = above[same], below[same]
    root = np.arange(len(begin))
    while True:
        a, b = root[above], root[below]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(further := root[root], root):
            root = further
    head = root == np.arange(len(root))
    return Regions((h, w), y, start, end, (np.cumsum(head) - 1)[root], begin[head])
