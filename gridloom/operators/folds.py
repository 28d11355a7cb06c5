"""Greedy passes over the ordered lists of a batch of images, side by side: numpy over Arrow batches, after the one shuffle by image.

A step of a pass looks at one element of every list at once. Lists of like lengths go together, so that no more than ``CELLS``
elements are held as a table; a longer list goes alone, against what it has kept so far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from gridloom.functions.boxes import CLIPPED, INCLUSIVE

#: Elements that are held side by side, and the length from which on a list goes alone.
CELLS, ALONE = 1 << 18, 1 << 11


def iou_over(a: list[np.ndarray], b: list[np.ndarray], mode: str, most: np.ndarray) -> np.ndarray:
    """Whether boxes overlap by more than ``most``, as ``functions.boxes.iou`` has it; what is not a number counts as more, as in Spark."""
    more = 1.0 if mode == INCLUSIVE else 0.0
    w = np.maximum(np.minimum(a[2], b[2]) - np.maximum(a[0], b[0]) + more, 0.0)
    h = np.maximum(np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]) + more, 0.0)
    shared = w * h
    if mode == CLIPPED:
        sides = [np.maximum(t[2] - t[0], 0.0) * np.maximum(t[3] - t[1], 0.0) for t in (a, b)]
    else:
        sides = [(t[2] - t[0] + more) * (t[3] - t[1] + more) for t in (a, b)]
    union = sides[0] + sides[1] - shared
    if mode not in (CLIPPED, INCLUSIVE):
        return np.where((shared > 0) & (union > 0), shared / union, 0.0) > most
    return ~(shared / (union + (1e-9 if mode == CLIPPED else 1e-6)) <= most)


def walk(lists: pa.Array, columns: list[np.ndarray], meets, own: list[np.ndarray]) -> pa.Array:
    """The lists without the elements that an earlier kept one ``meets``.

    ``columns`` hold a value for each element, ``own`` one for each list; ``meets(earlier, element, own)`` takes them as arrays that
    are broadcast against each other.
    """
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(n) - n
    stays = np.zeros(int(n.sum()), bool)
    size = np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
    for s in np.unique(size[n > 0]).tolist():
        every = np.flatnonzero((size == s) & (n > 0))
        if 1 << s > ALONE:
            for i in every.tolist():
                part = slice(begin[i], begin[i] + n[i])
                stays[part] = _alone([c[part] for c in columns], meets, [c[i] for c in own])
            continue
        step = max(1, CELLS >> s)
        for low in range(0, len(every), step):
            rows = every[low : low + step]
            real = np.arange(int(n[rows].max())) < n[rows][:, None]
            of = np.where(real, begin[rows][:, None] + np.arange(real.shape[1]), 0)
            held, mine = [c[of] for c in columns], [c[rows][:, None] for c in own]
            kept = real.copy()
            for k in range(1, real.shape[1]):
                met = kept[:, :k] & meets([c[:, :k] for c in held], [c[:, k : k + 1] for c in held], mine)
                kept[:, k] &= ~met.any(axis=1)
            stays[of[real]] = kept[real]
    count = np.zeros(len(n) + 1, np.int64)
    np.cumsum(stays, out=(total := np.zeros(len(stays), np.int64)))
    count[1:] = np.where(np.cumsum(n) > 0, np.concatenate([[0], total])[np.cumsum(n)], 0)
    return pa.ListArray.from_arrays(pa.array(count, pa.int32()), lists.flatten().filter(pa.array(stays)))


def _alone(columns: list[np.ndarray], meets, own: list) -> np.ndarray:
    kept, stays, m = [np.empty_like(c) for c in columns], np.zeros(len(columns[0]), bool), 0
    for k in range(len(stays)):
        if not meets([c[:m] for c in kept], [c[k] for c in columns], own).any():
            stays[k] = True
            for to, c in zip(kept, columns, strict=True):
                to[m] = c[k]
            m += 1
    return stays


def unsuppressed(boxes: pa.Array, most: pa.Array, mode: str) -> pa.Array:
    """Of each list of boxes (x1, y1, x2, y2, ...) in walking order those that no kept one overlaps by more than ``most``."""
    values = boxes.flatten()
    corners = [values.field(c) for c in ("x1", "y1", "x2", "y2")]
    known = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in corners])
    columns = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in corners]
    limit = most.to_numpy(zero_copy_only=False).astype(np.float64)

    def meets(a, b, own):
        return a[4] & b[4] & ~np.isnan(own[0]) & iou_over(a, b, mode, own[0])

    with np.errstate(divide="ignore", invalid="ignore"):
        return walk(boxes, [*columns, known], meets, [limit])


def unmatched_before(pairs: pa.Array) -> pa.Array:
    """Of each list of pairs (det_id, box_id, ...) in order those that share neither with an earlier one that was taken."""
    values, columns = pairs.flatten(), []
    for c in ("det_id", "box_id"):
        columns += [values.field(c).fill_null(0).to_numpy(zero_copy_only=False), values.field(c).is_valid().to_numpy(zero_copy_only=False)]

    def meets(a, b, own):
        return (a[0] == b[0]) & a[1] & b[1] | (a[2] == b[2]) & a[3] & b[3]

    return walk(pairs, columns, meets, [])
