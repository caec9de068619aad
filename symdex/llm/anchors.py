"""Places that every long repeated string shares: winnowed anchors of byte texts."""

from __future__ import annotations

import numpy as np

from symdex.llm.words import ODD, mixed, prefix_sums, stretch_hashes


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` values in a row."""
    span, out = 1, x
    while 2 * span <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(buf: np.ndarray, sums: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are least in some ``length``-byte window of ``buf``.

    Equal windows have their least grams at equal offsets, so two equal windows always share an anchor.
    """
    n = len(buf)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.arange(n - gram + 1)
    hashes = mixed(stretch_hashes(sums, starts, starts + gram))
    width = length - gram + 1
    least = _slide(hashes, width, np.minimum)
    # the largest of the minima of all windows that hold a gram is its own hash only if it is least in one of them
    padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    at = np.flatnonzero(_slide(padded, width, np.maximum) == hashes)
    return at, hashes[at]


def regions(sums: np.ndarray, n: int, at: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor the stretch that holds all windows around it, and a hash of its bytes and the anchor's place in it."""
    starts = np.maximum(at - (length - gram), 0)
    ends = np.minimum(at + length, n)
    shape = ((at - starts).astype(np.uint64) << np.uint64(32)) | (ends - at).astype(np.uint64)
    return starts, ends, mixed(stretch_hashes(sums, starts, ends) ^ (shape * np.uint64(ODD[2])))
