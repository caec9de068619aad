"""Hashed words and shingles of many texts at once, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 20
#: Rows of a batch that are looked at at once.
ROWS = 256
#: An odd base and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
ODD = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3]

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(ODD[0])
    h = (h ^ (h >> np.uint64(29))) * np.uint64(ODD[1])
    return h ^ (h >> np.uint64(32))


_known_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers; the longest row asked for so far is kept."""
    known = _known_powers.get(base)
    if known is None or len(known) < n:
        known = np.full(1 << max(12, (n - 1).bit_length()), base, np.uint64)
        known[0] = 1
        _known_powers[base] = known = np.cumprod(known)
    return known[:n]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums of ``(byte + 1) * BASE**place`` up to each place; two of them give the hash of a stretch."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(buf)), out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts]


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, A-Z lowered, and how many each text has.

    Texts are taken in stretches of ``GROUP_BYTES`` cut at white space, so a very long text needs no more memory a byte than its words do.
    """
    hashes, counts = [], np.zeros(len(texts), np.int64)
    joined, owners, size = [], [], 0

    def flush() -> None:
        nonlocal joined, owners, size
        if not joined:
            return
        buf = np.frombuffer(b"\n".join(joined) + b"\n", np.uint8)
        space = _SPACE[buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        low = _LOWER[buf] if lower else buf
        hashes.append(mixed(stretch_hashes(prefix_sums(low), starts, ends)))
        lengths = np.array([len(t) + 1 for t in joined])
        np.add.at(counts, owners, np.diff(np.concatenate(([0], np.searchsorted(starts, np.cumsum(lengths))))))
        joined, owners, size = [], [], 0

    for i, text in enumerate(texts):
        if size + len(text) > GROUP_BYTES:
            flush()
        while len(text) > GROUP_BYTES:  # cut after the last white space, or after the word that fills the stretch
            cut = max(text.rfind(c, 0, GROUP_BYTES) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < 0:
                later = [k for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (k := text.find(c, GROUP_BYTES)) >= 0]
                if not later:
                    break
                cut = min(later)
            joined, owners, size = [text[:cut]], [i], cut
            flush()
            text = text[cut + 1 :]
        joined.append(text)
        owners.append(i)
        size += len(text) + 1
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` words in a row of all texts, and how many each text has; fewer words are one shingle, none are none."""
    n = np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
    starts = np.cumsum(counts) - counts
    first = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    left = np.repeat(starts + counts, n) - first  # words of the text from here on
    h = np.zeros(len(first), np.uint64)
    for j in range(k):
        part = (padded[first + j] ^ np.uint64(ODD[2 + j % 4])) * np.uint64((ODD[j % 6] + 2 * j) | 1)
        h += np.where(left > j, part, np.uint64(j + 1))
    return mixed(h), n


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in small parts, so that few rows are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def rows_of(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """doc ids and UTF-8 texts of a partition, in groups of about ``most`` bytes."""
    ids, texts, size = [], [], 0
    for part in sliced(batches):
        for i, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
