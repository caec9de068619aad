"""Byte-pair encoding and decoding with a pair occurrence index.

A group of texts (the rows of a partition, up to ``GROUP_BYTES`` at a time) is
split into the tokenizer's pre-tokens, and each distinct one is encoded once.
All their bytes stand in one array, linked to their neighbours inside a
pre-token.  The index maps the rank of each pair to all positions where it occurs;
ranks in use are taken in ascending order, every listed position is merged at
once, and the pairs that the merges form are entered in the index.

The vocabulary file is a parameter: a path, or the name of a file of the installed
public tokenizers; workers read it themselves.  Null text counts as empty and gives no
ids; repeated rows and other columns do not matter; an empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdex.llm.common import text_or_empty
from symdex.llm.words import sliced

#: Fixed value: how the tokenizer splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space before this is no boundary of its own.
LOOSE_SPACE = r" (?:\s|\Z)"
GROUP_BYTES = 12 << 20
#: Rows go back to Spark in batches of about so many bytes.
OUT_BYTES = 4 << 20
NO_RANK = np.int32(2**31 - 1)


class Vocabulary:
    """Merges by rank, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = model["vocab"]
        self.n = max([*ids.values(), *self.special.values()]) + 1
        words = [b""] * self.n
        for token, i in ids.items():
            words[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            words[i] = token.encode()
        self.words = words
        self.id_of_byte = np.zeros(256, np.int32)
        for c, b in byte_of.items():
            self.id_of_byte[b] = ids[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int32)
        self.right = np.array([ids[b] for _, b in pairs], np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = self.left.astype(np.int64) * self.n + self.right
        self.rank_of_key = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.rank_of_key]
        self.split = regex.compile(PATTERN)
        self.loose = regex.compile(LOOSE_SPACE)
        self.specials = regex.compile("|".join(regex.escape(t) for t in self.special)) if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NO_RANK`` where it is never merged."""
        key = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of_key[at], NO_RANK)

    def merged(self, pool: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens that stand one after another in ``pool``, and how many each has."""
        n = len(pool)
        sym = self.id_of_byte[np.frombuffer(pool, np.uint8)]
        ends = np.cumsum(lengths)
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[ends - lengths] = -1
        occurrences: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            ranks = self.ranks(sym[at], sym[after[at]])
            some = ranks != NO_RANK
            at, ranks = at[some], ranks[some]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, places in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
                if rank in occurrences:
                    occurrences[rank].append(places)
                else:
                    occurrences[rank] = [places]
                    heapq.heappush(active, rank)

        enter(np.flatnonzero(after >= 0).astype(np.int32))
        while active:
            rank = heapq.heappop(active)
            places = occurrences.pop(rank)
            a, b, c = self.left[rank], self.right[rank], self.made[rank]
            at = np.unique(np.concatenate(places)) if len(places) > 1 else places[0]
            nxt = after[at]
            still = (sym[at] == a) & (nxt >= 0)
            still &= sym[nxt] == b
            at, nxt = at[still], nxt[still]
            if a == b and len(at) > 1:  # in a run of equal symbols every second pair, from its left end
                joined = np.concatenate(([False], nxt[:-1] == at[1:]))
                i = np.arange(len(at))
                odd = (i - np.maximum.accumulate(np.where(joined, 0, i))) & 1
                at, nxt = at[odd == 0], nxt[odd == 0]
            if not len(at):
                continue
            far = after[nxt]
            sym[at], sym[nxt] = c, -1
            after[at] = far
            inner = far >= 0
            before[far[inner]] = at[inner]
            back = before[at]
            enter(np.unique(np.concatenate((at[inner], back[back >= 0]))))
        alive = sym >= 0
        counts = np.add.reduceat(alive, ends - lengths, dtype=np.int64) if n else np.zeros(0, np.int64)
        return sym[alive], counts


@lru_cache(maxsize=4)
def vocabulary(name: str) -> Vocabulary:
    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Vocabulary(name)


class _Codes(dict):
    """Numbers keys as they come."""

    def __missing__(self, key):
        self[key] = code = len(self)
        return code


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """The stretches ``rows`` of ``flat``, one after another; places are worked out for ``step`` rows at a time."""
    out = np.empty(int(lengths[rows].sum()), flat.dtype)
    at = 0
    for a in range(0, len(rows), step):
        own = rows[a : a + step]
        n = lengths[own]
        ends = np.cumsum(n)
        total = int(ends[-1])
        out[at : at + total] = flat[np.repeat(starts[own] - (ends - n), n) + np.arange(total)]
        at += total
    return out


def _pieces(text: str, v: Vocabulary, codes: _Codes) -> list[int]:
    """Codes of the pieces of a text.

    A space before a non-space always begins a pre-token, so text falls apart there
    and equal pieces are split further only once.  A key is a string for a piece
    that follows a space, ``(piece,)`` for one that does not, ``("", pre-token)`` where the
    spaces are irregular, and ``(id, "special")`` for a special token.
    """
    parts = [(text, None)]
    if v.specials is not None and v.specials.search(text):
        parts, last = [], 0
        for m in v.specials.finditer(text):
            parts.append((text[last : m.start()], v.special[m[0]]))
            last = m.end()
        parts.append((text[last:], None))
    out: list[int] = []
    for part, special in parts:
        if v.loose.search(part):
            out.extend(codes["", t] for t in v.split.findall(part))
        elif part:
            head, *rest = part.split(" ")
            if head:
                out.append(codes[(head,)])
            out.extend(map(codes.__getitem__, rest))
        if special is not None:
            out.append(codes[special, "special"])
    return out


def encoded(texts: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and how many each has."""
    codes = _Codes()
    by_text = [np.array(_pieces(t, v, codes), np.int32) for t in texts]
    tokens = _Codes()
    per_piece: list[list[int]] = []
    for key in codes:
        if isinstance(key, str):
            own = v.split.findall(" " + key)
        elif len(key) == 1:
            own = v.split.findall(key[0])
        elif key[0] == "":
            own = [key[1]]
        else:
            own = [key]
        per_piece.append([tokens[t] for t in own])
    plain = [t.encode() for t in tokens if isinstance(t, str)]
    is_plain = np.array([isinstance(t, str) for t in tokens], bool)
    flat, counts = v.merged(b"".join(plain), np.array([len(t) for t in plain], np.int64))
    n_ids = np.ones(len(tokens), np.int64)
    n_ids[is_plain] = counts
    starts = np.cumsum(n_ids) - n_ids
    ids = np.empty(int(n_ids.sum()), np.int32)
    ids[np.repeat(is_plain, n_ids)] = flat
    for t, start in zip(tokens, starts.tolist(), strict=True):
        if not isinstance(t, str):
            ids[start] = t[0]
    # pre-tokens to pieces, pieces to texts
    lengths = np.array([len(p) for p in per_piece], np.int64)
    members = np.array([t for p in per_piece for t in p], np.int64)
    piece_ids = ragged(ids, starts, n_ids, members)
    piece_lengths = np.add.reduceat(n_ids[members], np.cumsum(lengths) - lengths) if len(members) else np.zeros(0, np.int64)
    piece_starts = np.cumsum(piece_lengths) - piece_lengths
    sizes = np.array([len(c) for c in by_text], np.int64)
    rows = np.concatenate(by_text) if by_text else np.zeros(0, np.int32)
    text_lengths = np.zeros(len(texts), np.int64)
    filled = sizes > 0
    if len(rows):
        text_lengths[filled] = np.add.reduceat(piece_lengths[rows], (np.cumsum(sizes) - sizes)[filled])
    return ragged(piece_ids, piece_starts, piece_lengths, rows), text_lengths


def grouped(batches: Iterator[pa.RecordBatch], most: int = GROUP_BYTES) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a partition's rows, in groups of about ``most`` bytes."""
    ids, texts, size = [], [], 0
    for batch in sliced(batches):
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def cuts(lengths: np.ndarray, unit: int, most: int = OUT_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose ``lengths`` of ``unit`` bytes each come to about ``most``."""
    lot = np.cumsum(lengths * unit + 64) // most
    edges = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), len(lengths)]
    yield from zip(edges, edges[1:])


def _lists(flat: np.ndarray, ends: np.ndarray, a: int, b: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends[a : b + 1] - ends[a], pa.int32()), pa.array(flat[ends[a] : ends[b]]))


def _texts(flat: np.ndarray, ends: np.ndarray, a: int, b: int, words: np.ndarray) -> pa.Array:
    """What the ids of rows ``a`` to ``b`` stand for; bytes that are not UTF-8 become replacement characters."""
    texts = [b"".join(words[flat[s:e]].tolist()).decode("utf-8", "replace") for s, e in zip(ends[a:b].tolist(), ends[a + 1 : b + 1].tolist(), strict=True)]
    return pa.array(texts, pa.string())


def encode(docs: DataFrame, vocabulary_name: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id and its ids, for every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_name)
        for doc_ids, texts in grouped(batches):
            flat, lengths = encoded(texts, v)
            ends = np.concatenate(([0], np.cumsum(lengths)))
            for a, b in cuts(lengths, 4):
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], pa.int64()), _lists(flat, ends, a, b)], ["doc_id", "ids"])

    return text_or_empty(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded_docs: DataFrame, vocabulary_name: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, ids and the text that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.array(vocabulary(vocabulary_name).words, dtype=object)
        for batch in sliced(batches):
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            decoded = _texts(flat, ends - ends[0], 0, batch.num_rows, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, decoded], ["doc_id", "ids", "decoded"])

    return encoded_docs.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_and_decode(docs: DataFrame, vocabulary_name: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, ids and the text that they stand for, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_name)
        words = np.array(v.words, dtype=object)
        for doc_ids, texts in grouped(batches):
            flat, lengths = encoded(texts, v)
            ends = np.concatenate(([0], np.cumsum(lengths)))
            for a, b in cuts(lengths, 8):
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], pa.int64()), _lists(flat, ends, a, b), _texts(flat, ends, a, b, words)], ["doc_id", "ids", "decoded"])

    return text_or_empty(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, vocabulary_name: str = "byte_bpe_50k.json") -> DataFrame:
    """Counts and digests of every text's ids and of what they decode to."""
    rows = encode_and_decode(docs, vocabulary_name)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
