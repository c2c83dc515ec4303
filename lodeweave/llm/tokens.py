"""Byte-level BPE encoding of a corpus with a public vocabulary.

Texts are split by the vocabulary's pattern; each distinct pre-token is merged once per worker by a
hierarchical-bitmap rank queue: one bucket per merge rank holds positions of a linked list of parts,
find-first-set on three levels of 64-bit words gives the least rank that waits, and entries whose
pair has changed since are skipped. A merge therefore costs the same in a pre-token of any length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.runtime import ship

# Fixed value: how byte-level vocabularies of this family split text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens that a worker remembers; beyond it the memory starts anew (results do not change).
REMEMBERED = 400_000


def vocabulary_path(name: str = "byte_bpe_50k") -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class RankQueue:
    """Positions by rank; ``pop`` gives the leftmost position of the least rank."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            a, b = rank >> 6, rank >> 12
            self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
            self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
            self.top |= 1 << b
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        m = self.mid[b]
        a = b << 6 | (m & -m).bit_length() - 1
        w = self.low[a]
        rank = a << 6 | (w & -w).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[a] = w = w & (w - 1)
            if not w:
                self.mid[b] = m = m & (m - 1)
                if not m:
                    self.top &= self.top - 1
        return rank, position


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    parts = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waits = [-1] * n  # the rank under which the pair that begins here waits, -1: none
    queue, get = RankQueue(), ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            waits[i] = rank
            queue.push(rank, i)
    while (least := queue.pop()) is not None:
        rank, i = least
        if waits[i] != rank:
            continue  # stale
        j = after[i]
        parts[i] += parts[j]
        waits[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
        for at in (before[i], i):
            if at >= 0:
                right = after[at]
                new = get(parts[at] + parts[right]) if right < n else None
                waits[at] = -1 if new is None else new
                if new is not None:
                    queue.push(new, at)
    out, i = [], 0
    while i < n:
        out.append(ranks[parts[i]])
        i = after[i]
    return out


class Encoder:
    """Encodes texts; remembers the ids of pre-tokens it has seen."""

    def __init__(self, ranks: dict[bytes, int], remembered: int = REMEMBERED):
        self.ranks, self.remembered, self.known = ranks, remembered, {}
        self.split = regex.compile(PATTERN).findall

    def _learn(self, piece: str) -> list[int]:
        ids = merge(piece.encode("utf-8", "replace"), self.ranks)
        if len(self.known) >= self.remembered:
            self.known.clear()
        if len(piece) < 200:
            self.known[piece] = ids
        return ids

    def pieces(self, text: str | None) -> list[list[int]]:
        known, learn = self.known, self._learn
        return [known.get(p) or learn(p) for p in self.split(text)] if text else []


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    key = hash(shared.value)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_ranks(shared.value))
    return _ENCODERS[key]


def _vocabulary(df: DataFrame, path: str | None):
    ship(df.sparkSession)
    with open(path or vocabulary_path(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: under 2 MB, whatever the corpus


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>) for every row, without special tokens, over whole texts.

    Null and empty texts have an empty list. Repeated rows are encoded each; extra columns are
    ignored. ``path`` is the vocabulary file (rank format); it is read by the driver and shared.
    """
    shared = _vocabulary(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for b in batches:
            flat, ends = [], [0]
            for text in b.column(1).to_pylist():
                flat.extend(chain.from_iterable(enc.pieces(text)))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    kind = documents.select(id_col).schema[0].dataType.simpleString()
    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, content binary) of (doc_id, ids): the bytes that the ids stand for, empty for an empty or null list."""
    shared = _vocabulary(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {i: b for b, i in _encoder(shared).ranks.items()}
        for b in batches:
            content = [b"".join([of[i] for i in ids]) if ids else b"" for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content, pa.binary())], ["doc_id", "content"])

    kind = encoded.select("doc_id").schema[0].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, content binary")


def count_tokens(path: str | None, df: DataFrame, text: str | Column) -> Column:
    """Number of tokens of a text column as a column; 0 for null and empty texts."""
    shared = _vocabulary(df, path)

    @F.arrow_udf("int")
    def tokens(texts: pa.Array) -> pa.Array:
        enc = _encoder(shared)
        return pa.array([sum(map(len, enc.pieces(t))) for t in texts.to_pylist()], pa.int32())

    return tokens(text)
