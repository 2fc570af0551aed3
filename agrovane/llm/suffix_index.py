"""Exact byte-level deduplication with a logarithmic family of suffix arrays.

Every byte that lies in a 200-byte string which also starts elsewhere is removed, in all places.

The suffix arrays are sparse: of all suffixes they hold those that some 200-byte window picks as its anchor (the position
with the least hash of the 100 bytes that follow, leftmost of equals), one in about 50 bytes; equal windows pick equal
anchors, so no match is missed. Arrays are ordered by the hash of the suffix's first 100 bytes and by fingerprints of the
match context, which puts equal suffixes next to each other as a lexicographic order does. (A dense lexicographic array of
one entry per byte would move several times the input.)

Each batch of a map task is one sorted array per part of the key space. In a part, ``LevelledIndex`` takes arrays one by
one: a new array is merge-scanned against every level, and matches of both sides are marked; then it becomes a level, and levels of equal
size merge geometrically, so an entry is moved a logarithmic number of times. ``repeats`` settles the ends of matches
byte by byte.

Defined cases: NULL or empty text has no bytes; texts under 200 bytes stay whole; repeated rows, with equal ids or none,
remove each other; overlapping matches within a text count; an empty table gives an empty result; additional columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from agrovane.llm import repeats
from agrovane.llm.common import in_files
from agrovane.llm.hashing import U64, mix

WINDOW, GRAM = 200, 100
_BYTE = mix(np.arange(1, 257, dtype=U64))


def tokens(text: bytes) -> np.ndarray:
    return _BYTE[np.frombuffer(text, np.uint8)]


def anchors(values: np.ndarray, window: int, prints: repeats.Fingerprints) -> tuple[np.ndarray, np.ndarray]:
    """The suffix that each window picks, and the length of its key."""
    n = len(values) - GRAM + 1
    at = np.arange(n)
    rank = prints.of(0, at, at + GRAM) & ~U64((1 << 20) - 1) | at.astype(U64)
    best = repeats.sliding_min(rank, window - GRAM + 1)
    return (best & U64((1 << 20) - 1)).astype(np.int64), np.full(len(best), GRAM)


class Level:
    """A sparse suffix array with the order of its match contexts."""

    def __init__(self, array: np.ndarray):
        self.array = array[np.argsort(array["key"], kind="stable")]
        self.order = np.argsort(self.array["context"], kind="stable")
        self.contexts = self.array["context"][self.order]
        self.many = np.concatenate([[0], np.cumsum(self.array["many"] > 0)])

    def __len__(self) -> int:
        return len(self.array)


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges low to high: the number of the range, and each place in it."""
    size = high - low
    number = np.repeat(np.arange(len(size)), size)
    return number, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[number]


class LevelledIndex:
    """Sorted arrays whose sizes at least double from level to level."""

    def __init__(self):
        self.levels: list[Level] = []

    @staticmethod
    def scan(new: Level, level: Level) -> None:
        """Marks long matches (DUP) and shared anchors in different contexts (OPEN) of both; looks only at what is hit."""
        a, b = new.array, level.array
        low, high = (np.searchsorted(level.contexts, a["context"], side) for side in ("left", "right"))
        equal = high - low
        _, at = spread(low, high)
        b["flags"][level.order[at]] |= repeats.DUP
        low, high = (np.searchsorted(b["key"], a["key"], side) for side in ("left", "right"))
        marked = level.many[high] > level.many[low]
        a["flags"] |= (repeats.DUP * (equal > 0) | repeats.OPEN * ((high - low > equal) | marked)).astype(np.uint8)
        number, at = spread(low, high)
        differs = (b["context"][at] != a["context"][number]) | (a["many"][number] > 0)
        b["flags"][at[differs]] |= repeats.OPEN

    def add(self, array: np.ndarray) -> None:
        new = Level(array)
        for level in self.levels:
            self.scan(new, level)
        self.levels.append(new)
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) > len(self.levels[-2]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(Level(np.concatenate([a.array, b.array])))


SUFFIX = np.dtype([*repeats.ENTRY.descr, ("context", "<u8"), ("flags", "u1")])


def merge(runs: list[np.ndarray], rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of a part with their marks, batch after batch through the index.

    A batch sends one entry per key, and what its entries have in common is settled there, so each pair of entries is compared once: when
    the later one's array arrives.
    """
    index = LevelledIndex()
    for run in runs:
        array = np.zeros(len(run), SUFFIX)
        for name in repeats.ENTRY.names:
            array[name] = run[name]
        array["context"] = mix(run["key"] ^ mix(run["c1"])) + run["c2"]
        index.add(array)
    table = np.concatenate([level.array for level in index.levels])
    return table, table["flags"] & repeats.DUP > 0, table["flags"] & repeats.OPEN > 0


def find(docs: DataFrame) -> DataFrame:
    """Repeated windows of each document of ``docs``, which are in files."""
    return repeats.find(docs, WINDOW, repeats.ANY, tokens, anchors, merge, squeeze_texts=True)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for packed, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            text = repeats.expand(packed) if packed else b""
            data = np.frombuffer(text, np.uint8)
            gone = repeats.covered(spans, len(data), WINDOW)
            runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            kept = data[~gone].tobytes() if runs else text
            out.append((len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def deduplicate(docs: DataFrame) -> DataFrame:
    """Every document with the bytes that are left of it (``kept``)."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    docs = in_files(docs)
    return repeats.join_back(docs, find(docs), squeeze_texts=True).mapInArrow(_kept, schema)


def op8(docs: DataFrame) -> DataFrame:
    return deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
