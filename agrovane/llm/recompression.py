"""Substring deduplication by recompression: words in repeated 20-word windows are removed, the first occurrence stays.

Rounds give names to runs of equal words and then, several times, to pairs of neighbours: a random bit of every name says
whether it is a left or a right half, and each left followed by a right becomes one name. A name is a hash of what it
stands for, so it is the same in every task and file. Whether a pair forms depends on its two halves alone (and on the
words next to it, for the runs); a name is used for a window only if all it depends on lies in the window, so equal windows have
equal interior names.

Each window is represented by its highest-level name (the most words; then by hash, then leftmost), a window without one
by itself. Names that two places share reveal candidates; ``repeats`` verifies them by the fingerprints of what surrounds
them, block by block and, where blocks differ, window by window.

Defined cases: NULL or empty text has no words and keeps none (the digest is that of the empty string); texts under 20
words stay whole; rows with the same id don't count as earlier than each other, and NULL ids come after all others; an
empty table gives an empty result; additional columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from agrovane.llm import repeats
from agrovane.llm.common import in_files
from agrovane.llm.hashing import U64, WordHash, mix

WINDOW, ROUNDS = 20, 4
_cache = WordHash()


def tokens(text: bytes) -> np.ndarray:
    return _cache.of(text.split())


def names(words: np.ndarray, rounds: int = ROUNDS) -> Iterator[tuple[np.ndarray, ...]]:
    """New names of each round: hash, first word, word after the last, and the range of words that they depend on."""
    # Runs. That a run ends is known only from the words next to it.
    new = np.ones(len(words), bool)
    new[1:] = words[1:] != words[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(words))
    size = (end - start).astype(U64)
    name = np.where(size > 1, mix(words[start] ^ mix(size)), words[start])
    low, high = start - 1, end + 1
    run = size > 1
    yield name[run], start[run], end[run], low[run], high[run]
    for turn in range(rounds):
        left = mix(name ^ U64(turn + 1)) & U64(1) == 0
        paired = left[:-1] & ~left[1:]
        head = np.flatnonzero(paired)
        # A name that stays single depends on the neighbour that might have joined it.
        near = np.where(left, np.append(np.arange(1, len(name)), len(name) - 1), np.maximum(np.arange(len(name)) - 1, 0))
        low, high = np.minimum(low, low[near]), np.maximum(high, high[near])
        both = mix(mix(name[head]) + name[head + 1] * U64(3))
        name[head] = both
        end[head] = end[head + 1]
        high[head] = np.maximum(high[head], high[head + 1])
        stays = np.ones(len(name), bool)
        stays[head + 1] = False
        made = np.zeros(len(name), bool)
        made[head] = True
        name, start, end, low, high, made = (x[stays] for x in (name, start, end, low, high, made))
        yield name[made], start[made], end[made], low[made], high[made]


def anchors(words: np.ndarray, window: int, prints: repeats.Fingerprints) -> tuple[np.ndarray, np.ndarray]:
    """The name that represents each window: its first word and its number of words."""
    n = len(words) - window + 1
    best = np.zeros(n, U64)
    for name, start, end, low, high in names(words):
        usable = (high - low <= window) & (low >= 0) & (high <= len(words))
        name, start, end, low, high = (x[usable] for x in (name, start, end, low, high))
        # Words, hash, place from the right: one number to compare by.
        rank = (end - start).astype(U64) << U64(58) | (mix(name) >> U64(26)) << U64(20) | (U64((1 << 20) - 1) - start.astype(U64))
        for back in range(window - 1):
            at = low - back
            fits = (at >= 0) & (at >= high - window) & (at < n)
            np.maximum.at(best, at[fits], rank[fits])
    none = best == 0
    at = np.where(none, np.arange(n), (1 << 20) - 1 - (best & U64((1 << 20) - 1)).astype(np.int64))
    return at, np.where(none, window, (best >> U64(58)).astype(np.int64))


def find(docs: DataFrame) -> DataFrame:
    """Repeated windows of each document of ``docs``, which are in files."""
    return repeats.find(docs, WINDOW, repeats.LATER, tokens, anchors)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = (text or b"").split()
            gone = repeats.covered(spans, len(words), WINDOW)
            kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g) if gone.any() else b" ".join(words)
            out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept))
        columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
        kept = pa.array([r[3] for r in out], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, kept], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def deduplicate(docs: DataFrame) -> DataFrame:
    """Every document with what is left of it (``kept``, words joined by one blank)."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    docs = in_files(docs)
    return repeats.join_back(docs, find(docs)).mapInArrow(_kept, schema)


def op4(docs: DataFrame) -> DataFrame:
    return deduplicate(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
