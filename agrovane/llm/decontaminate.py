"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised (lower case, ASCII punctuation and white space to one blank, UTF-8). An item of n bytes has an error
budget e of about one edit per 12 bytes and is cut into e + 1 pieces: where the item occurs with at most e edits, at least
one piece occurs exactly. One automaton finds all pieces of all items in a single pass over each whole text; around every
hit, Myers' bit-parallel algorithm computes the least edit distance of the item to any part of the text.

Items are read in blocks of bounded size (:data:`BLOCK_BYTES`), each sent to the tasks as one broadcast and matched with all documents; documents
are never shuffled. Windows of hits of one item that overlap are verified once.

Defined cases: NULL or empty text matches nothing; NULL items and items under :data:`MIN_BYTES` normalised bytes carry no
evidence and are skipped; repeated items and repeated documents give a row each; ids may be NULL; an empty table on either
side gives no match; additional columns are ignored by ``matches`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_BYTES = 12
MIN_BYTES = 24
BLOCK_BYTES = 4 * 1024 * 1024

_BLANKED = bytes(32 if c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128 else c for c in range(256))


def normalised(text: str | None) -> str:
    """One character per byte, so that positions are bytes of the normalised text."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_BLANKED).split()).decode("latin-1")


def budget(length: int) -> int:
    return max(1, length // PIECE_BYTES - 1)


def pieces(item: str) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length with their offsets."""
    count = budget(len(item)) + 1
    cuts = [len(item) * k // count for k in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Myers:
    """Least edit distance of a pattern to any part of a text, one step of word operations per character of the text."""

    def __init__(self, pattern: str):
        self.length = len(pattern)
        self.places: dict[str, int] = {}
        for k, c in enumerate(pattern):
            self.places[c] = self.places.get(c, 0) | 1 << k

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end of the first part that has it)."""
        full, high = (1 << self.length) - 1, 1 << self.length - 1
        up, down, score = full, 0, self.length
        least, end = score, 0
        for at, c in enumerate(text, 1):
            equal = self.places.get(c, 0)
            diagonal = (((equal & up) + up) ^ up) | equal
            rising = down | ~(diagonal | up) & full
            falling = up & diagonal
            if rising & high:
                score += 1
            elif falling & high:
                score -= 1
            vertical = equal | down
            rising = rising << 1 & full
            falling = falling << 1 & full
            up = falling | ~(vertical | rising) & full
            down = rising & vertical
            if score < least:
                least, end = score, at
        return least, end


@dataclass
class Index:
    """The items of a block, and the automaton over their pieces."""

    ids: list[int | None]
    items: list[str]

    def __post_init__(self):
        self.automaton = ahocorasick.Automaton()
        holders: dict[str, list[tuple[int, int]]] = {}
        for number, item in enumerate(self.items):
            for offset, piece in pieces(item):
                holders.setdefault(piece, []).append((number, offset))
        for piece, found in holders.items():
            self.automaton.add_word(piece, (len(piece), found))
        if holders:
            self.automaton.make_automaton()
        self.patterns: dict[int, Myers] = {}

    def pattern(self, number: int) -> Myers:
        if number not in self.patterns:
            self.patterns[number] = Myers(self.items[number])
        return self.patterns[number]

    def windows(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, from, to): parts of the text around piece hits; overlapping ones of an item are one."""
        if not len(self.automaton):
            return
        starts: dict[int, set[int]] = {}
        for last, (size, found) in self.automaton.iter(text):
            for number, offset in found:
                starts.setdefault(number, set()).add(last + 1 - size - offset)
        for number, begins in starts.items():
            length = len(self.items[number])
            spare = budget(length)
            low = high = None
            for begin in sorted(begins):
                a, b = max(0, begin - spare), min(len(text), begin + length + spare)
                if high is not None and a <= high:
                    high = max(high, b)
                    continue
                if high is not None:
                    yield number, low, high
                low, high = a, b
            yield number, low, high

    def matches(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Item number to (least distance, windows that match, end of the best) over the whole text."""
        out: dict[int, tuple[int, int, int]] = {}
        for number, low, high in self.windows(text):
            item = self.items[number]
            exact = text.find(item, low, high)
            distance, end = (0, exact - low + len(item)) if exact >= 0 else self.pattern(number).best(text[low:high])
            if distance <= budget(len(item)):
                seen = out.get(number, (distance, 0, low + end))
                out[number] = min((distance, low + end), (seen[0], seen[2]))[0], seen[1] + 1, min((seen[0], seen[2]), (distance, low + end))[1]
        return out


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """The items in blocks of at most ``block_bytes`` (a larger item is a block of its own), read one partition at a time."""
    ids, items, size = [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        item = normalised(row["text"])
        if len(item) < MIN_BYTES:
            continue
        if items and size + len(item) > block_bytes:
            yield Index(ids, items)
            ids, items, size = [], [], 0
        ids.append(row["item_id"])
        items.append(item)
        size += len(item)
    if items:
        yield Index(ids, items)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found in it: least edit distance, budget, matching places, normalised end of the best."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance long, budget long, places long, best_end long"
    out = spark.createDataFrame([], schema)
    for index in blocks(benchmark):
        shared = spark.sparkContext.broadcast((index.ids, index.items))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(*shared.value)
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    for number, (distance, places, end) in index.matches(normalised(text)).items():
                        rows.append((doc, index.ids[number], distance, budget(len(index.items[number])), places, end))
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                names = ["doc_id", "item_id", "distance", "budget", "places", "best_end"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, schema)
        out = out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents in which an item is found."""
    spark = docs.sparkSession
    for index in blocks(benchmark):
        shared = spark.sparkContext.broadcast((index.ids, index.items))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(*shared.value)
            for batch in batches:
                free = [not index.matches(normalised(t)) for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(free, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


op7 = matches
