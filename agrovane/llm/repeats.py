"""Exact repeats of W consecutive tokens over a whole corpus, found by anchors and settled by window fingerprints.

An anchor rule picks, for every window of W tokens and from nothing but the window's content, one part of it. Windows in a row that
pick the same part form a block; equal windows pick equal parts, so they can only lie in blocks with equal parts.

1. Every block sends the fingerprints of its part and of its whole content. Blocks with equal content repeat as a whole.
   Where contents differ but the part is the same, single windows may still be equal: those blocks are open.
2. Open blocks send the fingerprint of each window, which settles the rest.

So long copies cost an entry per block, not per token, and only their ends are compared window by window. Entries are
combined per batch of a map task before they are shuffled: a content that a third of all documents hold costs an entry
per batch, and a part that stands in many different surroundings sends one marker per batch. The key space is cut into as
many parts as the bytes of the texts, and later the open windows, ask for, so that what a reducing task holds at once is the same
at every size. What is found is joined back to the texts by the place of a row in its file; those two joins move the texts
at every size but the smallest. Entries travel compressed, and with ``squeezed`` the texts do too.

Two rules decide what a repeat is. ``later``: a window is repeated if an equal one starts earlier (smaller id, or same row and
smaller start; NULL ids come last, and rows with the same id don't precede each other). ``any``: if an equal one starts
anywhere else. Contents are compared by 160-bit, windows by 96-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrovane.llm.common import let_go, with_row_key
from agrovane.llm.hashing import U64, mix
from agrovane.scale import materialize

LATER, ANY = "later", "any"
DUP, OPEN = 1, 2
#: Tokens handled at once, entries combined at once, entries per shuffled row.
CHUNK, COMBINED, BLOB = 1 << 18, 400_000, 2_000
#: Bytes of text whose blocks, and number of windows, that make a part of the key space: what a reducing task holds at once.
PART_BYTES, PART_WINDOWS, LEAST_PARTS = 12 << 20, 600_000, 16
NO_ID = np.iinfo(np.int64).max
_BASES = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))

CODEC = "zstd"

ENTRY = np.dtype(
    [("key", "<u8"), ("c1", "<u8"), ("c2", "<u4"), ("did", "<i8"), ("fid", "<i8"), ("rix", "<i8"), ("start", "<u4"), ("end", "<u4"), ("many", "u1")]
)
MARK = np.dtype([*((name, ENTRY.fields[name][0]) for name in ("fid", "rix", "start", "end")), ("flags", "u1")])
#: Entries by the part of their key, and settled marks by the part of their row; then the marks of each row.
SHUFFLED = "part int, settled boolean, body binary"
COLUMNS = ["part", "settled", "body"]
FOUND = "fid long, rix long, opened boolean, windows long, body binary"


@lru_cache(maxsize=4)
def _powers(base: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    return tuple(np.multiply.accumulate(np.concatenate([[U64(1)], np.full(length, b, U64)])) for b in (base, inverse))


class Fingerprints:
    """Hashes of any part of a token sequence in constant time, two independent ones."""

    def __init__(self, tokens: np.ndarray):
        self.sums = []
        for k, base in enumerate(_BASES):
            power, inverse = _powers(int(base), CHUNK * 2)
            values = tokens if k == 0 else mix(tokens ^ base)
            total = np.empty(len(tokens) + 1, U64)
            total[0] = 0
            np.cumsum(values * power[: len(tokens)], out=total[1:])
            self.sums.append((total, inverse))

    def of(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total, inverse = self.sums[which]
        return mix((total[end] - total[start]) * inverse[start] ^ (end - start).astype(U64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row (van Herk)."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, U64)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


#: Tokens of a text, and the anchor of each window of a token sequence: its start and length.
Tokens = Callable[[bytes], np.ndarray]
Anchors = Callable[[np.ndarray, int, Fingerprints], tuple[np.ndarray, np.ndarray]]


def chunks(documents: Iterator[tuple[int, np.ndarray]], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Token sequences of bounded length: tokens, the number and the offset of the document at each place, and whether a window starts there.

    A document longer than a chunk is cut so that each window lies whole in one chunk.
    """
    held, size = [], 0

    def flat():
        sizes = np.array([len(t) for _, _, t in held])
        number = np.repeat(np.array([n for n, _, _ in held]), sizes)
        first = np.cumsum(sizes) - sizes
        offset = np.arange(size) - np.repeat(first - np.array([o for _, o, _ in held]), sizes)
        valid = np.arange(size) + window <= np.repeat(first + sizes, sizes)
        return np.concatenate([t for _, _, t in held]), number, offset, valid

    for number, tokens in documents:
        if len(tokens) < window:
            continue
        step = CHUNK - window
        for at in range(0, len(tokens) - window + 1, step):
            part = tokens[at : at + step + window - 1]
            if held and size + len(part) > CHUNK:
                yield flat()
                held, size = [], 0
            held.append((number, at, part))
            size += len(part)
    if held:
        yield flat()


def blocks_of(tokens, valid, window, anchors: Anchors) -> tuple[np.ndarray, ...]:
    """First and last window start, part fingerprint and two content fingerprints of each block of a chunk."""
    prints = Fingerprints(tokens)
    at, length = anchors(tokens, window, prints)
    n = len(at)
    ok = valid[:n]
    new = ok.copy()
    new[1:] &= (at[1:] != at[:-1]) | (length[1:] != length[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new)
    # A block ends before the next one, or before the first place where no window starts.
    index = np.cumsum(new) - 1
    last = np.zeros(len(first), np.int64)
    places = np.flatnonzero(ok)
    last[index[places]] = places
    key = prints.of(0, at[first], at[first] + length[first])
    end = last + window
    return first, last, key, prints.of(0, first, end), prints.of(1, first, end)


class Batch:
    """Documents of a task whose entries are combined together."""

    def __init__(self, rule: str, parts: int):
        self.rule, self.parts = rule, parts
        self.rows: list[tuple] = []
        self.entries: list[np.ndarray] = []
        self.size = 0

    def add(self, number, start, end, key, c1, c2) -> None:
        table = np.zeros(len(key), ENTRY)
        first = int(number.min(initial=len(self.rows)))
        ids = np.array(self.rows[first:], np.int64).reshape(-1, 3)[number - first]
        table["did"] = ids[:, 0] if self.rule == LATER else 0
        table["fid"], table["rix"] = ids[:, 1], ids[:, 2]
        table["start"], table["end"], table["key"], table["c1"], table["c2"] = start, end, key, c1, c2
        self.entries.append(table)
        self.size += len(table)

    def flush(self, found_many: bool = True) -> Iterator[pa.RecordBatch]:
        if self.entries:
            table = np.concatenate(self.entries)
            dup, opened, sent = settle(table, self.rule, found_many)
            yield from bundles(marked(table, dup, opened), self.parts)
            yield from blobs(table[sent], self.parts)
        self.rows, self.entries, self.size = [], [], 0


def groups(table: np.ndarray, *names: str) -> np.ndarray:
    """Group number of each row of a table sorted by ``names``."""
    new = np.zeros(len(table), bool)
    for name in names:
        new[1:] |= table[name][1:] != table[name][:-1]
    return np.cumsum(new)


def repeated(table: np.ndarray, content: np.ndarray, rule: str) -> np.ndarray:
    """Rows of a table, sorted by content, id, row and start, that repeat another one of their content."""
    if rule == ANY:
        return np.bincount(content, minlength=1)[content] > 1
    first = np.zeros(len(table), bool)
    first[0] = True
    first[1:] = content[1:] != content[:-1]
    least = table["did"][np.maximum.accumulate(np.where(first, np.arange(len(table)), 0))]
    same_row = np.zeros(len(table), bool)
    same_row[1:] = ~first[1:] & (table["fid"][1:] == table["fid"][:-1]) & (table["rix"][1:] == table["rix"][:-1])
    return (table["did"] > least) | same_row


def in_order(table: np.ndarray) -> np.ndarray:
    """Stable order by key, contents, id, row and start. Most keys stand alone, so only the others compare all columns."""
    order = np.argsort(table["key"])
    key = table["key"][order]
    same = key[1:] == key[:-1]
    shared = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(key) else order
    some = np.sort(order[shared])
    order[shared] = some[np.lexsort([table[c][some] for c in ("start", "rix", "fid", "did", "c2", "c1", "key")])]
    return order


def settle(table: np.ndarray, rule: str, found_many: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts ``table`` in place. Masks of the entries that are repeats, that are open, and that go on to the other batches.

    One entry per content goes on (with ``later``: those that nothing precedes). If a key has several contents here, they are
    open already, and a single marked entry goes on for the others' sake.
    """
    table[:] = table[in_order(table)]
    content, key = groups(table, "key", "c1", "c2"), groups(table, "key")
    dup = repeated(table, content, rule)
    lead = np.ones(len(table), bool)
    lead[1:] = content[1:] != content[:-1]
    stays = lead if rule == ANY else ~dup
    contents = np.bincount(key[lead])
    many = (contents[key] > 1) if found_many else np.zeros(len(table), bool)
    opened = stays & many
    table["many"] = many | (table["many"] > 0)
    first = np.ones(len(table), bool)
    first[1:] = key[1:] != key[:-1]
    return dup, opened, np.where(many, first, stays)


def marks(table: np.ndarray, dup: np.ndarray, opened: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows with the marked blocks of each document: start, end and flags, to be read by :func:`marked_blocks`; ``windows`` counts the
    windows of the open ones.

    Starts go as steps and ends as lengths, in planes of equal bytes: mostly zeros, which files and shuffles compress.
    """
    flags = dup * DUP + opened * OPEN
    hit = np.flatnonzero(flags)
    if not len(hit):
        return
    hit = hit[np.lexsort([table["start"][hit], table["rix"][hit], table["fid"][hit]])]
    fid, rix, start = table["fid"][hit], table["rix"][hit], table["start"][hit]
    cut = np.flatnonzero(np.concatenate([[True], (fid[1:] != fid[:-1]) | (rix[1:] != rix[:-1])]))
    body = np.zeros((len(hit), 3), "<u4")
    body[:, 0], body[:, 1], body[:, 2] = np.diff(start, prepend=start[:1]), table["end"][hit] - start, flags[hit]
    body[cut, 0] = start[cut]
    planes = body.view(np.uint8)
    opens = np.add.reduceat(np.where(body[:, 2] & OPEN, body[:, 1].astype(np.int64) + 1, 0), cut)
    bounds = np.append(cut, len(hit))
    for low in range(0, len(cut), 4096):
        some = range(low, min(low + 4096, len(cut)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(fid[cut[low : low + 4096]]),
                pa.array(rix[cut[low : low + 4096]]),
                pa.array(opens[low : low + 4096] > 0),
                pa.array(opens[low : low + 4096]),
                pa.array([planes[bounds[k] : bounds[k + 1]].T.tobytes() for k in some], pa.binary()),
            ],
            ["fid", "rix", "opened", "windows", "body"],
        )


def marked_blocks(bodies: list[bytes] | None) -> np.ndarray:
    """Start, end and flags of the blocks in the bodies of :func:`marks`."""
    found = [np.zeros((0, 3), np.int64)]
    for body in bodies or []:
        blocks = np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(12, -1).T).view("<u4").astype(np.int64)
        blocks[:, 0] = np.cumsum(blocks[:, 0])
        found.append(blocks)
    blocks = np.concatenate(found)
    blocks[:, 1] += blocks[:, 0]
    return blocks


def in_parts(table: np.ndarray, part: np.ndarray, settled: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a table by part, at most :data:`BLOB` in a shuffled one."""
    if not len(table):
        return
    order = np.lexsort([table["start"], table["rix"], table["fid"], part])
    table, part = table[order], part[order]
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    rows = []
    for low, high in zip(cut, [*cut[1:], len(part)], strict=True):
        for at in range(low, high, BLOB):
            some = table[at : min(at + BLOB, high)]
            rows.append((int(part[low]), pack(some)))
    for at in range(0, len(rows), 64):
        some = rows[at : at + 64]
        columns = [pa.array([p for p, _ in some], pa.int32()), pa.array([settled] * len(some)), pa.array([b for _, b in some], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, COLUMNS)


def blobs(table: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Entries by part (from their key)."""
    return in_parts(table, (mix(table["key"]) % U64(parts)).astype(np.int32), False)


def marked(table: np.ndarray, dup: np.ndarray, opened: np.ndarray) -> np.ndarray:
    """The marks of a table's entries."""
    hit = np.flatnonzero(dup | opened)
    some = np.empty(len(hit), MARK)
    for name in ("fid", "rix", "start", "end"):
        some[name] = table[name][hit]
    some["flags"] = dup[hit] * DUP + opened[hit] * OPEN
    return some


def bundles(table: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Marks by part (from the row they belong to), so that what many tasks find in a row meets without a shuffled row for each of them."""
    row = mix(table["fid"].astype(U64) ^ mix(table["rix"].astype(U64)))
    return in_parts(table, (row % U64(parts)).astype(np.int32), True)


def squeeze(data: bytes) -> bytes:
    """``data`` compressed, after its length."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec=CODEC, asbytes=True)


def expand(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec=CODEC, asbytes=True)


def pack(table: np.ndarray) -> bytes:
    """Entries or marks column after column, each as planes of equal bytes of its numbers; starts as steps, ends as lengths, both small."""
    columns = {name: np.ascontiguousarray(table[name]) for name in table.dtype.names}
    columns["end"] = columns["end"] - columns["start"]
    columns["start"] = np.diff(columns["start"], prepend=columns["start"].dtype.type(0))
    return squeeze(b"".join(c.view(np.uint8).reshape(len(table), c.itemsize).T.tobytes() for c in columns.values()))


def unpack(body: bytes, rows: np.dtype = ENTRY) -> np.ndarray:
    body = expand(body)
    n = len(body) // rows.itemsize
    table, at = np.empty(n, rows), 0
    for name in rows.names:
        kind = rows.fields[name][0]
        planes = np.frombuffer(body, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        table[name] = np.ascontiguousarray(planes.T).view(kind).ravel()
        at += n * kind.itemsize
    table["start"] = np.cumsum(table["start"], dtype=table["start"].dtype)
    table["end"] += table["start"]
    return table


def squeezed(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text, fid, rix) with compressed texts, for a join that moves them; :func:`expand` undoes it."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            small = pa.array([None if t is None else squeeze(t) for t in texts], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", small)

    return rows.select("doc_id", "text", "fid", "rix").mapInArrow(shrink, "doc_id long, text binary, fid long, rix long")


def by_group(runs: list[np.ndarray], rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries of a part, with the masks of repeats and of open blocks. Empties ``runs``."""
    table = np.concatenate(runs)
    runs.clear()
    marked = np.unique(table["key"][table["many"] > 0])
    dup, opened, _ = settle(table, rule, True)
    known = np.isin(table["key"], marked)
    stays = ~dup
    if rule == ANY:
        content = groups(table, "key", "c1", "c2")
        stays = np.ones(len(table), bool)
        stays[1:] = content[1:] != content[:-1]
    return table, dup, opened | (known & stays)


Merge = Callable[[list[np.ndarray], str], tuple[np.ndarray, np.ndarray, np.ndarray]]


def number_of_parts(amount: int | None, most: int) -> int:
    """Parts of the key space that hold about ``most`` of ``amount`` at the most."""
    return max(LEAST_PARTS, -(-(amount or 0) // most))


def _exchange(sent: DataFrame, parts: int, rule: str, merge: Merge) -> DataFrame:
    """Entries of all batches brought together by part, and their marks by row; returns the stored marks, one row (:data:`FOUND`) for
    each row of the documents that has some."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[np.ndarray] = []
        held: list[np.ndarray] = []
        current = None

        def done(last: bool = False) -> Iterator[pa.RecordBatch]:
            if runs:
                held.append(marked(*merge(runs, rule)))
            if held and (last or sum(map(len, held)) >= COMBINED):
                yield from bundles(np.concatenate(held), parts)
                held.clear()

        for batch in batches:
            yield batch.filter(batch.column("settled"))
            entries = batch.filter(pc.invert(batch.column("settled")))
            for part, body in zip(entries.column("part").to_pylist(), entries.column("body").to_pylist(), strict=True):
                if part != current:
                    yield from done()
                    runs, current = [], part
                runs.append(unpack(body))
        yield from done(True)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        current = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                table = np.concatenate(held)
                yield from marks(table, table["flags"] & DUP > 0, table["flags"] & OPEN > 0)

        for batch in batches:
            for part, body in zip(batch.column("part").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if part != current:
                    yield from done()
                    held, current = [], part
                held.append(unpack(body, MARK))
        yield from done()

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("part").sortWithinPartitions("part")

    done = materialize(dealt(dealt(sent).mapInArrow(reduce, SHUFFLED)).mapInArrow(gather, FOUND), "marks")
    del sent
    let_go(done.sparkSession)
    return done


def find(
    docs: DataFrame, window: int, rule: str, tokens: Tokens, anchors: Anchors, merge: Merge = by_group, squeeze_texts: bool = False
) -> DataFrame:
    """``fid``, ``rix`` and ``spans`` (arrays of marks) of each document with a repeated window."""
    rows = with_row_key(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    parts = number_of_parts(docs.agg(F.sum(F.octet_length("text"))).first()[0], PART_BYTES)

    def take(batch: pa.RecordBatch) -> Iterator[tuple[tuple, bytes]]:
        ids = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "fid", "rix")), strict=True)
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        for (doc, fid, rix), text in zip(ids, texts, strict=True):
            yield (NO_ID if doc is None else doc, fid, rix), text or b""

    def send_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Batch(rule, parts)
        for batch in batches:
            base = len(held.rows)
            rows = list(take(batch))
            held.rows += [r for r, _ in rows]
            each = ((base + k, tokens(text)) for k, (_, text) in enumerate(rows))
            for flat, number, offset, valid in chunks(each, window):
                first, last, key, c1, c2 = blocks_of(flat, valid, window, anchors)
                held.add(number[first], offset[first], offset[last], key, c1, c2)
            if held.size >= COMBINED:
                yield from held.flush()
        yield from held.flush()

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Batch(rule, window_parts)
        for batch in batches:
            for (row, text), bodies in zip(take(batch), batch.column("bodies").to_pylist(), strict=True):
                found = marked_blocks(bodies)
                # A block can be found open twice, in its batch and among all.
                found = np.unique(found[found[:, 2] & OPEN > 0, :2], axis=0)
                if not len(found):
                    continue
                number = len(held.rows)
                held.rows.append(row)
                sequence = tokens(expand(text) if squeeze_texts and text else text)
                for at in range(0, len(sequence), CHUNK):
                    some = found[(found[:, 0] >= at) & (found[:, 0] < at + CHUNK)]
                    if not len(some):
                        continue
                    prints = Fingerprints(sequence[at : at + CHUNK * 2])
                    size = some[:, 1] - some[:, 0] + 1
                    start = np.repeat(some[:, 0] - np.cumsum(size) + size, size) + np.arange(size.sum()) - at
                    h1, h2 = (prints.of(k, start, start + window) for k in (0, 1))
                    held.add(np.full(len(start), number), start + at, start + at, h1, np.zeros(len(start), U64), h2)
                if held.size >= COMBINED:
                    yield from held.flush(False)
        yield from held.flush(False)

    found = _exchange(rows.mapInArrow(send_blocks, SHUFFLED), parts, rule, merge)
    with_open = found.where("opened").select("fid", "rix", "windows", F.array("body").alias("bodies"))
    window_parts = number_of_parts(with_open.agg(F.sum("windows")).first()[0], PART_WINDOWS)
    candidates = (squeezed(rows) if squeeze_texts else rows).join(with_open.drop("windows"), ["fid", "rix"])
    single = _exchange(candidates.mapInArrow(send_windows, SHUFFLED), window_parts, rule, by_group)
    return found.unionByName(single).groupBy("fid", "rix").agg(F.collect_list("body").alias("spans"))


def covered(spans: list[bytes] | None, length: int, window: int) -> np.ndarray:
    """Which of ``length`` tokens lie in a repeated window."""
    found = marked_blocks(spans)
    found = found[found[:, 2] & DUP > 0]
    step = np.zeros(length + 1, np.int64)
    np.add.at(step, found[:, 0], 1)
    np.add.at(step, found[:, 1] + window, -1)
    return np.cumsum(step[:-1]) > 0


def join_back(docs: DataFrame, found: DataFrame, squeeze_texts: bool = False) -> DataFrame:
    """``doc_id``, ``text`` (compressed, with ``squeeze_texts``) and ``spans`` (NULL: none) of every document."""
    rows = with_row_key(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = squeezed(rows) if squeeze_texts else rows
    return rows.join(materialize(found, "spans"), ["fid", "rix"], "left").select("doc_id", "text", "spans")
