"""Near-duplicates by SuperMinHash signatures, banding, exact verification and union-find grouping.

A document's set are its distinct 5-word shingles (A-Z lower-cased). SuperMinHash gives every element a random order of
the signature's positions and, in round j, the value j + random at position j of that order; a signature keeps the least
value per position. The ranks of one element are correlated (each position once), which lowers the variance, and once
every position of a document holds a value below j + 1 no later round can change it: the rounds stop there.

* Documents with equal sets are one class and one node; a class of copies, however large, costs one signature.
* 32 bands of 4 positions make buckets. A pair at similarity 0.75 shares no bucket with probability 5e-6.
* In a bucket, members are first checked against its pivot, so a bucket of near copies costs about one check per member.
  Buckets that still hold several components are joined to families of members, and all members of different components of a family are
  compared exactly, block against block: no link between different components is left unchecked, and no pairs are listed.
* A check against a pivot compares signatures, and full shingle sets unless the signatures rule the pair out (estimate under 0.55, more
  than five standard deviations below 0.75).

Defined cases: NULL or empty text, or no words, gives an empty set that is linked with nothing; the component is then the
document's own id. Ids may repeat: rows are told apart by their place in the files. A NULL id is greater than all ids, so
a component has a NULL id only if all its rows have. ``kept`` is true where the id equals the component's. An empty table
gives an empty result. Additional columns are ignored. Word and set hashes have 64 bits, class keys 128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrovane.llm.common import in_files, whole_row, with_row_key
from agrovane.llm.components import components
from agrovane.llm.hashing import LOWER, U64, WordHash, mix, shingles, stream
from agrovane.scale import materialize, small_side

BANDS, ROWS = 32, 4
POSITIONS = BANDS * ROWS
SHINGLE, PERCENT = 5, 75
#: Signatures that agree in fewer positions rule a pair out.
LEAST_AGREEMENT = int(0.55 * POSITIONS)
#: Members of a block; two blocks meet in one group.
BLOCK = 256
#: Elements whose signatures are computed together.
ELEMENTS = 200_000


def signatures(sets: list[np.ndarray], positions: int = POSITIONS) -> np.ndarray:
    """SuperMinHash signatures of the sets, one row each: round in the upper, random in the lower 32 bits."""
    sizes = np.array([len(s) for s in sets])
    values = np.full(len(sets) * positions, np.iinfo(np.uint64).max, U64)
    elements = np.concatenate(sets) if len(sets) else np.empty(0, U64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = None  # of the positions, per element; after round 0 only needed for documents that go on
    for j in range(positions):
        if not len(elements):
            break
        drawn = stream(elements, j)
        pick = j + ((drawn >> U64(32)) * U64(positions - j) >> U64(32)).astype(np.int64)
        if order is None:
            at = pick
        else:
            each = np.arange(len(elements))
            at = order[each, pick].astype(np.int64)
            order[each, pick] = order[:, j]
            order[:, j] = at
        np.minimum.at(values, owner * positions + at, (drawn & U64(0xFFFFFFFF)) | U64(j << 32))
        open_ = (values.reshape(-1, positions).max(axis=1) >= U64((j + 1) << 32))[owner]
        if order is None:
            elements, owner, first = elements[open_], owner[open_], at[open_]
            order = np.tile(np.arange(positions, dtype=np.uint16), (len(elements), 1))
            each = np.arange(len(elements))
            order[each, first] = 0
            order[:, 0] = first
        elif not open_.all():
            elements, owner, order = elements[open_], owner[open_], order[open_]
    return values.reshape(-1, positions)


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    parts = values.reshape(len(values), bands, -1)
    acc = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U64)), parts.shape[:2])
    for k in range(parts.shape[2]):
        acc = mix(acc ^ parts[:, :, k]) + U64(k)
    return acc


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    cache = WordHash()
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        yield batch, [shingles(cache.of((t or b"").translate(LOWER).split()), SHINGLE) for t in texts]


def _key(s: np.ndarray) -> bytes | None:
    return hashlib.md5(s.tobytes(), usedforsecurity=False).digest() if len(s) else None


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, sets in _sets(batches):
        start = 0
        while start < len(sets):
            stop, total = start, 0
            while stop < len(sets) and (stop == start or total + len(sets[stop]) <= ELEMENTS):
                total += len(sets[stop])
                stop += 1
            some = sets[start:stop]
            values = signatures(some)
            keys = band_keys(values).view(np.int64)
            short = (mix(values) & U64(0xFFFF)).astype(np.uint16)
            full = [bool(len(s)) for s in some]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).slice(start, stop - start) for c in ("doc_id", "fid", "rix")],
                    pa.array([len(s) for s in some], pa.int64()),
                    pa.array([_key(s) for s in some], pa.binary()),
                    pa.array([k.tolist() if f else None for k, f in zip(keys, full, strict=True)], pa.list_(pa.int64())),
                    pa.array([v.tobytes() if f else None for v, f in zip(short, full, strict=True)], pa.binary()),
                ],
                ["doc_id", "fid", "rix", "n_shingles", "key", "bands", "sig"],
            )
            start = stop


def _keyed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, sets in _sets(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array([_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "body"]
        )


def _passing(test: Callable[[bytes, bytes], bool]):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            yield batch.select(["u", "v"]).filter(pa.array([test(a, b) for a, b in zip(left, right, strict=True)], pa.bool_()))

    return keep


def _agree(a: bytes, b: bytes) -> bool:
    return int((np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)).sum()) >= LEAST_AGREEMENT


def _similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _checked(pairs: DataFrame, bodies: DataFrame, column: str, test) -> DataFrame:
    """Those of ``pairs`` (u, v) whose bodies pass ``test``."""
    left = bodies.select(F.col("key").alias("u"), F.col(column).alias("left"))
    right = bodies.select(F.col("key").alias("v"), F.col(column).alias("right"))
    return pairs.join(right, "v").join(left, "u").select("u", "v", "left", "right").mapInArrow(_passing(test), "u binary, v binary")


def sign(docs: DataFrame) -> DataFrame:
    """Stored table with one row per document: id, place, set size, class key, band keys, signature, row number."""
    keyed = with_row_key(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = "doc_id long, fid long, rix long, n_shingles long, key binary, bands array<long>, sig binary"
    return materialize(keyed.mapInArrow(_sign, schema).withColumn("rid", F.monotonically_increasing_id()), "signed")


def group(docs: DataFrame) -> DataFrame:
    """For ``docs`` in files, one row per document: doc_id, fid, rix, rid, n_shingles and ``root``, the key of its component (NULL: empty set)."""
    signed = sign(docs)
    classes = signed.where("key IS NOT NULL").groupBy("key").agg(F.min("rid").alias("rid"))
    nodes = signed.join(classes.select("rid"), "rid", "left_semi")
    placed = nodes.select("key", F.explode("bands").alias("bucket")).repartition("bucket")
    short = F.xxhash64("key")
    shared = placed.groupBy("bucket").agg(F.min(short).alias("a"), F.max(short).alias("b")).where("a != b").select("bucket")
    members = materialize(placed.join(shared, "bucket"), "members")

    wanted = members.select("key").distinct()
    known = materialize(nodes.join(wanted, "key", "left_semi").select("key", "sig", "fid", "rix"), "candidates")
    places = known.select("fid", "rix")
    texts = with_row_key(docs, "text").join(small_side(places), ["fid", "rix"], "left_semi")
    bodies = materialize(texts.select("text").mapInArrow(_keyed_sets, "key binary, body binary"), "sets")

    found = known.select(F.col("key").alias("node"), F.col("key").alias("root"))
    pairs = materialize(_pivot_pairs(members), "pairs")
    close = materialize(_checked(pairs, known, "sig", _agree), "close")
    links = materialize(_checked(close, bodies, "body", _similar), "links")
    found = materialize(_merged(found, links), "roots")
    rest = materialize(_open_families(members, found), "families")
    found = materialize(_merged(found, materialize(_block_links(rest, bodies), "links")), "roots")
    named = found.withColumnRenamed("node", "key")
    return signed.join(named, "key", "left").select(
        "doc_id", "fid", "rix", "rid", "n_shingles", F.coalesce("root", "key").alias("root")
    )


def _pivot_pairs(members: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's pivot."""
    pivots = members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("key").alias("h"), "key")).alias("p"))
    pairs = members.join(pivots.select("bucket", F.col("p.key").alias("u")), "bucket").where("u != key")
    return pairs.select(F.least("u", "key").alias("u"), F.greatest("u", "key").alias("v")).distinct()


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (node, root) after ``links`` between nodes: components of components, an end stands for its root."""
    ends = lambda c: found.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    between = links.join(ends("u"), "u").join(ends("v"), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v")).where("u != v")
    merged = components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return found.join(merged, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def _open_families(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets with several components: key, root and family (buckets that share members are one family)."""
    placed = members.join(found.withColumnRenamed("node", "key"), "key")
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("bucket")
    left = materialize(placed.join(open_, "bucket"), "open")
    tie = F.concat(F.lit(b"bucket"), F.encode(F.col("bucket").cast("string"), "utf-8"))
    family = components(left.select(F.col("key").alias("u"), tie.alias("v")))
    keys = left.select("key", "root").distinct()
    return keys.join(family.select(F.col("node").alias("key"), F.col("root").alias("family")), "key")


def _block_links(rest: DataFrame, bodies: DataFrame) -> DataFrame:
    """Links between different components of a family, found block against block.

    Components of at least a block have blocks of their own, the other members share some. Every two blocks of a family meet in a
    group of bounded size unless both are of one component; a group returns a spanning forest of its links, never pairs.
    """
    size = rest.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n"))
    owner = F.when(F.col("n") >= BLOCK, F.col("root"))
    shared = size.withColumn("owner", owner).groupBy("family", "owner").agg(F.sum("n").alias("n"))
    many = F.ceil(F.col("n") / BLOCK).cast("long")
    blocks = shared.select("family", "owner", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("b"), many.alias("many"))
    blocks = materialize(blocks.withColumn("block", F.xxhash64(F.coalesce("owner", F.lit(b"")), "b")), "blocks")
    kinds = blocks.select("family", F.col("owner").alias("own"), "many").distinct()
    placed = (
        rest.join(size, ["family", "root"])
        .withColumn("owner", owner)
        .join(kinds, "family")
        .where(F.col("owner").eqNullSafe(F.col("own")))
        .withColumn("block", F.xxhash64(F.coalesce("owner", F.lit(b"")), F.pmod(F.xxhash64("key"), F.col("many"))))
        .select("family", "root", "key", "owner", "block")
    )
    other = blocks.select("family", F.col("owner").alias("own"), F.col("block").alias("facing"))
    met = placed.join(other, "family").where("owner IS NULL OR own IS NULL OR owner != own")
    met = met.select("family", F.least("block", "facing").alias("b1"), F.greatest("block", "facing").alias("b2"), "key", "root")
    return met.join(bodies, "key").groupBy("family", "b1", "b2").applyInArrow(_forest_of_block, "u binary, v binary")


def _forest_of_block(table: pa.Table) -> pa.Table:
    """Links that join different components among some hundred sets, by exact intersections of all of them at once."""
    keys, roots = table.column("key").to_pylist(), table.column("root").to_pylist()
    sets = [np.frombuffer(b, U64) for b in table.column("body").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    both = intersections(sets)
    similar = np.triu(100 * both >= PERCENT * (sizes[:, None] + sizes[None, :] - both), 1)
    parent = {r: r for r in roots}

    def root(x: bytes) -> bytes:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for a, b in zip(*np.nonzero(similar), strict=True):
        x, y = root(roots[a]), root(roots[b])
        if x != y:
            parent[max(x, y)] = min(x, y)
            links.append((keys[a], keys[b]))
    return pa.table([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["u", "v"])


def intersections(sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of the intersections of every two sets; elements of a single set are left out first."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    owner, column = owner[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32 if len(sets) else np.float64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, (low, low + columns))
        grid = np.zeros((len(sets), columns), np.float32)
        grid[owner[a:b], column[a:b] - low] = 1
        total += grid @ grid.T
    return np.rint(total).astype(np.int64)


def op5(docs: DataFrame) -> DataFrame:
    """Set size, component and whether the document is its component's first; see the module for the special cases."""
    grouped = materialize(group(in_files(docs)), "grouped")
    least = grouped.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    own = grouped.join(least, "root", "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    return own.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of each component: the one with the least id, of equal ids the first in the files."""
    docs = in_files(docs)
    grouped = materialize(group(docs), "grouped")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("rid").alias("rid"))
    first = grouped.where("root IS NOT NULL").groupBy("root").agg(F.min(rank).alias("first"))
    dropped = materialize(grouped.join(first, "root").where("rid != first.rid").select("fid", "rix"), "dropped")
    return with_row_key(docs, whole_row(docs)).join(small_side(dropped), ["fid", "rix"], "left_anti").select("_doc.*")
