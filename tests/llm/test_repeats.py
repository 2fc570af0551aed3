import hashlib
from collections import Counter

import numpy as np
import pytest

from agrovane.llm import recompression, repeats, suffix_index
from agrovane.llm.common import prepare

LAST = 1 << 62


def later(rows, window=20):
    """(n_words, n_removed, digest) per row: windows that also start earlier are removed; rows are judged on the input."""
    texts = [(LAST if i is None else i, (t or "").encode().split()) for i, t, *_ in rows]
    places = {}
    for r, (i, w) in enumerate(texts):
        for k in range(len(w) - window + 1):
            places.setdefault(tuple(w[k : k + window]), []).append((i, r, k))
    out = []
    for r, (i, w) in enumerate(texts):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if any(i2 < i or (r2 == r and k2 < k) for i2, r2, k2 in places[tuple(w[k : k + window])]):
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((rows[r][0], len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def anywhere(rows, window=200):
    texts = [(t or "").encode() for _, t, *_ in rows]
    count = Counter(t[k : k + window] for t in texts for k in range(len(t) - window + 1))
    out = []
    for (i, *_), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - window + 1):
            if count[t[k : k + window]] > 1:
                gone[k : k + window] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_words_against_brute_force(frame, corpus, rows):
    assert rows(recompression.op4(frame(corpus))) == later(corpus)


def test_bytes_against_brute_force(frame, corpus, rows):
    small = [(i, t and t[:6000], *s) for i, t, *s in corpus]
    assert rows(suffix_index.op8(frame(small))) == anywhere(small)


def test_kept_text_is_what_the_digest_says(frame, corpus):
    for row in recompression.deduplicate(frame(corpus)).collect():
        assert hashlib.sha256(row["kept"].encode()).hexdigest() == row["kept_sha256"]
    for row in suffix_index.deduplicate(frame(corpus[:10])).collect():
        assert hashlib.sha256(row["kept"]).hexdigest() == row["kept_sha256"]


@pytest.mark.parametrize("op", [recompression.op4, suffix_index.op8])
def test_empty_table(frame, op):
    assert op(frame([])).collect() == []


def test_small_batches_and_chunks_give_the_same(frame, corpus, rows, monkeypatch, spark):
    """Entries from many batches meet; long documents are cut. Only in-process pieces are bounded, so run them here."""
    flat = np.concatenate([recompression.tokens((t or "").encode()) for _, t, *_ in corpus[:30]])
    whole = list(repeats.chunks(iter([(0, flat)]), 20))
    monkeypatch.setattr(repeats, "CHUNK", 300)
    parts = list(repeats.chunks(iter([(0, flat)]), 20))
    assert len(whole) == 1 and len(parts) > 3
    starts = [o + at for tokens, _, offset, valid in parts for at, o in [(0, 0)] for o in offset[valid]]
    assert sorted(starts) == list(range(len(flat) - 19))


def test_names_depend_on_the_window_alone():
    """A window that stands in two surroundings is represented by the same part of it."""
    rng = np.random.default_rng(3)
    for case in range(200):
        window = rng.integers(0, 6 if case % 2 else 1000, 20).astype(np.uint64) + np.uint64(1)
        seen = set()
        for _ in range(4):
            left, right = rng.integers(1, 9, rng.integers(0, 12)), rng.integers(1, 9, rng.integers(0, 12))
            words = repeats.mix(np.concatenate([left.astype(np.uint64), window, right.astype(np.uint64)]))
            at, length = recompression.anchors(words, 20, None)
            seen.add((int(at[len(left)] - len(left)), int(length[len(left)])))
        assert len(seen) == 1


def test_levels_grow_geometrically():
    index = suffix_index.LevelledIndex()
    rng = np.random.default_rng(1)
    for _ in range(64):
        array = np.zeros(10, suffix_index.SUFFIX)
        array["key"] = np.sort(rng.integers(0, 1 << 60, 10).astype(np.uint64))
        array["context"] = array["key"]
        index.add(array)
    assert sum(map(len, index.levels)) == 640 and len(index.levels) <= 7
    again = index.levels[0].array[:3].copy()
    index.add(again)
    assert sum((level.array["flags"] & repeats.DUP > 0).sum() for level in index.levels) == 6


def test_sliding_min():
    values = np.random.default_rng(2).integers(0, 50, 97).astype(np.uint64)
    for width in (1, 2, 7, 96, 97):
        assert repeats.sliding_min(values, width).tolist() == [values[k : k + width].min() for k in range(98 - width)]


def test_index_marks_what_grouping_all_entries_marks():
    rng = np.random.default_rng(9)
    runs = []
    for _ in range(40):
        table = np.zeros(30, repeats.ENTRY)
        table["key"] = rng.choice(200, 30, replace=False)
        table["c1"], table["rix"], table["many"] = rng.integers(0, 3, 30), rng.integers(0, 1 << 40, 30), rng.random(30) < 0.1
        runs.append(table)
    marks = lambda out: sorted(zip(out[0]["rix"].tolist(), out[1].tolist(), strict=True))
    ours, theirs = suffix_index.merge(runs, repeats.ANY), repeats.by_group([r.copy() for r in runs], repeats.ANY)
    assert marks(ours) == marks(theirs)
    # Marked entries are open in their own batch already.
    every = {r: o or m for r, o, m in zip(ours[0]["rix"].tolist(), ours[2].tolist(), ours[0]["many"].tolist(), strict=True)}
    assert all(every[r] for r, o in zip(theirs[0]["rix"].tolist(), theirs[2].tolist(), strict=True) if o)


def test_entries_are_ordered_by_all_columns_where_keys_meet():
    rng = np.random.default_rng(3)
    for n, keys in ((0, 1), (1, 1), (500, 20), (500, 10**9), (500, 1)):
        table = np.zeros(n, repeats.ENTRY)
        for name in repeats.ENTRY.names:
            table[name] = rng.integers(0, keys if name == "key" else 3, n)
        order = np.lexsort([table[c] for c in ("start", "rix", "fid", "did", "c2", "c1", "key")])
        assert (repeats.in_order(table) == order).all()


def test_entries_travel_in_few_bytes():
    """Window entries cost what their fingerprints do (12 bytes) and little more, and arrive unchanged."""
    rng = np.random.default_rng(4)
    n = 50_000
    table = np.zeros(n, repeats.ENTRY)
    table["key"], table["c2"] = rng.integers(0, 1 << 63, n), rng.integers(0, 1 << 32, n)
    table["fid"], table["rix"] = -5, np.arange(n) // 1000
    table["start"] = table["end"] = np.arange(n) % 1000 + 200
    table["end"] += (np.arange(n) % 3).astype("<u4")
    sent = [b for batch in repeats.blobs(rng.permutation(table), 16) for b in batch.column("body").to_pylist()]
    assert sum(map(len, sent)) < 16 * n
    assert (np.sort(np.concatenate([repeats.unpack(b) for b in sent]), order="key") == np.sort(table, order="key")).all()


@pytest.mark.parametrize("n", [0, 1, 7])
def test_packed_entries_of_any_order(n):
    rng = np.random.default_rng(n)
    table = np.zeros(n, repeats.ENTRY)
    for name in repeats.ENTRY.names:
        table[name] = rng.integers(0, 100, n)
    table["start"] = rng.permutation(np.linspace(0, (1 << 32) - 200, n).astype(np.uint32))
    table["end"] += table["start"]
    assert (repeats.unpack(repeats.pack(table)) == table).all()


def test_texts_travel_compressed(frame):
    texts = [None, "", "a", "ñandú \x00", "the same words again " * 500]
    rows = frame([(k, t) for k, t in enumerate(texts)])
    keyed = repeats.with_row_key(suffix_index.in_files(rows), "doc_id", "text")
    found = {r["doc_id"]: r["text"] for r in repeats.squeezed(keyed).collect()}
    assert [None if found[k] is None else repeats.expand(found[k]).decode() for k in range(5)] == texts
    assert len(found[4]) < 200


def test_marks_travel_in_few_bytes():
    """Marked windows of many documents, most of them near the one before, cost little when they are compressed."""
    rng = np.random.default_rng(5)
    n = 20_000
    table = np.zeros(n, repeats.ENTRY)
    table["fid"], table["rix"] = 3, rng.integers(0, 400, n)
    table["start"] = rng.choice(100 * n, n, replace=False) % 20_000
    table["end"] = table["start"] + rng.integers(0, 2, n).astype("<u4")
    dup, opened = rng.random(n) < 0.7, rng.random(n) < 0.1
    batches = list(repeats.marks(table, dup, opened))
    rows = [row for batch in batches for row in batch.to_pylist()]
    got = sorted((r["rix"], *block) for r in rows for block in repeats.marked_blocks([r["body"]]).tolist())
    flags = dup * repeats.DUP + opened * repeats.OPEN
    assert got == sorted((int(e["rix"]), int(e["start"]), int(e["end"]), int(f)) for e, f in zip(table, flags, strict=True) if f)
    assert all(r["opened"] == bool((repeats.marked_blocks([r["body"]])[:, 2] & repeats.OPEN).any()) for r in rows)
    assert len(repeats.squeeze(b"".join(r["body"] for r in rows))) < 4 * len(got)
    assert len(repeats.marked_blocks(None)) == len(repeats.marked_blocks([])) == 0


@pytest.mark.parametrize(("op", "brute"), [(recompression.op4, later), (suffix_index.op8, anywhere)])
def test_parts_follow_the_input(frame, corpus, rows, monkeypatch, op, brute):
    """What a reducing task holds at once is bounded by more parts, for blocks and for windows, whatever the number of files."""
    small = [(i, t and t[:3000], *s) for i, t, *s in corpus]
    used, exchange = [], repeats._exchange
    monkeypatch.setattr(repeats, "_exchange", lambda sent, parts, *rest: used.append(parts) or exchange(sent, parts, *rest))
    assert rows(op(frame(small))) == brute(small) and used == [16, 16]
    monkeypatch.setattr(repeats, "PART_BYTES", 2000)
    monkeypatch.setattr(repeats, "PART_WINDOWS", 40)
    assert rows(op(frame(small))) == brute(small)
    assert used[2] == -(-sum(len((t or "").encode()) for _, t, *_ in small) // 2000) and used[3] > 16


def test_marks_of_many_tasks_share_rows(spark):
    """A document that many reducing tasks mark has one row for all of them, with the number of its open windows."""
    prepare(spark)

    def send(batches):
        for part in (p for batch in batches for p in batch.column("id").to_pylist()):
            table = np.zeros(40, repeats.ENTRY)
            table["key"], table["fid"], table["rix"] = np.arange(40) // 2 + 100 * part, -1, np.arange(40) // 4
            table["start"] = 1000 * part + np.arange(40)
            table["end"] = table["start"] + 4
            table["c2"] = np.where(np.arange(40) % 4 < 2, 0, np.arange(40))
            yield from repeats.blobs(table, 16)

    sent = spark.range(30).repartition(5).mapInArrow(send, repeats.SHUFFLED)
    found = repeats._exchange(sent, 16, repeats.ANY, repeats.by_group)
    got = sorted((r["fid"], r["rix"], r["opened"], r["windows"], len(repeats.marked_blocks([r["body"]]))) for r in found.collect())
    assert got == [(-1, k, True, 300, 120) for k in range(10)]
