import random

import pytest

from agrovane.llm import decontaminate as m

SCHEMA = "item_id long, text string, doc_id long, extra string"


def distance(pattern, text):
    """Least edit distance of a pattern to any part of a text, and the first end that has it."""
    row = [0] * (len(text) + 1)
    for k, a in enumerate(pattern, 1):
        new = [k]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row), row.index(min(row))


def test_myers_against_the_table():
    rng = random.Random(1)
    for _ in range(400):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        assert m.Myers(p).best(t) == distance(p, t)


@pytest.fixture
def tables(spark, frame):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    items = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(12)]
    items[3] = items[3].upper() + "?!"
    rows, item_rows = [], [(k, t, 1, "x") for k, t in enumerate(items)] + [(50, None, 1, "x"), (51, "", 1, "x"), (52, "of", 1, "x"), (None, items[0], 1, "x"), (53, items[1], 1, "x")]
    for k in range(90):
        text = [word() for _ in range(60)]
        item = list(items[k % 12])
        for _ in range(k % 30):
            at = rng.randrange(len(item))
            item[at : at + 1] = rng.choice([[], ["q"], [item[at], "z"]])
        text[20:20] = ["".join(item)]
        rows.append((k, " ".join(text)))
    rows += [(k, " ".join(word() for _ in range(80))) for k in range(100, 110)]
    rows += [(None, items[2]), (200, None), (201, ""), (202, items[2]), (202, items[2]), (203, "w " * 30000 + items[4] + " w" * 30000), (204, items[5] + " x" * 300 + " " + items[5])]
    return rows, item_rows, frame(rows), spark.createDataFrame(item_rows, SCHEMA)


def test_against_every_item_and_text(tables, rows):
    texts, items, docs, benchmark = tables
    expected = []
    for i, text in texts:
        line = m.normalised(text)
        for j, item, *_ in items:
            p = m.normalised(item)
            if len(p) >= m.MIN_BYTES:
                found = (0, 0) if p in line else distance(p, line) if len(line) < 5000 else (len(p), 0)
                if found[0] <= m.budget(len(p)):
                    expected.append((i, j, found[0]))
    got = m.op7(docs, benchmark)
    assert rows(got.select("doc_id", "item_id", "distance")) == sorted(expected, key=repr)
    assert {r["places"] for r in got.where("doc_id = 204 AND item_id = 5").collect()} == {2}
    clean = m.clean(docs, benchmark).select("doc_id", "text")
    dirty = {i for i, _, _ in expected}
    assert rows(clean) == sorted(((i, t) for i, t in texts if i not in dirty), key=repr)


def test_small_blocks_give_the_same(tables, rows, monkeypatch):
    _, _, docs, benchmark = tables
    whole = rows(m.op7(docs, benchmark)), rows(m.clean(docs, benchmark))
    monkeypatch.setattr(m.blocks, "__defaults__", (400,))
    assert (rows(m.op7(docs, benchmark)), rows(m.clean(docs, benchmark))) == whole


def test_empty_tables(spark, frame):
    none = spark.createDataFrame([], SCHEMA)
    docs = frame([(1, "some text")])
    assert m.op7(docs, none).collect() == [] and m.clean(docs, none).count() == 1
    some = spark.createDataFrame([(1, "a long enough item of a benchmark", 1, "x")], SCHEMA)
    assert m.op7(frame([]), some).collect() == [] and m.clean(frame([]), some).collect() == []
