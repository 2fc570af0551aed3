import random

import pytest

from agrovane.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fid string, rix int, key string, size int, n_words string"


@pytest.fixture
def frame(spark):
    """A frame like ``documents`` from (doc_id, text[, source]) rows, with additional columns whose names clash with operators' own."""
    prepare(spark)

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "x", 1, "k", 5, "w") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


def prose(seed: int, words: int, vocabulary: int = 3000) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(words)]


@pytest.fixture
def corpus():
    """Rows with copies, near copies, shared passages, runs, periods, NULLs, empty and long texts, repeated ids."""
    rows = []
    shared = prose(99, 70)
    for k in range(40):
        words = prose(k, 30 + 7 * k)
        if k % 4 == 0:
            words[10:10] = shared
        if k % 5 == 0:
            words[5:5] = shared[10 : 10 + 21]
        rows.append((k, " ".join(words), f"s{k % 3}"))
    rng = random.Random(5)
    for k in range(40, 60):
        words = prose(7, 150)
        for _ in range(k % 8):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words), None if k % 2 else "s0"))
    rows += [(60 + k, rows[3][1], "s1") for k in range(5)]
    rows += [(70, "a " * 60, "s1"), (71, "b " + "a " * 45 + "c", "s1"), (72, "a b " * 40, "s2"), (73, "z a b " + "a b " * 30, "s2"), (74, "a a b " * 30, None)]
    rows += [(80, None, "s1"), (81, "", "s1"), (82, " \n\t ", None), (83, "one two", "s1"), (84, "ONE\x0btwo", "s1")]
    rows += [(90, " ".join(prose(1000, 30000, 10**6)), "s1"), (91, " ".join(prose(1000, 30000, 10**6)[500:20000]), "s2")]
    rows += [(None, rows[12][1], "s1"), (None, rows[12][1], "s1"), (95, rows[16][1], "s1"), (95, rows[16][1], "s1")]
    rows += [(96, "ñandú é " * 100, "s1"), (97, "x" * 450, "s1"), (98, "y" + "x" * 230, "s2")]
    return rows
