import random
import re

from agrovane.llm import license_scan as m

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {k: k + 32 for k in range(65, 91)}


def base(text):
    words = WORD.findall((text or "").translate(UPPER))
    found = []
    for phrase, label in m.BASE.items():
        p = phrase.split()
        found += [(k, label) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    places = [k for k, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "CC-BY cc_by CC BY\tcc by; ccby cc byé",
    "GNU General Public License general public licenses GENERAL\nPUBLIC  LICENSE.",
    "All rights reserved. All Rights Reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "SPDX-License-Identifier: LGPL-2.1",
    "Licensed under CC BY-NC 4.0.",
    "ÀÉ all rights É reserved",
    None,
    "",
    " \x00\x1f ",
    "plain prose without anything " * 3000,
    "all rights reserved " * 2000,
]


def test_base_columns_and_labels(frame):
    out = {r["doc_id"]: r for r in m.op2(frame(list(enumerate(TEXTS)))).collect()}
    for k, text in enumerate(TEXTS):
        row = out[k]
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == base(text)
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(","))
        assert 0 <= row["score"] <= 1 and (row["score"] > 0) == bool(row["labels"])
    assert out[0]["labels"] == "apache" and out[4]["labels"] == "mit" and "lgpl" in out[5]["labels"] and out[6]["labels"] == "cc-by,cc-by-nc"


def test_suppression_against_all_pairs():
    rng, count = random.Random(2), len(m.rules())
    assert count > 300 and len({(r.label, r.pattern.pattern) for r in m.rules()}) > 300
    for _ in range(500):
        found = list({(a := rng.randint(0, 12), a + rng.randint(1, 8), rng.randrange(count)) for _ in range(rng.randint(0, 9))})
        kept = []
        for d in sorted(found, key=lambda d: (-m.rules()[d[2]].priority, d[0] - d[1], d[2])):
            if not any(k[0] <= d[0] and k[1] >= d[1] for k in kept):
                kept.append(d)
        assert m.unsuppressed(found) == sorted(kept)


def test_every_keyword_is_in_what_its_rule_matches():
    line = m.line_of(" ".join(t for t in TEXTS[:8]).encode())
    by_gate = {d for d in m.detections(line)}
    every = {(x.start(), x.end(), n) for n, r in enumerate(m.rules()) for x in r.pattern.finditer(line)}
    assert by_gate == every


def test_empty_table_repeated_rows(frame):
    assert m.op2(frame([])).collect() == []
    got = m.op2(frame([(None, TEXTS[0]), (None, TEXTS[0])])).collect()
    assert len(got) == 2 and got[0] == got[1]
