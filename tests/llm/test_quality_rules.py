import re
from collections import Counter

from agrovane.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count, gone = Counter(windows), set()
    for k, x in enumerate(windows):
        if count[x] > 1:
            gone |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(w) < 50 or 100 * len(gone) > 50 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(gone), failed


def test_base_against_brute_force(frame, corpus, rows):
    texts = corpus + [(200, "a\nb\na\n \nb c#\n#$%&|<>*", "s"), (201, "é ü\n" * 60, "s"), (202, "LOUD!! NOISE!! " * 40, "s")]
    out = q.op1(frame(texts))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows(out.select(*names)) == sorted(((i, *base(t)) for i, t, *_ in texts), key=repr)
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert kept[1] is False and kept[30] is True and kept[202] is False and kept[90] is True and kept[81] is False


def test_policies_and_ablation_agree_with_the_ledger(frame, corpus):
    entries = q.ledger(frame(corpus), "doc_id")
    bits = [r["fail_bits"] for r in entries.collect()]
    applied = q.apply_policies(entries).collect()
    for p in q.POLICIES:
        assert [r[f"{p.name}_v{p.version}"] for r in applied] == [b & p.mask == 0 for b in bits]
    for r in q.ablation(entries).collect():
        p = next(p for p in q.POLICIES if (p.name, p.version) == (r["policy"], r["version"]))
        bit = 1 << list(q.RULES).index(r["rule"])
        failing = [b & p.mask for b in bits]
        expected = sum(b & bit > 0 for b in failing), sum(b == bit for b in failing), failing.count(0), sum(b & ~bit == 0 for b in failing)
        assert (r["n_fail"], r["n_only"], r["n_kept"], r["n_kept_without"]) == expected


def test_empty_table(frame):
    assert q.op1(frame([])).collect() == []
    assert q.ablation(q.ledger(frame([]), "doc_id")).collect() == []
