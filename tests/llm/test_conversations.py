import hashlib
import itertools
import re
import zlib

import pyarrow.parquet as pq

from agrovane.llm import conversations

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        c = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if c == 0:
            continue
        if c == 1:
            text = ""
        if c == 2:
            text = re.sub(r"[.!?]", "", text)
        if c == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if c == 3 else 1)
    return out


def classes(rows):
    """(role, text, kind) in order; kind is D (must delete), or role initial class plus truncation flag."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] if r[1] is not None else 0, r[2].encode(), r[3].encode()))
    seen, out = set(), []
    for _, _, role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        dup = not blank and (role, text) in seen
        seen.add((role, text))
        trunc = not blank and not dup and not re.search(r"[.!?][\x20\x09-\x0D]*$", text)
        out.append((role, text, blank, dup, trunc))
    return out


def options(row, state):
    role, _, blank, dup, trunc = row
    yield "D", 3, state
    if blank or dup:
        return
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    if (state, initial) in NEXT:
        yield "K", int(trunc), NEXT[(state, initial)]
    for target in "ua":
        if target != initial and (state, target) in NEXT:
            yield "R", 2 + int(trunc), NEXT[(state, target)]


def dp(rows):
    """Cheapest (cost, audit) by a direct DP over positions and states, insertions relaxed in place."""
    def relax(best):
        changed = True
        while changed:
            changed = False
            for state in range(4):
                if best[state] is None:
                    continue
                for target in "ua":
                    if (state, target) in NEXT:
                        after = NEXT[(state, target)]
                        cand = (best[state][0] + 2, best[state][1] + "I")
                        if best[after] is None or cand < best[after]:
                            best[after], changed = cand, True
        return best

    best = relax([(0, ""), None, None, None])
    for row in rows:
        new = [None] * 4
        for state in range(4):
            if best[state] is None:
                continue
            for letter, cost, after in options(row, state):
                cand = (best[state][0] + cost, best[state][1] + letter)
                if new[after] is None or cand < new[after]:
                    new[after] = cand
        best = relax(new)
    return min(b for b in (best[0], best[3]) if b is not None)


def exhaustive(rows):
    """Every choice per row and every insertion run of up to two rows between rows."""
    runs = ["", "I", "II"]
    found = []
    for letters in itertools.product("DKR", repeat=len(rows)):
        for targets in itertools.product("ua", repeat=len(rows)):
            for gaps in itertools.product(runs, repeat=len(rows) + 1):
                state, cost, audit, ok = 0, 0, gaps[0], True
                for _ in gaps[0]:
                    target = "a" if state == 2 else "u"
                    state, cost = NEXT.get((state, target), -1), cost + 2
                for row, letter, target, gap in zip(rows, letters, targets, gaps[1:], strict=True):
                    choice = [o for o in options(row, state) if o[0] == letter and (letter != "R" or o[2] == NEXT.get((state, target)))]
                    if not choice or state < 0:
                        ok = False
                        break
                    _, c, state = choice[0]
                    cost, audit = cost + c, audit + letter + gap
                    for _ in gap:
                        target2 = "a" if state == 2 else "u"
                        state, cost = NEXT.get((state, target2), -1), cost + 2
                if ok and state in (0, 3):
                    found.append((cost, audit))
    return min(found)


def replay(rows, audit):
    state, i, lines = 0, 0, []
    for letter in audit:
        made = "assistant" if state == 2 else "user"
        if letter == "D":
            i += 1
        elif letter == "I":
            lines.append(made + ":")
            state = NEXT[(state, made[0])]
        elif letter == "K":
            lines.append(f"{rows[i][0]}:{rows[i][1]}")
            state, i = NEXT[(state, rows[i][0][0])], i + 1
        else:
            lines.append(f"{made}:{rows[i][1]}")
            state, i = NEXT[(state, made[0])], i + 1
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def expected(table):
    by_conv = {}
    for row in table:
        by_conv.setdefault(row[0], []).append(row)
    out = {}
    for conv, rows in by_conv.items():
        kept = damage(rows)
        ordered = classes(kept)
        turns = [r[1] for r in kept if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[0][:1] for r in ordered]
        illegal = sum(1 for a, b in zip(initials, initials[1:], strict=False) if a + b not in ("su", "ua", "au"))
        cost, audit = dp(ordered)
        out[conv] = (
            gaps, sum(r[2] for r in ordered), sum(r[3] for r in ordered), sum(r[4] for r in ordered), illegal, cost, audit,
            replay(ordered, audit),
        )
    return out


def test_dp_against_exhaustive_search():
    kinds = [("user", "hi.", False, False, False), ("assistant", "ok", False, False, True), ("system", "s.", False, False, False),
             ("tool", "t.", False, False, False), ("user", "", True, False, False), ("assistant", "x.", False, True, False)]
    for n in range(0, 4):
        for rows in itertools.product(kinds, repeat=n):
            assert dp(list(rows)) == exhaustive(list(rows))


def test_against_direct_dp(spark):
    table = [tuple(r.values()) for r in pq.read_table("/root/testdata/sf0.01/conversations.parquet").to_pylist()]
    table += [(None, 1, "user", "a."), (None, None, None, None), (900, 1, "user", "x"), (900, 1, "user", "x"), (901, None, "tool", "q.")]
    table += [(902, t, "user" if t % 2 else "assistant", f"t{t % 3}.") for t in range(40)]
    df = spark.createDataFrame(
        [(c, t, r, x, "clash") for c, t, r, x in table], "conv_id long, turn long, role string, text string, audit string"
    )
    got = {
        r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"])
        for r in conversations.op11(df).collect()
    }
    assert got == expected(table)


def test_empty_and_all_dropped(spark):
    assert conversations.op11(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    row = conversations.op11(spark.createDataFrame([(5, dropped, "user", "a.")], "conv_id long, turn long, role string, text string")).first()
    assert (row["cost"], row["audit"], row["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())
