"""Conversation structure repair by a grammar-compressed dynamic programme.

Damage, order and faults are column expressions. A row of a conversation is a terminal symbol of its repair class:
``D`` (blank or duplicate: must be deleted) or its role initial (s, u, a or any other) with a truncation flag. The
cheapest repair of a symbol sequence into role initials ``(s?(ua)+)?`` is a product of min-plus transfer matrices over
the four states of that grammar (start, after s, after u, after a), one matrix per symbol; an entry holds the cost and
the ASCII-least audit of the edits that take one state to another (K keep, R rerole, D delete, I insert), insertions
after the row included. Among equal-cost audits of one state pair none is a prefix of another (the extra insertions
would cost more), so the least audit of a product is the least concatenation of least audits: the product is exact.

Re-Pair builds the grammar over all conversations at once: each of ``ROUNDS`` rounds counts adjacent symbol pairs in
Spark, promotes the ``PAIRS`` most frequent pairs seen at least twice to rules and rewrites the sequences left to right.
Each rule's matrix is the product of its two symbols' matrices, computed once bottom-up (rules are at most ``ROUNDS *
PAIRS``, a bound of the parameters, not of the data) and shared by every conversation that holds it; a conversation is
then one fold over its compressed sequence. The audit is replayed over the ordered rows to give the repaired text.

Damage: crc32 of ``conv_id:turn`` (NULL written as one space) mod 20: 0 drops the row, 1 empties its text, 2 removes its
``[.!?]``, 3 repeats it (same turn), 4 makes it a user row. NULL text and role are one space. Rows are ordered by turn,
NULL first, then role and text. Faults, first counted: blank (no character outside blank, tab and \\x0A-\\x0D), duplicate
(role and text of an earlier row), truncated (last such character not one of ``.!?``).

Defined cases: every conversation id of the input gives one row, NULL included (its rows form one conversation); a
conversation without rows after damage gives zeros, an empty audit and the hash of the empty string; repeated rows are
duplicates after the first; roles other than system, user and assistant can only be rerouted or deleted; ties of cost go
to the ASCII-least audit; an empty table gives an empty result; columns other than conv_id, turn, role and text are
ignored. A conversation's rows meet in one group for its order and its repaired text.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrovane.scale import materialize

ROUNDS = 8
PAIRS = 32
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
SPACE = r"\x20\x09-\x0D"

# States of (s?(ua)+)?: 0 start, 1 after s, 2 after u, 3 after a. Accepting: 0 and 3.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ACCEPT = (0, 3)
_TERMINALS = ["D"] + [f"{r}{t}" for r in "suax" for t in "01"]


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage: conv_id, turn, role, text."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    c = F.pmod(F.crc32(key), F.lit(20))
    text = F.coalesce(F.col("text"), F.lit(" "))
    role = F.coalesce(F.col("role"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(c == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(c == 1, F.lit("")).when(c == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(c == 0, 0).when(c == 3, 2).otherwise(1))).alias("_copy"),
    )
    return rows.drop("_copy")


def faults(rows: DataFrame) -> DataFrame:
    """Ordered rows with pos, blank, duplicate, truncated and their terminal symbol."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(order))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("pos"))
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    rows = rows.withColumn("blank", blank).withColumn("duplicate", ~F.col("blank") & (seen > 1))
    ends = F.col("text").rlike(f"[.!?][{SPACE}]*$")
    rows = rows.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & ~ends)
    initial = F.substring("role", 1, 1)
    role_class = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    symbol = F.when(F.col("blank") | F.col("duplicate"), F.lit("D")).otherwise(F.concat(role_class, F.col("truncated").cast("int").cast("string")))
    index = F.create_map(*itertools.chain.from_iterable((F.lit(s), F.lit(i)) for i, s in enumerate(_TERMINALS)))
    return rows.withColumn("symbol", index[symbol])


# ---- min-plus matrices with audits -----------------------------------------------------------------------------

Entry = tuple[int, str] | None


def _best(*entries: Entry) -> Entry:
    found = [e for e in entries if e is not None]
    return min(found) if found else None


def _times(a: list[Entry], b: list[Entry]) -> list[Entry]:
    out: list[Entry] = []
    for i in range(4):
        for j in range(4):
            out.append(_best(*[(a[i * 4 + k][0] + b[k * 4 + j][0], a[i * 4 + k][1] + b[k * 4 + j][1]) for k in range(4) if a[i * 4 + k] and b[k * 4 + j]]))
    return out


def _insertions() -> list[Entry]:
    """Cheapest runs of inserted user/assistant rows between two states."""
    closure: list[Entry] = [(0, "") if i == j else None for i in range(4) for j in range(4)]
    for _ in range(4):
        step: list[Entry] = [None] * 16
        for (state, role), after in _NEXT.items():
            if role in "ua":
                step[state * 4 + after] = (INSERT, "I")
        closure = [_best(x, y) for x, y in zip(closure, _times(closure, step), strict=True)]
    return closure


def _terminal(symbol: str) -> list[Entry]:
    out: list[Entry] = [None] * 16
    for state in range(4):
        options = [(state, (DELETE, "D"))]
        if symbol != "D":
            role, extra = symbol[0], int(symbol[1]) * TRUNCATED
            if (state, role) in _NEXT:
                options.append((_NEXT[(state, role)], (extra, "K")))
            for target in "ua":
                if target != role and (state, target) in _NEXT:
                    options.append((_NEXT[(state, target)], (REROLE + extra, "R")))
        for after, entry in options:
            out[state * 4 + after] = _best(out[state * 4 + after], entry)
    return _times(out, _insertions())


def rule_matrices(rules: list[tuple[int, int, int]]) -> dict[int, list[Entry]]:
    """Matrices of the terminals and of the rules (id, left, right), bottom-up in the order the rules were made."""
    matrices = {i: _terminal(s) for i, s in enumerate(_TERMINALS)}
    for rule, left, right in rules:
        matrices[rule] = _times(matrices[left], matrices[right])
    return matrices


_ENTRY = "struct<c:bigint,a:string>"


def _entry(e: Entry) -> Column:
    return F.lit(None).cast(_ENTRY) if e is None else F.struct(F.lit(e[0]).cast("bigint").alias("c"), F.lit(e[1]).alias("a"))


def _literal(value: dict, type_: str) -> Column:
    """A constant map, given as one literal that Spark folds once."""
    return F.from_json(F.lit(json.dumps(value)), type_)


def _min_plus(vector: Column, matrix: Column) -> Column:
    def cell(j):
        terms = F.transform(
            F.sequence(F.lit(0), F.lit(3)),
            lambda i: F.when(
                vector[i].isNotNull() & matrix[i * 4 + j].isNotNull(),
                F.struct((vector[i]["c"] + matrix[i * 4 + j]["c"]).alias("c"), F.concat(vector[i]["a"], matrix[i * 4 + j]["a"]).alias("a")),
            ),
        )
        return F.array_min(F.filter(terms, lambda t: t.isNotNull()))

    return F.transform(F.sequence(F.lit(0), F.lit(3)), cell)


# ---- Re-Pair over all conversations --------------------------------------------------------------------------


def _rewrite(seq: Column, pairs: dict[tuple[int, int], int]) -> Column:
    """Left-to-right rewrite of every listed pair into its rule."""
    lookup = _literal({str(a * 1_000_003 + b): r for (a, b), r in pairs.items()}, "map<string,int>")
    start = F.struct(F.array().cast("array<int>").alias("o"), F.lit(False).alias("skip"))

    def step(acc, i):
        here = F.try_element_at(seq, i)
        rule = F.when(i < F.size(seq), lookup[(here.cast("long") * 1_000_003 + F.try_element_at(seq, i + 1)).cast("string")])
        return F.when(acc["skip"], F.struct(acc["o"].alias("o"), F.lit(False).alias("skip"))).when(
            rule.isNotNull(), F.struct(F.array_append(acc["o"], rule).alias("o"), F.lit(True).alias("skip"))
        ).otherwise(F.struct(F.array_append(acc["o"], here).alias("o"), F.lit(False).alias("skip")))

    positions = F.filter(F.sequence(F.lit(1), F.greatest(F.size(seq), F.lit(1))), lambda i: i <= F.size(seq))
    return F.aggregate(positions, start, step, lambda acc: acc["o"])


def repair_grammar(sequences: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Sequences (conv_id, seq) rewritten by Re-Pair rounds, and the rules (id, left, right) in the order they were made."""
    rules: list[tuple[int, int, int]] = []
    next_id = len(_TERMINALS)
    for _ in range(rounds):
        seq = F.col("seq")
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(seq), F.lit(1))), lambda i: i < F.size(seq))
        adjacent = sequences.select(F.inline(F.transform(starts, lambda i: F.struct(F.element_at(seq, i).alias("a"), F.element_at(seq, i + 1).alias("b")))))
        counted = adjacent.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
        # At most ``pairs`` rows reach the driver: a bound of the parameters.
        top = counted.orderBy(F.col("n").desc(), "a", "b").limit(pairs).collect()
        if not top:
            break
        chosen = {}
        for row in top:
            chosen[(row["a"], row["b"])] = next_id
            rules.append((next_id, row["a"], row["b"]))
            next_id += 1
        sequences = materialize(sequences.select("conv_id", _rewrite(F.col("seq"), chosen).alias("seq")), "repair-seq")
    return sequences, rules


def cheapest(sequences: DataFrame, rules: list[tuple[int, int, int]]) -> DataFrame:
    """(conv_id, cost, audit) of the cheapest repair of each compressed sequence."""
    matrices = rule_matrices(rules)
    entries = {str(s): [None if e is None else {"c": e[0], "a": e[1]} for e in m] for s, m in matrices.items()}
    table = _literal(entries, f"map<string,array<{_ENTRY}>>")
    closure = _insertions()
    start = F.array(*[_entry(closure[j]) for j in range(4)])
    final = F.aggregate(F.col("seq"), start, lambda v, s: _min_plus(v, table[s.cast("string")]))
    best = F.array_min(F.filter(F.array(*[final[j] for j in _ACCEPT]), lambda t: t.isNotNull()))
    return sequences.select("conv_id", best["c"].alias("cost"), best["a"].alias("audit"))


def _replay(rows: Column, audit: Column) -> Column:
    """Repaired ``role:text`` lines of the ordered rows under an audit."""
    start = F.struct(F.lit(1).alias("i"), F.lit(0).alias("st"), F.array().cast("array<string>").alias("lines"))

    def after(state: Column, initial: Column) -> Column:
        return F.when(initial == "s", 1).when(initial == "u", 2).otherwise(F.when(state == 2, 3).otherwise(2))

    def step(acc, letter):
        row = F.try_element_at(rows, acc["i"])
        made = F.when(acc["st"] == 2, F.lit("assistant")).otherwise(F.lit("user"))
        return (
            F.when(letter == "D", F.struct((acc["i"] + 1).alias("i"), acc["st"].alias("st"), acc["lines"].alias("lines")))
            .when(
                letter == "I",
                F.struct(acc["i"].alias("i"), after(acc["st"], F.substring(made, 1, 1)).alias("st"), F.array_append(acc["lines"], F.concat(made, F.lit(":"))).alias("lines")),
            )
            .when(
                letter == "K",
                F.struct(
                    (acc["i"] + 1).alias("i"),
                    after(acc["st"], F.substring(row["role"], 1, 1)).alias("st"),
                    F.array_append(acc["lines"], F.concat(row["role"], F.lit(":"), row["text"])).alias("lines"),
                ),
            )
            .otherwise(
                F.struct(
                    (acc["i"] + 1).alias("i"),
                    after(acc["st"], F.substring(made, 1, 1)).alias("st"),
                    F.array_append(acc["lines"], F.concat(made, F.lit(":"), row["text"])).alias("lines"),
                )
            )
        )

    letters = F.filter(F.split(audit, ""), lambda x: x != "")
    return F.array_join(F.aggregate(letters, start, step, lambda acc: acc["lines"]), "\n")


def repair(conversations: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost (long), audit, repaired_sha256; plus rows and symbols."""
    base = conversations.select("conv_id", "turn", "role", "text")
    ids = base.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    rows = materialize(faults(damaged(base)), "repair-rows")

    initial = F.substring("role", 1, 1)
    before = F.lag(initial).over(Window.partitionBy("conv_id").orderBy("pos"))
    pairs_ok = F.concat(before, initial).isin("su", "ua", "au")
    per_conv = rows.withColumn("_illegal", F.when(before.isNotNull() & ~pairs_ok, 1).otherwise(0)).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("blank").cast("long")).alias("blank"),
        F.sum(F.col("duplicate").cast("long")).alias("duplicate"),
        F.sum(F.col("truncated").cast("long")).alias("truncated"),
        F.sum("_illegal").cast("long").alias("illegal"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sort_array(F.collect_list(F.struct("pos", "symbol", "role", "text"))).alias("_rows"),
    )
    per_conv = materialize(per_conv, "repair-conv")
    sequences = per_conv.select("conv_id", F.transform("_rows", lambda r: r["symbol"]).alias("seq"))
    compressed, rules = repair_grammar(sequences, rounds, pairs)
    best = cheapest(compressed, rules)

    joined = per_conv.join(best.withColumnRenamed("conv_id", "_id"), per_conv["conv_id"].eqNullSafe(F.col("_id"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.sha2(_replay(F.col("_rows"), F.col("audit")), 256).alias("repaired_sha256"), "n_rows",
    )
    empty = F.sha2(F.lit(""), 256)
    zero = F.lit(0).cast("long")
    out = ids.join(joined, ids["conv_id"].eqNullSafe(joined["conv_id"]), "left").select(
        ids["conv_id"],
        *[F.coalesce(joined[c], zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce(joined["audit"], F.lit("")).alias("audit"),
        F.coalesce(joined["repaired_sha256"], empty).alias("repaired_sha256"),
        F.coalesce(joined["n_rows"], zero).alias("n_rows"),
    )
    return out


def op11(conversations: DataFrame) -> DataFrame:
    """Registered query: the repair of every conversation of ``conversations``."""
    return repair(conversations)
