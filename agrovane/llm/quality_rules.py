"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger holds the measurements and one ``fail_bits`` number, bit k set if
rule k fails. Policies are named, versioned masks over those bits: applying one, or asking what each of its rules costs
on its own, is bit arithmetic over the ledger and never reads a text again.

NULL text counts as empty (all counts 0, so the length rule fails). A NULL ``doc_id`` is passed on. Repeated rows give
repeated ledger rows. An empty table gives an empty ledger. Additional input columns are ignored. Only built-in column
functions are used; work per row is n log n in its words at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrovane.llm.common import SPACE, bound, count_chars, words_of

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Policy:
    """A version of a set of rules; a document stays if none of them fails."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(rule) for rule in self.rules)


# Rule -> whether a document with the ledger's measurements fails it. The position is the bit.
RULES = {
    "few_words": lambda: F.col("n_words") < 50,
    "repeated_trigrams": lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "duplicate_lines": lambda: 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
    "short_words": lambda: F.col("word_chars") < 3 * F.col("n_words"),
    "long_words": lambda: F.col("word_chars") > 12 * F.col("n_words"),
    "no_letters": lambda: 100 * F.col("n_plain_words") > 20 * F.col("n_words"),
    "upper_case": lambda: 100 * F.col("n_upper") > 30 * F.col("word_chars"),
    "exclamations": lambda: 2 * F.col("n_exclaim") > F.col("n_words"),
}

POLICIES = (
    Policy("base", 1, ("few_words", "repeated_trigrams")),
    Policy("web", 1, ("few_words", "repeated_trigrams", "symbols", "duplicate_lines", "short_words", "long_words")),
    Policy("web", 2, tuple(RULES)),
    # Lines that repeat are no fault of an otherwise clean document; the ledger keeps their bit.
    Policy("web", 3, tuple(rule for rule in RULES if rule != "duplicate_lines")),
)
PRODUCTION = POLICIES[-1]
#: The policy of op1's ``kept``: all rules, as its SQL has it.
STRICT = POLICIES[2]
MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "n_plain_words",
    "n_upper",
    "n_exclaim",
)


def repeat_words(words: Column) -> Column:
    """How many words stand in a 3-word window that the text holds at least twice."""

    def windows(w: Column) -> Column:
        n = F.greatest(F.size(w) - 2, F.lit(0))
        parts = [F.slice(w, k, n).alias(f"w{k}") for k in (1, 2, 3)]
        return F.arrays_zip(*parts, F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")).alias("at"))

    def covered(z: Column) -> Column:
        # Windows in word order: equal ones are neighbours. Each start stands for itself and the two words after it.
        return bound(
            F.sort_array(z),
            lambda s: F.size(
                F.array_distinct(
                    F.flatten(
                        F.transform(
                            F.filter(
                                F.arrays_zip(s.alias("a"), F.slice(s, 2, F.size(s)).alias("b")),
                                lambda p: (p["a"]["w1"] == p["b"]["w1"])
                                & (p["a"]["w2"] == p["b"]["w2"])
                                & (p["a"]["w3"] == p["b"]["w3"]),
                            ),
                            lambda p: F.array(*[p[side]["at"] + k for side in ("a", "b") for k in (0, 1, 2)]),
                        )
                    )
                )
            ),
        )

    def counted(z: Column) -> Column:
        # Most texts repeat no window. Distinct hashes prove that in linear time; only the others are sorted.
        return bound(
            F.transform(z, lambda x: F.xxhash64(x["w1"], x["w2"], x["w3"])),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(z)),
        )

    return bound(windows(words), counted).cast("long")


def measure(docs: DataFrame, *carry: str) -> DataFrame:
    """One row of measurements per document: ``carry`` columns and :data:`MEASURES`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*[F.col(f"`{c}`") for c in carry], text.alias("_t"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: ~x.rlike("\\p{L}"))).cast("long").alias("n_plain_words"),
        )

    def of_marks(marks: Column) -> Column:
        return F.struct(
            count_chars(marks, SYMBOLS).alias("n_symbols"),
            count_chars(marks, "!").alias("n_exclaim"),
            F.char_length(F.regexp_replace(marks, f"[!{SYMBOLS}]+", "")).cast("long").alias("n_upper"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    with_word = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    # One scan keeps the few characters that are counted; the counts then run over that short rest.
    marks = F.regexp_replace("_t", f"[^\\p{{Lu}}!{SYMBOLS}]+", "")
    measured = base.select(
        *[F.col(f"`{c}`") for c in carry],
        bound(words_of(F.col("_t")), of_words).alias("_w"),
        bound(with_word, of_lines).alias("_l"),
        bound(marks, of_marks).alias("_m"),
    )
    return measured.select(*[F.col(f"`{c}`") for c in carry], "_w.*", "_l.*", "_m.*")


def ledger(docs: DataFrame, *carry: str) -> DataFrame:
    """Measurements and ``fail_bits`` of every document."""
    bits = F.lit(0).cast("long")
    for k, fails in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(fails(), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, *carry).withColumn("fail_bits", bits)


def passes(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policies(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """The ledger with a boolean ``<name>_v<version>`` per policy."""
    return entries.select("*", *[passes(p).alias(f"{p.name}_v{p.version}") for p in policies])


def ablation(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """What each rule does in each policy: documents it fails, fails alone, and kept without it.

    The ledger is folded to one row per combination of bits first, at most two to the power of the number of rules.
    """
    folded = entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = F.array(
        *[
            F.struct(
                F.lit(p.name).alias("policy"),
                F.lit(p.version).alias("version"),
                F.lit(rule).alias("rule"),
                F.lit(p.mask).cast("long").alias("mask"),
                F.lit(1 << list(RULES).index(rule)).cast("long").alias("bit"),
            )
            for p in policies
            for rule in p.rules
        ]
    )
    each = folded.select("fail_bits", "n", F.explode(cases).alias("c")).select("fail_bits", "n", "c.*")
    failing = F.col("fail_bits").bitwiseAND(F.col("mask"))
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0)).cast("long")
    return each.groupBy("policy", "version", "rule").agg(
        total(failing.bitwiseAND(F.col("bit")) != 0).alias("n_fail"),
        total(failing == F.col("bit")).alias("n_only"),
        total(failing == 0).alias("n_kept"),
        total(failing.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    )


def op1(docs: DataFrame) -> DataFrame:
    """The ledger under the strict policy, which its SQL defines; see the module for empty, NULL and repeated input."""
    base = POLICIES[0]
    return ledger(docs, "doc_id").select("doc_id", *MEASURES, (~passes(base)).alias("base_failed"), passes(STRICT).alias("kept"), "fail_bits")
