"""Quality classifier: a sparse ensemble of rules over text statistics.

A forest of shallow trees is grown on labelled rows. Every path from a root to a node is a conjunctive rule. A logistic
regression with an L1 penalty over the rules keeps a few of them with weights, and those become one Spark column
expression, so scoring is a projection over the statistics.

Rows with crc32(doc_id) mod 5 = 0 are held out. Label, language, source and id are no inputs. Training uses at most
``max_rows`` labelled rows, drawn by a hash of the id; statistics and scores cover every row.

Defined cases: NULL or empty text has zero counts and gets a score like any text; a NULL id is held out and never
labelled; labels other than 0 and 1, and documents with contradicting labels, are not learned from; without both labels
the score is the smoothed share of ones (0.5 without labels); repeated rows are scored alike; an empty table gives an empty result; additional columns are
ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrovane.llm.quality_rules import measure
from agrovane.scale import materialize

THRESHOLD = 0.3
MAX_TRAINING_ROWS = 200_000
TREES, DEPTH, SEED = 24, 3, 7
#: Weight of the L1 penalty, and the weight under which a rule is left out.
PENALTY, LEAST_WEIGHT = 5e-4, 1e-6

_share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
FEATURES = {
    "log_words": lambda: F.log1p(F.col("n_words")),
    "word_length": lambda: _share("word_chars", "n_words"),
    "symbols": lambda: _share("n_symbols", "n_words"),
    "dup_lines": lambda: _share("n_dup_lines", "n_lines"),
    "repeats": lambda: _share("n_repeat_words", "n_words"),
    "plain_words": lambda: _share("n_plain_words", "n_words"),
    "upper": lambda: _share("n_upper", "word_chars"),
    "exclaims": lambda: _share("n_exclaim", "n_words"),
    "line_words": lambda: F.log1p(_share("n_words", "n_lines")),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


Rule = frozenset[Condition]


def tightened(conditions: list[Condition]) -> Rule:
    """The conditions without those that another one implies."""
    best: dict[tuple[str, bool], float] = {}
    for c in conditions:
        key = c.feature, c.above
        best[key] = c.threshold if key not in best else (max if c.above else min)(best[key], c.threshold)
    return frozenset(Condition(f, above, t) for (f, above), t in best.items())


def paths(described: str, features: list[str]) -> set[Rule]:
    """Rules of the trees that a model's description lists: one for every node but the roots."""
    found, stack = set(), []
    for line in described.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if m:
            depth = len(m[1])
            while stack and stack[-1][0] >= depth:
                stack.pop()
            stack.append((depth, Condition(features[int(m[2])], m[3] == ">", float(m[4]))))
            found.add(tightened([c for _, c in stack]))
        elif line.strip().startswith("Tree"):
            stack.clear()
    return found


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules and an intercept; ``score`` is the compiled column."""

    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            holds = reduce(and_, [c.column() for c in sorted(rule, key=repr)])
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def statistics(docs: DataFrame) -> DataFrame:
    """Stored features of every document: one pass over the texts, thin rows."""
    measured = measure(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    return materialize(measured.select("doc_id", *[make().cast("double").alias(name) for name, make in FEATURES.items()]), "statistics")


def training_rows(features: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Labelled rows that are not held out, at most about ``max_rows``."""
    known = (
        labels.where(F.col("quality").isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
        .where("label = other")
        .select("doc_id", F.col("label").cast("double").alias("label"))
    )
    rows = materialize(features.where(~held_out()).join(known, "doc_id"), "labelled")
    total = rows.count()
    if total > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * max_rows / total)))
    return rows


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Ensemble:
    """Rules and weights from labelled rows (features and ``label``)."""
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        ones, total = counts.get(1.0, 0), sum(counts.values())
        share = (ones + 1) / (total + 2)
        return Ensemble(math.log(share / (1 - share)), ())
    names = list(FEATURES)
    # A fixed order of rows makes the trees' samples the same in every run.
    ordered = rows.repartition(8, "doc_id").sortWithinPartitions("doc_id", *names)
    data = VectorAssembler(inputCols=names, outputCol="features").transform(ordered).select("features", "label", *names)
    data = data.persist()
    try:
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="all", subsamplingRate=0.5).fit(data)
        rules = sorted(paths(forest.toDebugString, names), key=lambda r: sorted(map(repr, r)))
        flags = [reduce(and_, [c.column() for c in sorted(r, key=repr)]).cast("double").alias(f"r{k}") for k, r in enumerate(rules)]
        table = data.select("label", *flags)
        table = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="features").transform(table)
        model = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(table.select("features", "label"))
    finally:
        data.unpersist()
    weights = [(r, float(w)) for r, w in zip(rules, model.coefficients, strict=True) if abs(w) > LEAST_WEIGHT]
    return Ensemble(float(model.intercept), tuple(weights))


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Held-out flag, score and prediction of every document."""
    features = statistics(docs)
    score = fit(training_rows(features, labels)).score()
    return features.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    )
