"""Mixing sources to target weights by capped water-filling, and the sampling that meets the targets.

``water_fill`` gives every source its share of the budget by weight, clamps those above ``max_epochs`` times their size
and shares what is left among the others by weight, until none is above. ``mix`` turns targets into repetitions: every
document is taken a whole number of times, and documents in a seeded order are taken once more until the fraction that is
left of the source's target is met.

The seeded order is split into 4096 ranges of the hash. Sizes are summed per source and range first, so each range knows
what stands before it and is ordered on its own: a source with a third of all rows is spread over 4096 groups.

Defined cases: NULL or empty text has size 0 and takes 0 words; NULL is a source of its own; a source of size 0 has target
0; repeated rows and NULL ids are rows like any other (equal rows share a place in the order, and which of them is taken
once more makes no difference to the result); an empty table gives an empty result; additional columns are ignored.
Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrovane.llm.common import words_of
from agrovane.scale import materialize

MAX_EPOCHS = 3
SEED = "mix-1"
WIDE = "decimal(19,0)"  # products of two such totals stay exact


def sized(docs: DataFrame, *carry: str) -> DataFrame:
    """``carry`` columns, source and number of words of each document."""
    return docs.select(*[F.col(f"`{c}`") for c in carry], F.col("source").alias("source"), F.size(words_of(F.col("text"))).cast("long").alias("size"))


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1 to ``cycle``, repeating, over the sources in code point order, NULL last.

    The rank of a source is the number of sources in smaller ranges plus its rank within its range, so no task sees them all.
    """
    spread = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    spread = materialize(spread, "sources")
    before = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    # One row per range: at most as many as there are shuffle partitions.
    start = before.withColumn("_start", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1
    return (
        spread.withColumn("_rank", rank)
        .join(start.select("_part", "_start"), "_part")
        .withColumn("weight", ((F.col("_rank") + F.col("_start")) % cycle + 1).cast("long"))
        .drop("_part", "_rank", "_start")
    )


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target`` in words; targets add up to the sum of all sizes.

    The fill level (budget over weight of the sources not clamped) only rises, so a clamped source stays clamped. The
    driver holds three totals per round, never the sources. Integer totals make each target one exact division.
    """
    table = materialize(sources.withColumn("cap", F.col("source_size") * max_epochs), "weights")
    budget = int(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    left, weight = budget, None
    while True:
        clamped = F.lit(False) if weight is None else F.col("cap").cast(WIDE) * F.lit(weight).cast(WIDE) <= F.col("weight").cast(WIDE) * F.lit(left).cast(WIDE)
        total = table.agg(
            F.coalesce(F.sum(F.when(clamped, F.col("cap"))), F.lit(0)).alias("cap"),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        now = budget - int(total["cap"]), int(total["weight"])
        if now[1] == 0 or now == (left, weight):
            break
        left, weight = now
    open_share = F.lit(0.0) if not weight else F.col("weight") * F.lit(left) / F.lit(weight).cast("double")
    return table.withColumn("target", F.least(F.col("cap").cast("double"), open_share)).drop("cap")


def place(seed: str, key: str) -> Column:
    """Position of a document in the seeded order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary"))


def mix(rows: DataFrame, targets: DataFrame, key: str = "doc_id", seed: str = SEED) -> DataFrame:
    """Repetitions of each of ``rows`` (source, size and ``key``): ``copies`` and ``taken`` (copies times size)."""
    placed = rows.withColumn("_place", place(seed, key)).withColumn("_range", F.substring("_place", 1, 3))
    by_range = placed.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    starts = (
        starts.alias("s")
        .join(targets.alias("t"), F.expr("s.source <=> t.source"))
        .select("s.source", "s._range", "s._start", "t.source_size", "t.target")
    )
    within = Window.partitionBy("source", "_range").orderBy("_place", F.col(key), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = (
        placed.alias("p")
        .join(starts.alias("s"), F.expr("p.source <=> s.source AND p._range = s._range"))
        .select("p.*", "s._start", "s.source_size", "s.target")
    )
    # A source of n words with target T: each document floor(T / n) times, and the first T - n * floor(T / n) words of the
    # order once more; the document across that mark goes to the side that holds its middle.
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("source_size") * whole
    again = 2 * (F.col("_start") + F.col("_before")) + F.col("size") <= 2 * rest
    copies = whole + F.when(again & (rest > 0), 1).otherwise(0)
    return joined.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("long")).withColumn("taken", F.col("copies") * F.col("size")).drop("_place", "_range", "_before", "_start")


def targets_of(rows: DataFrame) -> DataFrame:
    """Sources of ``rows`` with size, cyclic weight and target."""
    return water_fill(cyclic_weights(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))


def op9(docs: DataFrame) -> DataFrame:
    """Sizes, targets and words taken of every document; see the module for empty, NULL and repeated input."""
    rows = materialize(sized(docs, "doc_id"), "sized")
    targets = targets_of(rows)
    return mix(rows, targets).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
