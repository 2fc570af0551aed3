"""Every tree of the isolation forest draws from all rows, at every size."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from agrovane.ml import isolation
from agrovane.sources.schemas import KEY


def test_each_tree_draws_from_all_rows(spark, rows):
    """4,000 rows for 6 trees of 8 rows: far more rows than the trees want together."""
    table = spark.range(4000).select(
        F.col("id").cast("string").alias("codigo_municipio"),
        F.lit("x").alias("cultivo"),
        F.lit("2001-01-01").cast("date").alias("periodo"),
        (F.col("id") * F.lit(1.0)).alias("value"),
    )
    nodes = isolation.fit_forest(table, ["value"], trees=6, sample=8, seed=3)
    assert nodes.select("tree").distinct().count() == 6
    # Thresholds lie between a tree's extremes, so the root's threshold tells its sample's range; the sample itself is
    # the 8 least hashes of (row, tree) among all rows.
    key = F.shiftrightunsigned(F.xxhash64(F.lit(3), *KEY), 11)
    each = table.select(*KEY, "value", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("tree"), key.alias("u"))
    each = each.withColumn("h", F.shiftrightunsigned(F.xxhash64("u", "tree"), 11))
    order = Window.partitionBy("tree").orderBy("h")
    best = each.withColumn("rn", F.row_number().over(order)).where("rn <= 8")
    drawn = isolation._samples(isolation._filled(table, ["value"]), ["value"], "global", 6, 8, 3)
    assert rows(drawn.select("tree", "_rn", "value")) == rows(best.select("tree", "rn", "value"))
    extremes = {r["tree"]: (r["lo"], r["hi"]) for r in best.groupBy("tree").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).collect()}
    inner = nodes.where("feature >= 0").groupBy("tree").agg(F.min("threshold").alias("lo"), F.max("threshold").alias("hi"))
    assert all(extremes[r["tree"]][0] <= r["lo"] and r["hi"] <= extremes[r["tree"]][1] for r in inner.collect())
