"""Connected components by alternating stars, and properties spread over them.

Edges are kept as (high, low). A large star ties every neighbour above a node to
the least of the node's neighbourhood; a small star ties the node and those
below it to the least of them. Both keep the components, and alternating they
end in stars around the least nodes after a number of rounds that grows with the
logarithm of the size, for long paths too. Each half is an aggregate (least
neighbour, combined before it is shuffled) and a join back to the edges; nodes
with very many edges are joined by a small table that every task has, so a hub's
edges stay where they are. Each half's edges are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.sources.shared import written

#: Rows from which a key is a hub, if there are few enough of such (rows / hubs): the broadcast table has no more keys than this.
HUB = 10_000


def keyed_join(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """The inner join of many rows with one row a key; ``values`` has (key, value, n), n the key's number of rows.

    Keys with more than max(HUB, total / HUB) rows are fewer than HUB; they are
    sent to every task, only the others are shuffled.
    """
    limit = max(HUB, total // HUB)
    hubs = F.broadcast(values.where(F.col("n") > limit).select(key, F.col("value").alias("_hub")))
    marked = rows.join(hubs, key, "left")
    far = marked.where("_hub is not null").withColumnRenamed("_hub", "value")
    near = marked.where("_hub is null").drop("_hub").join(values.where(F.col("n") <= limit).select(key, "value"), key)
    return far.unionByName(near)


def _large(edges: DataFrame, total: int) -> DataFrame:
    ends = edges.select(F.explode(F.array(F.struct(F.col("low").alias("u"), F.col("high").alias("v"), F.lit(1).alias("up")), F.struct(F.col("high").alias("u"), F.col("low").alias("v"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    least = ends.groupBy(F.col("u").alias("low")).agg(F.least(F.first("u"), F.min("v")).alias("value"), F.sum("up").alias("n")).where("n > 0")
    return written(keyed_join(edges, least, "low", total).select("high", F.col("value").alias("low")).distinct())


def _small(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("high").agg(F.min("low").alias("value"), F.count("*").alias("n"))
    tied = keyed_join(edges, least, "high", total).where("low > value").select(F.col("low").alias("high"), F.col("value").alias("low"))
    return written(tied.unionByName(least.select("high", F.col("value").alias("low"))).distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that each node is linked to; edges (a, b).

    Rows with a null end are left out; a node with an edge to itself only is its
    own component; repeated and reversed edges count once.
    """
    known = written(edges.where("a is not null and b is not null").select("a", "b"))
    stars = written(known.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())
    before = mark(stars)
    while before[0]:
        stars = _small(_large(stars, before[0]), before[0])
        after = mark(stars)
        if after == before:
            break
        before = after
    nodes = known.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(stars.select(F.col("high").alias("node"), "low"), "node", "left").select("node", F.coalesce("low", "node").alias("label"))


def spread(labels: DataFrame, having: DataFrame) -> DataFrame:
    """labels (node, label) with ``has``: whether any node of the component is in ``having`` (node)."""
    labels = written(labels)
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    found = labels.join(having.select("node").distinct(), "node", "left_semi").select("label").distinct().withColumn("value", F.lit(True))
    values = sizes.join(found, "label", "left").select("label", F.coalesce("value", F.lit(False)).alias("value"), "n")
    return keyed_join(labels, values, "label", labels.count()).select("node", "label", F.col("value").alias("has"))
