"""Clusters in seed order: what a serial pass over the points would give, in rounds.

A point is a seed if no earlier seed is near; the others join a seed that came
before them. That is the lexicographically first maximal independent set of the
graph of near points, and a point can decide as soon as all earlier points near
it have. Points are kept in cells so small that all points of a cell are near
each other: a cell has one seed at most, and in a round only its first open
point can become one. So a round compares each open point with the first points
of the 25 cells around, never with the other points of a crowd, and no edge is
written. Each round is a written table; there are as many as the longest chain
of near points in rising order (a few dozen where the order is no walk along a
line; each decides the first open point of all, so it ends).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.sources.shared import written

#: Near: a column of two points' x and y. Cell: the share of the radius within which all are near each other.
EUCLID = (lambda dx, dy, r: F.sqrt(dx * dx + dy * dy) < r, 0.999 / math.sqrt(2))
BOX = (lambda dx, dy, r: (F.abs(dx) < r) & (F.abs(dy) < r), 0.999)
#: Points of a cell from which on they are dealt among several tasks, so many at most in each.
CROWD = 20_000


def _around(df: DataFrame) -> DataFrame:
    """The rows in each of the 25 cells around theirs."""
    near = F.array(*(F.lit(k).cast("bigint") for k in range(-2, 3)))
    return df.withColumn("_y", F.explode(F.transform(near, lambda k: F.col("_cy") + k))).withColumn("_x", F.explode(F.transform(near, lambda k: F.col("_cx") + k)))


def _meet(points: DataFrame, firsts: DataFrame, keys: list[str], radius: float, near: Callable[[Column, Column, float], Column], before: Callable[[Column, Column], Column]) -> DataFrame:
    """p, f: points with those of few rows a cell that are near them, an array a point, and before(p's, f's rank).

    The few rows around a cell come to it as one array, once for each CROWD of its points. Joins are never broadcast:
    sizes that Spark guesses know nothing of the 25 cells that a row becomes.
    """
    cell = [*keys, "_y", "_x"]
    around = _around(firsts).groupBy(*cell).agg(F.collect_list(F.struct("_rank", "x", "y")).alias("fs"))
    here = points.groupBy(*keys, F.col("_cy").alias("_y"), F.col("_cx").alias("_x")).agg(F.max("_tasks").alias("_tasks"))
    f = around.join(here.hint("merge"), cell).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1))).drop("_tasks")
    p = points.select(*keys, F.col("_cy").alias("_y"), F.col("_cx").alias("_x"), F.pmod(F.xxhash64("_rank"), F.col("_tasks")).cast("int").alias("_salt"), F.struct("_rank", "x", "y").alias("p"))
    close = F.filter("fs", lambda f: before(F.col("p._rank"), f["_rank"]) & near(F.col("p.x") - f["x"], F.col("p.y") - f["y"], radius))
    return p.join(f.hint("merge"), [*cell, "_salt"]).select(*keys, "p", close.alias("f")).where(F.size("f") > 0)


def _placed(points: DataFrame, keys: list[str], order: list[str], radius: float, share: float) -> DataFrame:
    known = points.where("x is not null and y is not null")
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    cell = [*keys, "_cy", "_cx"]
    placed = known.select(*keys, F.struct(*order).alias("_rank"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.floor(F.col("y") / (radius * share)).alias("_cy"), F.floor(F.col("x") / (radius * share)).alias("_cx"))
    crowded = placed.groupBy(*cell).agg(F.ceil(F.count("*") / CROWD).cast("int").alias("_tasks")).where("_tasks > 1")  # a row for CROWD points at most
    return placed.join(F.broadcast(crowded), cell, "left").withColumn("_tasks", F.coalesce("_tasks", F.lit(1)))


def seeds(points: DataFrame, keys: list[str], order: list[str], radius: float, metric=EUCLID) -> DataFrame:
    """keys, _rank (struct of the order), x, y, _cy, _cx of the seeds; the order is unique within the keys."""
    near, share = metric
    left, found = written(_placed(points, keys, order, radius, share)), []
    while not left.isEmpty():
        row = ("_rank", "x", "y")
        first = left.groupBy(*keys, "_cy", "_cx").agg(F.min(F.struct(*row)).alias("m")).select(*keys, "_cy", "_cx", *(F.col(f"m.{c}").alias(c) for c in row))
        blocked = _meet(left, first, keys, radius, near, lambda p, f: p < f).select(*keys, F.explode("f._rank").alias("_rank")).distinct()
        new = written(first.join(blocked.hint("merge"), [*keys, "_rank"], "left_anti"))
        gone = _meet(left, new, keys, radius, near, lambda p, f: F.lit(True)).select(*keys, F.col("p._rank").alias("_rank"))
        left = written(left.join(gone.hint("merge"), [*keys, "_rank"], "left_anti"))
        found.append(new)
    if not found:
        return left
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def distinct_points(points: DataFrame, keys: list[str], order: list[str], radius: float) -> DataFrame:
    """keys and order of the points that no earlier kept one of their keys is near, in both x and y."""
    return seeds(points, keys, order, radius, BOX).select(*keys, "_rank.*")


def grid_cluster(points: DataFrame, order: list[str], radius: float) -> DataFrame:
    """seed (struct of the order), n, x, y (centroid): groups of the points (x, y, order columns) within a radius of a seed.

    Of several seeds before a point, it joins the nearest of those in the
    leftmost column of radius-wide cells that has one, as the serial search
    does, which looks column by column. Points without coordinates are in none.
    """
    near, share = EUCLID
    chosen = written(seeds(points, [], order, radius))
    column = lambda c: F.floor(F.col(c) / radius)
    d = F.sqrt((F.col("p.x") - F.col("f.x")) * (F.col("p.x") - F.col("f.x")) + (F.col("p.y") - F.col("f.y")) * (F.col("p.y") - F.col("f.y")))
    own = F.when(F.col("p._rank") == F.col("f._rank"), 0).otherwise(1)
    best = _meet(_placed(points, [], order, radius, share), chosen, [], radius, near, lambda p, f: f <= p).select("p", F.explode("f").alias("f"))
    joined = best.groupBy("p").agg(F.min(F.struct(own.alias("own"), column("f.x").alias("column"), d.alias("d"), column("f.y").alias("row"), F.col("f._rank").alias("seed"))).alias("m"))
    return joined.groupBy(F.col("m.seed").alias("seed")).agg(F.count("*").alias("n"), F.avg("p.x").alias("x"), F.avg("p.y").alias("y"))
