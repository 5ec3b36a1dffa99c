"""Points in polygons by a quadtree cover.

A polygon is an id and its rings, arrays of (x, y); holes and islands are rings
like any other (even-odd rule). A polygon starts as the cells of ``size`` that
its box meets. A cell that no edge crosses is all in or all out: it is kept as
inner, or dropped. A crossed cell is cut in four, level by level, until few
edges concern it: those in its rows of y that are not left of it, which are all
that the even-odd test of its points can count; edges that pass it on the right
from below to above count for all its points and are folded into one bit. So
points of inner cells are accepted untested, and those near a border meet a few
edges, not the polygon. Points find cells by an equi join at each level; nothing is
broadcast and no polygon, however large, is in one row beyond its first cells.

Defined results: a point on a border belongs to the side that the rule gives (a
lower or left border is in); rings may be closed or not; rings of fewer than
three points hold nothing; null coordinates and empty polygons match nothing;
points with equal ids each come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.sources.shared import written

#: Edges up to which a crossed cell is not cut any more, and the most levels.
FEW = 8
LEVELS = 8


def _edges(rings: Column) -> Column:
    """All rings' edges (x1, y1, x2, y2), each ring closed; edges without length are left out."""
    whole = F.filter(rings, lambda r: F.size(r) >= 3)
    after = lambda r: F.concat(F.slice(r, F.lit(2), F.size(r) - 1), F.slice(r, 1, 1))
    edge = lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    return F.filter(F.flatten(F.transform(whole, lambda r: F.zip_with(r, after(r), edge))), lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))


def holds(x: Column, y: Column, edges: Column) -> Column:
    """The even-odd rule: whether a ray to the right crosses an odd number of edges."""
    crossed = F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    return F.size(crossed) % 2 == 1


def _crosses(e: Column, s: Column, w: Column, n: Column, o: Column) -> Column:
    """Whether an edge may meet a box: their boxes do, and the box's corners are not all on one side."""
    boxes = (F.least(e["x1"], e["x2"]) <= o) & (F.greatest(e["x1"], e["x2"]) >= w) & (F.least(e["y1"], e["y2"]) <= n) & (F.greatest(e["y1"], e["y2"]) >= s)
    side = lambda x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    sides = [side(x, y) for x in (w, o) for y in (s, n)]
    return boxes & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def cover(polygons: DataFrame, size: float) -> DataFrame:
    """polygon, level, cx, cy, odd, edges: the cells of polygons (id, rings); edges are null in inner cells, odd is whether the folded ones are."""
    whole = polygons.select(F.col("id").alias("polygon"), _edges(F.col("rings")).alias("edges")).where("size(edges) > 0")
    low = lambda c: F.array_min(F.transform("edges", lambda e: F.least(e[f"{c}1"], e[f"{c}2"])))
    high = lambda c: F.array_max(F.transform("edges", lambda e: F.greatest(e[f"{c}1"], e[f"{c}2"])))
    cells = lambda c: F.explode(F.sequence(F.floor(low(c) / size), F.floor(high(c) / size)))
    open_ = whole.withColumn("odd", F.lit(False)).withColumn("cx", cells("x")).withColumn("cy", cells("y"))
    done, level = None, 0
    while True:
        side = size / 2**level
        slack = side * 1e-9  # a point's cell and a cell's sides are rounded apart
        w, s = F.col("cx") * F.lit(side) - slack, F.col("cy") * F.lit(side) - slack
        o, n = (F.col("cx") + 1) * F.lit(side) + slack, (F.col("cy") + 1) * F.lit(side) + slack
        low_y, high_y = lambda e: F.least(e["y1"], e["y2"]), lambda e: F.greatest(e["y1"], e["y2"])
        passes = lambda e: (F.least(e["x1"], e["x2"]) > o) & (low_y(e) <= s) & (high_y(e) >= n)
        concerns = F.filter("edges", lambda e: (low_y(e) <= n) & (high_y(e) >= s) & (F.greatest(e["x1"], e["x2"]) >= w))
        at = open_.withColumn("edges", concerns).withColumn("odd", F.col("odd") != (F.size(F.filter("edges", passes)) % 2 == 1)).withColumn("edges", F.filter("edges", lambda e: ~passes(e)))
        at = at.withColumn("crossed", F.exists("edges", lambda e: _crosses(e, s, w, n, o)))
        at = written(at.where(F.col("crossed") | (F.col("odd") != holds((w + o) / 2, (s + n) / 2, F.col("edges")))).withColumn("level", F.lit(level)))
        final = F.lit(level == LEVELS) | ~F.col("crossed") | (F.size("edges") <= FEW)
        kept = at.where(final).select("polygon", "level", "cx", "cy", "odd", F.when(F.col("crossed"), F.col("edges")).alias("edges"))
        done = kept if done is None else done.unionByName(kept)
        rest = at.where(~final)
        if rest.isEmpty():
            return done
        halves = lambda c: F.explode(F.array(2 * F.col(c), 2 * F.col(c) + 1))
        open_ = rest.select("polygon", "edges", "odd", halves("cx").alias("cx"), "cy").select("polygon", "edges", "odd", "cx", halves("cy").alias("cy"))
        level += 1


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """id, polygon of the points (id, x, y) in each polygon (id, rings)."""
    cells = written(cover(polygons, size))
    levels = sorted(r.level for r in cells.select("level").distinct().collect())  # LEVELS + 1 at most
    if not levels:
        return points.select("id").limit(0).crossJoin(cells.select("polygon").limit(0))
    known = points.where("x is not null and y is not null").select("id", "x", "y", F.explode(F.array(*map(F.lit, levels))).alias("level"))
    cell = lambda c: F.floor(F.col(c) / (F.lit(size) / F.pow(F.lit(2.0), F.col("level"))))
    met = known.withColumn("cx", cell("x")).withColumn("cy", cell("y")).join(cells, ["level", "cx", "cy"])
    return met.where(F.col("edges").isNull() | (F.col("odd") != holds(F.col("x"), F.col("y"), F.col("edges")))).select("id", "polygon")
