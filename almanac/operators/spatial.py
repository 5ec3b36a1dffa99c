"""Joins and groupings by distance. Points are columns id, lat, lng (degrees).

Distance joins go by cells in bands of latitude: a band has so many cells around
the globe that each is as wide as the distance at least. One side keeps its own
cell, the other is repeated in the cells of its own and the neighbouring bands
that the distance can reach, across the date line and around the poles; an equi
join on the cell and the exact distance follow. Points without coordinates are
in no cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.geo import DEGREE, EARTH, boxes_meet, haversine, whole
from almanac.sources.shared import written

#: Points that a cube may have at the end of a search for the nearest, levels after which it ends (cubes of some metres), and what straight lines on the unit sphere are rounded by.
LEAF = 32
DEEPEST = 11
ROUNDING = 1e-12
#: Times that the search for some nearest ones within a distance doubles its circle.
CIRCLES = 8
#: Pivots of a medoid's first and later rounds, tasks a group's points are dealt among, micrometres by which a distance may be off (next to the antipode).
FIRST_PIVOTS = 8
MOST_PIVOTS = 1024
SALTS = 8
SLACK = 1e5


def grid_cells(df: DataFrame, metres: float, around: bool) -> DataFrame:
    """The rows with their cell _y, _x, or repeated in the cells that a distance can reach from them."""
    height = metres * 1.01 / DEGREE
    # cells of a band: as wide as the distance at the band's narrow side
    edge = lambda y: F.least(F.lit(90.0), F.greatest(F.abs(y * height), F.abs((y + 1) * height)))
    cells = lambda y: F.greatest(F.lit(1), F.floor(F.cos(F.radians(edge(y))) * (360 / height))).cast("bigint")
    at = lambda lng, y: F.floor((lng + 180) / 360 * cells(y)).cast("bigint")
    df, y = df.where("lat is not null and lng is not null"), F.floor(F.col("lat") / height)
    if not around:
        return df.withColumn("_y", y).withColumn("_x", F.pmod(at(F.col("lng"), y), cells(y)))
    reach = metres * 1.01 / EARTH
    if reach < math.pi / 2:
        side = F.degrees(F.asin(F.lit(math.sin(reach)) / F.cos(F.radians("lat"))))  # the farthest meridian that the circle touches
        side = F.when(F.abs("lat") + math.degrees(reach) < 90, side).otherwise(180.0)
    else:
        side = F.lit(180.0)
    df = df.withColumn("_y", F.explode(F.transform(F.array(*(F.lit(k).cast("bigint") for k in (-1, 0, 1))), lambda k: y + k))).withColumn("_side", side)
    first, last, n = at(F.col("lng") - F.col("_side"), F.col("_y")), at(F.col("lng") + F.col("_side"), F.col("_y")), cells(F.col("_y"))
    wide = F.when(last - first + 1 >= n, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.transform(F.sequence(first, last), lambda x: F.pmod(x, n)))
    return df.withColumn("_x", F.explode(wide)).drop("_side")


def _pair() -> Column:
    return haversine(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))


def _straight_square() -> Column:
    """The square of the straight line through the unit sphere between the points a0, a1, a2 and b0, b1, b2."""
    return sum(((F.col(f"a{k}") - F.col(f"b{k}")) * (F.col(f"a{k}") - F.col(f"b{k}")) for k in range(3)), F.lit(0.0))


def _met(a: DataFrame, b: DataFrame, metres: float, repeated: str) -> DataFrame:
    """a_id, b_id and both points of all pairs within a distance.

    Straight lines through the sphere tell nearly all pairs apart; only where rounding could matter the distance itself is looked at.
    """
    sure = lambda c: F.coalesce(c, F.lit(0.0))  # noqa: E731  (no nulls are left: with checks for them the code of a pair gets too long to be compiled)
    side = lambda df, p: _vector(grid_cells(df.select("id", "lat", "lng"), metres, repeated == p)).select(F.col("id").alias(f"{p}_id"), *(sure(c).alias(f"{p}_{c}") for c in ("lat", "lng")), *(sure(f"_v{k}").alias(f"{p}{k}") for k in range(3)), "_y", "_x")
    line, square = 2 * math.sin(min(metres / EARTH, math.pi) / 2), _straight_square()
    near = F.when(square < max(0.0, line * (1 - 1e-6) - 1e-12) ** 2, True).when(square > (line * (1 + 1e-6) + 1e-12) ** 2, False).otherwise(_pair() <= metres)
    return side(a, "a").join(side(b, "b"), ["_y", "_x"]).where(near)


def radius_join(a: DataFrame, b: DataFrame, metres: float, repeated: str = "b") -> DataFrame:
    """a_id, b_id, d of all pairs within a distance (inclusive), anywhere on the sphere; the rows of ``repeated``, best the smaller table, are put in all cells around."""
    return _met(a, b, metres, repeated).select("a_id", "b_id", _pair().alias("d"))


def radius_metres(a: DataFrame, b: DataFrame, metres: float, repeated: str = "b") -> DataFrame:
    """a_id, b_id, metres: as radius_join, in whole metres.

    Up to some 100 km the distance is summed up from the straight line, to less
    than a micrometre; where that could change the rounding it is worked out.
    """
    x = _straight_square() / 4
    d = F.lit(2 * EARTH) * F.sqrt(x) * (1 + x * (1 / 6 + x * (3 / 40 + x * (5 / 112))))
    part = d - d.cast("bigint")
    short = F.when((x > 6e-5) | (F.abs(part - 0.5) < 1e-6), whole(_pair())).otherwise(d.cast("bigint") + (part >= 0.5).cast("bigint"))
    return _met(a, b, metres, repeated).select("a_id", "b_id", short.alias("metres"))


def nearest_n(pairs: DataFrame, n: int) -> DataFrame:
    """The n nearest of each a_id, with their rank; ties by b_id."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a_id").orderBy("d", "b_id"))).where(F.col("rank") <= n)


def nearest_within(a: DataFrame, b: DataFrame, metres: float, n: int, repeated: str = "b") -> DataFrame:
    """a_id, b_id, d, rank of the n nearest b within a distance of each a (ids unique); ties by b_id.

    A search in growing circles: rows that have n within one are done, the
    others go on to the next, twice as wide. Of the b at one place the n least
    ids are enough.
    """
    at = Window.partitionBy("lat", "lng").orderBy("id")
    few = written(b.select("id", "lat", "lng").where("lat is not null and lng is not null").withColumn("_k", F.row_number().over(at)).where(F.col("_k") <= n).drop("_k"))
    left, found, reach = written(a.select("id", "lat", "lng").where("lat is not null and lng is not null")), None, metres / 2**CIRCLES
    while True:
        pairs = nearest_n(radius_join(left, few, reach, repeated), n)
        if reach >= metres:
            return pairs if found is None else found.unionByName(pairs)
        full = written(pairs.withColumn("_n", F.count("*").over(Window.partitionBy("a_id"))).where(F.col("_n") == n).drop("_n"))
        found = full if found is None else found.unionByName(full)
        left = written(left.join(full.where("rank = 1").select(F.col("a_id").alias("id")).hint("merge"), "id", "left_anti"))
        reach = metres if left.isEmpty() else min(metres, 2 * reach)


def radius_fallback(a: DataFrame, b: DataFrame, near: float, far: float, n: int, repeated: str = "b") -> DataFrame:
    """The n nearest within ``near``; where there are none, within ``far``."""
    pairs = nearest_within(a, b, far, n, repeated)
    any_near = F.min("d").over(Window.partitionBy("a_id")) <= near
    return pairs.withColumn("near", any_near).where(~F.col("near") | (F.col("d") <= near)).select("a_id", "b_id", "d", "rank", "near")


def _vector(df: DataFrame) -> DataFrame:
    """The rows with their point on the unit sphere in _v0, _v1, _v2."""
    lat, lng = F.radians("lat"), F.radians("lng")
    return df.withColumn("_v0", F.cos(lat) * F.cos(lng)).withColumn("_v1", F.cos(lat) * F.sin(lng)).withColumn("_v2", F.sin(lat))


def _cube(level: int) -> Column:
    """A point's cube at a level: the space around the sphere is cut in 4 along each axis from level to level."""
    return F.array(*(F.floor((F.col(f"_v{k}") + 1) * 4**level / 2).cast("bigint") for k in range(3)))


def _straight(v: list[Column], w: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(v, w, strict=True)), F.lit(0.0)))


def nearest_one(a: DataFrame, b: DataFrame) -> DataFrame:
    """a_id, b_id, d of the nearest b of each a, however far; ties by b_id.

    A search down a tree of cubes around the sphere. Of each cube that holds
    points of b one point is known; the nearest known one bounds a row's
    distance, and cubes that begin beyond it are left. So a row meets a few
    cubes a level and the points of its last ones, be it amid a crowd or far
    out. Levels go on until no cube has more than ``LEAF`` different points.
    Nulls only where a has no coordinates or no b has any.
    """
    me, you = [F.col(f"a.v{k}") for k in range(3)], [F.col(f"_v{k}") for k in range(3)]
    left = written(_vector(a.select("id", "lat", "lng").where("lat is not null and lng is not null")).select(F.struct("id", "lat", "lng", *(F.col(f"_v{k}").alias(f"v{k}") for k in range(3))).alias("a")))
    points = written(_vector(b.where("lat is not null and lng is not null").groupBy("lat", "lng").agg(F.min("id").alias("id"))))
    level, front = 0, left.withColumn("cube", F.array(F.lit(0), F.lit(0), F.lit(0)).cast("array<bigint>"))
    full = points.count()
    while full > LEAF and level < DEEPEST:
        level += 1
        cubes = written(points.groupBy(_cube(level).alias("_cube")).agg(F.count("*").alias("_n"), F.min(F.struct(*you)).alias("_m")).select("_cube", "_n", "_m.*"))
        full = cubes.agg(F.max("_n")).first()[0]
        parent = F.transform("_cube", lambda c: F.floor(c / 4).cast("bigint")) if level > 1 else F.array(F.lit(0), F.lit(0), F.lit(0)).cast("array<bigint>")
        met = front.join(cubes.withColumn("cube", parent), "cube")
        size = 2 / 4**level
        corner = [F.get("_cube", F.lit(k)) * size - 1 for k in range(3)]
        inside = [F.greatest(c, F.least(c + size, v)) for c, v in zip(corner, me, strict=True)]  # the cube's nearest point
        met = met.select("a", "_cube", _straight(me, you).alias("known"), _straight(me, inside).alias("begins"))
        bound = met.groupBy(F.col("a.id").alias("_id")).agg(F.min("known").alias("bound"))
        front = written(met.join(bound, F.col("a.id") == F.col("_id")).where(F.col("begins") <= F.col("bound") + ROUNDING).select("a", F.col("_cube").alias("cube")).distinct())
    ends = points.withColumn("cube", _cube(level) if level else F.array(F.lit(0), F.lit(0), F.lit(0)).cast("array<bigint>"))
    d = haversine(F.col("a.lat"), F.col("a.lng"), F.col("lat"), F.col("lng"))
    best = front.join(ends, "cube").groupBy(F.col("a.id").alias("a_id")).agg(F.min(F.struct(d.alias("d"), F.col("id").alias("b_id"))).alias("m")).select("a_id", "m.b_id", "m.d")
    return a.select(F.col("id").alias("a_id")).join(best, "a_id", "left")


def boxes_join(x: DataFrame, y: DataFrame, margin: float, size: float) -> DataFrame:
    """a, b of the boxes (id, s, w, n, e) of x and y that meet, x's widened by a margin.

    A box is in each grid cell of ``size`` degrees that it covers; boxes of one
    cell are compared, and a pair counts in the first cell that both cover.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))
    p = x.select(F.col("id").alias("a"), (F.col("s") - margin).alias("s1"), (F.col("w") - margin).alias("w1"), (F.col("n") + margin).alias("n1"), (F.col("e") + margin).alias("e1"))
    q = y.select(F.col("id").alias("b"), F.col("s").alias("s2"), F.col("w").alias("w2"), F.col("n").alias("n2"), F.col("e").alias("e2"))
    p = p.withColumn("_y", cells(F.col("s1"), F.col("n1"))).withColumn("_x", cells(F.col("w1"), F.col("e1")))
    q = q.withColumn("_y", cells(F.col("s2"), F.col("n2"))).withColumn("_x", cells(F.col("w2"), F.col("e2")))
    box = lambda k: tuple(F.col(f"{c}{k}") for c in "swne")
    first = (F.col("_y") == F.floor(F.greatest("s1", "s2") / size)) & (F.col("_x") == F.floor(F.greatest("w1", "w2") / size))
    return p.join(q, ["_y", "_x"]).where(first & boxes_meet(box(1), box(2))).select("a", "b")


def near_point(df: DataFrame, lat: float, lng: float, metres: float, same_place: bool) -> DataFrame:
    """Rows within a distance of a point, nearest first in ``d``; without same_place those at the point (0.5 m) are left out."""
    d = haversine(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))
    out = df.withColumn("d", d).where(F.col("d") <= metres)
    return out if same_place else out.where("d > 0.5")


def medoid_sums(df: DataFrame, group: str) -> DataFrame:
    """group, id, total: exact summed distances (micrometres) of the members that bounds did not rule out, each group's medoid among them.

    A pivot p with sum S in a group of n bounds every other member's sum from
    below: it is |n d(i, p) - S| at least, by the triangle inequality. So each
    round sums up a few pivots against all points, and leaves open only members
    whose bound does not exceed the group's least sum so far. Half of the
    pivots are the members with the least bounds, half are drawn by hash, and
    their number doubles each round up to ``MOST_PIVOTS``. Members at one place
    are one weighted point with their smallest id; a crowded group is salted
    against its pivots. Members without coordinates or group are left out, those
    without id count in the sums and are no medoids.
    """
    micro = lambda lat, lng, lat2, lng2: F.round(haversine(lat, lng, lat2, lng2) * 1e6)
    at = df.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).alias("_g"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    points = written(at.agg(F.count("*").alias("n"), F.min("id").alias("id")))
    sizes = points.groupBy("_g").agg(F.sum("n").alias("_size"))
    salted = points.select("_g", "lat", "lng", "n", F.pmod(F.xxhash64("lat", "lng"), F.lit(SALTS)).cast("int").alias("_salt"))
    left, known, many = points.where("id is not null").join(sizes, "_g").select("_g", "id", "lat", "lng", "_size", F.lit(0.0).alias("bound")), None, FIRST_PIVOTS
    while not left.isEmpty():
        drawn = F.xxhash64("id")
        firsts = lambda *order: left.withColumn("_k", F.row_number().over(Window.partitionBy("_g").orderBy(*order))).where(F.col("_k") <= many // 2).select("_g", "id", "lat", "lng")  # noqa: B023, E731
        pivots = firsts("bound", drawn, "id").unionByName(firsts(F.desc(drawn), "id")).distinct()
        dealt = pivots.select("_g", "id", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        part = micro(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng")).cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)")
        summed = written(salted.join(dealt, ["_g", "_salt"]).groupBy("_g", "id", "p_lat", "p_lng").agg(F.sum(part).alias("total")))
        known = summed if known is None else known.unionByName(summed)
        told = known.groupBy("_g").agg(F.min("total").cast("double").alias("_least")).join(summed.groupBy("_g").agg(F.collect_list(F.struct("id", "p_lat", "p_lng", F.col("total").cast("double").alias("s"))).alias("_pivots")), "_g")
        near = lambda p: F.abs(F.col("_size") * micro(F.col("lat"), F.col("lng"), p["p_lat"], p["p_lng"]) - p["s"])
        open_ = left.join(told, "_g").where(~F.exists("_pivots", lambda p: p["id"] == F.col("id"))).withColumn("bound", F.greatest("bound", F.array_max(F.transform("_pivots", near))))
        left = written(open_.where(F.col("bound") <= F.col("_least") + F.col("_size") * SLACK).select("_g", "id", "lat", "lng", "_size", "bound"))
        many = min(2 * many, MOST_PIVOTS)
    return left.select(F.col("_g").alias(group), "id", F.lit(None).cast("decimal(38,0)").alias("total")) if known is None else known.select(F.col("_g").alias(group), "id", "total")


def medoid(df: DataFrame, group: str) -> DataFrame:
    """group, id, total: the member with the least summed distance (metres) to the others of its group; of equal ones the smallest id."""
    return medoid_sums(df, group).groupBy(group).agg(F.min(F.struct("total", "id")).alias("m")).select(group, F.col("m.id").alias("id"), (F.col("m.total").cast("double") / 1e6).alias("total"))


def medoid_and_far(df: DataFrame, group: str, metres: float) -> DataFrame:
    """group, id, medoid: each group's medoid, and its members from so many metres away from it on."""
    m = df.join(medoid(df, group).select(group, "id"), [group, "id"], "left_semi").select(group, F.col("id").alias("_m"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    d = haversine(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng"))
    return df.join(m, group).withColumn("medoid", F.col("id") == F.col("_m")).where(F.col("medoid") | (d >= metres)).select(group, "id", "medoid")


def off_view(df: DataFrame, box: tuple[float, float, float, float]) -> Column:
    """Direction (N, S, W, E) in which a point is out of a box; null inside."""
    s, w, n, e = box
    return F.when(F.col("lat") > n, "N").when(F.col("lat") < s, "S").when(F.col("lng") < w, "W").when(F.col("lng") > e, "E")


def route_legs(stops: DataFrame, route: str, order: list[str]) -> DataFrame:
    """The stops with ``leg``, metres to the route's next stop; null if either has no point."""
    w = Window.partitionBy(route).orderBy(*order)
    return stops.withColumn("leg", haversine(F.col("lat"), F.col("lng"), F.lead("lat").over(w), F.lead("lng").over(w)))
