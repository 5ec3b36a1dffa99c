"""Queries by distance and place."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from almanac.functions import geo as G
from almanac.operators import clusters as K
from almanac.operators import polygons as P
from almanac.operators import ranking as R
from almanac.operators import spatial as S
from almanac.plans.registry import METRES, Load, query

BOX = (27.4, -82.6, 28.4, -81.9)
PAIR = METRES.format(a="a", b="b")
#: Parts of a place's events at most, so that a busy place is no single row.
BLOCK = 64


@query(f"SELECT a.id AS a_id, b.id AS b_id, CAST(round({PAIR}) AS BIGINT) AS metres FROM places a JOIN stays b ON {PAIR} <= 8000")
def radius_join(t: Load):
    """Stays within 8 km of each place."""
    return S.radius_metres(t("places"), t("stays"), 8000)


@query(f"SELECT a_id, b_id, rank FROM (SELECT a.id AS a_id, b.id AS b_id, CAST(row_number() OVER (PARTITION BY a.id ORDER BY {PAIR}, b.id) AS INTEGER) AS rank FROM places a JOIN stays b ON {PAIR} <= 20000) WHERE rank <= 6")
def radius_top_n(t: Load):
    """The six nearest stays within 20 km of each place."""
    return S.nearest_within(t("places"), t("stays"), 20000, 6).select("a_id", "b_id", "rank")


@query(f"""
SELECT b.id, CAST(round({PAIR}) AS BIGINT) AS metres FROM (SELECT 27.5::DOUBLE AS lat, -82.0::DOUBLE AS lng) a, places b WHERE {PAIR} <= 30000 AND {PAIR} > 0.5
UNION ALL SELECT b.id, CAST(round({PAIR}) AS BIGINT) FROM (SELECT 27.5::DOUBLE AS lat, -82.0::DOUBLE AS lng) a, stays b WHERE {PAIR} <= 30000 AND {PAIR} > 0.5
""")
def nearby_point(t: Load):
    """Places and stays within 30 km of a point, what stands on it left out."""
    both = t("places").select("id", "lat", "lng").unionByName(t("stays").select("id", "lat", "lng"))
    return S.near_point(both, 27.5, -82.0, 30000, same_place=False).select("id", F.round("d").cast("bigint").alias("metres"))


@query(f"SELECT a.id AS stay, b.id AS id, CAST(round({PAIR}) AS BIGINT) AS metres FROM stays a JOIN stays b ON {PAIR} <= 1000")
def nearby_inclusive(t: Load):
    """Stays within 1 km of each stay, itself included."""
    return S.radius_join(t("stays"), t("stays"), 1000).select(F.col("a_id").alias("stay"), F.col("b_id").alias("id"), F.round("d").cast("bigint").alias("metres"))


@query(f"""
WITH p AS (SELECT a.id AS a_id, b.id AS b_id, {PAIR} AS d FROM stays a JOIN places b ON {PAIR} <= 16000), q AS (SELECT *, min(d) OVER (PARTITION BY a_id) <= 1200 AS near FROM p)
SELECT a_id, b_id, near, CAST(row_number() OVER (PARTITION BY a_id ORDER BY d, b_id) AS INTEGER) AS rank FROM q WHERE NOT near OR d <= 1200 QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY d, b_id) <= 5
""")
def radius_fallback(t: Load):
    """Places within 1.2 km of each stay; the five nearest within 16 km where there are none."""
    return S.radius_fallback(t("stays"), t("places"), 1200, 16000, 5, "a").select("a_id", "b_id", "near", "rank")


@query(f"WITH p AS (SELECT a.id AS a_id, b.id AS b_id, {PAIR} AS d FROM places a JOIN stays b ON true), m AS (SELECT a_id, arg_min(b_id, (d, b_id)) AS b_id, min(d) AS d FROM p GROUP BY a_id) SELECT places.id AS a_id, b_id, CAST(round(d) AS BIGINT) AS metres FROM places LEFT JOIN m ON places.id = a_id")
def nearest_one(t: Load):
    """The nearest stay of each place, however far."""
    return S.nearest_one(t("places"), t("stays")).select("a_id", "b_id", F.round("d").cast("bigint").alias("metres"))


@query(f"WITH p AS (SELECT a.id AS a_id, b.id AS b_id, {PAIR} AS d FROM stays a JOIN (SELECT h.id, lat, lng, date FROM happenings h JOIN places ON h.place = places.id WHERE status <> 'cancelled' AND end_date >= DATE '1997-06-15') b ON {PAIR} <= 2000) SELECT a_id, b_id FROM p")
def near_events(t: Load):
    """Live events to come within 2 km of each stay."""
    live = t("happenings").where("status <> 'cancelled' and end_date >= date '1997-06-15'").select("id", "place").join(t("places").select(F.col("id").alias("place"), "lat", "lng"), "place")
    at = live.groupBy("lat", "lng", (F.col("id") % BLOCK).alias("part")).agg(F.collect_list("id").alias("id"))
    return S.radius_join(t("stays"), at, 2000, "a").select("a_id", F.explode("b_id").alias("b_id"))


@query(f"SELECT l_orderkey AS route FROM lineitem WHERE l_suppkey IN (SELECT a.id FROM stays a JOIN places b ON {PAIR} <= 600) GROUP BY 1")
def point_set_proximity(t: Load):
    """Orders of which any supplier is within 600 m of any customer (semi join of point sets)."""
    near = S.radius_join(t("stays"), t("places"), 600).select(F.col("a_id").alias("l_suppkey")).distinct()
    return t("lineitem").join(near, "l_suppkey", "left_semi").select(F.col("l_orderkey").alias("route")).distinct()


_CENTRES = "SELECT n_regionkey AS region, area, avg(lat) AS lat, avg(lng) AS lng FROM {0} JOIN nation ON area = n_nationkey GROUP BY ALL"


@query(f"WITH a AS ({_CENTRES.format('stays')}), b AS ({_CENTRES.format('places')}) SELECT b.area AS area, a.area AS stays, CAST(round({PAIR}) AS BIGINT) AS metres, row_number() OVER (PARTITION BY b.area ORDER BY round({PAIR}, 3), a.area) = 1 AS nearest FROM a JOIN b ON a.region = b.region")
def distance_matrix(t: Load):
    """The centres of each area's places by those of the stays of all areas of its region, the nearest marked."""

    def centres(name: str):
        own = t(name).join(t("nation").select(F.col("n_nationkey").alias("area"), F.col("n_regionkey").alias("region")), "area")
        return own.groupBy("region", "area").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))

    a = centres("stays").select("region", F.col("area").alias("stays"), F.col("lat").alias("slat"), F.col("lng").alias("slng"))
    d = centres("places").join(a, "region").withColumn("d", G.haversine(F.col("slat"), F.col("slng"), F.col("lat"), F.col("lng")))
    first = F.row_number().over(Window.partitionBy("area").orderBy(F.round("d", 3), "stays")) == 1
    return d.select("area", "stays", F.round("d").cast("bigint").alias("metres"), first.alias("nearest"))


@query("""
SELECT id, lat BETWEEN 27.4 AND 28.4 AND lng BETWEEN -82.6 AND -81.9 AS inside, CASE WHEN lat > 28.4 THEN 'N' WHEN lat < 27.4 THEN 'S' WHEN lng < -82.6 THEN 'W' WHEN lng > -81.9 THEN 'E' END AS direction FROM places
""")
def bbox_filter(t: Load):
    return t("places").select("id", G.in_box(F.col("lat"), F.col("lng"), BOX).alias("inside"), S.off_view(t("places"), BOX).alias("direction"))


@query("""
WITH o AS (SELECT *, CASE WHEN lat > 28.4 THEN 'N' WHEN lat < 27.4 THEN 'S' WHEN lng < -82.6 THEN 'W' WHEN lng > -81.9 THEN 'E' END AS direction FROM places),
c AS (SELECT direction, area, count(*) AS n FROM o WHERE direction IS NOT NULL GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY direction) AS total, row_number() OVER (PARTITION BY direction ORDER BY n DESC, area) AS k FROM c)
SELECT direction, CAST(total AS BIGINT) AS total, area, n, n * 2 >= total AS majority FROM r WHERE k = 1
""")
def off_view_summary(t: Load):
    """Points out of a box by direction, with the leading area."""
    off = t("places").withColumn("direction", S.off_view(t("places"), BOX)).where("direction is not null")
    counts = off.groupBy("direction", "area").agg(F.count("*").alias("n"))
    total = counts.groupBy("direction").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "area")).alias("lead"))
    return total.select("direction", "total", "lead.area", (-F.col("lead.m")).alias("n"), (-F.col("lead.m") * 2 >= F.col("total")).alias("majority"))


@query("WITH b AS (SELECT area, min(lat) AS s, min(lng) AS w, max(lat) AS n, max(lng) AS e FROM places GROUP BY area) SELECT x.area AS a, y.area AS b FROM b x JOIN b y ON x.area < y.area AND x.s - 0.06 <= y.n AND x.n + 0.06 >= y.s AND x.w - 0.06 <= y.e AND x.e + 0.06 >= y.w")
def bbox_intersects(t: Load):
    """Areas whose boxes come within 0.06 degrees of each other."""
    b = t("places").groupBy(F.col("area").alias("id")).agg(F.min("lat").alias("s"), F.min("lng").alias("w"), F.max("lat").alias("n"), F.max("lng").alias("e"))
    return S.boxes_join(b, b, 0.06, 0.25).where("a < b")


@query("""
WITH RECURSIVE p AS (SELECT id, lng AS x, lat AS y, row_number() OVER (ORDER BY -score, id) AS i FROM places),
g AS (SELECT 0::BIGINT AS i, []::STRUCT(i BIGINT, x DOUBLE, y DOUBLE)[] AS seeds
  UNION ALL SELECT p.i, CASE WHEN len(list_filter(seeds, lambda s: sqrt((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y)) < 0.01)) > 0 THEN seeds ELSE list_append(seeds, {'i': p.i, 'x': p.x, 'y': p.y}) END FROM g JOIN p ON p.i = g.i + 1),
s AS (SELECT unnest(seeds, recursive := true) FROM (SELECT seeds FROM g ORDER BY i DESC LIMIT 1)),
j AS (SELECT p.*, s.i AS seed, row_number() OVER (PARTITION BY p.i ORDER BY s.i <> p.i, floor(s.x / 0.01), sqrt((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y)), floor(s.y / 0.01), s.i) AS k
  FROM p JOIN s ON s.i <= p.i AND sqrt((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y)) < 0.01)
SELECT f.id AS seed, count(*) AS n, round(avg(j.y), 8) AS lat, round(avg(j.x), 8) AS lng FROM j JOIN p f ON f.i = j.seed WHERE k = 1 GROUP BY f.id
""")
def grid_cluster(t: Load):
    """Places around seeds, the best ones first, within 0.01 degrees."""
    p = t("places").select("id", (-F.col("score")).alias("first"), F.col("lng").alias("x"), F.col("lat").alias("y"))
    return K.grid_cluster(p, ["first", "id"], 0.01).select(F.col("seed.id").alias("seed"), "n", F.round("y", 8).alias("lat"), F.round("x", 8).alias("lng"))


@query("""
WITH RECURSIVE p AS (SELECT id, area, lng AS x, lat AS y, row_number() OVER (PARTITION BY area ORDER BY id) AS i FROM places),
g AS (SELECT DISTINCT area, 0::BIGINT AS i, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[] AS kept FROM p
  UNION ALL SELECT p.area, p.i, CASE WHEN len(list_filter(kept, lambda s: abs(s.x - p.x) < 0.0004 AND abs(s.y - p.y) < 0.0004)) > 0 THEN kept ELSE list_append(kept, {'id': p.id, 'x': p.x, 'y': p.y}) END FROM g JOIN p ON p.area = g.area AND p.i = g.i + 1)
SELECT area, unnest(kept).id AS id FROM (SELECT area, arg_max(kept, i) AS kept FROM g GROUP BY area)
""")
def distinct_points(t: Load):
    """Places that no earlier kept one of their area is within 0.0004 degrees of."""
    return K.distinct_points(t("places").select("id", "area", F.col("lng").alias("x"), F.col("lat").alias("y")), ["area"], ["id"], 0.0004).select("id", "area")


@query(f"WITH c AS (SELECT n_regionkey AS region, area AS id, avg(lat) AS lat, avg(lng) AS lng FROM places JOIN nation ON area = n_nationkey GROUP BY ALL), s AS (SELECT a.region, a.id, sum({PAIR}) AS total FROM c a JOIN c b ON a.region = b.region GROUP BY ALL), m AS (SELECT region, arg_min(id, (total, id)) AS id FROM s GROUP BY region), a AS (SELECT c.* FROM c JOIN m USING (region, id)) SELECT b.region AS region, b.id AS id, a.id = b.id AS medoid FROM a JOIN c b ON a.region = b.region WHERE a.id = b.id OR {PAIR} >= 40000")
def medoid(t: Load):
    """The area that is nearest to the others of its region, and those that are 40 km or more from it."""
    c = t("places").join(t("nation"), F.col("area") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("region"), F.col("area").alias("id")).agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    return S.medoid_and_far(c, "region", 40000)


@query(f"""
WITH l AS (SELECT l_orderkey AS route, l_linenumber, l_partkey, l_suppkey, l_shipdate, lat, lng FROM lineitem JOIN stays ON l_suppkey = stays.id),
n AS (SELECT route, lat, lng, lead(lat) OVER w AS nlat, lead(lng) OVER w AS nlng FROM l WINDOW w AS (PARTITION BY route ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate)),
g AS (SELECT a.route, CASE WHEN a.nlat IS NOT NULL THEN {METRES.format(a="a", b="b").replace("b.lat", "a.nlat").replace("b.lng", "a.nlng")} END AS leg FROM n a)
SELECT route, CAST(round(sum(leg) / 100) AS BIGINT) AS total, CAST(round(max(leg)) AS BIGINT) AS longest, count(*) AS stops FROM g GROUP BY route
""")
def route_legs(t: Load):
    """Length, longest leg and stops of each route."""
    stops = t("lineitem").join(t("stays").select(F.col("id").alias("l_suppkey"), "lat", "lng"), "l_suppkey")
    legs = S.route_legs(stops, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"])
    return legs.groupBy(F.col("l_orderkey").alias("route")).agg(F.round(F.sum("leg") / 100).cast("bigint").alias("total"), F.round(F.max("leg")).cast("bigint").alias("longest"), F.count("*").alias("stops"))


@query(f"""
WITH p AS (SELECT id, {METRES.format(a="a", b="b").replace("b.lat", "27.5::DOUBLE").replace("b.lng", "(-82.0::DOUBLE)")} AS d, lat, lng FROM places a)
SELECT id, CAST(greatest(1, floor(d * 1.3 / 80 + 0.5)) AS BIGINT) AS walk,
  CASE WHEN d < 1000 THEN CAST(CAST(greatest(10, floor(d / 10 + 0.5) * 10) AS BIGINT) AS VARCHAR) || ' m' ELSE CAST(CAST(round(d / 1609.344, 1) AS DECIMAL(12, 1)) AS VARCHAR) || ' mi' END AS words,
  ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST((CAST(floor(degrees(atan2((lng + 82.0) * cos(radians((27.5 + lat) / 2)), lat - 27.5)) / 45 + 0.5) AS BIGINT) + 8) % 8 AS BIGINT) + 1] AS direction
FROM p
""")
def distance_words(t: Load):
    """Walking minutes, distance words and direction from a point."""
    d = G.haversine(F.col("lat"), F.col("lng"), F.lit(27.5), F.lit(-82.0))
    return t("places").select("id", G.walk_minutes(d).alias("walk"), G.distance_words(d).alias("words"), G.compass8(F.lit(27.5), F.lit(-82.0), F.col("lat"), F.col("lng")).alias("direction"))


@query("""
WITH k AS (SELECT cos(radians(27.9)) AS k, 1000 / (0.7 * cos(radians(27.9))) AS scale)
SELECT id, round((lng + 82.6) * k * scale, 4) AS x, round((28.4 - lat) * scale, 4) AS y, round(lat, 6) AS lat, round(lng, 6) AS lng FROM places, k
""")
def project(t: Load):
    """Planar coordinates in a box, and back."""
    p = t("places").select("id", G.project(F.col("lat"), F.col("lng"), BOX, 1000).alias("p"))
    back = G.unproject(F.col("p.x"), F.col("p.y"), BOX, 1000)
    return p.select("id", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"), F.round(back["lat"], 6).alias("lat"), F.round(back["lng"], 6).alias("lng"))


@query("SELECT area, round(min(lat) - greatest((max(lat) - min(lat)) * 0.1, 0.01), 6) AS s, round(min(lng) - greatest((max(lng) - min(lng)) * 0.1, 0.01), 6) AS w, round(max(lat) + greatest((max(lat) - min(lat)) * 0.1, 0.01), 6) AS n, round(max(lng) + greatest((max(lng) - min(lng)) * 0.1, 0.01), 6) AS e FROM places GROUP BY area")
def fit_box(t: Load):
    """Padded box of each area's places."""
    b = t("places").groupBy("area").agg(F.min("lat").alias("s0"), F.min("lng").alias("w0"), F.max("lat").alias("n0"), F.max("lng").alias("e0"))
    py, px = F.greatest((F.col("n0") - F.col("s0")) * 0.1, F.lit(0.01)), F.greatest((F.col("e0") - F.col("w0")) * 0.1, F.lit(0.01))
    return b.select("area", F.round(F.col("s0") - py, 6).alias("s"), F.round(F.col("w0") - px, 6).alias("w"), F.round(F.col("n0") + py, 6).alias("n"), F.round(F.col("e0") + px, 6).alias("e"))


@query("""
WITH b AS (SELECT area, min(lat) - 0.00003 AS s, min(lng) - 0.00003 AS w, max(lat) AS n, max(lng) AS e FROM places GROUP BY area), p AS (SELECT id, lat, lng FROM stays UNION ALL SELECT id + 1000000, lat, lng FROM places)
SELECT p.id AS id, b.area AS area FROM p JOIN b ON lat >= s AND lat < n
WHERE lng >= w AND lng < w + (e - w) * (n - lat) / (n - s)
  AND NOT (lat >= s + (n - s) * 0.1 AND lat < s + (n - s) * 0.3 AND lng >= w + (e - w) * 0.1 AND lng < w + (e - w) * 0.3)
""")
def point_in_polygon(t: Load):
    """Stays and places within each area's lower left triangle, which has a hole."""
    b = t("places").groupBy(F.col("area").alias("id")).agg((F.min("lat") - 0.00003).alias("s"), (F.min("lng") - 0.00003).alias("w"), F.max("lat").alias("n"), F.max("lng").alias("e"))
    corner = lambda x, y: F.struct((F.col("w") + (F.col("e") - F.col("w")) * x).alias("x"), (F.col("s") + (F.col("n") - F.col("s")) * y).alias("y"))
    rings = F.array(F.array(corner(0.0, 0.0), corner(1.0, 0.0), corner(0.0, 1.0)), F.array(corner(0.1, 0.1), corner(0.3, 0.1), corner(0.3, 0.3), corner(0.1, 0.3)))
    at = lambda name, first: t(name).select((F.col("id") + first).alias("id"), F.col("lng").alias("x"), F.col("lat").alias("y"))
    return P.points_in_polygons(at("stays", 0).unionByName(at("places", 1000000)), b.select("id", rings.alias("rings")), 0.25).select("id", F.col("polygon").alias("area"))


@query("""
WITH b AS (SELECT area, min(lat) AS s, min(lng) AS w, max(lat) AS n, max(lng) AS e FROM places GROUP BY area)
SELECT area, round((e - w) * (n - s) / 2, 6) AS surface, round((e - w) + sqrt((e - w) * (e - w) + (n - s) * (n - s)), 6) AS length FROM b
""")
def ring_area(t: Load):
    """Surface of each area's triangle, and the length of two of its sides."""
    b = t("places").groupBy("area").agg(F.min("lat").alias("s"), F.min("lng").alias("w"), F.max("lat").alias("n"), F.max("lng").alias("e"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("w", "s"), corner("e", "s"), corner("w", "n"))
    return b.select("area", F.round(G.ring_area(ring), 6).alias("surface"), F.round(G.path_length(ring), 6).alias("length"))


def _sun(sign: str) -> str:
    """Minutes of sunrise (+) or sunset (-) in SQL, over p(id, n, lat, lng): three steps from solar noon."""
    g = "(2 * pi() / 365 * (n - 1 + (m{0} / 60 - 12) / 24))"
    steps = ["m0 AS (SELECT *, 720 - 4 * lng AS m0 FROM p)"]
    for k in range(3):
        at = g.format(k)
        steps.append(f"g{k} AS (SELECT *, {at} AS g{k} FROM m{k})")
        x = f"g{k}"
        steps.append(f"d{k} AS (SELECT *, 0.006918 - 0.399912 * cos({x}) + 0.070257 * sin({x}) - 0.006758 * cos(2 * {x}) + 0.000907 * sin(2 * {x}) - 0.002697 * cos(3 * {x}) + 0.00148 * sin(3 * {x}) AS d{k} FROM g{k})")
        steps.append(f"m{k + 1} AS (SELECT *, 720 - 4 * (lng {sign} degrees(acos(cos(radians(90.833)) / (cos(radians(lat)) * cos(d{k})) - tan(radians(lat)) * tan(d{k})))) - 229.18 * (0.000075 + 0.001868 * cos({x}) - 0.032077 * sin({x}) - 0.014615 * cos(2 * {x}) - 0.040849 * sin(2 * {x})) AS m{k + 1} FROM d{k})")
    return f"WITH {', '.join(steps)} SELECT id, CAST(round(m3) AS INTEGER) AS at FROM m3"


@query(f"WITH p AS (SELECT h.id AS id, dayofyear(date) AS n, lat, lng FROM happenings h JOIN places ON h.place = places.id) SELECT r.id AS id, r.at AS rise, s.at AS set FROM ({_sun('+')}) r JOIN ({_sun('-')}) s ON r.id = s.id")
def sun_times(t: Load):
    """UTC minutes of sunrise and sunset on each event's date at its place."""
    at = t("happenings").select("id", "date", F.col("place")).join(t("places").select(F.col("id").alias("place"), "lat", "lng"), "place")
    day = F.dayofyear("date")
    return at.select("id", F.round(G.sun_minutes(day, F.col("lat"), F.col("lng"), True)).cast("int").alias("rise"), F.round(G.sun_minutes(day, F.col("lat"), F.col("lng"), False)).cast("int").alias("set"))


@query("""
SELECT place, round(lat, 5) AS lat, round(lng, 5) AS lng, count(*) AS events, count(DISTINCT date) AS days, count(DISTINCT h.kind) AS kinds
FROM happenings h JOIN places ON place = places.id WHERE status <> 'cancelled' GROUP BY ALL
""")
def event_locations(t: Load):
    """Live events grouped by place, or by point where there is none."""
    p = t("places").select(F.col("id").alias("pid"), "lat", "lng")
    return t("happenings").where("status <> 'cancelled'").join(p, F.col("place") == F.col("pid")).groupBy("place", F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng")).agg(F.count("*").alias("events"), F.countDistinct("date").alias("days"), F.countDistinct("kind").alias("kinds"))


@query("SELECT CAST(floor(lat * 500) AS BIGINT) AS y, CAST(floor(lng * 500) AS BIGINT) AS x, count(*) AS members, arg_min(id, (list_position(['BUILDING', 'MACHINERY', 'AUTOMOBILE', 'FURNITURE', 'HOUSEHOLD'], kind), id)) AS lead FROM places GROUP BY 1, 2")
def colocated_pins(t: Load):
    """One pin a point, led by kind order."""
    o = R.vocab_order(F.col("kind"), ["BUILDING", "MACHINERY", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"])
    return t("places").groupBy(F.floor(F.col("lat") * 500).alias("y"), F.floor(F.col("lng") * 500).alias("x")).agg(F.count("*").alias("members"), F.min(F.struct(o.alias("o"), "id")).alias("m")).select("y", "x", "members", F.col("m.id").alias("lead"))
