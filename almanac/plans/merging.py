"""Queries on consolidation, duplicates and search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from almanac.functions import text as T
from almanac.operators import consolidate as C
from almanac.operators import graph as N
from almanac.operators import likeness as L
from almanac.operators import references as J
from almanac.operators import search as Q
from almanac.plans.registry import METRES, Load, query

# Three slices tell of each customer; the second one lacks some values, the third changes some.
_PARTS = """
SELECT c_custkey AS id, s.slice, s.ord AS owner, c_custkey % 13 = 0 AND s.ord = 2 AS verified,
  CASE WHEN s.ord = 1 AND c_custkey % 3 = 0 THEN NULL WHEN s.ord = 2 AND c_custkey % 5 = 0 THEN 'The ' || c_name || ' House' ELSE c_name END AS name,
  CASE WHEN s.ord = 0 AND c_custkey % 2 = 0 THEN NULL ELSE '+1 555 ' || CAST(1000 + c_custkey % 9000 + CASE WHEN s.ord = 2 THEN 1 ELSE 0 END AS VARCHAR) END AS phone,
  CASE (c_custkey + s.ord) % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' ELSE NULL END AS status,
  DATE '2024-01-01' + CAST((c_custkey * 7 + s.ord * 11) % 50 AS INTEGER) AS checked,
  s.ord = 1 AND c_custkey % 10 = 0 AS featured, c_acctbal > 5000 AS rich
FROM customer, (SELECT 'alpha' AS slice, 0 AS ord UNION ALL SELECT 'beta', 1 UNION ALL SELECT 'gamma', 2) s
"""


def parts(t: Load):
    slices = t("customer").sparkSession.createDataFrame([("alpha", 0), ("beta", 1), ("gamma", 2)], "slice string, ord int")
    each = t("customer").withColumn("slice", F.explode(F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma"))))
    return C.owner_rank(each, slices).selectExpr(
        "c_custkey as id",
        "slice",
        "owner",
        "c_custkey % 13 = 0 and owner = 2 as verified",
        "case when owner = 1 and c_custkey % 3 = 0 then null when owner = 2 and c_custkey % 5 = 0 then concat('The ', c_name, ' House') else c_name end as name",
        "case when owner = 0 and c_custkey % 2 = 0 then null else concat('+1 555 ', 1000 + c_custkey % 9000 + case when owner = 2 then 1 else 0 end) end as phone",
        "case (c_custkey + owner) % 3 when 0 then 'open' when 1 then 'closed' end as status",
        "date_add(date'2024-01-01', cast((c_custkey * 7 + owner * 11) % 50 as int)) as checked",
        "owner = 1 and c_custkey % 10 = 0 as featured",
        "array(c_mktsegment, case when owner = 2 then lower(c_mktsegment) else slice end) as tags",
        "cast(27.0 + c_custkey % 100 / 100.0D + owner / 1000.0D as double) as lat",
        "cast(-82.0D as double) as lng",
        "case owner when 0 then 'manual' when 1 then 'official' else 'map' end as geo_source",
    )


@query(f"""
WITH p AS ({_PARTS}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (NOT verified)::INT, owner) AS k FROM p)
SELECT id, arg_min(name, k) FILTER (name IS NOT NULL) AS name, arg_min(phone, k) FILTER (phone IS NOT NULL) AS phone, bool_or(featured) AS featured, count(*) AS parts FROM r GROUP BY id
""")
def consolidate(t: Load):
    """One record of three slices' parts: precedence values and or-flags."""
    return C.consolidate(parts(t), ["name", "phone"], [], ["featured"])


@query("""
SELECT c_custkey AS id, CASE lower(c_mktsegment) < 'alpha' WHEN true THEN c_mktsegment || ',alpha,beta' ELSE CASE WHEN lower(c_mktsegment) < 'beta' THEN 'alpha,' || c_mktsegment || ',beta' ELSE 'alpha,beta,' || c_mktsegment END END AS tags FROM customer
""")
def union_lists(t: Load):
    """Lists of three slices united by key, the first spelling kept."""
    return C.consolidate(parts(t), [], ["tags"], []).select("id", F.array_join("tags", ",").alias("tags"))


@query(f"""
WITH p AS ({_PARTS}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (NOT verified)::INT, owner) AS k FROM p),
m AS (SELECT id, arg_min(name, k) FILTER (name IS NOT NULL) AS name, arg_min(phone, k) FILTER (phone IS NOT NULL) AS phone FROM r GROUP BY id),
u AS (SELECT r.id, 'name' AS field, slice, r.name AS value, m.name AS kept FROM r JOIN m ON r.id = m.id WHERE r.name IS NOT NULL AND regexp_replace(regexp_replace(lower(r.name), '[^a-z0-9]+', ' ', 'g'), '^the ', '') <> regexp_replace(regexp_replace(lower(m.name), '[^a-z0-9]+', ' ', 'g'), '^the ', '')
UNION ALL SELECT r.id, 'phone', slice, r.phone, m.phone FROM r JOIN m ON r.id = m.id WHERE r.phone <> m.phone)
SELECT * FROM u
""")
def conflict_log(t: Load):
    """Values of the losing parts that differ as facts."""
    p = parts(t)
    return C.conflict_log(p, C.consolidate(p, ["name", "phone"], [], []), ["name", "phone"]).select("id", "field", "slice", "value", "kept")


@query(f"WITH p AS ({_PARTS}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY checked DESC, (NOT verified)::INT, owner) AS k FROM p WHERE status IS NOT NULL) SELECT id, status, checked FROM r WHERE k = 1")
def status_latest(t: Load):
    """Each record's status by its latest check."""
    p = parts(t).where("status is not null")
    return p.groupBy("id").agg(C.status_latest().alias("status"), F.max("checked").alias("checked"))


@query("SELECT c_custkey AS id, 'official' AS geo_source, round(27.0 + c_custkey % 100 / 100.0::DOUBLE + 0.001, 6) AS lat FROM customer")
def best_point(t: Load):
    """The best-ranked source's point of each record."""
    b = parts(t).groupBy("id").agg(C.best_point({"official": 1, "map": 2, "manual": 3}).alias("b"))
    return b.select("id", "b.geo_source", F.round("b.lat", 6).alias("lat"))


@query("WITH c AS (SELECT o_custkey % 20 AS series, o_orderpriority AS slice, count(*) AS n FROM orders GROUP BY ALL) SELECT series, arg_min(slice, (-n, slice)) AS slice FROM c GROUP BY series")
def owner_by_volume(t: Load):
    return C.owner_by_volume(t("orders").select((F.col("o_custkey") % 20).alias("series"), F.col("o_orderpriority").alias("slice")), "series")


@query("SELECT l_orderkey AS id, max(l_shipdate) AS checked, min(l_shipdate) AS first, bool_or(l_returnflag = 'R') AS returned, count(DISTINCT l_returnflag) > 1 AS differs FROM lineitem GROUP BY 1")
def latest_checked(t: Load):
    """Latest and earliest date and an or-flag, with disagreement, of each group."""
    return t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_shipdate").alias("checked"), F.min("l_shipdate").alias("first"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"), (F.countDistinct("l_returnflag") > 1).alias("differs"))


@query("""
WITH c AS (SELECT 'part' AS collection, p_partkey AS k FROM part UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'customer', c_custkey FROM customer UNION ALL SELECT 'nation', n_nationkey FROM nation),
h AS (SELECT *, k::VARCHAR AS id, bool_or(collection = 'customer') OVER w AS bought, bool_or(collection = 'part') OVER w AS made FROM c WINDOW w AS (PARTITION BY k) QUALIFY count(*) OVER w > 1)
SELECT collection, id, CASE collection WHEN 'nation' THEN id WHEN 'supplier' THEN id || '-supplier' || CASE WHEN k % 6 = 0 THEN '-3' WHEN k % 3 = 0 THEN '-2' ELSE '' END WHEN 'customer' THEN CASE WHEN k % 10 = 0 THEN 'customer-' || id END ELSE CASE WHEN NOT bought OR k % 10 = 0 THEN id END END AS new_id,
  CASE collection WHEN 'nation' THEN 'fold' WHEN 'supplier' THEN 'suffix' WHEN 'customer' THEN CASE WHEN k % 10 = 0 THEN 'rename' ELSE 'unresolved' END ELSE CASE WHEN NOT bought OR k % 10 = 0 THEN 'keep' ELSE 'unresolved' END END AS action
FROM h
""")
def resolve_id_collisions(t: Load):
    """Ids that parts, suppliers, customers and nations share: some customers are renamed, nations fold into parts, suppliers get a suffix (some are taken)."""
    ids = lambda name, key: t(name).select(F.lit(name).alias("collection"), F.col(key).cast("string").alias("id"))
    s = F.col("s_suppkey").cast("string")
    taken = t("supplier").where("s_suppkey % 3 = 0").select(F.concat(s, F.lit("-supplier")).alias("id")).union(t("supplier").where("s_suppkey % 6 = 0").select(F.concat(s, F.lit("-supplier-2"))))
    c = ids("part", "p_partkey").union(ids("supplier", "s_suppkey")).union(ids("customer", "c_custkey")).union(ids("nation", "n_nationkey")).union(taken.select(F.lit("old").alias("collection"), "id"))
    renames = ids("customer", "c_custkey").where("cast(id as long) % 10 = 0").withColumn("new_id", F.concat(F.lit("customer-"), "id"))
    return C.resolve_id_collisions(c, renames, {"supplier": "supplier"}, [("nation", "part")])


_NEAR = METRES.format(a="a", b="b")


@query(f"""
WITH k AS (SELECT id, kind, area, lat, lng, kind || '|' || (id % 40) AS name, area || '|' || (id % 60) AS street FROM places)
SELECT a.id AS a, b.id AS b, concat_ws(',', CASE WHEN a.name = b.name THEN 'name' END, CASE WHEN a.street = b.street THEN 'street' END) AS reasons
FROM k a JOIN k b ON a.id < b.id AND (a.name = b.name OR a.street = b.street) AND round({_NEAR}) <= 4000
""")
def dup_located(t: Load):
    """Pairs of one name or street key (stand-in keys) within 4 km."""
    p = t("places").withColumn("keys", F.array(F.concat(F.lit("name:"), "kind", F.lit("|"), (F.col("id") % 40).cast("string")), F.concat(F.lit("street:"), F.col("area").cast("string"), F.lit("|"), (F.col("id") % 60).cast("string"))))
    return C.dup_located(p, 4000)


@query("""
WITH w AS (SELECT l_orderkey AS id, string_agg(p_name, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS names FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
f AS (SELECT h.id AS id, date, end_date AS last, CASE h.id % 4 WHEN 0 THEN '3rd Annual ' WHEN 1 THEN 'The ' ELSE '' END || names || CASE WHEN h.id % 3 = 0 THEN ' 20' || (10 + h.id % 20) ELSE '' END AS title,
  CASE WHEN h.id % 3 = 0 THEN place::VARCHAR ELSE replace(lower(n_name), '_', ' ') || ' ' || lower(c_mktsegment) END AS spot
  FROM happenings h LEFT JOIN w ON w.id = h.id JOIN customer ON c_custkey = place JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT id, date, last, spot, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(title, '')), '^the ', ''), '\\b(20\\d\\d|annual|\\d+(st|nd|rd|th))\\b', ' ', 'g'), ' +', ' ', 'g')) AS title FROM f),
c AS (SELECT title, spot, date, last, min(id) AS id, count(*) AS n, list_distinct(list_filter(string_split(title, ' '), lambda w: length(w) > 2 AND w NOT IN ('and', 'the', 'for', 'with', 'vs'))) AS words FROM k WHERE title <> '' GROUP BY title, spot, date, last),
p AS (SELECT a.id AS a, b.id AS b, a.n AS n_a, b.n AS n_b, a.title = b.title AS same, a.spot = b.spot AS here, len(list_intersect(a.words, b.words)) AS shared, least(len(a.words), len(b.words)) AS size
  FROM c a JOIN c b ON a.date <= b.last AND b.date <= a.last AND a.id < b.id)
SELECT a, b, CASE WHEN same THEN 'same title, overlapping dates' ELSE 'same place, ' || shared || ' title words shared' END AS reason, CASE WHEN NOT same THEN shared::INTEGER END AS shared, n_a, n_b
FROM p WHERE same OR (here AND shared >= 2 AND shared / size >= 0.6)
UNION ALL SELECT id, id, 'same title, overlapping dates', NULL, n, n FROM c WHERE n > 1
""")
def dup_events(t: Load):
    """Events (orders titled by their parts) of one title, or of one spot and most title words, whose dates overlap."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "p_name")
    names = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(line)).alias("o"))
    names = names.select("id", F.array_join(F.transform("o", lambda x: x["p_name"]), " ").alias("names"))
    where = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("place"), F.concat_ws(" ", "n_name", "c_mktsegment").alias("spot"))
    title = F.concat(F.expr("case id % 4 when 0 then '3rd Annual ' when 1 then 'The ' else '' end"), "names", F.expr("case when id % 3 = 0 then concat(' 20', 10 + id % 20) else '' end"))
    e = t("happenings").join(names, "id", "left").join(where, "place")
    return L.dup_events(e.select("id", title.alias("title"), F.when(F.col("id") % 3 == 0, F.col("place")).alias("place"), F.col("spot").alias("location_text"), "date", "end_date"))


@query(f"""
WITH k AS (SELECT id, lat, lng, kind || (id % 40) AS name, area % 5 AS operator FROM places),
p AS (SELECT a.id AS a, b.id AS b, a.operator = b.operator AS same FROM k a JOIN k b ON a.name = b.name AND a.id < b.id AND (a.operator = b.operator OR round({_NEAR}) <= 2500)),
n AS (SELECT id, count(*) AS links FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY id)
SELECT min(k.id) OVER (PARTITION BY name, operator) AS a, k.id AS b, 'operator' AS reason, coalesce(links, 0) AS links FROM k LEFT JOIN n ON k.id = n.id
UNION ALL SELECT a, b, 'near', NULL FROM p WHERE NOT same
""")
def dup_operator(t: Load):
    """One name and operator, or one name nearby: every record's class and number of links, and the near pairs of other classes."""
    k = t("places").select("id", "lat", "lng", F.concat("kind", (F.col("id") % 40).cast("string")).alias("name"), (F.col("area") % 5).alias("operator"))
    return C.dup_operator_classes(k, 2500)


@query("WITH p AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_quantity > 30), d AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_quantity > 40) SELECT a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM d WHERE (d.a = p.a AND d.b = p.b) OR (d.a = p.b AND d.b = p.a))")
def reviewed_pairs_filter(t: Load):
    pairs = t("lineitem").where("l_quantity > 30").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return C.reviewed_pairs_filter(pairs, t("lineitem").where("l_quantity > 40").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")))


@query("""
WITH s AS (SELECT p_name AS key, min(p_partkey) AS keep, max(p_partkey) AS drop FROM part GROUP BY 1 HAVING count(*) > 1), p AS (SELECT p_partkey AS id, p_brand AS brand, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS type FROM part)
SELECT a.id AS id, a.brand || CASE WHEN b.brand IS NOT NULL AND b.brand <> a.brand THEN ',' || b.brand ELSE '' END AS brands, coalesce(a.type, b.type) AS type
FROM p a LEFT JOIN s ON a.id = s.keep LEFT JOIN p b ON b.id = s.drop WHERE a.id NOT IN (SELECT drop FROM s)
""")
def fold_record(t: Load):
    """Of records of one name the last is folded into the first: lists united, gaps filled."""
    p = t("part").selectExpr("p_partkey as id", "p_name", "array(p_brand) as brands", "case when p_partkey % 2 = 0 then p_type end as type")
    s = p.groupBy("p_name").agg(F.min("id").alias("into_id"), F.max("id").alias("gone")).where("into_id < gone").drop("p_name")
    folded = p.join(s, F.col("id") == F.col("gone")).select("into_id", "brands", "type")
    kept = p.join(s.select(F.col("gone").alias("id")), "id", "left_anti").select("id", "brands", "type")
    return C.fold_record(kept, folded, ["brands"], ["type"]).select("id", F.array_join("brands", ",").alias("brands"), "type")


_QUALIFIERS = ["museum", "gallery", "house"]


@query(f"""
WITH n AS (SELECT p_partkey AS id, p_name, string_split(p_name, ' ') AS w FROM part),
a AS (SELECT places.id AS id, lat, lng, places.id % 23 = 0 AS done, p_name AS name, w FROM places JOIN n ON n.id = places.id),
b AS (SELECT stays.id AS id, lat, lng, CASE stays.id % 4 WHEN 0 THEN p_name WHEN 1 THEN w[2] || ' ' || w[1] WHEN 2 THEN 'The ' || p_name || ' Museum' ELSE w[1] || ' of ' || w[1] END AS name,
  CASE stays.id % 4 WHEN 2 THEN list_append(w, 'museum') WHEN 3 THEN [w[1]] ELSE w END AS w FROM stays JOIN n ON n.id = stays.id + 7),
c AS (SELECT a.id AS subject, b.id AS item, {_NEAR} AS d, a.id % 5 = 0 AND b.id = a.id % 100 AS forced, b.id < 100 AND b.id % 10 = a.id % 10 AS rejected, len(list_intersect(a.w, b.w)) AS shared, len(a.w) AS na, len(b.w) AS nb,
  CASE WHEN a.name = b.name THEN 3 WHEN list_sort(a.w) = list_sort(b.w) THEN 2 WHEN len(a.w) >= 2 AND list_has_all(b.w, a.w) AND len(list_filter(b.w, lambda x: NOT list_contains(a.w, x) AND x NOT IN ('museum', 'gallery', 'house'))) = 0 THEN 1 ELSE 0 END AS level
  FROM a JOIN b ON {_NEAR} <= 20000 AND NOT a.done),
o AS (SELECT *, level > 0 AND NOT rejected AS named, level > 0 AND NOT rejected AND d <= CASE level WHEN 3 THEN 20000 WHEN 2 THEN 5000 ELSE 800 END AS fits FROM c),
r AS (SELECT * FROM o WHERE forced OR fits QUALIFY row_number() OVER (PARTITION BY subject ORDER BY forced DESC, CASE WHEN forced THEN 0 ELSE -level END, d, item) = 1),
g AS (SELECT subject, bool_or(named) AS far, bool_or(shared >= 0.5 * least(na, nb)) AS near FROM o GROUP BY subject)
SELECT a.id AS subject, item, CASE WHEN forced THEN greatest(level, 1) ELSE level END AS level, CAST(round(d) AS BIGINT) AS metres,
  CASE WHEN done THEN 'has one' WHEN forced THEN 'forced' WHEN item IS NOT NULL THEN 'linked' WHEN far THEN 'same name, too far' WHEN near THEN 'name differs' ELSE 'nothing near' END AS reason
FROM a LEFT JOIN r ON a.id = r.subject LEFT JOIN g ON a.id = g.subject
""")
def entity_link(t: Load):
    """Each place's stay by real name levels and distance, with forced and rejected pairs, or why there is none."""
    n = t("part").select(F.col("p_partkey").alias("id"), "p_name", F.split("p_name", " ").alias("w"))
    a = t("places").join(n, "id").select("id", "lat", "lng", (F.col("id") % 23 == 0).alias("done"), F.array("p_name").alias("names"))
    name = F.expr("case id % 4 when 0 then p_name when 1 then concat(w[1], ' ', w[0]) when 2 then concat('The ', p_name, ' Museum') else concat(w[0], ' of ', w[0]) end")
    b = t("stays").join(n.withColumn("id", F.col("id") - 7), "id").select("id", "lat", "lng", F.array(name).alias("names"))
    forced = a.where("id % 5 = 0").select(F.col("id").alias("subject"), (F.col("id") % 100).alias("item"))
    rejected = a.select(F.col("id").alias("subject"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.col("id") % 10 + 10 * k)).alias("item"))
    return J.entity_link(a, b, forced, rejected, {3: 20000, 2: 5000, 1: 800}, _QUALIFIERS).select("subject", "item", "level", F.round("d").cast("bigint").alias("metres"), "reason")


@query(f"""
WITH c AS (SELECT area, avg(lat) AS lat, avg(lng) AS lng FROM places GROUP BY area),
p AS (SELECT places.id AS id, places.area AS area, 100 + places.id % 3 AS no, CASE WHEN places.id % 2 = 0 THEN 'w' ELSE 'e' END AS dir, places.id % 50 AS street, p_name AS name, places.id % 9 <> 0 AS housed FROM places JOIN part ON p_partkey = places.id),
s AS (SELECT stays.id AS id, stays.area AS area, lat, lng, 100 + stays.id % 3 AS no, CASE WHEN stays.id % 4 = 0 THEN 'e' ELSE 'w' END AS dir, stays.id % 50 AS street, p_name AS name FROM stays JOIN part ON p_partkey = stays.id),
x AS (SELECT p.id AS id, arg_min(s.id, (abs(s.no - p.no), s.id)) AS ref FROM p JOIN s ON p.street = s.street WHERE housed GROUP BY p.id),
y AS (SELECT p.id AS id, min(s.id) AS ref FROM p JOIN s ON p.name = s.name AND p.area = s.area GROUP BY p.id),
h AS (SELECT id, 1 AS step, ref FROM x UNION ALL SELECT id, 2, ref FROM y),
w AS (SELECT h.*, CASE WHEN {METRES.format(a="c", b="s")} > 30000 THEN 'too far from the area' WHEN step = 1 AND s.no <> p.no THEN 'house number differs' WHEN step = 1 AND s.dir <> p.dir THEN 'street differs'
  WHEN step = 2 AND housed AND s.no <> p.no THEN 'house number differs' END AS why FROM h JOIN p ON h.id = p.id JOIN s ON h.ref = s.id JOIN c ON c.area = p.area),
m AS (SELECT id, min(step) AS step, arg_min(ref, step) AS ref FROM w WHERE why IS NULL GROUP BY id),
f AS (SELECT w.id, string_agg(why, '; ' ORDER BY w.step) AS refusals FROM w LEFT JOIN m ON w.id = m.id WHERE why IS NOT NULL AND (m.step IS NULL OR w.step < m.step) GROUP BY w.id)
SELECT p.id AS id, m.ref AS ref, m.step AS step, coalesce(refusals, '') AS refusals FROM p LEFT JOIN m ON p.id = m.id LEFT JOIN f ON p.id = f.id
""")
def geocode_cascade(t: Load):
    """A point from an address table by street, else by name; accepted if house number, street and area agree."""
    part = t("part").select(F.col("p_partkey").alias("id"), "p_name")
    centre = t("places").groupBy("area").agg(F.avg("lat").alias("clat"), F.avg("lng").alias("clng"))
    no, street = (100 + F.col("id") % 3).cast("string"), (F.col("id") % 50).cast("string")
    side = lambda c, a, b: F.when(c, a).otherwise(b)
    address = F.when(F.col("id") % 9 != 0, F.concat(no, F.lit(" "), side(F.col("id") % 2 == 0, "West", "East"), F.lit(" "), street, F.lit("th Avenue, Suite 4")))
    p = t("places").join(part, "id").join(centre, "area").select("id", "area", address.alias("address"), F.array("p_name").alias("names"), "p_name", street.alias("street"), (F.col("id") % 3).alias("n"), F.col("clat").alias("lat"), F.col("clng").alias("lng"))
    way = F.concat(side(F.col("id") % 4 == 0, "E.", "W."), F.lit(" "), street, F.lit("th Ave"))
    s = t("stays").join(part, "id").select(F.col("id").alias("ref"), F.col("area").alias("s_area"), F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"), (F.col("id") % 3).alias("s_n"), street.alias("s_street"), F.col("p_name").alias("s_name"), F.concat(no, F.lit(" "), F.upper(way), F.lit(", SPRINGFIELD")).alias("line"), F.concat_ws(", ", "p_name", no, way, F.lit("Springfield")).alias("label"))
    # the least address of each street and number, or name and area, is enough: records never meet all of them
    least = lambda by, matched: s.groupBy(*by).agg(F.min(F.struct("ref", matched, "s_lat", "s_lng")).alias("s")).select(*by, "s.*")
    hit = lambda pairs, step, first, matched: pairs.groupBy("id").agg(F.min(F.struct(*first, "ref", matched, "s_lat", "s_lng")).alias("m")).select("id", F.lit(step).alias("step"), "m.ref", F.col(f"m.{matched}").alias("matched"), F.lit(step == 2).alias("photon"), F.lit(step == 2).alias("by_name"), F.col("m.s_lat").alias("lat"), F.col("m.s_lng").alias("lng"))
    by_street = hit(p.where("address is not null").join(least(["s_street", "s_n"], "line"), F.col("street") == F.col("s_street")), 1, [F.abs(F.col("s_n") - F.col("n")).alias("off")], "line")
    by_name = hit(p.join(least(["s_name", "s_area"], "label"), (F.col("p_name") == F.col("s_name")) & (F.col("area") == F.col("s_area"))), 2, [], "label")
    return J.geocode_cascade(p.select("id", "address", "names", "lat", "lng"), by_street.unionByName(by_name))


@query("""
WITH RECURSIVE e AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem WHERE l_quantity > 45),
l AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r AS (SELECT a AS node, a AS seen FROM l UNION SELECT node, b FROM r JOIN l ON seen = a)
SELECT node, min(seen) AS label, bool_or(p_size = 50) AS has FROM r JOIN part ON p_partkey = seen GROUP BY node
""")
def connected_components(t: Load):
    """Parts joined through orders that hold both (neighbouring lines of an order), and whether any of them has size 50."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    edges = t("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(w).alias("b")).where("b is not null and a <> b")
    return N.spread(N.connected_components(edges), t("part").where("p_size = 50").select(F.col("p_partkey").alias("node")))


@query()
def assign_images(t: Load):
    """One supplier for each part in order of tier, each supplier used once (tests hold it against the serial choice)."""
    c = t("lineitem").where("l_quantity > 40").groupBy(F.col("l_partkey").alias("subject"), F.col("l_suppkey").alias("file")).agg(F.min("l_extendedprice").alias("p"))
    return C.assign_best(c.select("subject", "file", (F.col("subject") % 11).alias("tier"), F.row_number().over(Window.partitionBy("subject").orderBy("p", "file")).alias("rank")))


@query("""
WITH m AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'stay' WHEN 4 THEN 'map' ELSE 'place' END AS kind, o_custkey AS subject, o_orderstatus AS licence, CASE WHEN o_orderkey % 13 = 0 THEN ' ' WHEN o_orderkey % 29 <> 0 THEN o_orderpriority END AS credit,
  CASE WHEN o_orderkey % 17 = 0 THEN 'http://x' ELSE 'https://x' END AS url, o_totalprice AS ord FROM orders),
s AS (SELECT 'place' AS kind, id AS subject, -score AS rank FROM places WHERE id % 7 <> 0 UNION ALL SELECT 'stay', id, 0 FROM stays),
n AS (SELECT kind, subject, max(id) AS id FROM m WHERE subject % 3 = 0 GROUP BY ALL),
r AS (SELECT m.*, s.subject IS NOT NULL AS known, rank, n.id IS NOT NULL AS named, CASE WHEN m.kind NOT IN ('place', 'stay') THEN 'no image kind' WHEN s.subject IS NULL THEN 'subject not known' WHEN licence NOT IN ('F', 'O') THEN 'licence not accepted'
  WHEN trim(coalesce(credit, '')) = '' THEN 'no credit line' WHEN NOT starts_with(url, 'https://') THEN 'not https' END AS reason
  FROM m LEFT JOIN s ON m.kind = s.kind AND m.subject = s.subject LEFT JOIN n ON m.kind = n.kind AND m.subject = n.subject AND m.id = n.id),
c AS (SELECT * FROM r WHERE reason IS NULL UNION ALL SELECT * FROM r WHERE reason IS NOT NULL AND known AND named AND (kind, subject) IN (SELECT (kind, subject) FROM r WHERE reason IS NULL)),
p AS (SELECT *, row_number() OVER (PARTITION BY kind, subject ORDER BY named DESC, ord, id) - 1 AS place FROM c),
j AS (SELECT id, row_number() OVER (ORDER BY rank, CASE kind WHEN 'place' THEN 1 ELSE 2 END, subject, id) AS job FROM p WHERE place = 0)
SELECT id, kind, subject, NULL AS reason, place::INTEGER AS place, job FROM p LEFT JOIN j USING (id) UNION ALL SELECT id, kind, subject, reason, NULL, NULL FROM r WHERE id NOT IN (SELECT id FROM c)
""")
def image_plan(t: Load):
    """Images (orders, as media) of places and stays: why one can't be used, each subject's image and alternates, jobs in order."""
    media = t("orders").selectExpr("o_orderkey as id", "case o_orderkey % 5 when 0 then 'stay' when 4 then 'map' else 'place' end as kind", "o_custkey as subject", "o_orderstatus as licence", "case when o_orderkey % 13 = 0 then ' ' when o_orderkey % 29 <> 0 then o_orderpriority end as credit", "case when o_orderkey % 17 = 0 then 'http://x' else 'https://x' end as url", "o_totalprice as ord")
    subjects = t("places").where("id % 7 <> 0").selectExpr("'place' as kind", "id as subject", "-score as rank").unionByName(t("stays").selectExpr("'stay' as kind", "id as subject", "0d as rank"))
    primary = media.where("subject % 3 = 0").groupBy("kind", "subject").agg(F.max("id").alias("id"))
    return J.image_plan(media, subjects, primary, ["place", "stay"], ["F", "O"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_todo(t: Load):
    return t("documents").select("doc_id").join(t("labels").select("doc_id"), "doc_id", "left_anti")


# --- search: parts and documents are entries; their first words are titles

_ENTRIES = """
SELECT 'part' AS kind, p_partkey AS id, p_name AS title, p_type AS subline, p_brand AS keywords FROM part
UNION ALL SELECT 'document', doc_id, array_to_string(list_slice(string_split(replace(text, chr(10), ' '), ' '), 1, 5), ' '), source, lang FROM documents
"""
_NORM = "translate(strip_accents(lower({0})), '’', '''')"
QUERIES_ = [(1, ["the", "to"], "the to"), (2, ["red"], "red"), (3, ["la", "de"], "la de"), (4, ["brand"], "brand"), (5, ["small", "red"], "small red"), (6, ["purchase"], "purchase"), (7, ["e"], "e")]
SEARCH_NOW = "2024-01-15 12:00:00"


def entries(t: Load):
    words = F.array_join(F.slice(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), 1, 5), " ")
    docs = t("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), words.alias("title"), F.col("source").alias("subline"), F.col("lang").alias("keywords"))
    return t("part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("subline"), F.col("p_brand").alias("keywords")).unionByName(docs)


@query("SELECT kind, id, title, subline, keywords FROM (" + _ENTRIES + ")")
def build_search_index(t: Load):
    """One entry a record of each collection."""
    return entries(t)


def hits(t: Load):
    q = t("part").sparkSession.createDataFrame(QUERIES_, "query_id int, terms array<string>, phrase string")
    hour = F.expr("INTERVAL 1 HOUR")
    events = t("events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("event_type").alias("title"), F.concat(F.lit("O'Brien "), F.col("user_id").cast("string")).alias("subline"), F.lit(None).cast("string").alias("keywords"), F.col("ts").cast("timestamp").alias("starts"), (F.col("ts").cast("timestamp") + hour).alias("ends"))
    return Q.score_search(Q.prepare_index(events.unionByName(entries(t), allowMissingColumns=True)), q, F.lit(SEARCH_NOW).cast("timestamp"))


_VALUES = ", ".join(f"({i}, {terms}, '{phrase}')" for i, terms, phrase in QUERIES_)
_TERM = "CASE WHEN starts_with(t, x) THEN 40 WHEN len(list_filter(words, lambda w: starts_with(w, x))) > 0 THEN 30 WHEN contains(t, x) THEN 20 ELSE 0 END + CASE WHEN contains(s, x) THEN 8 ELSE 0 END + CASE WHEN contains(k, x) THEN 4 ELSE 0 END"
_HITS = f"""
e AS (SELECT kind, id, title, subline, keywords, NULL::TIMESTAMP AS starts, NULL::TIMESTAMP AS ends FROM ({_ENTRIES}) UNION ALL SELECT 'event', event_id, event_type, 'O''Brien ' || user_id, NULL, ts::TIMESTAMP, ts::TIMESTAMP + INTERVAL 1 HOUR FROM events),
n AS (SELECT kind, id, title, coalesce({_NORM.format('title')}, '') AS t, coalesce({_NORM.format('subline')}, '') AS s, coalesce({_NORM.format('keywords')}, '') AS k,
  CASE WHEN kind <> 'event' THEN 0 WHEN starts <= TIMESTAMP '{SEARCH_NOW}' AND ends > TIMESTAMP '{SEARCH_NOW}' THEN 25 WHEN starts > TIMESTAMP '{SEARCH_NOW}' AND starts < TIMESTAMP '{SEARCH_NOW}' + INTERVAL 3 HOUR THEN 15 WHEN ends < TIMESTAMP '{SEARCH_NOW}' THEN -5 ELSE 0 END AS part FROM e), q(query_id, terms, phrase) AS (VALUES {_VALUES}),
x AS (SELECT query_id, kind, id, title, t, phrase, part, {_TERM} AS p FROM (SELECT *, unnest(terms) AS x FROM (SELECT *, regexp_split_to_array(t, '[^\\p{{L}}\\p{{N}}'']+') AS words FROM n), q)),
h AS (SELECT query_id, kind, id, title, any_value(t) = any_value(phrase) AND length(any_value(phrase)) > 1 AS exact, CAST(sum(p) + any_value(part) + any_value(CASE WHEN length(phrase) < 2 THEN 0 WHEN t = phrase THEN 100 WHEN starts_with(t, phrase) THEN 60 WHEN contains(t, phrase) THEN 30 ELSE 0 END) AS INTEGER) AS score FROM x GROUP BY query_id, kind, id, title HAVING min(p) > 0)
"""


@query(f"WITH {_HITS} SELECT query_id, kind, id, score FROM h")
def score_search(t: Load):
    """All hits of five queries with their scores."""
    return hits(t).select("query_id", "kind", "id", "score")


@query(f"WITH {_HITS} SELECT query_id, kind, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, kind, id) AS INTEGER) AS rank FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, kind, id) <= 200")
def search_top(t: Load):
    return Q.search_top(hits(t)).select("query_id", "kind", "id", "score", "rank")


@query(f"WITH {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, kind, id) AS rank FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, kind, id) <= 200) SELECT query_id, kind, id, count(*) OVER (PARTITION BY query_id, kind) AS total, CAST(row_number() OVER (PARTITION BY query_id, kind ORDER BY rank) AS INTEGER) AS in_kind FROM r QUALIFY row_number() OVER (PARTITION BY query_id, kind ORDER BY rank) <= 5")
def group_hits(t: Load):
    return Q.group_hits(Q.search_top(hits(t)), ["part", "document", "event"]).select("query_id", "kind", "id", "total", "in_kind")


@query("SELECT id, CAST(row_number() OVER (ORDER BY CASE WHEN start IS NULL THEN '12:00' ELSE start END, id) AS INTEGER) AS n FROM happenings WHERE status <> 'cancelled' AND date = DATE '1997-06-15'")
def today_hits(t: Load):
    """Empty query: today's events by start, those without one at noon."""
    rows = t("happenings").where("status <> 'cancelled' and date = date '1997-06-15'")
    return rows.select("id", F.row_number().over(Window.partitionBy("date").orderBy(F.coalesce("start", F.lit("12:00")), "id")).alias("n"))


@query("SELECT doc_id, substr(sha256(text), 1, 8) AS h FROM documents")
def hash8(t: Load):
    return t("documents").select("doc_id", T.hash8(F.col("text")).alias("h"))
