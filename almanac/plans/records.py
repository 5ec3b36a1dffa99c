"""Queries on references, filters, orders and facets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from almanac.operators import evidence as V
from almanac.operators import facets as X
from almanac.operators import ranking as R
from almanac.operators import references as J
from almanac.plans.registry import Load, query


@query("SELECT h.id AS id, p.name AS place_name, p.kind AS place_kind FROM happenings h LEFT JOIN places p ON h.place = p.id AND p.id % 7 <> 0")
def lookup_join(t: Load):
    return J.lookup_join(t("happenings"), "place", t("places").where("id % 7 <> 0"), "id", "place_").select("id", "place_name", "place_kind")


@query("SELECT id, place FROM happenings WHERE place NOT IN (SELECT id FROM places WHERE id % 7 <> 0)")
def dangling_refs(t: Load):
    return J.dangling_refs(t("happenings"), "place", t("places").where("id % 7 <> 0"), "id").select("id", "place")


@query("WITH a AS (SELECT l_orderkey AS id, list(DISTINCT l_partkey ORDER BY l_partkey) AS parts FROM lineitem GROUP BY 1), e AS (SELECT id, unnest(parts) AS ref, unnest(generate_series(0, len(parts) - 1)) AS pos FROM a) SELECT id, CAST(pos AS INTEGER) AS pos, ref FROM e WHERE ref % 7 = 0")
def dangling_array_refs(t: Load):
    a = t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    return J.dangling_array_refs(a, "id", "parts", t("part").where("p_partkey % 7 <> 0"), "p_partkey").select("id", "pos", "ref")


_POLY = "SELECT l_orderkey AS id, l_linenumber AS line, CASE l_linenumber % 2 WHEN 0 THEN 'part' ELSE 'supplier' END AS kind, CASE l_linenumber % 2 WHEN 0 THEN l_partkey ELSE l_suppkey END AS ref FROM lineitem"


def poly(t: Load):
    return t("lineitem").selectExpr("l_orderkey as id", "l_linenumber as line", "case l_linenumber % 2 when 0 then 'part' else 'supplier' end as kind", "case l_linenumber % 2 when 0 then l_partkey else l_suppkey end as ref")


@query(f"SELECT * FROM ({_POLY}) WHERE ref % 7 = 0")
def polymorphic_refs(t: Load):
    """References to a part or a supplier, by kind, whose target is gone."""
    return J.polymorphic_refs(poly(t), "kind", "ref", {"part": (t("part").where("p_partkey % 7 <> 0"), "p_partkey"), "supplier": (t("supplier").where("s_suppkey % 7 <> 0"), "s_suppkey")}).select("id", "line", "kind", "ref")


@query("SELECT h.id AS id, coalesce(p.name, s.name) AS found FROM happenings h LEFT JOIN places p ON h.place = p.id AND p.id % 3 = 0 LEFT JOIN stays s ON h.place = s.id")
def either_refs(t: Load):
    """A reference that holds in places or, if not, in stays."""
    return J.either_refs(t("happenings"), "place", t("places").where("id % 3 = 0"), t("stays"), "id", "name").select("id", "found")


@query("WITH k AS (SELECT lower(p_name) AS key, max(p_partkey) AS last, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1) SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN p_partkey WHEN n = 1 THEN last END AS ref, CASE WHEN p_partkey % 5 = 0 THEN p_partkey ELSE last END AS last_ref FROM part JOIN k ON lower(p_name) = key")
def alias_join(t: Load):
    """Free text to id: a key of several ids is not used; in the other form its last one is."""
    rows = t("part").selectExpr("p_partkey as id", "p_name as text", "case when p_partkey % 5 = 0 then p_partkey end as ref", "case when p_partkey % 5 = 0 then p_partkey end as last_ref")
    names = t("part").selectExpr("lower(p_name) as key", "p_partkey as id", "p_partkey as ord")
    one = J.alias_join(rows, F.lower("text"), "ref", names)
    return J.alias_join(one, F.lower("text"), "last_ref", names, last_wins=True).select("id", "ref", "last_ref")


@query("WITH k AS (SELECT regexp_extract(lower(p_name), '^[^ ]+') AS key, min(p_partkey) AS id, count(DISTINCT p_type) AS n FROM part GROUP BY 1) SELECT p_partkey AS part, CASE WHEN regexp_matches(lower(p_name), ' (and|or|from) ') THEN NULL ELSE k.id END AS place FROM part LEFT JOIN k ON regexp_extract(lower(p_name), '^[^ ]+') = key")
def alias_join_first_segment(t: Load):
    """By the first part of a name; not for names that join two."""
    first = F.regexp_extract(F.lower("p_name"), "^[^ ]+", 0)
    keys = t("part").groupBy(first.alias("key")).agg(F.min("p_partkey").alias("kid"))
    text = F.when(~F.lower("p_name").rlike(" (and|or|from) "), first)
    return t("part").withColumn("k", text).join(keys, F.col("k") == F.col("key"), "left").select(F.col("p_partkey").alias("part"), F.col("kid").alias("place"))


@query("WITH k AS (SELECT p_partkey AS id, regexp_replace(replace(lower(p_brand || p_type), 'the-', ''), '[^a-z0-9]', '', 'g') AS k FROM part) SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.k = b.k AND a.id < b.id")
def compact_slug_join(t: Load):
    """Pairs whose slugs are equal without "the-" and hyphens (groups of parts of one brand and type)."""
    k = t("part").select(F.col("p_partkey").alias("id"), F.regexp_replace(F.replace(F.lower(F.concat("p_brand", "p_type")), F.lit("the-"), F.lit("")), "[^a-z0-9]", "").alias("k"))
    return k.alias("a").join(k.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query("SELECT id, CASE WHEN place % 7 = 0 THEN NULL WHEN place % 5 = 0 THEN place + 1 ELSE place END AS place FROM happenings")
def remap_refs(t: Load):
    remap = t("places").where("id % 7 = 0 or id % 5 = 0").selectExpr("id as old", "case when id % 7 <> 0 then id + 1 end as new")
    return J.remap_refs(t("happenings").select("id", "place"), "place", remap)


@query("SELECT DISTINCT p_partkey AS part FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def coverage_gap(t: Load):
    return J.coverage_gap(t("part").select(F.col("p_partkey").alias("part")), t("lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("part")), ["part"])


@query("WITH s AS (SELECT DISTINCT user_id % 97 AS id FROM events) SELECT id, place FROM happenings WHERE place IN (SELECT id FROM s)")
def membership_filter(t: Load):
    saved = t("events").select((F.col("user_id") % 97).alias("place")).distinct()
    return t("happenings").join(saved, "place", "left_semi").select("id", "place")


@query("WITH c AS (SELECT l_orderkey AS id, list(DISTINCT l_partkey % 500) AS c FROM lineitem GROUP BY 1), e AS (SELECT id, unnest(c) AS code FROM c) SELECT e.id AS id, coalesce(string_agg(DISTINCT CAST(p_partkey AS VARCHAR), ',' ORDER BY CAST(p_partkey AS VARCHAR)), '') AS ids, count(*) FILTER (p_partkey IS NULL) AS unknown FROM e LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0) ON code = p_partkey GROUP BY e.id")
def decode_codes(t: Load):
    c = t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.col("l_partkey") % 500).alias("codes")).withColumnRenamed("id", "row_id")
    d = J.decode_codes(c, "codes", t("part").where("p_partkey % 3 = 0").selectExpr("p_partkey as code", "cast(p_partkey as string) as id"))
    return d.select(F.col("row_id").alias("id"), F.array_join("ids", ",").alias("ids"), "unknown")


@query("WITH u AS (SELECT CAST(p_partkey AS VARCHAR) AS id, 'part' AS o FROM part UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'supplier' FROM supplier UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'customer' FROM customer) SELECT id, string_agg(DISTINCT o, ',' ORDER BY o) AS owners, count(*) AS n FROM u GROUP BY id")
def id_space(t: Load):
    return J.id_space({"part": (t("part"), "p_partkey"), "supplier": (t("supplier"), "s_suppkey"), "customer": (t("customer"), "c_custkey")}).select("id", F.array_join("owners", ",").alias("owners"), "n")


_KINDS = "string_split(p_name, ' ')"


@query(f"SELECT p_partkey AS id FROM part WHERE list_has_any({_KINDS}, ['red', 'blue', 'hot']) AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND contains(lower(p_type), 'an')")
def facet_filter(t: Load):
    spec = {"kind": ("list", "kinds"), "brand": ("one", "p_brand"), "q": ("text", "p_type"), "free": ("bool", "p_partkey")}
    state = {"kind": ["red", "blue", "hot"], "brand": ["Brand#11", "Brand#12", "Brand#13"], "q": "AN", "free": False, "other": 3}
    return t("part").withColumn("kinds", F.split("p_name", " ")).where(X.facet_filter(spec, state)).select(F.col("p_partkey").alias("id"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'ing')")
def text_all_terms(t: Load):
    return t("documents").where(X.text_all_terms(F.lower("text"), "the ing")).select("doc_id")


@query("""
WITH u AS (SELECT page_id, string_split(regexp_replace(regexp_extract(url, '\\?([^#]*)', 1), '#.*', ''), '&') AS q FROM pages),
k AS (SELECT page_id, [x FOR x IN q IF starts_with(x, 'page=')] AS p, [x FOR x IN q IF starts_with(x, 'ref=')] AS r, [x FOR x IN q IF starts_with(x, 'utm_source=')] AS s FROM u)
SELECT page_id, concat_ws('&', CASE WHEN len(p) > 0 AND p[1] <> 'page=' AND p[1] <> 'page=1' THEN p[1] END, CASE WHEN len(s) > 0 AND s[1] = 'utm_source=feed' THEN s[1] END) AS query FROM k
""")
def canonicalize_query(t: Load):
    """The query strings of all URLs: known keys, valid values, defaults left out."""
    return t("pages").select("page_id", X.canonical_query(F.col("url"), {"page": ("one", "1", None), "utm_source": ("one", None, ["feed", "mail"])}).alias("query"))


@query("""
WITH q AS (SELECT page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS kv FROM pages WHERE contains(url, '?'))
SELECT page_id, string_split(kv, '=')[1] AS key, string_split(kv, '=')[2] AS value FROM q WHERE NOT (string_split(kv, '=')[1] = 'page' OR kv = 'utm_source=feed')
""")
def query_param_audit(t: Load):
    """Query parameters that no page accepts, by anti joins on (key) and (key, value)."""
    said = t("pages").select("page_id", F.explode(F.str_to_map(F.try_parse_url("url", F.lit("QUERY")), F.lit("&"), F.lit("="))))
    spark = t("pages").sparkSession
    keys = spark.createDataFrame([("page",)], "key string")
    values = spark.createDataFrame([("utm_source", "feed")], "key string, value string")
    return said.join(keys, "key", "left_anti").join(values, ["key", "value"], "left_anti").select("page_id", "key", "value")


@query("SELECT page_id, CAST((regexp_matches(url, '[?&]page=[^1&#]') OR regexp_matches(url, '[?&]page=1[0-9]'))::INT + (contains(url, 'ref=')::INT) AS INTEGER) AS active FROM pages")
def active_filter_count(t: Load):
    said = F.str_to_map(F.coalesce(F.try_parse_url("url", F.lit("QUERY")), F.lit("")), F.lit("&"), F.lit("="))
    return t("pages").select("page_id", X.active_filters({"page": "1", "ref": ""}, said).cast("int").alias("active"))


@query(f"SELECT 'kind' AS facet, k AS value, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, unnest({_KINDS}) AS k FROM part) GROUP BY k UNION ALL SELECT 'brand', p_brand, count(*) FROM part GROUP BY p_brand UNION ALL SELECT 'size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY p_size")
def facet_counts(t: Load):
    return X.facet_counts(t("part"), {"kind": F.split("p_name", " "), "brand": F.array("p_brand"), "size": F.array(F.col("p_size").cast("string"))}, "p_partkey")


@query("SELECT id, area, kind FROM places WHERE NOT (kind = 'MACHINERY' AND id % 4 <> 0)")
def drop_closed(t: Load):
    """Closed places (stand-in: a kind) go unless they have heritage (every fourth)."""
    return t("places").where(~((F.col("kind") == "MACHINERY") & (F.col("id") % 4 != 0))).select("id", "area", "kind")


@query(f"SELECT p_partkey AS id FROM part WHERE p_partkey % 50 = 0 OR (list_has_any({_KINDS}, ['red', 'green']) AND p_size > 10 AND (p_brand <> 'Brand#11' OR p_retailprice > 1000))")
def layered_visibility(t: Load):
    """Pinned rows, or those that pass every layer's rule."""
    kinds = F.arrays_overlap(F.split("p_name", " "), F.array(F.lit("red"), F.lit("green")))
    return t("part").where((F.col("p_partkey") % 50 == 0) | (kinds & (F.col("p_size") > 10) & ((F.col("p_brand") != "Brand#11") | (F.col("p_retailprice") > 1000)))).select(F.col("p_partkey").alias("id"))


_ELSEWHERE = ["Apache License", "MIT License", "GNU General Public License", "CC BY-NC"]
_WORDS = "list_distinct(list_filter(string_split(regexp_replace(strip_accents(lower(coalesce({0}, ''))), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''))"


@query(f"""
WITH d AS (SELECT doc_id, doc_id % 40 AS item_id, text, {_WORDS.format("replace(text, '&', ' and ')")} AS words FROM documents),
c AS (SELECT list(w) AS common FROM (SELECT w FROM (SELECT unnest(words) AS w FROM d) GROUP BY w HAVING count(*) >= 0.02 * (SELECT count(*) FROM d))),
n AS (SELECT item_id, text AS name, list_filter({_WORDS.format("text")}, lambda w: length(w) >= 3 AND w <> 'the') AS words FROM benchmark),
t AS (SELECT item_id, name, CASE WHEN len(list_filter(words, lambda w: NOT list_contains(common, w))) > 0 THEN list_filter(words, lambda w: NOT list_contains(common, w)) ELSE words END AS tokens FROM n, c),
p AS (SELECT d.doc_id, d.item_id, d.words, tokens, name, nullif(regexp_extract(d.text, '({'|'.join(_ELSEWHERE)})', 1), '') AS place FROM d JOIN t ON d.item_id = t.item_id),
m AS (SELECT doc_id, item_id, CASE WHEN NOT contains(name, place) THEN place END AS far, len(list_filter(words, lambda w: len(list_filter(tokens, lambda k: k = w OR (length(k) >= 5 AND length(w) >= 5 AND (starts_with(w, k) OR starts_with(k, w))))) > 0)) > 0 AS mentioned FROM p)
SELECT doc_id, item_id, mentioned, far, mentioned AND far IS NULL AS kept FROM m
""")
def text_evidence_filter(t: Load):
    """Whether each document's text shows that it is about its item (words in 2 % of the texts tell nothing) and not elsewhere."""
    texts = t("documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 40).alias("subject"), "text")
    subjects = t("benchmark").select(F.col("item_id").alias("subject"), F.array("text").alias("names"))
    return V.text_evidence(texts, subjects, V.common_words(texts, 0.02), ["the"], _ELSEWHERE).select(F.col("id").alias("doc_id"), F.col("subject").alias("item_id"), "mentioned", "far", "kept")


@query("SELECT id, area, rank, total FROM (SELECT id, area, CAST(row_number() OVER (PARTITION BY area ORDER BY score DESC, id) AS INTEGER) AS rank, count(*) OVER (PARTITION BY area) AS total FROM places) WHERE rank <= 3")
def top_n_per_group(t: Load):
    return R.top_n_per_group(t("places"), ["area"], [F.desc("score"), "id"], 3).select("id", "area", "rank", "total")


@query("""
WITH m AS (SELECT *, id % 3 = 0 AS sp FROM places), o AS (SELECT *, row_number() OVER (PARTITION BY area, kind, sp ORDER BY score DESC, id) AS one, bool_or(sp) OVER (PARTITION BY area, kind) AS seen FROM m),
s AS (SELECT *, CASE WHEN sp AND one = 1 THEN 1 WHEN sp THEN 2 WHEN one = 1 AND NOT seen THEN 3 ELSE 4 END AS step FROM o)
SELECT area, id, step, CAST(row_number() OVER (PARTITION BY area ORDER BY step, score DESC, id) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY area ORDER BY step, score DESC, id) <= 6
""")
def diverse_top_n(t: Load):
    return R.diverse_top_n(t("places"), ["area"], "kind", F.col("id") % 3 == 0, [F.desc("score"), "id"], 6).select("area", "id", "step", "rank")


@query("SELECT id, area FROM places QUALIFY row_number() OVER (PARTITION BY area, kind ORDER BY name, id) = 1")
def keep_first(t: Load):
    return R.keep_first(t("places"), ["area", "kind"], ["name", "id"]).select("id", "area")


@query("SELECT id, CASE WHEN id % 4 <> 0 THEN CAST(row_number() OVER (PARTITION BY id % 4 <> 0 ORDER BY area, name, id) AS BIGINT) END AS number FROM places")
def reading_order_number(t: Load):
    """1.. in area and name order, only some rows numbered; without one task for all."""
    return R.numbered(t("places").select("id", "area", "name"), ["area", "name", "id"], F.col("id") % 4 != 0).select("id", "number")


@query("SELECT p_partkey AS id, p_name || CASE WHEN n = 1 THEN '' ELSE ' (' || n || ')' END AS shown FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def suffix_duplicates(t: Load):
    return R.suffix_duplicates(t("part"), "p_name", ["p_partkey"]).select(F.col("p_partkey").alias("id"), "shown")


@query("SELECT id, CASE list_position(['BUILDING', 'MACHINERY'], kind) WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 99 END AS ord, CAST(row_number() OVER (PARTITION BY area ORDER BY CASE list_position(['BUILDING', 'MACHINERY'], kind) WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 99 END, lower(name), id) AS INTEGER) AS n FROM places".replace(" AS ord", "::BIGINT AS ord", 1))
def vocab_order(t: Load):
    o = R.vocab_order(F.col("kind"), ["BUILDING", "MACHINERY"])
    return t("places").select("id", o.alias("ord"), F.row_number().over(Window.partitionBy("area").orderBy(o, R.name_sort_key(F.col("name")), "id")).alias("n"))


@query("SELECT id, score FROM places ORDER BY score DESC, id LIMIT 20")
def top_k(t: Load):
    return t("places").select("id", "score").orderBy(F.desc("score"), "id").limit(20)


@query("SELECT id, CAST(row_number() OVER (PARTITION BY area ORDER BY CASE WHEN kind = 'BUILDING' THEN 0 ELSE 1 END, score DESC, name, id) AS INTEGER) AS n FROM places")
def primary_first(t: Load):
    """Rows of the group's own kind before those that join by another one, else by rank."""
    return t("places").select("id", F.row_number().over(Window.partitionBy("area").orderBy(F.when(F.col("kind") == "BUILDING", 0).otherwise(1), F.desc("score"), "name", "id")).alias("n"))


@query("SELECT area, arg_min(id, (-places_n, -events_n, id)) AS principal FROM (SELECT p.area, p.kind AS id, count(DISTINCT p.id) AS places_n, count(h.id) AS events_n FROM places p LEFT JOIN happenings h ON h.place = p.id GROUP BY ALL) GROUP BY area")
def principal_area(t: Load):
    """Each area's kind with most places, then events, then name."""
    n = t("happenings").groupBy(F.col("place").alias("id")).agg(F.count("*").alias("e"))
    c = t("places").join(n, "id", "left").groupBy("area", "kind").agg(F.count("*").alias("p"), F.sum(F.coalesce("e", F.lit(0))).alias("e"))
    return c.groupBy("area").agg(F.min(F.struct(-F.col("p"), -F.col("e"), "kind")).alias("m")).select("area", F.col("m.kind").alias("principal"))


@query("SELECT user_id, list_sort(list(DISTINCT event_type)) = ['click', 'purchase', 'view'] AS same, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (event_type NOT IN ('click', 'view')) AS missing, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (event_type IN ('click', 'error')) AS common FROM events GROUP BY user_id")
def saved_sets(t: Load):
    """A user's set against another one: equal, missing from it, common."""
    own = t("events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("s"))
    text = lambda c: F.nullif(F.array_join(F.array_sort(c), ","), F.lit(""))
    lits = lambda *v: F.array(*map(F.lit, v))
    return own.select("user_id", (F.col("s") == lits("click", "purchase", "view")).alias("same"), text(F.array_except("s", lits("click", "view"))).alias("missing"), text(F.array_intersect("s", lits("click", "error"))).alias("common"))


@query("SELECT user_id, id, kind FROM (SELECT user_id, event_id % 30 AS id, event_type AS kind, row_number() OVER (PARTITION BY user_id, event_id % 30 ORDER BY (event_type <> 'view')::INT, ts, event_id) AS n FROM events WHERE event_type IN ('view', 'click')) WHERE n = 1")
def saved_union(t: Load):
    """Union of two saved sets, the first one's kind wins."""
    rows = t("events").where("event_type in ('view', 'click')").withColumn("id", F.col("event_id") % 30)
    return R.keep_first(rows, ["user_id", "id"], [(F.col("event_type") != "view").cast("int"), "ts", "event_id"]).select("user_id", "id", F.col("event_type").alias("kind"))
