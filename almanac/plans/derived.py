"""Queries on derived columns, aggregates and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from almanac.functions import text as T
from almanac.operators import consolidate as C
from almanac.operators import ranking as R
from almanac.plans.registry import Load, query

_FOLD = "strip_accents(lower({0}))"
_NAME = "trim(regexp_replace(trim(regexp_replace(regexp_replace(replace(strip_accents(lower({0})), '&', ' and '), '[''’`]', '', 'g'), '[^a-z0-9]+', ' ', 'g')), '^the\\s+', ''))"
_FIRST = "list_extract(string_split(text, chr(10)), 1)"


def line(t: Load):
    """The first line of each document."""
    return t("documents").select("doc_id", F.split("text", "\n")[0].alias("line"))


@query(f"SELECT doc_id, {_NAME.format(_FIRST)} AS name, replace(trim(regexp_replace(replace(strip_accents(lower({_FIRST})), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' ', '-') AS slug FROM documents")
def name_key(t: Load):
    """Name key and slug of each document's first line."""
    return line(t).select("doc_id", T.name_key(F.col("line")).alias("name"), T.slug(F.col("line")).alias("slug"))


@query(f"SELECT doc_id, {_FOLD.format('text')} AS folded FROM documents")
def fold_accents(t: Load):
    """Whole texts without accents."""
    return t("documents").select("doc_id", T.fold_accents(F.col("text")).alias("folded"))


@query("""
WITH a AS (SELECT c_custkey AS id, (c_custkey % 900 + 1) || ' ' || ['North', 'S.', 'East'][CAST(c_custkey % 3 AS INTEGER) + 1] || ' ' || ['Highland Avenue', 'First Street', 'Beach Drive'][CAST(c_custkey % 3 AS INTEGER) + 1] || CASE WHEN c_custkey % 4 = 0 THEN ', Suite 5' WHEN c_custkey % 4 = 1 THEN ' # 7' ELSE '' END AS a FROM customer)
SELECT id, (id % 900 + 1) || ' ' || ['n highland ave', 's 1st st', 'e beach dr'][CAST(id % 3 AS INTEGER) + 1] AS key, CAST(id % 900 + 1 AS VARCHAR) AS no, ['n highland ave', 's 1st st', 'e beach dr'][CAST(id % 3 AS INTEGER) + 1] AS street FROM a
""")
def addr_key(t: Load):
    """Address and street keys of made-up addresses of each customer."""
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("c_custkey") % 3 + 1).cast("int"))
    tail = F.when(F.col("c_custkey") % 4 == 0, ", Suite 5").when(F.col("c_custkey") % 4 == 1, " # 7").otherwise("")
    a = F.concat((F.col("c_custkey") % 900 + 1).cast("string"), F.lit(" "), pick("North", "S.", "East"), F.lit(" "), pick("Highland Avenue", "First Street", "Beach Drive"), tail)
    return t("customer").select(F.col("c_custkey").alias("id"), T.addr_key(a).alias("key"), T.street_key(a)["no"].alias("no"), T.street_key(a)["street"].alias("street"))


@query("""
SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') AS host, regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://(www\\.)?', ''), '/+$', ''), '[?#].*$', '') AS key FROM pages
""")
def host_of(t: Load):
    return t("pages").select("page_id", T.host_of(F.col("url")).alias("host"), T.url_key(F.col("url")).alias("key"))


@query("WITH h AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') AS host FROM pages) SELECT host, count(DISTINCT page_id) AS n, arg_min(url, page_id) AS first_url, min(page_id) AS first FROM h GROUP BY host")
def host_citations(t: Load):
    """Pages of each host, the first URL kept."""
    return t("pages").groupBy(T.host_of(F.col("url")).alias("host")).agg(F.countDistinct("page_id").alias("n"), F.min_by("url", "page_id").alias("first_url"), F.min("page_id").alias("first"))


@query("WITH h AS (SELECT page_id % 20 AS record, page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages) SELECT record, host, count(*) AS n, string_agg(url, ' ' ORDER BY page_id) AS urls FROM h GROUP BY ALL")
def urls_by_host(t: Load):
    h = t("pages").select((F.col("page_id") % 20).alias("record"), "page_id", "url", F.parse_url("url", F.lit("HOST")).alias("host"))
    return h.groupBy("record", "host").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda x: x["url"]), " ").alias("urls"))


@query("SELECT p_partkey AS id, regexp_replace(trim(p_name), '\\s+', ' ', 'g') AS name, array_to_string(list_sort(list_distinct(string_split(p_name, ' ') || [lower(p_type)])), ',') AS kinds, upper(substr(string_split(p_name, ' ')[1], 1, 1) || coalesce(substr(string_split(p_name, ' ')[2], 1, 1), '')) AS initials FROM part")
def derive_kinds(t: Load):
    """All kinds of a record (its own and further ones), clean name, initials."""
    kinds = F.array_sort(F.array_distinct(F.concat(F.split("p_name", " "), F.array(F.lower("p_type")))))
    return t("part").select(F.col("p_partkey").alias("id"), F.regexp_replace(F.trim("p_name"), "\\s+", " ").alias("name"), F.array_join(kinds, ",").alias("kinds"), T.initials(F.col("p_name")).alias("initials"))


@query("SELECT id, CASE WHEN status = 'cancelled' THEN 0 ELSE 1 END + CASE WHEN featured THEN 2 ELSE 0 END + CASE WHEN all_day THEN 4 ELSE 0 END + CASE WHEN start IS NULL THEN 8 ELSE 0 END + CASE WHEN \"end\" IS NULL THEN 16 ELSE 0 END AS flags FROM happenings")
def pack_flags(t: Load):
    bit = lambda cond, n: F.when(cond, 1 << n).otherwise(0)
    f = bit(F.col("status") != "cancelled", 0).bitwiseOR(bit(F.col("featured"), 1)).bitwiseOR(bit(F.col("all_day"), 2)).bitwiseOR(bit(F.col("start").isNull(), 3)).bitwiseOR(bit(F.col("end").isNull(), 4))
    return t("happenings").select("id", f.alias("flags"))


@query("SELECT h.id AS id, round(coalesce(CASE WHEN h.id % 9 = 0 THEN 27.77 END, p.lat), 6) AS lat, coalesce(CASE WHEN h.id % 9 = 0 THEN 999 END, p.area) AS area FROM happenings h LEFT JOIN places p ON h.place = p.id")
def inherit_location(t: Load):
    """An event's own point and area, else its place's."""
    p = t("places").select(F.col("id").alias("pid"), "lat", "area")
    own = F.col("id") % 9 == 0
    return t("happenings").join(p, F.col("place") == F.col("pid"), "left").select("id", F.round(F.coalesce(F.when(own, 27.77), "lat"), 6).alias("lat"), F.coalesce(F.when(own, 999), "area").alias("area"))


@query("WITH c AS (SELECT c_nationkey AS area, count(*) AS n FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1) SELECT n_nationkey AS area, n_name AS name, n_regionkey AS region, coalesce(n, 0) AS n, n IS NOT NULL AS record FROM nation LEFT JOIN c ON n_nationkey = area")
def complete_dimension(t: Load):
    """Every fixed area with its record's figures, if it has one."""
    c = t("customer").where("c_nationkey % 3 <> 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return t("nation").join(c, F.col("n_nationkey") == F.col("k"), "left").select(F.col("n_nationkey").alias("area"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("record"))


@query("SELECT doc_id, coalesce(TRY_CAST(nullif(regexp_extract(text, '(\\d{4})', 1), '') AS INTEGER), 9999) AS year FROM documents")
def first_year(t: Load):
    return t("documents").select("doc_id", T.first_year(F.col("text")).alias("year"))


@query("SELECT id, CASE WHEN featured THEN 'featured' WHEN run THEN 'run' WHEN all_day THEN 'all day' WHEN start IS NULL THEN 'no hours' ELSE 'timed' END AS list FROM (SELECT DISTINCT id, featured, run, all_day, start FROM instances)")
def first_fit_partition(t: Load):
    """Each record goes to the first list that fits."""
    run = F.datediff("end_date", "date") > 13
    return t("happenings").select("id", F.when(F.col("featured"), "featured").when(run, "run").when(F.col("all_day"), "all day").when(F.col("start").isNull(), "no hours").otherwise("timed").alias("list"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '(MIT|Apache|GNU|Creative)') THEN 'license' WHEN contains(text, '@') THEN 'mail' WHEN regexp_matches(text, '[0-9]{6}') THEN 'numbers' ELSE 'prose' END AS class FROM documents")
def route_text_rules(t: Load):
    """Ordered text rules, the first that matches names the class."""
    rules = [("(MIT|Apache|GNU|Creative)", "license"), ("@", "mail"), ("[0-9]{6}", "numbers")]
    c = F.lit("prose")
    for pattern, name in reversed(rules):
        c = F.when(F.col("text").rlike(pattern), name).otherwise(c)
    return t("documents").select("doc_id", c.alias("class"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '//(www\\.)?[^/]*(spam|cheap)') THEN 'blocked' WHEN contains(url, '//blog.') THEN 'blog' WHEN contains(url, '//m.') THEN 'mobile' WHEN contains(url, '//www.') THEN 'site' ELSE 'other' END AS class FROM pages")
def source_class(t: Load):
    u = F.col("url")
    return t("pages").select("page_id", F.when(u.rlike("//(www\\.)?[^/]*(spam|cheap)"), "blocked").when(F.contains(u, F.lit("//blog.")), "blog").when(F.contains(u, F.lit("//m.")), "mobile").when(F.contains(u, F.lit("//www.")), "site").otherwise("other").alias("class"))


@query("SELECT p_partkey AS id, CASE WHEN p_retailprice > 1800 THEN 1 WHEN p_size > 40 THEN 2 WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 3 WHEN contains(p_name, 'red') THEN 4 ELSE 5 END AS tier, coalesce(list_max([x FOR x IN [160, 320, 640, 960] IF x < p_retailprice]), 160) AS step FROM part")
def priority_tier(t: Load):
    """Tier of a record, and the largest standard step below its size."""
    step = F.coalesce(F.array_max(F.filter(F.array(*map(F.lit, (160, 320, 640, 960))), lambda s: s < F.col("p_retailprice"))), F.lit(160))
    tier = F.when(F.col("p_retailprice") > 1800, 1).when(F.col("p_size") > 40, 2).when(F.col("p_brand").isin("Brand#11", "Brand#12"), 3).when(F.contains("p_name", F.lit("red")), 4).otherwise(5)
    return t("part").select(F.col("p_partkey").alias("id"), tier.alias("tier"), step.alias("step"))


@query("SELECT 'place' AS kind, id, name, 'lat' AS layer FROM places WHERE id % 6 <> 0 UNION ALL SELECT 'stay', id, name, 'lat' FROM stays UNION ALL SELECT 'off', id, name, NULL FROM places WHERE id % 6 = 0")
def typed_union_rows(t: Load):
    """One row a mappable thing of each kind; those without a point go apart."""
    p = t("places").select("id", "name", F.when(F.col("id") % 6 != 0, F.col("lat")).alias("lat"))
    rows = p.select(F.when(F.col("lat").isNull(), "off").otherwise("place").alias("kind"), "id", "name", F.when(F.col("lat").isNotNull(), "lat").alias("layer"))
    return rows.unionByName(t("stays").select(F.lit("stay").alias("kind"), "id", "name", F.lit("lat").alias("layer")))


@query("""
WITH b AS (SELECT id, dayofyear(date) AS a, dayofyear(end_date) AS z FROM happenings), s AS (SELECT id, a, CASE WHEN z < a THEN 366 ELSE z END AS z FROM b UNION ALL SELECT id, 1, z FROM b WHERE z < a)
SELECT id, CAST(a AS INTEGER) AS first, CAST(z AS INTEGER) AS last FROM s
""")
def season_bands(t: Load):
    """Day-of-year bands; one across New Year becomes two."""
    b = t("happenings").select("id", F.dayofyear("date").alias("a"), F.dayofyear("end_date").alias("z"))
    band = lambda a, z: F.struct(a.alias("first"), z.alias("last"))
    two = F.array(band(F.col("a"), F.lit(366)), band(F.lit(1), F.col("z")))
    return b.select("id", F.explode(F.when(F.col("z") < F.col("a"), two).otherwise(F.array(band(F.col("a"), F.col("z"))))).alias("b")).select("id", "b.*")


@query("SELECT l_orderkey AS route, count(*) AS stops, count(*) >= 2 AND count(DISTINCT l_linenumber) = count(*) AS numbered FROM lineitem GROUP BY 1")
def numbered_line(t: Load):
    return t("lineitem").groupBy(F.col("l_orderkey").alias("route")).agg(F.count("*").alias("stops"), ((F.count("*") >= 2) & (F.countDistinct("l_linenumber") == F.count("*"))).alias("numbered"))


@query("""
WITH u AS (SELECT 'customer' AS c, c_custkey AS id, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'supplier', s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT c AS collection, CAST(r AS INTEGER) AS region, count(DISTINCT id) AS n FROM u GROUP BY ROLLUP (c, r)
""")
def region_matrix(t: Load):
    """Collection by region with totals of distinct records."""
    n = t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("region"))
    u = t("customer").join(n, F.col("c_nationkey") == F.col("k")).select(F.lit("customer").alias("collection"), F.col("c_custkey").alias("id"), "region").unionByName(t("supplier").join(n, F.col("s_nationkey") == F.col("k")).select(F.lit("supplier").alias("collection"), F.col("s_suppkey").alias("id"), "region"))
    return u.rollup("collection", "region").agg(F.countDistinct("id").alias("n"))


@query("SELECT 'places' AS collection, count(*) AS n FROM places UNION ALL SELECT 'stays', count(*) FROM stays UNION ALL SELECT 'events', count(*) FROM happenings WHERE status <> 'cancelled' UNION ALL SELECT 'pages', count(*) FROM pages")
def collection_counts(t: Load):
    """Rows of each collection, of events the live ones."""
    out = None
    for name, df in (("places", t("places")), ("stays", t("stays")), ("events", t("happenings").where("status <> 'cancelled'")), ("pages", t("pages"))):
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT 'no start' AS what, count(*) FILTER (start IS NULL) AS n FROM happenings UNION ALL SELECT 'no end', count(*) FILTER (\"end\" IS NULL) FROM happenings UNION ALL SELECT 'cancelled', count(*) FILTER (status = 'cancelled') FROM happenings")
def unknown_audit(t: Load):
    """Counts of unknown values, unpivoted from one pass."""
    one = t("happenings").agg(F.count_if(F.col("start").isNull()).alias("a"), F.count_if(F.col("end").isNull()).alias("b"), F.count_if(F.col("status") == "cancelled").alias("c"))
    return one.selectExpr("stack(3, 'no start', a, 'no end', b, 'cancelled', c) as (what, n)")


@query("WITH c AS (SELECT area, kind, count(*) AS n FROM places GROUP BY ALL) SELECT area, arg_min(kind, (-n, kind)) AS mode, count(*) = 1 AS all_same FROM c GROUP BY area")
def most_common_value(t: Load):
    c = t("places").groupBy("area", "kind").agg(F.count("*").alias("n"))
    return c.groupBy("area").agg(F.min(F.struct(-F.col("n"), "kind")).alias("m"), (F.count("*") == 1).alias("all_same")).select("area", F.col("m.kind").alias("mode"), "all_same")


@query("SELECT event_type AS value, count(*) AS n, CAST(list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type) AS INTEGER) AS ord FROM events GROUP BY 1")
def value_histogram(t: Load):
    kinds = F.array(*map(F.lit, ("signup", "view", "click", "purchase", "error")))
    return t("events").groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n")).select("value", "n", F.array_position(kinds, F.col("value")).cast("int").alias("ord"))


@query("WITH m AS (SELECT c_mktsegment AS series, month(o_orderdate) AS month, round(avg(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT series, CAST(arg_min(month, (-v, month)) AS INTEGER) AS top, CAST(arg_min(month, (v, month)) AS INTEGER) AS low, CAST(floor(min(v) / 10) * 10 AS BIGINT) AS axis FROM m GROUP BY series")
def argminmax_series(t: Load):
    """Months of the highest and lowest mean, and the axis' start."""
    m = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("series"), F.month("o_orderdate").alias("month")).agg(F.round(F.avg("o_totalprice"), 2).alias("v"))
    return m.groupBy("series").agg(F.min(F.struct(-F.col("v"), "month")).alias("t"), F.min(F.struct("v", "month")).alias("l"), F.min("v").alias("m")).select("series", F.col("t.month").alias("top"), F.col("l.month").alias("low"), (F.floor(F.col("m") / 10) * 10).cast("bigint").alias("axis"))


@query("SELECT month(ts) * 100 + day(ts) AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def climate_pivot(t: Load):
    """Keyed facts as rows by day and columns by series."""
    e = t("events").select((F.month("ts") * 100 + F.dayofmonth("ts")).cast("bigint").alias("day"), "event_type")
    return e.groupBy("day").pivot("event_type", ["click", "error", "view"]).count().na.fill(0)


@query("SELECT place, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY date, id) AS ids FROM happenings WHERE status <> 'cancelled' GROUP BY place")
def group_index(t: Load):
    """Place to events in order of date."""
    return t("happenings").where("status <> 'cancelled'").groupBy("place").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", "id"))), lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("SELECT p.id AS id, coalesce(e.n, 0) AS events, coalesce(s.n, 0) AS series, coalesce(e.n, 0) + coalesce(s.n, 0) + (p.id % 8 = 0)::INT AS refs FROM places p LEFT JOIN (SELECT place, count(*) AS n FROM happenings GROUP BY 1) e ON p.id = e.place LEFT JOIN (SELECT place, count(DISTINCT series) AS n FROM happenings GROUP BY 1) s ON p.id = s.place")
def child_counts(t: Load):
    c = t("happenings").groupBy(F.col("place").alias("id")).agg(F.count("*").alias("e"), F.countDistinct("series").alias("s"))
    e, s = F.coalesce("e", F.lit(0)), F.coalesce("s", F.lit(0))
    return t("places").select("id").join(c, "id", "left").select("id", e.alias("events"), s.alias("series"), (e + s + (F.col("id") % 8 == 0).cast("int")).alias("refs"))


@query("SELECT id, count(*) OVER (PARTITION BY kind) - 1 AS same_kind, count(*) OVER (PARTITION BY area) - 1 AS same_area FROM places")
def related_counts(t: Load):
    by = lambda c, n: t("places").groupBy(c).agg((F.count("*") - 1).alias(n))
    return t("places").join(by("kind", "same_kind"), "kind").join(by("area", "same_area"), "area").select("id", "same_kind", "same_area")


@query("SELECT n_regionkey AS region, area, count(*) AS n, count(*) FILTER (score < 0) AS closed, count(DISTINCT kind) AS kinds FROM places JOIN nation ON area = n_nationkey GROUP BY ROLLUP (region, area)")
def area_summary(t: Load):
    """Rows, closed ones and kinds by region and area, with totals."""
    n = t("nation").select(F.col("n_nationkey").alias("area"), F.col("n_regionkey").alias("region"))
    return t("places").join(n, "area").rollup("region", "area").agg(F.count("*").alias("n"), F.count_if(F.col("score") < 0).alias("closed"), F.countDistinct("kind").alias("kinds"))


@query("SELECT 'colors' AS grp, count(*) FILTER (list_has_any(string_split(p_name, ' '), ['red', 'blue', 'green'])) AS n FROM part UNION ALL SELECT 'large', count(*) FILTER (list_has_any(string_split(p_name, ' '), ['large', 'big'])) FROM part")
def tag_group_counts(t: Load):
    has = lambda *v: F.count_if(F.arrays_overlap(F.split("p_name", " "), F.array(*map(F.lit, v))))
    return t("part").agg(has("red", "blue", "green").alias("a"), has("large", "big").alias("b")).selectExpr("stack(2, 'colors', a, 'large', b) as (grp, n)")


@query("SELECT l_orderkey AS route, count(*) AS stops, count(*) FILTER (l_suppkey % 5 = 0) AS unmapped, count(*) FILTER (l_suppkey % 5 <> 0 AND lat > 28.4) AS outside FROM lineitem JOIN stays ON l_suppkey = stays.id GROUP BY 1")
def stop_coverage(t: Load):
    s = t("lineitem").join(t("stays").select(F.col("id").alias("l_suppkey"), "lat"), "l_suppkey")
    return s.groupBy(F.col("l_orderkey").alias("route")).agg(F.count("*").alias("stops"), F.count_if(F.col("l_suppkey") % 5 == 0).alias("unmapped"), F.count_if((F.col("l_suppkey") % 5 != 0) & (F.col("lat") > 28.4)).alias("outside"))


@query("SELECT year(date) AS era, count(*) AS entries, count(DISTINCT place) AS sites, count(*) FILTER (featured) * 2 >= count(*) AS mostly FROM happenings GROUP BY 1")
def era_summary(t: Load):
    return t("happenings").groupBy(F.year("date").cast("bigint").alias("era")).agg(F.count("*").alias("entries"), F.countDistinct("place").alias("sites"), (F.count_if(F.col("featured")) * 2 >= F.count("*")).alias("mostly"))


@query("SELECT count(*) AS stops, count(DISTINCT l_suppkey) AS sites, count(DISTINCT l_orderkey) AS routes FROM lineitem")
def route_totals(t: Load):
    return t("lineitem").agg(F.count("*").alias("stops"), F.countDistinct("l_suppkey").alias("sites"), F.countDistinct("l_orderkey").alias("routes"))


@query("WITH r AS (SELECT id, place, CASE WHEN status = 'cancelled' THEN 'cancelled' WHEN start IS NULL THEN 'no start' WHEN \"end\" IS NULL THEN 'no end' ELSE 'fine' END AS reason FROM happenings), c AS (SELECT place, reason, count(*) AS n FROM r GROUP BY ALL) SELECT place, arg_min(reason, (-n, reason)) AS main, sum(n)::BIGINT AS n FROM c GROUP BY place")
def reason_counts(t: Load):
    """The main reason of each record's rows."""
    reason = F.when(F.col("status") == "cancelled", "cancelled").when(F.col("start").isNull(), "no start").when(F.col("end").isNull(), "no end").otherwise("fine")
    c = t("happenings").groupBy("place", reason.alias("reason")).agg(F.count("*").alias("n"))
    return c.groupBy("place").agg(F.min(F.struct(-F.col("n"), "reason")).alias("m"), F.sum("n").alias("n")).select("place", F.col("m.reason").alias("main"), "n")


@query("WITH c AS (SELECT n_regionkey AS region, kind, count(*) AS n FROM places JOIN nation ON area = n_nationkey GROUP BY ALL) SELECT region, kind, n FROM c QUALIFY row_number() OVER (PARTITION BY region ORDER BY n DESC, kind) <= 2")
def top_values(t: Load):
    n = t("nation").select(F.col("n_nationkey").alias("area"), F.col("n_regionkey").alias("region"))
    c = t("places").join(n, "area").groupBy("region", "kind").agg(F.count("*").alias("n"))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("region").orderBy(F.desc("n"), "kind"))).where("k <= 2").drop("k")


@query("SELECT place, arg_min(id, (date, coalesce(start, '99:99'), id)) AS first, count(*) AS n FROM (SELECT * FROM happenings WHERE status <> 'cancelled' AND date BETWEEN DATE '1997-06-01' AND DATE '1997-08-31') GROUP BY place")
def events_at_location(t: Load):
    """The earliest event of each place inside a window, with its count."""
    live = t("happenings").where("status <> 'cancelled' and date between date '1997-06-01' and date '1997-08-31'")
    return live.groupBy("place").agg(F.min(F.struct("date", F.coalesce("start", F.lit("99:99")).alias("s"), "id")).alias("m"), F.count("*").alias("n")).select("place", F.col("m.id").alias("first"), "n")


@query("SELECT count(DISTINCT place) AS places FROM instances WHERE NOT run AND NOT all_day AND start IS NOT NULL AND \"end\" IS NOT NULL AND status <> 'cancelled' AND date = DATE '1997-06-15' AND start <= '12:00' AND (\"end\" > '12:00' OR \"end\" < start)")
def live_now_locations(t: Load):
    """Places with an event on now, both ends known."""
    from almanac.plans.dated import NOW, instances

    i = instances(t).where("not run and not all_day and start is not null and end is not null and status <> 'cancelled' and date = date '1997-06-15'")
    now = F.lit(NOW).cast("timestamp")
    return i.where((F.col("s") <= now) & (F.col("e") > now)).agg(F.countDistinct("place").alias("places"))


@query("SELECT user_id, arg_min(event_id, ((event_type = 'view')::INT, ts, event_id)) AS next_up FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' GROUP BY user_id")
def next_up(t: Load):
    """The earliest item to come of each user; one kind only if there is nothing else."""
    e = t("events").where("ts >= timestamp '2024-01-15 12:00:00'")
    return e.groupBy("user_id").agg(F.min(F.struct((F.col("event_type") == "view").alias("v"), "ts", "event_id")).alias("m")).select("user_id", F.col("m.event_id").alias("next_up"))


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY (ts < TIMESTAMP '2024-01-15 12:00:00')::INT, CASE WHEN ts >= TIMESTAMP '2024-01-15 12:00:00' THEN epoch_ms(ts) ELSE -epoch_ms(ts) END, event_id) AS INTEGER) AS n FROM events")
def saved_list_order(t: Load):
    """Items to come by their next start, then past ones, the latest first."""
    past = F.col("ts") < F.lit("2024-01-15 12:00:00").cast("timestamp")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return t("events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(past.cast("int"), F.when(past, -ms).otherwise(ms), "event_id")).alias("n"))


@query("""
WITH p AS (SELECT n_regionkey AS region, n_name AS area, id, name, score >= 0 AS open, id % 8 = 0 AS heritage, id % 5 AS features FROM places JOIN nation ON area = n_nationkey),
l AS (SELECT region, area, id, row_number() OVER (PARTITION BY region ORDER BY name, id) AS k FROM p WHERE open AND heritage QUALIFY k <= 2),
s AS (SELECT region, area, count(*) AS size FROM p GROUP BY ALL),
o AS (SELECT region, area, arg_min(id, (-features, name, id)) AS id FROM p WHERE open AND id NOT IN (SELECT id FROM l) GROUP BY ALL),
a AS (SELECT o.*, row_number() OVER (PARTITION BY region ORDER BY size DESC, area) AS k FROM o JOIN s USING (region, area)),
c AS (SELECT region, count(*) AS led FROM l GROUP BY region)
SELECT region, area, id, k::INTEGER AS step FROM l UNION ALL SELECT a.region, area, id, (coalesce(led, 0) + k)::INTEGER FROM a LEFT JOIN c USING (region) WHERE coalesce(led, 0) + k <= 6
""")
def spread_picks(t: Load):
    """Of each region two open heritage places by name, then one place of each area, six in all."""
    p = t("places").join(t("nation").select(F.col("n_nationkey").alias("area"), F.col("n_regionkey").alias("region"), "n_name"), "area").drop("area").withColumnRenamed("n_name", "area")
    open_ = F.col("score") >= 0
    return R.spread_picks(p, "region", "area", open_ & (F.col("id") % 8 == 0), open_, ["name", "id"], F.col("id") % 5)


@query("WITH d AS (SELECT DISTINCT l_suppkey AS k, l_linenumber AS n FROM lineitem), g AS (SELECT k, n, n - row_number() OVER (PARTITION BY k ORDER BY n) AS g FROM d), r AS (SELECT k, min(n) AS a, max(n) AS b FROM g GROUP BY k, g) SELECT k AS supplier, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '–' || b END, ', ' ORDER BY a) AS label FROM r GROUP BY k")
def number_ranges(t: Load):
    """Numbers as ranges such as 1–3, 5."""
    w = Window.partitionBy("k").orderBy("n")
    d = t("lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("n")).distinct().withColumn("g", F.col("n") - F.row_number().over(w))
    r = d.groupBy("k", "g").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    label = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("–"), F.col("b").cast("string")))
    return r.groupBy(F.col("k").alias("supplier")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", label.alias("l")))), lambda x: x["l"]), ", ").alias("label"))


@query("SELECT l_orderkey AS id, round(arg_min(l_extendedprice, (l_linenumber, l_partkey, l_suppkey)) FILTER (l_discount > 0.03), 2) AS v FROM lineitem GROUP BY 1")
def precedence_value(t: Load):
    """A group's first value by an order that is not null."""
    v = F.when(F.col("l_discount") > 0.03, F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(v).alias("m")).select("id", F.round("m.l_extendedprice", 2).alias("v"))


@query("SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS words, len([x FOR x IN [trim(p) FOR p IN string_split_regex(text, '\\n\\s*\\n')] IF x <> '']) AS paragraphs FROM documents")
def word_count(t: Load):
    c = F.col("text")
    return t("documents").select("doc_id", T.word_count(c).cast("bigint").alias("words"), F.size(T.paragraphs(c)).cast("bigint").alias("paragraphs"))


@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script\\b.*?</script>', ' ', 'g'), '(?s)<style\\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&quot;', '\"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages")
def plain_text(t: Load):
    """Text of every page without tags."""
    return t("pages").select("page_id", T.plain_text(F.col("html")).alias("text"))


_FNV = "list_reduce(list_concat([2166136261::BIGINT], [CAST(unicode(c) AS BIGINT) FOR c IN string_split({0}, '')]), lambda h, b: (xor(h, b) * 16777619) % 4294967296) % 60466176"
_BASE36 = " || ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((h // {36**k}) % 36 AS BIGINT) + 1, 1)" for k in (4, 3, 2, 1, 0))


@query(f"SELECT id, {_BASE36} AS code FROM (SELECT p_partkey AS id, {_FNV.format("(p_name || '/' || p_partkey)")} AS h FROM part)")
def share_code(t: Load):
    """Short codes of all parts' names and keys."""
    return t("part").select(F.col("p_partkey").alias("id"), T.share_code(F.concat_ws("/", "p_name", "p_partkey")).alias("code"))


_LINE_CODES = f"SELECT id, {_BASE36} AS code FROM (SELECT id, {_FNV.format('id')} AS h FROM (SELECT DISTINCT concat_ws('/', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS id FROM lineitem))"


@query(f"SELECT code, count(*) AS n FROM ({_LINE_CODES}) GROUP BY code HAVING count(*) > 1")
def check_code_collisions(t: Load):
    """Short codes that two order lines share."""
    codes = t("lineitem").select(F.concat_ws("/", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("id")).distinct().select("id", T.share_code(F.col("id")).alias("code"))
    return codes.groupBy("code").agg(F.countDistinct("id").alias("n")).where("n > 1")


@query("SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(regexp_replace(substr(text, 1, 80), '\\s+\\S*$', ''), '[,;:.\\s]+$', '') || '…' END AS short FROM documents")
def truncate_words(t: Load):
    return t("documents").select("doc_id", T.truncate_words(F.col("text"), 80).alias("short"))


@query(r"""
WITH p AS (SELECT doc_id, text, list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 1) IN ('.', '!', '?')) AS marks FROM documents),
e AS (SELECT doc_id, text, list_min(list_filter(marks, lambda i: regexp_matches(substr(text, i + 1, 300), '^\s+["“(]?[A-Z0-9]')
  AND NOT regexp_matches(substr(text, greatest(1, i - 8), least(i - 1, 8)), '(^|[\s("“])(St|Ste|Ft|Mt|Dr|Mr|Mrs|Ms|Jr|Sr|No|Ave|Blvd|Rd|U\.S|Inc|Co|vs|Pt|[A-Z])$'))) AS stop FROM p)
SELECT doc_id, CASE WHEN stop IS NULL THEN text ELSE substr(text, 1, stop) END AS sentence FROM e
""")
def first_sentence(t: Load):
    """Each text up to its first sentence end that no abbreviation makes."""
    return t("documents").select("doc_id", T.first_sentence(F.col("text")).alias("sentence"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\\bnc\\b|non-?commercial') THEN 'rejected: non-commercial' WHEN regexp_matches(lower(text), '\\bnd\\b|no-?deriv') THEN 'rejected: no derivatives' WHEN regexp_matches(lower(text), 'public domain|cc0|\\bpd\\b') THEN 'public-domain' WHEN regexp_matches(lower(text), 'cc[ -]by[ -]sa|share-?alike') THEN 'cc-by-sa' WHEN regexp_matches(lower(text), 'cc[ -]by|attribution') THEN 'cc-by' WHEN trim(text) = '' THEN 'rejected: none' ELSE 'rejected: unknown' END AS class FROM documents")
def license_class(t: Load):
    return t("documents").select("doc_id", T.license_class(F.col("text")).alias("class"))


@query("WITH w AS (SELECT p_partkey AS id, p_name, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(lower(p_type) || ' red blue', ' ')) AS b FROM part) SELECT id, CAST(len(list_intersect(a, b)) AS INTEGER) AS shared, round(len(list_intersect(a, b)) / least(len(a), len(b)), 4) AS ratio FROM w")
def token_overlap(t: Load):
    s = T.shared_words(F.col("p_name"), F.concat(F.lower("p_type"), F.lit(" red blue")))
    return t("part").select(F.col("p_partkey").alias("id"), s["shared"].alias("shared"), F.round(s["ratio"], 4).alias("ratio"))


@query("""
WITH n AS (SELECT p_partkey AS id, p_name AS a, coalesce(lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey), '') AS b FROM part),
w AS (SELECT *, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM n),
d AS (SELECT *, [v FOR v IN x IF NOT list_contains(y, v)] AS p, [v FOR v IN y IF NOT list_contains(x, v)] AS q FROM w)
SELECT id, CAST(CASE WHEN a = b THEN 3 WHEN list_sort(x) = list_sort(y) THEN 2 WHEN (len(p) = 0 OR len(q) = 0) AND len([v FOR v IN list_concat(p, q) IF v NOT IN ('red', 'blue', 'small', 'large')]) = 0 THEN 1 ELSE 0 END AS INTEGER) AS level FROM d
""")
def name_level(t: Load):
    """Levels of likeness of neighbouring parts' names (blocked by brand)."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return t("part").select(F.col("p_partkey").alias("id"), T.name_level(F.col("p_name"), F.coalesce(F.lead("p_name").over(w), F.lit("")), ["red", "blue", "small", "large"]).alias("level"))


@query(f"""
WITH l AS (SELECT doc_id, translate(strip_accents(lower({_FIRST})), '‘’', repeat(chr(39), 2)) AS f FROM documents),
s AS (SELECT doc_id, f, list_filter([regexp_replace(x, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g') FOR x IN string_split_regex(f, '[\\s,]+')], lambda x: x <> '') AS terms FROM l)
SELECT doc_id, array_to_string(terms, ' ') AS said, CAST(len([x FOR x IN terms IF contains(f, x)]) AS INTEGER) AS spans FROM s
""")
def search_terms(t: Load):
    """Terms of each document's first line, and where they stand in it."""
    s = line(t).withColumn("terms", T.search_terms(F.col("line")))
    return s.withColumn("spans", F.size(T.match_spans(F.col("line"), F.col("terms")))).select("doc_id", F.array_join("terms", " ").alias("said"), "spans")


@query("SELECT doc_id, coalesce(TRY_CAST(nullif(regexp_extract(text, '([0-9]+)', 1), '') AS DOUBLE), -1) AS number FROM documents")
def parse_number(t: Load):
    return t("documents").select("doc_id", F.coalesce(F.expr("try_cast(nullif(regexp_extract(text, '([0-9]+)', 1), '') as double)"), F.lit(-1.0)).alias("number"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, len(json_keys(props)) AS keys FROM events")
def json_fields(t: Load):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.size(F.expr("json_object_keys(props)")).cast("bigint").alias("keys"))


@query("SELECT user_id % 40 AS key, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def latest_by_key(t: Load):
    """The last value of each key of a log."""
    return t("events").groupBy((F.col("user_id") % 40).alias("key")).agg(F.max(F.struct("ts", "event_id", "value")).alias("m")).select("key", "m.value")


@query(r"""
SELECT doc_id, coalesce(regexp_matches(CASE WHEN doc_id % 3 = 0 THEN 'Verified 2024-01-05: ' ELSE 'Seen 2024-01-05: ' END || text, '(?i)\bverif(ied|ier)\b[^.;]{0,20}[0-9]{4}-[0-9]{2}-[0-9]{2}'), false) AS verified FROM documents
""")
def verified_flag(t: Load):
    """Whether a note holds a verifier's date (notes made of documents)."""
    note = F.concat(F.when(F.col("doc_id") % 3 == 0, "Verified 2024-01-05: ").otherwise("Seen 2024-01-05: "), F.col("text"))
    return t("documents").select("doc_id", C.verified_flag(note).alias("verified"))


@query("SELECT lang, source, count(*) AS n, count(*) FILTER (text IS NULL OR trim(text) = '') AS blank, max(length(text)) AS longest FROM documents GROUP BY ALL")
def clean_strings(t: Load):
    """Blank texts as nulls, counted by language and source."""
    d = t("documents").withColumn("text", F.nullif(F.trim("text"), F.lit("")))
    return d.groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("blank")).join(t("documents").groupBy("lang", "source").agg(F.max(F.length("text")).cast("bigint").alias("longest")), ["lang", "source"])


@query("SELECT place, CASE WHEN n <= 4 AND date_diff('day', a, b) + 1 > n THEN CAST(n AS VARCHAR) || ' dates' WHEN date_diff('day', a, b) + 1 = n THEN 'run of ' || n ELSE n || ' dates, ' || strftime(a, '%Y-%m-%d') || ' to ' || strftime(b, '%Y-%m-%d') END AS words FROM (SELECT place, count(DISTINCT date) AS n, min(date) AS a, max(date) AS b FROM happenings GROUP BY place)")
def event_date_text(t: Load):
    """Words for a set of days: a run, a few dates, or the span."""
    g = t("happenings").groupBy("place").agg(F.countDistinct("date").alias("n"), F.min("date").alias("a"), F.max("date").alias("b"))
    n, span = F.col("n").cast("string"), F.datediff("b", "a") + 1
    words = F.when((F.col("n") <= 4) & (span > F.col("n")), F.concat(n, F.lit(" dates"))).when(span == F.col("n"), F.concat(F.lit("run of "), n)).otherwise(F.concat(n, F.lit(" dates, "), F.col("a").cast("string"), F.lit(" to "), F.col("b").cast("string")))
    return g.select("place", words.alias("words"))
