"""Queries on further derivations, orders, checks and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from almanac.functions import dates as D
from almanac.functions import geo as G
from almanac.functions import text as T
from almanac.operators import consolidate as C
from almanac.operators import derive as V
from almanac.operators import ranking as R
from almanac.operators import search as Q
from almanac.plans.merging import _PARTS, entries, parts
from almanac.plans.registry import METRES, Load, query
from almanac.streaming import jobs


@query("SELECT page_id, url, length(html) AS size FROM pages")
def read_pages(t: Load):
    return t("pages").select("page_id", "url", F.length("html").cast("bigint").alias("size"))


@query("SELECT c_custkey AS id, n_regionkey AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def derive_region(t: Load):
    return t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("id"), F.col("n_regionkey").alias("region"))


@query("SELECT id, status <> 'cancelled' AND status <> 'tentative' AS open, status <> 'cancelled' AS live FROM happenings")
def derive_flags(t: Load):
    return t("happenings").select("id", (~F.col("status").isin("cancelled", "tentative")).alias("open"), (F.col("status") != "cancelled").alias("live"))


@query("SELECT c_custkey AS id, c_name || CASE WHEN contains(lower(c_name), lower(n_name)) THEN '' ELSE ', ' || n_name END || ', FL ' || (33000 + c_custkey % 900) AS line FROM customer JOIN nation ON c_nationkey = n_nationkey")
def address_line(t: Load):
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("id"), V.address_line(F.col("c_name"), F.col("n_name"), F.lit("FL"), (F.col("c_custkey") % 900 + 33000).cast("string")).alias("line"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN strftime(date, '%Y-%m-%d') WHEN id % 4 = 1 THEN 'about ' || year(date) WHEN id % 4 = 2 THEN (year(date) - 1500) || ' BCE' ELSE CAST(year(date) AS VARCHAR) END AS words FROM happenings")
def date_precision(t: Load):
    text = F.when(F.col("id") % 4 == 0, F.col("date").cast("string")).when(F.col("id") % 4 == 1, F.concat(F.lit("c. "), F.year("date").cast("string"))).otherwise("then")
    year = F.when(F.col("id") % 4 == 2, F.lit(1500) - F.year("date")).otherwise(F.year("date"))
    return t("happenings").select("id", V.date_precision(year, text).alias("words"))


@query("SELECT id, CASE WHEN kind IN ('BUILDING', 'FURNITURE') THEN 'indoors' WHEN kind = 'HOUSEHOLD' THEN 'stay' ELSE 'things' END AS home FROM places")
def assign_home(t: Load):
    return t("places").select("id", F.when(F.col("kind").isin("BUILDING", "FURNITURE"), "indoors").when(F.col("kind") == "HOUSEHOLD", "stay").otherwise("things").alias("home"))


@query("WITH r AS (SELECT l_orderkey AS id, count(DISTINCT s_nationkey) AS n, bool_or(l_suppkey % 5 = 0) AS near, min(l_linenumber) % 3 AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) SELECT id, CASE WHEN m = 0 OR near THEN 'air' WHEN m = 1 THEN 'water' WHEN n > 1 THEN 'between regions' ELSE 'local' END AS section FROM r")
def transport_section(t: Load):
    r = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("s_nationkey").alias("regions"), F.bool_or(F.col("l_suppkey") % 5 == 0).alias("near"), (F.min("l_linenumber") % 3).alias("m"))
    mode = F.when(F.col("m") == 0, "air").when(F.col("m") == 1, "ferry").otherwise("bus")
    return r.select("id", V.transport_section(mode, F.col("regions"), F.col("near")).alias("section"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'not (yet )?(running|open) yet|opens? in|coming soon') THEN 'Not running yet' WHEN regexp_matches(lower(text), 'not running|suspended|discontinued|no service') THEN 'Not running' WHEN contains(lower(text), 'season') THEN 'Seasonal' END AS word FROM documents")
def season_word(t: Load):
    return t("documents").select("doc_id", V.season_word(F.col("text")).alias("word"))


@query("SELECT event_id, TRY_CAST(substr(CAST(event_id AS VARCHAR) || CASE WHEN event_id % 3 = 0 THEN 'x' ELSE '' END, 1, 9) AS BIGINT) AS n, event_id % 3 = 0 AS wrong FROM events")
def coerce_types(t: Load):
    """Wrong-typed values as null, and reported."""
    raw = t("events").select("event_id", F.concat(F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "x").otherwise("")).alias("n"))
    good, wrong = V.coerce_types(raw, {"n": "bigint"})
    return good.join(wrong.select("event_id", F.lit(True).alias("w")), "event_id", "left").select("event_id", "n", F.coalesce("w", F.lit(False)).alias("wrong"))


@query("SELECT p_partkey AS id, CAST(coalesce(list_max([x FOR x IN [400, 800, 1200, 1600] IF x < p_retailprice]), 400) AS INTEGER) AS step FROM part")
def pick_step(t: Load):
    steps = F.array(*map(F.lit, (400, 800, 1200, 1600)))
    return t("part").select(F.col("p_partkey").alias("id"), F.coalesce(F.array_max(F.filter(steps, lambda s: s < F.col("p_retailprice"))), F.lit(400)).alias("step"))


@query("SELECT id, CASE WHEN all_day THEN 'All day' WHEN id % 6 = 0 THEN 'by appointment' ELSE coalesce(start || '-' || coalesce(\"end\", ''), '') END AS words FROM happenings")
def live_words_display(t: Load):
    hours = F.coalesce(F.concat("start", F.lit("-"), F.coalesce("end", F.lit(""))), F.lit(""))
    return t("happenings").select("id", V.live_words_display(F.col("all_day"), F.when(F.col("id") % 6 == 0, "by appointment"), hours).alias("words"))


@query(f"WITH p AS ({_PARTS}) SELECT id, bool_or(featured) AS featured, bool_or(featured) AND NOT bool_and(featured) AS disagreed FROM p GROUP BY id")
def or_flags(t: Load):
    """True if any slice says so; whether the slices disagree."""
    return parts(t).groupBy("id").agg(C.or_flag("featured").alias("featured"), (F.bool_or("featured") & ~F.bool_and("featured")).alias("disagreed"))


@query("SELECT slice, id % 9 AS record, ord FROM (SELECT id, slice, CASE WHEN slice = 'alpha' THEN 0 WHEN slice = 'beta' THEN 1 ELSE 2 END AS ord FROM (" + _PARTS + "))")
def owner_rank(t: Load):
    """The place of each part's slice in the precedence."""
    return parts(t).select("slice", (F.col("id") % 9).alias("record"), F.col("owner").cast("int").alias("ord"))


@query("SELECT id, CAST(row_number() OVER (PARTITION BY area ORDER BY kind, score DESC, lower(name), id) AS INTEGER) AS n FROM places")
def multi_key_sort(t: Load):
    return t("places").select("id", F.row_number().over(Window.partitionBy("area").orderBy("kind", F.desc("score"), F.lower("name"), "id")).alias("n"))


@query("SELECT p.id AS id, CAST(row_number() OVER (PARTITION BY area ORDER BY CASE WHEN score < 0 THEN 1 ELSE 0 END, (p.id % 8 <> 0)::INT, coalesce(list_position(['BUILDING', 'MACHINERY', 'AUTOMOBILE', 'FURNITURE'], kind), 99), coalesce(n, 0) DESC, lower(name), p.id) AS INTEGER) AS n FROM places p LEFT JOIN (SELECT place, count(*) AS n FROM happenings GROUP BY 1) e ON p.id = e.place")
def rank_places(t: Load):
    """Open ones first, then signature ones, by priority of kinds, references and name."""
    e = t("happenings").groupBy(F.col("place").alias("id")).agg(F.count("*").alias("refs"))
    w = Window.partitionBy("area").orderBy(F.when(F.col("score") < 0, 1).otherwise(0), (F.col("id") % 8 != 0).cast("int"), R.vocab_order(F.col("kind"), ["BUILDING", "MACHINERY", "AUTOMOBILE", "FURNITURE"]), F.desc(F.coalesce("refs", F.lit(0))), F.lower("name"), "id")
    return t("places").join(e, "id", "left").select("id", F.row_number().over(w).alias("n"))


@query("SELECT p_partkey AS id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY regexp_replace(lower(p_name), '^the\\s+', ''), p_partkey) AS INTEGER) AS n FROM part")
def name_sort(t: Load):
    return t("part").select(F.col("p_partkey").alias("id"), F.row_number().over(Window.partitionBy("p_brand").orderBy(R.name_sort_key(F.col("p_name")), "p_partkey")).alias("n"))


@query("SELECT id, CAST(row_number() OVER (PARTITION BY date ORDER BY (start IS NOT NULL)::INT, start NULLS FIRST, id) AS INTEGER) AS n FROM happenings")
def untimed_first(t: Load):
    return t("happenings").select("id", F.row_number().over(Window.partitionBy("date").orderBy(F.col("start").isNotNull().cast("int"), F.col("start").asc_nulls_first(), "id")).alias("n"))


@query("SELECT id, CAST(row_number() OVER (PARTITION BY place ORDER BY list_position(['scheduled', 'tentative', 'cancelled'], status), CASE WHEN id % 3 = 0 THEN 9999 ELSE year(date) END, id) AS INTEGER) AS n FROM happenings")
def heritage_order(t: Load):
    """By era, first year (unknown last), name."""
    era = R.vocab_order(F.col("status"), ["scheduled", "tentative", "cancelled"])
    return t("happenings").select("id", F.row_number().over(Window.partitionBy("place").orderBy(era, F.when(F.col("id") % 3 == 0, 9999).otherwise(F.year("date")), "id")).alias("n"))


_SETS = "WITH a AS (SELECT DISTINCT user_id, event_id % 30 AS id FROM events WHERE event_type = 'view'), b AS (SELECT DISTINCT user_id, event_id % 30 AS id FROM events WHERE event_type = 'click') "


def _sets(t: Load):
    one = lambda kind: t("events").where(F.col("event_type") == kind).select("user_id", (F.col("event_id") % 30).alias("id")).distinct()
    return one("view"), one("click")


@query(_SETS + "SELECT * FROM b EXCEPT SELECT * FROM a")
def saved_missing(t: Load):
    a, b = _sets(t)
    return b.join(a, ["user_id", "id"], "left_anti")


@query(_SETS + "SELECT * FROM b INTERSECT SELECT * FROM a")
def saved_intersection(t: Load):
    a, b = _sets(t)
    return b.join(a, ["user_id", "id"], "left_semi")


@query(_SETS + "SELECT coalesce(x.user_id, y.user_id) AS user_id, coalesce(x.s = y.s, false) AS same FROM (SELECT user_id, list_sort(list(id)) AS s FROM a GROUP BY 1) x FULL JOIN (SELECT user_id, list_sort(list(id)) AS s FROM b GROUP BY 1) y ON x.user_id = y.user_id")
def saved_same(t: Load):
    x, y = (s.groupBy("user_id").agg(F.array_sort(F.collect_set("id")).alias(n)) for s, n in zip(_sets(t), "xy", strict=True))
    return x.join(y, "user_id", "full").select("user_id", F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("same"))


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Room ' || (c_custkey % 20) WHEN 1 THEN NULL ELSE 'Other Hall' END AS room FROM customer")
def room_text(t: Load):
    """What a room's label says beyond its venue's name."""
    label = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(", Room "), (F.col("c_custkey") % 20).cast("string"))).when(F.col("c_custkey") % 3 == 1, F.col("c_name")).otherwise("Other Hall")
    plain = F.replace("c_name", F.lit("#"), F.lit(" "))
    return t("customer").select(F.col("c_custkey").alias("id"), V.room_text(F.replace(label, F.lit("#"), F.lit(" ")), plain).alias("room"))


@query("""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, strip_accents(lower(text)) AS n FROM documents WHERE length(strip_accents(lower(text))) = length(text)),
p AS (SELECT doc_id, r, generate_subscripts(parts, 1) AS i, unnest(parts) AS part, unnest(list_append(regexp_extract_all(n, 'there|the|on'), NULL)) AS hit FROM (SELECT *, regexp_split_to_array(n, 'there|the|on') AS parts FROM d)),
s AS (SELECT doc_id, hit, sum(length(part) + coalesce(length(hit), 0)) OVER (PARTITION BY r ORDER BY i) AS done FROM p)
SELECT doc_id, (done - length(hit) + 1)::BIGINT AS start, length(hit)::INTEGER AS length FROM s WHERE hit IS NOT NULL
""")
def mark_spans(t: Load):
    """All places of some terms in each whole text."""
    return Q.mark_spans(t("documents"), ["on", "the", "there", "e"]).select("doc_id", "start", "length")


@query("SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) AS number, TRY_CAST(nullif(regexp_extract(url, 'page=([0-9]+)', 1), '') AS INTEGER) AS page FROM pages")
def parse_normals(t: Load):
    """Numbers out of text, null where there is none."""
    return t("pages").select("page_id", F.expr("try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') as bigint)").alias("number"), F.expr("try_cast(nullif(regexp_extract(url, 'page=([0-9]+)', 1), '') as int)").alias("page"))


@query("SELECT id, CAST(dayofyear(make_date(2023, month(date), least(day(date), 28))) AS INTEGER) AS day FROM happenings")
def day_of_year(t: Load):
    """Day of a fixed year that is no leap year."""
    return t("happenings").select("id", F.dayofyear(F.make_date(F.lit(2023), F.month("date"), F.least(F.dayofmonth("date"), F.lit(28)))).alias("day"))


@query("WITH x AS (SELECT id, date, 2023 + id % 2 AS y FROM happenings) SELECT id, strftime(date, '%A') <> strftime(make_date(CAST(y AS BIGINT), month(date), least(day(date), 28)), '%A') AS wrong FROM x")
def weekday_mismatch(t: Load):
    """Whether a text's weekday is not the calendar's (texts made of dates)."""
    day = F.make_date((F.col("id") % 2 + 2023).cast("int"), F.month("date"), F.least(F.dayofmonth("date"), F.lit(28)))
    text = F.concat(F.lit("On "), F.date_format("date", "EEEE"), F.lit(", "), F.date_format(day, "MMMM d"), F.lit(" at noon"))
    return t("happenings").select("id", (F.size(V.weekday_mismatch(text, F.col("id") % 2 + 2023)) > 0).alias("wrong"))


@query("""
WITH w AS (SELECT DISTINCT date, CAST(date AS TIMESTAMP) + INTERVAL 720 MINUTE AS wall FROM happenings)
SELECT date, strftime(timezone('UTC', timezone('America/New_York', wall)), '%Y-%m-%d %H:%M') AS noon FROM w
""")
def ny_to_instant(t: Load):
    return t("happenings").select("date").distinct().select("date", F.date_format(D.to_instant(F.col("date"), F.lit("12:00")), "yyyy-MM-dd HH:mm").alias("noon"))


@query("SELECT id, CAST(date_diff('day', date, end_date) AS INTEGER) AS days, CAST(date + 45 AS DATE) AS later, len(generate_series(date, end_date, INTERVAL 1 DAY)) AS n, strftime(date, '%Y-%m') AS month FROM happenings")
def date_range(t: Load):
    """Days between, days added, the range's length and the month key."""
    return t("happenings").select("id", F.datediff("end_date", "date").alias("days"), F.date_add("date", 45).alias("later"), F.size(F.sequence("date", "end_date")).cast("bigint").alias("n"), F.date_format("date", "yyyy-MM").alias("month"))


@query("SELECT id, CASE WHEN date = DATE '1997-06-15' THEN 'Today' WHEN date < DATE '1997-06-15' THEN '' WHEN date = DATE '1997-06-16' THEN 'Tomorrow' ELSE '' END AS word FROM happenings")
def day_words(t: Load):
    return t("happenings").select("id", D.date_word(F.col("date"), F.lit("1997-06-15").cast("date")).alias("word"))


@query("""
WITH e AS (SELECT event_id, date_diff('second', TIMESTAMP '2024-01-15 12:00:00', ts) AS d FROM events), m AS (SELECT event_id, d, CAST(greatest(1, floor(abs(d) / 60.0 + 0.5)) AS BIGINT) AS m FROM e)
SELECT event_id, CASE WHEN d > 0 THEN 'in ' || CASE WHEN m < 60 THEN m || ' min' ELSE (m // 60) || ' h' || CASE WHEN m % 60 > 0 THEN ' ' || (m % 60) || ' min' ELSE '' END END
  WHEN d > -3600 THEN 'Started ' || CASE WHEN m < 60 THEN m || ' min' ELSE (m // 60) || ' h' END || ' ago' ELSE 'Ended' END AS words FROM m
""")
def relative_time(t: Load):
    s = F.date_trunc("second", F.col("ts").cast("timestamp"))
    return t("events").select("event_id", D.relative_time(s, s + F.expr("INTERVAL 1 HOUR"), F.lit("2024-01-15 12:00:00").cast("timestamp"), F.lit(False)).alias("words"))


@query("SELECT lower(p_name) AS key, count(DISTINCT p_partkey) AS n, 'several records' AS problem FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def check_aliases(t: Load):
    """Alias keys that lead to several records."""
    return t("part").groupBy(F.lower("p_name").alias("key")).agg(F.countDistinct("p_partkey").alias("n")).where("n > 1").select("key", "n", F.lit("several records").alias("problem"))


@query("SELECT doc_id, problem FROM (SELECT doc_id, CASE WHEN quality NOT IN (0, 1) THEN 'bad quality' WHEN toxic = 1 THEN 'toxic' WHEN doc_id NOT IN (SELECT doc_id FROM documents) THEN 'unknown document' END AS problem FROM labels) WHERE problem IS NOT NULL")
def check_manifest(t: Load):
    """A manifest's entries: values in range, known targets."""
    known = t("documents").select("doc_id", F.lit(True).alias("known"))
    j = t("labels").join(known, "doc_id", "left")
    return j.select("doc_id", F.when(~F.col("quality").isin(0, 1), "bad quality").when(F.col("toxic") == 1, "toxic").when(F.col("known").isNull(), "unknown document").alias("problem")).where("problem is not null")


@query("SELECT kind, id, CASE WHEN trim(title) = '' THEN 'no title' WHEN keywords IS NULL THEN 'no keywords' ELSE 'one word' END AS problem FROM (SELECT 'part' AS kind, p_partkey AS id, p_name AS title, p_brand AS keywords FROM part UNION ALL SELECT 'document', doc_id, array_to_string(list_slice(string_split(replace(text, chr(10), ' '), ' '), 1, 5), ' '), lang FROM documents) WHERE trim(title) = '' OR keywords IS NULL OR NOT contains(trim(title), ' ')")
def check_index(t: Load):
    """Search entries without a title or keywords, or with a title of one word."""
    p = F.when(F.trim("title") == "", "no title").when(F.col("keywords").isNull(), "no keywords").when(~F.contains(F.trim("title"), F.lit(" ")), "one word")
    return entries(t).select("kind", "id", p.alias("problem")).where("problem is not null")


@query("SELECT kind, id, strip_accents(lower(title)) AS n_title, len(list_filter(string_split_regex(strip_accents(lower(title)), '[^\\p{L}\\p{N}'']+'), lambda w: w <> '')) AS words FROM (SELECT 'part' AS kind, p_partkey AS id, p_name AS title FROM part UNION ALL SELECT 'document', doc_id, array_to_string(list_slice(string_split(replace(text, chr(10), ' '), ' '), 1, 5), ' ') FROM documents)")
def prepare_index(t: Load):
    return Q.prepare_index(entries(t)).select("kind", "id", "n_title", F.size("words").cast("bigint").alias("words"))


@query("""
WITH p AS (SELECT l_orderkey AS id, l_linenumber AS owner, l_partkey, l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS built, l_linestatus AS d FROM lineitem)
SELECT id, arg_min(built, (owner, built)) FILTER (built IS NOT NULL) AS built, string_agg(DISTINCT d, ',' ORDER BY d) AS designations FROM p GROUP BY id
""")
def merge_heritage(t: Load):
    """A nested block: its scalars by precedence, its lists united."""
    p = t("lineitem").selectExpr("l_orderkey as id", "l_linenumber as owner", "case when l_linenumber % 2 = 0 then l_returnflag end as built", "l_linestatus as d")
    return p.groupBy("id").agg(F.min(F.when(F.col("built").isNotNull(), F.struct("owner", "built")))["built"].alias("built"), F.array_join(F.array_sort(F.collect_set("d")), ",").alias("designations"))


@query("SELECT l_orderkey AS id, l_returnflag AS name, l_linestatus AS ref, count(*) AS n, min(l_shipdate) AS first FROM lineitem GROUP BY ALL")
def merge_designations(t: Load):
    """Nested entries, one a (name, ref) of a record, with the earliest date."""
    return t("lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("ref")).agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first"))


@query("WITH d AS (SELECT max(p_partkey) AS gone, min(p_partkey) AS keep FROM part GROUP BY p_name HAVING count(*) > 1) SELECT l_orderkey AS id, l_linenumber AS line, l_suppkey AS supplier, coalesce(keep, l_partkey) AS part FROM lineitem LEFT JOIN d ON l_partkey = gone")
def apply_reviewed_merges(t: Load):
    """References to merged records lead to the kept ones."""
    from almanac.operators.references import remap_refs

    d = t("part").groupBy("p_name").agg(F.max("p_partkey").alias("old"), F.min("p_partkey").alias("new")).where("old > new").select("old", "new")
    rows = t("lineitem").selectExpr("l_orderkey as id", "l_linenumber as line", "l_suppkey as supplier", "l_partkey as part")
    return remap_refs(rows, "part", d)


@query("SELECT p_partkey AS id, array_to_string(CASE WHEN p_partkey % 2 = 0 THEN [x FOR x IN string_split(p_name, ' ') IF x <> 'red' AND x <> 'hot'] ELSE string_split(p_name, ' ') END, ',') AS aliases FROM part")
def drop_reviewed_aliases(t: Load):
    p = t("part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("aliases"))
    drops = t("part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.explode(F.array(F.lit("red"), F.lit("hot"))).alias("key"))
    return V.drop_reviewed_aliases(p, "aliases", drops).select("id", F.array_join("aliases", ",").alias("aliases"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 'manual' WHEN id % 4 = 1 THEN 'osm' WHEN id % 4 = 2 THEN 'census' END AS source, id % 4 = 3 AS dropped FROM places")
def infer_geo_source(t: Load):
    notes = F.when(F.col("id") % 4 == 1, "from OpenStreetMap").when(F.col("id") % 4 == 2, "Census match").otherwise("seen")
    g = t("places").select("id", V.infer_geo_source(F.when(F.col("id") % 4 == 0, "manual"), notes, F.col("lat")).alias("g"))
    return g.select("id", "g.source", F.col("g.lat").isNull().alias("dropped"))


@query("WITH n AS (SELECT DISTINCT lower(p_name || ' ' || p_brand) AS key FROM part WHERE p_size > 25), a AS (SELECT lower(p_name || ' ' || p_brand) AS key, min(p_partkey) AS id FROM part WHERE p_size <= 25 GROUP BY 1) SELECT key, id FROM a WHERE key NOT IN (SELECT key FROM n)")
def alias_table_out(t: Load):
    """Resolved texts that no record's own name covers."""
    k = F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("key")
    return t("part").where("p_size <= 25").groupBy(k).agg(F.min("p_partkey").alias("id")).join(t("part").where("p_size > 25").select(k).distinct(), "key", "left_anti")


@query("SELECT 'merged' AS what, count(DISTINCT c_custkey) AS n FROM customer UNION ALL SELECT 'parts', 3 * count(*) FROM customer UNION ALL SELECT 'parts a record', 3 FROM (SELECT count(*) FROM customer)")
def quality_report(t: Load):
    """Counts of a merge, written beside the data."""
    p = parts(t).agg(F.countDistinct("id").alias("a"), F.count("*").alias("b")).withColumn("c", (F.col("b") / F.col("a")).cast("bigint"))
    return p.selectExpr("stack(3, 'merged', a, 'parts', b, 'parts a record', c) as (what, n)")


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) FILTER (ts <= d AND d < ts + INTERVAL 1 HOUR) AS live, count(*) FILTER (ts > d) AS to_come FROM (SELECT ts, date_trunc('day', ts) + INTERVAL 12 HOUR AS d FROM events) GROUP BY 1")
def live_board(t: Load):
    """Live and coming events of each day at noon (the batch form of the stream's count)."""
    e = t("events").select(F.col("ts").cast("timestamp").alias("s"), F.to_date("ts").alias("day"))
    now = F.col("day").cast("timestamp") + F.expr("INTERVAL 12 HOURS")
    return e.groupBy("day").agg(F.count_if((F.col("s") <= now) & (now < F.col("s") + F.expr("INTERVAL 1 HOUR"))).alias("live"), F.count_if(F.col("s") > now).alias("to_come"))


@query("""
WITH e AS (SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS s, CAST(ts AS TIMESTAMP) + INTERVAL 1 HOUR AS e, event_type = 'error' AS no_end FROM events),
c AS (SELECT id, TIMESTAMP '1900-01-01 00:00:00' AS at, 'upcoming' AS state FROM e UNION ALL SELECT id, s - INTERVAL 30 MINUTE, 'soon' FROM e
  UNION ALL SELECT id, s, CASE WHEN no_end THEN 'started' ELSE 'live' END FROM e
  UNION ALL SELECT id, CASE WHEN no_end THEN greatest(e, date_trunc('day', s - INTERVAL 5 HOUR) + INTERVAL 29 HOUR) ELSE e END, 'past' FROM e)
SELECT id, "at", state FROM c
""")
def board_changes(t: Load):
    """Every change of the events' live state (the plan that the running board follows with timers); winter, so New York is five hours behind."""
    e = t("events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("s"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("e"), (F.col("event_type") == "error").alias("end_unknown"))
    flags = {c: F.lit(False) for c in ("run", "time_unknown", "all_day", "cancelled")}
    return jobs.state_changes(e.withColumns(flags)).select("id", F.explode("changes").alias("c")).select("id", "c.at", "c.state")


@query("SELECT doc_id, CAST(regexp_matches(text, '(?i)\\b(about|approx\\.|approximately|approx|around|roughly|estimated|estimate|probably|likely|call for|or so|guessed|guess)\\b|~') AS BOOLEAN) AS guess, regexp_matches(text, '(?i)\\b(tbd|tba|todo|lorem ipsum|n/a|xxx)\\b') AS placeholder, regexp_matches(text, '<[a-zA-Z/!][^>]*>|&[a-z]+;|&#\\d+;') AS markup FROM documents")
def text_quality(t: Load):
    """Guess words, placeholders and markup in texts."""
    c = F.col("text")
    return t("documents").select("doc_id", T.guess_words(c).alias("guess"), T.placeholder(c).alias("placeholder"), T.html_in_text(c).alias("markup"))


@query("SELECT page_id, lower(regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '')) || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') || CASE WHEN contains(url, '?') THEN '?' || regexp_extract(url, '\\?([^#]*)', 1) ELSE '' END AS key FROM pages")
def page_key(t: Load):
    return t("pages").select("page_id", T.page_key(F.col("url")).alias("key"))


@query("SELECT id, CAST(row_number() OVER (PARTITION BY kind ORDER BY {0}, id) AS INTEGER) AS n FROM (SELECT id, kind, lat, lng FROM places) b, (SELECT 27.5::DOUBLE AS lat, -82.0::DOUBLE AS lng) a".format(METRES.format(a="a", b="b").join(["round(", ")"])).replace("b.id", "id"))
def haversine(t: Load):
    """Places of each kind by rounded distance from a point."""
    d = F.round(G.haversine(F.lit(27.5), F.lit(-82.0), F.col("lat"), F.col("lng")))
    return t("places").select("id", F.row_number().over(Window.partitionBy("kind").orderBy(d, "id")).alias("n"))


@query("SELECT user_id AS user, CAST(event_id AS VARCHAR) AS item, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS INTEGER) AS n FROM events")
def saved_order(t: Load):
    """Users' items numbered by when they were saved."""
    return jobs.saved_order(t("events").select(F.col("user_id").alias("user"), F.col("event_id").cast("string").alias("item"), "ts")).select("user", "item", "n")
