"""Queries on data quality and raw pages, and the batch forms of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators import checks as K
from almanac.operators import pages as P
from almanac.plans.registry import Load, query
from almanac.streaming import jobs

_HREFS = "SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)) AS href FROM pages"


@query(f"SELECT href, count(*) AS n, min(page_id) AS first FROM ({_HREFS}) GROUP BY href")
def links(t: Load):
    """All links of all pages, by target."""
    return P.links(t("pages")).groupBy("href").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


@query(f"WITH h AS ({_HREFS}) SELECT page_id, href, 'no such page' AS problem FROM h WHERE page_id % 2 = 1 AND href NOT IN (SELECT href FROM h WHERE page_id % 2 = 0)")
def link_check(t: Load):
    """Links of odd pages to targets that even pages do not use."""
    found = P.links(t("pages")).withColumn("path", P.resolve(F.col("href"), F.lit("/"))).withColumn("anchor", F.lit(None).cast("string"))
    return P.link_check(found.where("page_id % 2 = 1"), found.where("page_id % 2 = 0"))


@query("""
SELECT page_id, 'no description' AS problem FROM pages WHERE NOT regexp_matches(html, '<meta\\s[^>]*name\\s*=\\s*["'']description')
UNION ALL SELECT page_id, 'no canonical' FROM pages WHERE NOT regexp_matches(html, '<link\\s[^>]*rel\\s*=\\s*["'']canonical')
UNION ALL SELECT page_id, 'not exactly one h1' FROM pages WHERE len(regexp_extract_all(html, '<h1[\\s>]')) <> 1
UNION ALL SELECT page_id, 'no title' FROM pages WHERE NOT regexp_matches(html, '<title[^>]*>\\s*\\S')
UNION ALL SELECT page_id, 'insecure link' FROM pages WHERE regexp_matches(html, '\\b(href|src)\\s*=\\s*["'']http://')
""")
def page_audit(t: Load):
    """Structure rules that each page breaks."""
    return P.page_audit(t("pages"))


@query("SELECT page_id, octet_length(encode(html)) AS raw, octet_length(encode(html)) > 10000 AS over FROM pages")
def raw_size(t: Load):
    """Bytes of each page, and whether they are over a budget (``size_budget`` has the compressed ones too)."""
    raw = F.octet_length("html").cast("bigint")
    return t("pages").select("page_id", raw.alias("raw"), (raw > 10_000).alias("over"))


@query()
def size_budget(t: Load):
    """Raw and gzip bytes of each page against a budget."""
    return P.size_budget(t("pages"), 10_000, 4_000)


@query("SELECT page_id FROM pages WHERE page_id % 5 <> 0 AND NOT regexp_matches(url, '(spam|cheap)')")
def page_list_export(t: Load):
    """Pages to be listed in the site map."""
    return t("pages").where(~F.col("url").rlike("(spam|cheap)") & (F.col("page_id") % 5 != 0)).select("page_id")


SPEC = {"text": {"req": True, "text": True, "max": 5000}, "lang": {"req": True, "enum": ["en", "fr", "de"]}, "source": {"req": True, "kind": "id"}}


@query("""
SELECT 'documents' AS collection, CAST(doc_id AS VARCHAR) AS record_id, field, level, message FROM (
  SELECT doc_id, 'text' AS field, 'error' AS level, 'blank' AS message FROM documents WHERE trim(text) = ''
  UNION ALL SELECT doc_id, 'text', 'warning', 'white space at an edge' FROM documents WHERE text <> trim(text)
  UNION ALL SELECT doc_id, 'text', 'warning', 'placeholder' FROM documents WHERE regexp_matches(text, '(?i)\\b(tbd|tba|todo|lorem ipsum|n/a|xxx)\\b')
  UNION ALL SELECT doc_id, 'text', 'error', 'HTML in text' FROM documents WHERE regexp_matches(text, '<[a-zA-Z/!][^>]*>|&[a-z]+;|&#\\d+;')
  UNION ALL SELECT doc_id, 'text', 'warning', 'too long' FROM documents WHERE length(text) > 5000
  UNION ALL SELECT doc_id, 'lang', 'error', 'not in the vocabulary' FROM documents WHERE lang NOT IN ('en', 'fr', 'de')
  UNION ALL SELECT doc_id, 'source', 'error', 'not a id' FROM documents WHERE NOT regexp_matches(source, '^[a-z0-9][a-z0-9-]*$'))
""")
def check_spec(t: Load):
    """Findings of a declared spec on documents."""
    return K.check_spec(t("documents"), "documents", "doc_id", SPEC)


@query("""
SELECT CAST(id AS VARCHAR) AS record_id, message FROM (
  SELECT id, 'end before start' AS message FROM happenings WHERE "end" < start AND "end" > '06:00'
  UNION ALL SELECT id, 'all day with times' FROM happenings WHERE all_day AND start IS NOT NULL
  UNION ALL SELECT id, 'end without start' FROM happenings WHERE "end" IS NOT NULL AND start IS NULL
  UNION ALL SELECT id, 'outside the window' FROM happenings WHERE end_date > DATE '1998-06-30')
""")
def check_record_rules(t: Load):
    """Cross-field rules of dated records."""
    c = F.col
    rules = [
        ((c("end") < c("start")) & (c("end") > "06:00"), "error", "end before start", "end"),
        (c("all_day") & c("start").isNotNull(), "error", "all day with times", "start"),
        (c("end").isNotNull() & c("start").isNull(), "error", "end without start", "end"),
        (c("end_date") > F.lit("1998-06-30").cast("date"), "warning", "outside the window", "end_date"),
    ]
    return K.findings(t("happenings"), "events", "id", rules).select("record_id", "message")


@query("SELECT l_orderkey || '-' || l_linenumber AS record_id, 'used ' || count(*) || ' times' AS message FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def check_unique(t: Load):
    return K.check_unique(t("lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber")), "lines", "key").select("record_id", "message")


@query("SELECT l_orderkey AS id, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate - INTERVAL 2000 DAY OR l_shipdate > o_orderdate + INTERVAL 2000 DAY")
def check_window(t: Load):
    """Occurrences outside their event's span."""
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    wide = F.expr("INTERVAL 2000 DAYS")
    return j.where((F.col("l_shipdate") < F.col("o_orderdate") - wide) | (F.col("l_shipdate") > F.col("o_orderdate") + wide)).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"))


@query("SELECT event_id, unnest(json_keys(props)) AS key FROM events")
def unknown_keys(t: Load):
    """Keys of JSON objects that the schema does not know (none is known here)."""
    return K.unknown_keys(t("events"), "props", "event_id", [])


@query("""
WITH f AS (SELECT DISTINCT p_type AS value, p_brand AS family FROM part WHERE p_size < 6), v AS (SELECT DISTINCT p_type AS value FROM part WHERE p_size > 3),
n AS (SELECT value, count(DISTINCT family) AS n FROM f GROUP BY value)
SELECT value, 'in no family' AS problem FROM v WHERE value NOT IN (SELECT value FROM n) UNION ALL SELECT value, 'in several families' FROM n WHERE n > 1 UNION ALL SELECT value, 'unknown value' FROM n WHERE value NOT IN (SELECT value FROM v)
""")
def check_partition(t: Load):
    f = t("part").where("p_size < 6").select(F.col("p_type").alias("value"), F.col("p_brand").alias("family"))
    return K.check_partition(f, t("part").where("p_size > 3").select(F.col("p_type").alias("value")).distinct())


@query("SELECT source, count(*) AS n, count(*) FILTER (length(text) < 200) AS thin, count(*) FILTER (lang IS NULL) AS no_lang FROM documents GROUP BY source")
def slice_audit(t: Load):
    """Thin records and gaps of each slice."""
    return t("documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.length("text") < 200).alias("thin"), F.count_if(F.col("lang").isNull()).alias("no_lang"))


@query("""
SELECT id, flag FROM (SELECT id, 'far' AS flag FROM places WHERE abs(lat - 28) > 0.9 UNION ALL SELECT id, 'no summary' FROM places WHERE id % 9 = 0 UNION ALL SELECT id, 'free but priced' FROM places WHERE id % 4 = 0 AND score > 5000)
""")
def qa_flags(t: Load):
    c = F.col
    rules = [(F.abs(c("lat") - 28) > 0.9, "warning", "far", "lat"), (c("id") % 9 == 0, "warning", "no summary", "summary"), ((c("id") % 4 == 0) & (c("score") > 5000), "warning", "free but priced", "price")]
    return K.findings(t("places"), "places", "id", rules).select(c("record_id").cast("bigint").alias("id"), c("message").alias("flag"))


@query("SELECT CASE WHEN start IS NULL AND \"end\" IS NOT NULL THEN 'error' ELSE 'warning' END AS level, count(*) AS n FROM happenings WHERE start IS NULL OR \"end\" IS NULL GROUP BY 1")
def severity_gate(t: Load):
    """Findings by level."""
    c = F.col
    found = K.findings(t("happenings"), "events", "id", [(c("start").isNull() & c("end").isNotNull(), "error", "end without start", "end"), (c("end").isNull(), "warning", "no end", "end")])
    return K.severity_gate(found).groupBy("level").agg(F.sum("n").alias("n"))


@query(r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS lede FROM documents), c AS (SELECT doc_id, substr(text, length(lede) + 2) AS cited, unnest(list_distinct(list_transform(regexp_extract_all(lede, '\b[0-9][0-9,.]*\b'), lambda x: rtrim(x, '.')))) AS claim FROM l)
SELECT doc_id, count(*) AS unbacked FROM c WHERE NOT contains(cited, claim) AND NOT contains(cited, replace(claim, ',', '')) GROUP BY doc_id
""")
def route_claims_check(t: Load):
    """Numbers of a text's first line, with or without their commas, that the rest of it (the record it speaks of) does not hold."""
    lede = F.split("text", "\n")[0]
    claims = F.array_distinct(F.transform(F.regexp_extract_all(lede, F.lit(r"\b[0-9][0-9,.]*\b"), F.lit(0)), lambda x: F.rtrim(x, F.lit("."))))
    d = t("documents").select("doc_id", claims.alias("claims"), F.substr("text", F.length(lede) + 2).alias("cited"))
    held = lambda x: F.contains("cited", x) | F.contains("cited", F.replace(x, F.lit(","), F.lit("")))
    return d.select("doc_id", F.size(F.filter("claims", lambda x: ~held(x))).cast("bigint").alias("unbacked")).where("unbacked > 0")


@query("SELECT p_partkey AS id, '{\"@type\":\"Product\",\"name\":\"' || p_name || '\",\"brand\":\"' || p_brand || '\"' || CASE WHEN p_size > 25 THEN ',\"size\":' || p_size ELSE '' END || '}' AS json FROM part")
def export_jsonld(t: Load):
    """Records as JSON; null fields are left out."""
    return t("part").select(F.col("p_partkey").alias("id"), F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"))).alias("json"))


@query("SELECT o_orderkey AS id, count(*) AS n, string_agg(l_partkey || 'x' || CAST(l_quantity AS BIGINT), ';' ORDER BY l_partkey || 'x' || CAST(l_quantity AS BIGINT)) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def export_lean(t: Load):
    """Records with their nested rows in one lean output."""
    item = F.concat(F.col("l_partkey").cast("string"), F.lit("x"), F.col("l_quantity").cast("bigint").cast("string"))
    return t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(item)), ";").alias("lines"))


_ACTIONS = "SELECT user_id AS \"user\", CAST(event_id % 12 AS VARCHAR) AS item, CASE event_type WHEN 'click' THEN 'toggle' WHEN 'view' THEN 'add' WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'clear' ELSE 'replace' END AS action, ts, event_id AS seq FROM events"


@query(f"""
WITH a AS ({_ACTIONS}), w AS (SELECT "user", max((ts, seq)) AS wiped FROM a WHERE action IN ('clear', 'replace') GROUP BY "user"),
r AS (SELECT a.*, (ts, seq) AS pos FROM a LEFT JOIN w ON a."user" = w."user" WHERE action <> 'clear' AND (wiped IS NULL OR (ts, seq) >= wiped)),
s AS (SELECT "user", item, max(pos) FILTER (action <> 'toggle') AS set_at, arg_max(action, pos) FILTER (action <> 'toggle') AS act FROM r GROUP BY ALL),
g AS (SELECT r."user", r.item, count(*) AS n FROM r JOIN s ON r."user" = s."user" AND r.item = s.item WHERE action = 'toggle' AND (set_at IS NULL OR pos > set_at) GROUP BY ALL)
SELECT s."user" AS "user", s.item AS item FROM s LEFT JOIN g ON s."user" = g."user" AND s.item = g.item WHERE (coalesce(act IN ('add', 'replace'), false)::INT + coalesce(n, 0)) % 2 = 1
""")
def saved_set_state(t: Load):
    """Every user's saved set after all actions (the batch form of the stream)."""
    a = t("events").selectExpr("user_id as user", "cast(event_id % 12 as string) as item", "case event_type when 'click' then 'toggle' when 'view' then 'add' when 'error' then 'remove' when 'signup' then 'clear' else 'replace' end as action", "ts", "event_id as seq")
    return jobs.saved_set_batch(a)


@query("SELECT CAST(user_id % 40 AS VARCHAR) AS key, arg_max(CAST(event_id AS VARCHAR), (ts, event_id)) AS value FROM events GROUP BY 1")
def log_compaction(t: Load):
    """The latest value of each key (the batch form of the stream)."""
    return jobs.log_compaction_batch(t("events").selectExpr("cast(user_id % 40 as string) as key", "cast(event_id as string) as value", "ts", "event_id"), "key", "value", ["ts", "event_id"])
