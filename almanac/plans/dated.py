"""Queries on dates, instances and calendars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from almanac.functions import dates as D
from almanac.operators import schedule as S
from almanac.plans.registry import Load, query

NOW = "1997-06-15 16:00:00"  # 12:00 in New York
TODAY = "1997-06-15"


def instances(t: Load):
    return S.expand_instances(t("happenings"))


@query("""
SELECT n_regionkey AS region, date AS day, count(DISTINCT i.id) AS events
FROM (SELECT o.id, o.date, happenings.place FROM occurrences o JOIN happenings ON o.id = happenings.id WHERE status <> 'cancelled') i
JOIN customer ON i.place = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE date BETWEEN DATE '1997-06-01' AND DATE '1997-06-30' GROUP BY ALL
""")
def distinct_live_per_day(t: Load):
    """Distinct live events by region and day of a month (occurrences, area to region)."""
    days = S.expand_instances(t("happenings").where("status <> 'cancelled'"), "1997-06-01", "1997-06-30", occurrences=t("occurrences"))
    area = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("place"), F.col("n_regionkey").alias("region"))
    return days.join(t("occurrences"), ["id", "date"], "left_semi").join(area, "place").groupBy("region", F.col("date").alias("day")).agg(F.countDistinct("id").alias("events"))


@query("""
SELECT id, date, CASE WHEN run OR all_day OR start IS NULL OR start >= '05:00' THEN date ELSE date - 1 END AS day, run,
  CASE WHEN run THEN end_date END AS through,
  -- of a wall time that comes twice, the first
  strftime(timezone('UTC', CASE WHEN timezone('America/New_York', x - INTERVAL 1 HOUR) = wall THEN x - INTERVAL 1 HOUR ELSE x END), '%Y-%m-%d %H:%M') AS s,
  NOT all_day AND start IS NULL AS time_unknown, NOT all_day AND start IS NOT NULL AND NOT run AND "end" IS NULL AS end_unknown
FROM (SELECT *, timezone('America/New_York', wall) AS x FROM (SELECT *, CAST(date AS TIMESTAMP) + CASE WHEN all_day OR start IS NULL THEN INTERVAL 0 MINUTE ELSE to_minutes(CAST(left(start, 2) AS INTEGER) * 60 + CAST(right(start, 2) AS INTEGER)) END AS wall FROM instances))
""")
def expand_instances(t: Load):
    """Every event's instances."""
    return instances(t).select("id", "date", "day", "run", "through", F.date_format("s", "yyyy-MM-dd HH:mm").alias("s"), "time_unknown", "end_unknown")


@query("SELECT id, CASE WHEN start IS NULL THEN 'allday' WHEN start < '05:00' THEN 'late' WHEN start < '12:00' THEN 'morning' WHEN start < '17:00' THEN 'afternoon' WHEN start < '21:00' THEN 'evening' ELSE 'late' END AS bucket, CASE WHEN start < '05:00' THEN date - 1 ELSE date END AS day FROM happenings")
def time_bucket(t: Load):
    return t("happenings").select("id", D.time_bucket(F.col("start")).alias("bucket"), D.listing_day(F.col("date"), F.col("start")).alias("day"))


@query("""
SELECT date, CAST(dayofweek(date) AS BIGINT) AS weekday, dayofweek(date) IN (0, 6) AS weekend, strftime(date, '%Y-%m') AS month_key,
  strftime(date, '%a, %b ') || day(date) AS label, strftime(date, '%B %Y') AS month,
  CASE WHEN dayofweek(date) IN (0, 5, 6) THEN date ELSE CAST(date + CAST(5 - dayofweek(date) AS INTEGER) AS DATE) END AS weekend_first,
  CASE WHEN dayofweek(date) = 0 THEN date ELSE CAST(date + CAST(7 - dayofweek(date) AS INTEGER) AS DATE) END AS weekend_last,
  CAST(date + 6 AS DATE) AS week_last, last_day(date) AS month_last
FROM (SELECT DISTINCT date FROM happenings)
""")
def when_range(t: Load):
    """What today, weekend, week and month mean on each date, and the date's words."""
    d = F.col("date")
    a, b = D.when_range("weekend", d)
    return t("happenings").select("date").distinct().select("date", D.weekday(d).cast("bigint").alias("weekday"), D.is_weekend(d).alias("weekend"), F.date_format(d, "yyyy-MM").alias("month_key"), D.format_day(d).alias("label"), D.format_month(d).alias("month"), a.alias("weekend_first"), b.alias("weekend_last"), D.when_range("week", d)[1].alias("week_last"), D.when_range("month", d)[1].alias("month_last"))


@query("""
WITH m AS (SELECT id, start, "end", CAST(left(start, 2) AS INTEGER) AS h, CAST(left("end", 2) AS INTEGER) AS g FROM happenings),
f AS (SELECT id, start, "end", CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END || ':' || right(start, 2) AS a, CASE WHEN h < 12 THEN ' AM' ELSE ' PM' END AS ap, CASE WHEN g % 12 = 0 THEN 12 ELSE g % 12 END || ':' || right("end", 2) AS b, CASE WHEN g < 12 THEN ' AM' ELSE ' PM' END AS bp FROM m)
SELECT id, CASE WHEN start IS NULL THEN '' WHEN "end" IS NULL THEN a || ap WHEN ap = bp AND "end" >= start THEN a || '–' || b || bp ELSE a || ap || '–' || b || bp END AS hours FROM f
""")
def format_range(t: Load):
    return t("happenings").select("id", D.format_range(F.col("start"), F.col("end")).alias("hours"))


@query("""
SELECT id, CASE WHEN end_date = date THEN strftime(date, '%b ') || day(date)
  WHEN year(end_date) - year(date) > 1 OR (year(end_date) - year(date) = 1 AND month(end_date) >= month(date)) THEN strftime(date, '%b ') || day(date) || ', ' || year(date) || '–' || strftime(end_date, '%b ') || day(end_date) || ', ' || year(end_date)
  WHEN month(date) = month(end_date) THEN strftime(date, '%b ') || day(date) || '–' || day(end_date)
  ELSE strftime(date, '%b ') || day(date) || '–' || strftime(end_date, '%b ') || day(end_date) END AS dates,
  'Through ' || strftime(end_date, '%b ') || day(end_date) || CASE WHEN year(end_date) <> year(date) THEN ', ' || year(end_date) ELSE '' END AS through
FROM happenings
""")
def format_date_range(t: Load):
    return t("happenings").select("id", D.format_date_range(F.col("date"), F.col("end_date")).alias("dates"), D.format_through(F.col("end_date"), F.col("date")).alias("through"))


@query("""
SELECT event_id, strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d %H:%M') AS wall, CAST(date_diff('minute', ts, timezone('America/New_York', timezone('UTC', ts))) AS INTEGER) AS ahead
FROM events
""")
def ny_parts(t: Load):
    """New York wall time and offset of every event's instant."""
    return t("events").select("event_id", F.date_format(D.ny_time(F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm").alias("wall"), D.ny_offset(F.col("ts").cast("timestamp")).alias("ahead"))


@query("""
WITH e AS (SELECT event_id, ts AS s, ts + to_minutes(CAST(event_id % 180 AS INTEGER)) AS e, TIMESTAMP '2024-01-15 12:00:00' AS now, event_id % 3 = 0 AS u FROM events)
SELECT event_id, CASE WHEN now < s - INTERVAL 30 MINUTE THEN 'upcoming' WHEN now < s THEN 'soon' WHEN now < e THEN CASE WHEN u THEN 'started' ELSE 'live' END ELSE 'past' END AS state FROM e
""")
def time_status(t: Load):
    e = t("events").select("event_id", F.col("ts").cast("timestamp").alias("s"), (F.col("ts").cast("timestamp") + F.make_dt_interval(mins=(F.col("event_id") % 180).cast("int"))).alias("e"))
    return e.select("event_id", D.time_status(F.col("s"), F.col("e"), F.lit("2024-01-15 12:00:00").cast("timestamp"), F.col("event_id") % 3 == 0).alias("state"))


@query("""
WITH d AS (SELECT *, date_diff('day', date, end_date) > 13 AS run FROM happenings),
i AS (SELECT id, CAST(unnest(generate_series(date, CASE WHEN run THEN date ELSE end_date END, INTERVAL 1 DAY)) AS DATE) AS date, end_date, start, "end", all_day, NOT all_day AND start IS NULL AS unknown, run, status = 'cancelled' AS off FROM d),
w AS (SELECT *, CASE WHEN all_day OR unknown THEN date::TIMESTAMP ELSE date + start::TIME END AS s, CASE WHEN run THEN end_date ELSE date END AS last, NOT all_day AND NOT unknown AND NOT run AND "end" IS NULL AS open_end, all_day OR unknown AS no_hours FROM i),
v AS (SELECT *, CASE WHEN no_hours OR (run AND "end" IS NULL) THEN (last + 1)::TIMESTAMP WHEN "end" IS NULL THEN s + INTERVAL 1 HOUR WHEN "end" < start THEN (last + 1) + "end"::TIME ELSE last + "end"::TIME END AS e, TIMESTAMP '1997-06-15 12:00:00' AS now FROM w),
l AS (SELECT *, s::DATE AS day, date_diff('second', now, s) AS ahead,
  CASE WHEN s::DATE = now::DATE THEN 'Today' WHEN s::DATE = now::DATE + 1 THEN 'Tomorrow' ELSE '' END AS word FROM v),
t AS (SELECT id, date, off, CASE
  WHEN run THEN CASE WHEN now >= e THEN 'past|Ended' WHEN now >= s THEN 'running|' WHEN NOT no_hours AND ahead <= 1800 THEN 'soon|In ' || greatest(1, round(ahead / 60)::BIGINT) || ' min' ELSE 'upcoming|' || word END
  WHEN unknown THEN CASE WHEN day = now::DATE THEN 'today|Today' WHEN day > now::DATE THEN 'upcoming|' || word ELSE 'past|Ended' END
  WHEN all_day THEN CASE WHEN now >= e THEN 'past|Ended' WHEN now >= s THEN 'today|Today' ELSE 'upcoming|' || word END
  WHEN now < s THEN CASE WHEN ahead <= 1800 THEN 'soon|In ' || greatest(1, round(ahead / 60)::BIGINT) || ' min' ELSE 'upcoming|' || word END
  WHEN open_end THEN CASE WHEN now < greatest(e, (day + 1)::TIMESTAMP) THEN 'started|Started' ELSE 'past|Ended' END
  WHEN now >= e THEN 'past|Ended' ELSE 'live|Now' END AS said FROM l)
SELECT id, date, CASE WHEN NOT off THEN split_part(said, '|', 1) END AS state, CASE WHEN NOT off THEN split_part(said, '|', 2) END AS label FROM t
""")
def live_state(t: Load):
    """State and label of every instance at a fixed time: Sunday noon in New York, so "this weekend" is today or over (the full state machine)."""
    rows = S.expand_instances(t("happenings"))
    st = D.live_state(F.col("s"), F.col("e"), F.lit(NOW).cast("timestamp"), F.col("run"), F.col("time_unknown"), F.col("all_day"), F.col("end_unknown"), F.col("status") == "cancelled")
    return rows.select("id", "date", st.alias("st")).select("id", "date", "st.state", "st.label")


@query("SELECT id FROM happenings WHERE date <= DATE '1997-06-21' AND end_date >= DATE '1997-06-15'")
def in_days(t: Load):
    """Events with a listing day within a week, by their first and last day."""
    a, b = D.when_range("week", F.lit(TODAY).cast("date"))
    return t("happenings").where(S.in_days(F.col("date"), F.col("end_date"), a, b)).select("id")


@query("SELECT id, date FROM instances WHERE date BETWEEN DATE '1997-06-15' AND DATE '1997-06-30' AND strftime(date, '%Y-%m') IN ('1997-06')")
def own_day_filter(t: Load):
    """Instances whose own day is within a span and month."""
    return instances(t).where(F.col("date").between("1997-06-15", "1997-06-30") & F.date_format("date", "yyyy-MM").isin("1997-06")).select("id", "date")


@query("""
WITH d AS (SELECT DISTINCT place, date FROM instances), g AS (SELECT place, date, date - CAST(row_number() OVER (PARTITION BY place ORDER BY date) AS INTEGER) AS g FROM d)
SELECT place, min(date) AS first, max(date) AS last, count(*) AS n FROM g GROUP BY place, g
""")
def consecutive_runs(t: Load):
    """Runs of consecutive days with an event at each place."""
    return S.consecutive_runs(instances(t).select("place", F.col("date").alias("day")), ["place"])


@query("""
WITH RECURSIVE m AS (SELECT DISTINCT place, month(date) AS m FROM happenings),
g AS (SELECT place, m, m - row_number() OVER (PARTITION BY place ORDER BY m) AS g FROM m),
r AS (SELECT place, min(m) AS f, max(m) AS l FROM g GROUP BY place, g),
w AS (SELECT *, min(f) OVER (PARTITION BY place) = 1 AND max(l) OVER (PARTITION BY place) = 12 AND count(*) OVER (PARTITION BY place) > 1 AS wrap, max(CASE WHEN f = 1 THEN l END) OVER (PARTITION BY place) AS head FROM r)
SELECT place, CAST(f AS INTEGER) AS first, CAST(l - f + 1 + CASE WHEN wrap AND l = 12 THEN head ELSE 0 END AS INTEGER) AS n FROM w WHERE NOT (wrap AND f = 1)
""".replace("WITH RECURSIVE", "WITH"))
def circular_month_runs(t: Load):
    """Seasons: runs of months around the year with an event at each place."""
    return S.circular_month_runs(t("happenings").select("place", F.month("date").alias("month")), ["place"])


@query("""
SELECT id, CASE WHEN run THEN 'span' ELSE 'timed' END AS item, date AS first, CASE WHEN run THEN end_date ELSE date END AS last FROM instances WHERE run OR (NOT all_day AND start IS NOT NULL)
UNION ALL
SELECT id, 'days', min(date), max(date) FROM (SELECT id, date, date - CAST(row_number() OVER (PARTITION BY id ORDER BY date) AS INTEGER) AS g FROM instances WHERE NOT run AND (all_day OR start IS NULL)) GROUP BY id, g
""")
def calendar_items(t: Load):
    return S.calendar_items(instances(t))


@query("""
SELECT id, min(CASE WHEN run THEN greatest(date, DATE '1997-06-15') ELSE CASE WHEN all_day OR start IS NULL OR start >= '05:00' THEN date ELSE date - 1 END END) AS next FROM instances
WHERE CASE WHEN run THEN end_date ELSE CASE WHEN all_day OR start IS NULL OR start >= '05:00' THEN date ELSE date - 1 END END >= DATE '1997-06-15'
  AND CASE WHEN run THEN date ELSE CASE WHEN all_day OR start IS NULL OR start >= '05:00' THEN date ELSE date - 1 END END <= DATE '1997-07-14' GROUP BY id
""")
def next_occurrence(t: Load):
    """Each event's next listing day within 30 days."""
    return S.next_occurrence(instances(t), TODAY, 30)


@query("""
SELECT id, min(date) AS first, max(CASE WHEN run THEN end_date ELSE date END) AS last, count(*) AS n, bool_or(run) AS run FROM instances GROUP BY id
""")
def first_last_instance(t: Load):
    return instances(t).groupBy("id").agg(F.min("date").alias("first"), F.max(F.coalesce("through", "date")).alias("last"), F.count("*").alias("n"), F.bool_or("run").alias("run"))


@query("""
WITH c AS (SELECT n_regionkey AS region, h.id, h.date, h.end_date FROM happenings h JOIN customer ON h.place = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE featured AND status <> 'cancelled' AND h.end_date >= DATE '1997-06-15')
SELECT region, arg_min(id, (date, id)) AS id, min(date) AS date FROM c GROUP BY region
""")
def next_featured(t: Load):
    """The next featured event of each region that is not over."""
    area = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("place"), F.col("n_regionkey").alias("region"))
    live = t("happenings").where(f"featured and status <> 'cancelled' and end_date >= date '{TODAY}'").join(area, "place")
    return live.groupBy("region").agg(F.min(F.struct("date", "id")).alias("m")).select("region", "m.id", "m.date")


@query("""
SELECT count(DISTINCT id) AS on_today FROM instances WHERE NOT run AND status <> 'cancelled' AND date = DATE '1997-06-15'
  AND (all_day OR start IS NULL OR "end" < start OR ("end" IS NULL AND CAST(left(start, 2) AS INTEGER) * 60 + CAST(right(start, 2) AS INTEGER) + 60 > 720) OR "end" > '12:00')
  AND (all_day OR start IS NULL OR start >= '05:00')
""")
def on_today_count(t: Load):
    """Live events, runs apart, that are listed today and have not ended."""
    rows = instances(t).where(f"not run and status <> 'cancelled' and date = date '{TODAY}' and day = date '{TODAY}'").where(F.col("e") > F.lit(NOW).cast("timestamp"))
    return rows.agg(F.countDistinct("id").alias("on_today"))


@query("""
SELECT CASE WHEN run THEN 'open run' WHEN date = DATE '1997-06-15' THEN 'today' WHEN date <= DATE '1997-06-22' AND dayofweek(date) IN (5, 6, 0) THEN 'weekend' ELSE 'later' END AS band, count(DISTINCT id) AS events, min(date) AS first
FROM instances WHERE status <> 'cancelled' AND (CASE WHEN run THEN end_date ELSE date END) >= DATE '1997-06-15' AND date <= DATE '1997-07-15' AND (NOT run OR date <= DATE '1997-06-15') GROUP BY ALL
""")
def today_band(t: Load):
    """Today's list, the weekend's days, open runs and later ones, in one pass."""
    d = F.col("date")
    rows = instances(t).where(f"status <> 'cancelled' and coalesce(through, date) >= date '{TODAY}' and date <= date '1997-07-15' and (not run or date <= date '{TODAY}')")
    band = F.when(F.col("run"), "open run").when(d == TODAY, "today").when((d <= "1997-06-22") & F.dayofweek(d).isin(6, 7, 1), "weekend").otherwise("later")
    return rows.groupBy(band.alias("band")).agg(F.countDistinct("id").alias("events"), F.min("date").alias("first"))


@query("""
WITH i AS (SELECT id, place, date, CAST(date AS TIMESTAMP) + to_minutes(CAST(left(start, 2) AS INTEGER) * 60 + CAST(right(start, 2) AS INTEGER)) AS s,
  CASE WHEN "end" IS NULL THEN NULL ELSE CAST(date AS TIMESTAMP) + to_minutes(CAST(left("end", 2) AS INTEGER) * 60 + CAST(right("end", 2) AS INTEGER) + CASE WHEN "end" < start THEN 1440 ELSE 0 END) END AS e
  FROM happenings WHERE start IS NOT NULL AND NOT all_day)
SELECT a.date AS day, a.id AS a_id, b.id AS b_id FROM i a JOIN i b ON a.date = b.date AND (b.s > a.s OR (b.s = a.s AND b.id > a.id)) AND (a.s = b.s OR b.s < a.e)
""")
def overlap_join(t: Load):
    """Pairs of events of one day that are on at once."""
    at = lambda c: F.col("date").cast("timestamp") + F.make_dt_interval(mins=F.substring(c, 1, 2).cast("int") * 60 + F.substring(c, 4, 2).cast("int"))
    e = at("end") + F.when(F.col("end") < F.col("start"), F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))
    items = t("happenings").where("start is not null and not all_day").select("id", F.col("date").alias("day"), at("start").alias("s"), e.alias("e"))
    return S.overlap_join(items).select(F.col("a_day").alias("day"), "a_id", "b_id")


@query("""
WITH a AS (SELECT id, date AS s, end_date AS e, place FROM happenings WHERE status = 'cancelled'), b AS (SELECT id, date AS s, end_date AS e, place FROM happenings WHERE featured AND status <> 'cancelled')
SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON b.s <= a.e AND b.e >= a.s
""")
def interval_overlap(t: Load):
    """Cancelled events and the featured ones that overlap them."""
    part = lambda w: t("happenings").where(w).select("id", F.col("date").cast("timestamp").alias("s"), F.col("end_date").cast("timestamp").alias("e"))
    return S.interval_overlap(part("status = 'cancelled'"), part("featured and status <> 'cancelled'")).select("a_id", "b_id")


@query("""
SELECT CAST(m AS DATE) AS month, count(*) AS runs FROM happenings, (SELECT DISTINCT date_trunc('month', date) AS m FROM happenings) WHERE date <= last_day(m) AND end_date >= m AND date_diff('day', date, end_date) > 13 GROUP BY ALL
""")
def date_cover_join(t: Load):
    """Long runs by each month that they cover."""
    runs = t("happenings").where("datediff(end_date, date) > 13").select("id", F.trunc("date", "MM").alias("first"), F.col("end_date").alias("last"))
    months = t("happenings").select(F.trunc("date", "MM").alias("month")).distinct()
    return S.date_cover(runs, months, "month").groupBy("p.month").agg(F.count("*").alias("runs"))


@query("""
SELECT series, CAST(min(month(date)) AS BIGINT) AS first_month, count(*) AS dated, count(DISTINCT month(date)) AS months, bool_or(featured) AS featured FROM happenings GROUP BY series
""")
def month_calendar(t: Load):
    """Series under their first month, with counts of dated events."""
    return t("happenings").groupBy("series").agg(F.min(F.month("date")).cast("bigint").alias("first_month"), F.count("*").alias("dated"), F.countDistinct(F.month("date")).alias("months"), F.bool_or("featured").alias("featured"))


@query("""
WITH d AS (SELECT place, date, string_agg(coalesce(start, '') || '-' || coalesce("end", ''), ',' ORDER BY coalesce(start, '') || '-' || coalesce("end", '')) AS sig FROM instances GROUP BY place, date)
SELECT place, count(DISTINCT sig) > 1 AS differs FROM d GROUP BY place
""")
def differs_by_day(t: Load):
    """Whether a place's daily hours differ."""
    sig = F.array_join(F.array_sort(F.collect_list(F.concat(F.coalesce("start", F.lit("")), F.lit("-"), F.coalesce("end", F.lit(""))))), ",")
    return instances(t).groupBy("place", "date").agg(sig.alias("sig")).groupBy("place").agg((F.countDistinct("sig") > 1).alias("differs"))


@query("""
SELECT id, kind, place, date, start, row_number() OVER (PARTITION BY place ORDER BY date, coalesce(start, '99:99'), kind, id) AS n FROM happenings
""")
def schedule_sort(t: Load):
    """Each place's events in schedule order (no start is last)."""
    w = Window.partitionBy("place").orderBy("date", F.coalesce("start", F.lit("99:99")), "kind", "id")
    return t("happenings").select("id", "kind", "place", "date", "start", F.row_number().over(w).cast("bigint").alias("n"))


@query("""
SELECT id, kind, date, place, start, count(*) OVER (PARTITION BY kind, date, place % 50) AS same FROM happenings WHERE status <> 'cancelled' AND start IS NOT NULL
QUALIFY count(*) OVER (PARTITION BY kind, date, place % 50) > 1
""")
def slot_duplicates(t: Load):
    """Live timed events that share title, date and place."""
    live = t("happenings").where("status <> 'cancelled' and start is not null")
    return live.withColumn("same", F.count("*").over(Window.partitionBy("kind", "date", F.col("place") % 50))).where("same > 1").select("id", "kind", "date", "place", "start", "same")


@query("""
SELECT id, row_number() OVER (PARTITION BY date ORDER BY ("end" < '12:00')::INT NULLS FIRST, (start IS NULL)::INT, start NULLS FIRST, id) AS place_in_day FROM happenings
""")
def day_list_order(t: Load):
    """A day's list: ended ones last, timed before untimed, then by start."""
    w = Window.partitionBy("date").orderBy((F.col("end") < "12:00").cast("int").asc_nulls_first(), F.col("start").isNull().cast("int"), F.col("start").asc_nulls_first(), "id")
    return t("happenings").select("id", F.row_number().over(w).cast("bigint").alias("place_in_day"))
