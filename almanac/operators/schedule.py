"""Schedules: dated instances, runs, calendars, overlaps.

``expand_instances`` is the core table of everything dated. An event has id,
date, end_date, start, end, all_day; it gives one instance for each day, or one
for the whole span if it runs for more than ``RUN_DAYS`` days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions import dates as D
from almanac.operators.intervals import covered, meeting, overlapping

RUN_DAYS = 14


def expand_instances(events: DataFrame, first: str | None = None, last: str | None = None, run_days: int = RUN_DAYS, occurrences: DataFrame | None = None) -> DataFrame:
    """The events' columns with date, day, s, e, run, through and flags for each instance.

    ``occurrences`` (id, date) gives the days of the events that it names, instead
    of date..end_date. first..last is the window; runs are clipped to it.
    """
    end = F.coalesce("end_date", "date")
    run = F.datediff(end, "date") + 1 > run_days
    columns = [c for c in events.columns if c != "date"]
    listed = events.withColumnRenamed("date", "_from")
    if occurrences is not None:
        own = listed.join(occurrences.select("id", F.col("date")), "id", "left")
        own, listed = own.where("date is not null"), own.where("date is null").drop("date")
        own = own.withColumn("run", F.lit(False))
    span = F.greatest(F.col("_from"), F.lit(first).cast("date")) if first else F.col("_from")
    end, run = F.coalesce(F.col("end_date"), F.col("_from")), F.datediff(F.coalesce(F.col("end_date"), F.col("_from")), F.col("_from")) + 1 > run_days
    stop = F.when(run, span).otherwise(F.greatest(end, F.col("_from")))
    out = listed.withColumn("run", run).withColumn("date", F.explode(F.sequence(F.when(run, span).otherwise(F.col("_from")), stop)))
    if occurrences is not None:
        out = out.unionByName(own.select(out.columns))
    if first:
        out = out.where(F.col("date") >= F.lit(first).cast("date"))
    if last:
        out = out.where(F.col("date") <= F.lit(last).cast("date"))
    to = F.coalesce(F.col("end_date"), F.col("_from"))
    last_day = F.when(F.col("run"), F.least(to, F.lit(last).cast("date")) if last else to).otherwise(F.col("date"))
    all_day = F.coalesce(F.col("all_day"), F.lit(False))
    unknown = ~all_day & F.col("start").isNull()
    whole = all_day | unknown
    s = D.to_instant(F.col("date"), F.when(whole, "00:00").otherwise(F.col("start")))
    no_end = F.col("end").isNull()
    e = (
        F.when(whole | (F.col("run") & no_end), D.to_instant(F.date_add(last_day, 1), F.lit("00:00")))
        .when(no_end, s + F.expr("INTERVAL 1 HOUR"))
        .when(F.col("end") < F.col("start"), D.to_instant(F.date_add(last_day, 1), F.col("end")))
        .otherwise(D.to_instant(last_day, F.col("end")))
    )
    return out.select(
        *columns,
        "date",
        F.when(F.col("run") | whole, F.col("date")).otherwise(D.listing_day(F.col("date"), F.col("start"))).alias("day"),
        s.alias("s"),
        e.alias("e"),
        "run",
        F.when(F.col("run"), to).alias("through"),
        (~whole & ~F.col("run") & no_end).alias("end_unknown"),
        unknown.alias("time_unknown"),
        (~whole & ~F.col("run") & (F.col("start") < "05:00")).alias("late_night"),
    )


def listing_days(instances: DataFrame) -> DataFrame:
    """The instances with days, all their listing days: of a run, every day through its end."""
    return instances.withColumn("listed", F.explode(F.when(F.col("run"), F.sequence("date", "through")).otherwise(F.array("day"))))


def in_days(first: Column, last: Column, a: Column, b: Column) -> Column:
    """Whether days first..last meet a..b, both inclusive."""
    return (first <= b) & (last >= a)


def consecutive_runs(days: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """keys, first, last, n: runs of consecutive distinct days."""
    w = Window.partitionBy(*keys).orderBy(day)
    marked = days.select(*keys, day).distinct().withColumn("_g", F.date_sub(F.col(day), F.row_number().over(w)))
    return marked.groupBy(*keys, "_g").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("n")).drop("_g")


def circular_month_runs(months: DataFrame, keys: list[str], month: str = "month") -> DataFrame:
    """keys, first, n: runs of months around the year; twelve months are one run from 1."""
    w = Window.partitionBy(*keys).orderBy(month)
    d = months.select(*keys, F.col(month).cast("int").alias("m")).distinct()
    d = d.withColumn("_g", F.col("m") - F.row_number().over(w.orderBy("m")))
    runs = d.groupBy(*keys, "_g").agg(F.min("m").alias("first"), F.max("m").alias("last"))
    all_ = Window.partitionBy(*keys)
    # a run that ends in December goes on in one that begins in January
    runs = runs.withColumn("_wrap", (F.min("first").over(all_) == 1) & (F.max("last").over(all_) == 12) & (F.count("*").over(all_) > 1))
    head = F.max(F.when(F.col("first") == 1, F.col("last"))).over(all_)
    return runs.withColumn("n", F.col("last") - F.col("first") + 1 + F.when(F.col("_wrap") & (F.col("last") == 12), head).otherwise(0)).where("not (_wrap and first = 1)").select(*keys, "first", "n")


def overlap_join(items: DataFrame, key: str = "day") -> DataFrame:
    """Pairs of items (id, s, e, key column) of one key that are on at once.

    An unknown end is a point. Each pair comes once, in the order of (s, id).
    """
    t = items.select(key, "id", "s", F.greatest("s", F.coalesce("e", "s")).alias("e"))
    pairs = overlapping(t, [key], "s", "e").where("x.s = p.s or p.s < x.e")
    swap = (F.col("x.s") == F.col("p.s")) & (F.col("x.id") > F.col("p.id"))
    pairs = pairs.select(F.when(swap, F.col("p")).otherwise(F.col("x")).alias("a"), F.when(swap, F.col("x")).otherwise(F.col("p")).alias("b"))
    return pairs.select(*(F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "ab" for c in t.columns))


def interval_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of intervals (id, s, e) that overlap, both ends inclusive; each once. An unknown end is a point."""
    ended = lambda df: df.select("id", "s", F.coalesce("e", "s").alias("e"))
    pairs = meeting(ended(a), ended(b), [], "s", "e")
    return pairs.select(*(F.col(f"{struct}.{c}").alias(f"{side}_{c}") for struct, side in (("x", "a"), ("p", "b")) for c in ("id", "s", "e")))


def date_cover(spans: DataFrame, days: DataFrame, day: str = "day") -> DataFrame:
    """x, p (structs): each span (first, last) with each of the days that it covers, both ends inclusive."""
    return covered(spans, days, [], "first", "last", day)


def calendar_items(instances: DataFrame) -> DataFrame:
    """id, kind ('timed', 'days', 'span'), first, last: an item for each timed instance, run of untimed days or span."""
    timed = instances.where("not run and not time_unknown and not coalesce(all_day, false)").select("id", F.lit("timed").alias("item"), F.col("date").alias("first"), F.col("date").alias("last"))
    untimed = consecutive_runs(instances.where("not run and (time_unknown or coalesce(all_day, false))").select("id", F.col("date").alias("day")), ["id"])
    spans = instances.where("run").select("id", F.lit("span").alias("item"), F.col("date").alias("first"), F.col("through").alias("last"))
    return timed.unionByName(untimed.select("id", F.lit("days").alias("item"), "first", "last")).unionByName(spans)


def next_occurrence(instances: DataFrame, today: str, days: int) -> DataFrame:
    """id, next: the next listing day within so many days; today for an open run."""
    t = F.lit(today).cast("date")
    start = F.when(F.col("run"), F.greatest(F.col("date"), t)).otherwise(F.col("day"))
    end = F.when(F.col("run"), F.col("through")).otherwise(F.col("day"))
    return instances.where((end >= t) & (start <= F.date_add(t, days - 1))).groupBy("id").agg(F.min(start).alias("next"))
