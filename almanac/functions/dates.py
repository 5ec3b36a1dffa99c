"""Dates, New York wall time, listing days, states and their words. All are Columns.

``now`` is always a Column or literal; the session's time zone is UTC. Times of
day are strings HH:MM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"


def to_instant(date: Column, time: Column) -> Column:
    """Instant of a New York date and time of day (in the spring gap, an hour later)."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", date.cast("string"), time), "yyyy-MM-dd HH:mm"), ZONE)


def ny_time(instant: Column) -> Column:
    """New York wall time of an instant."""
    return F.from_utc_timestamp(instant, ZONE)


def ny_midnight(date: Column) -> Column:
    """Instant at which a day begins in New York."""
    return F.to_utc_timestamp(date.cast("timestamp"), ZONE)


def ny_offset(instant: Column) -> Column:
    """Minutes that New York is ahead of UTC."""
    return ((F.unix_timestamp(ny_time(instant)) - F.unix_timestamp(instant)) / 60).cast("int")


def weekday(date: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(date) - 1


def is_weekend(date: Column) -> Column:
    return F.dayofweek(date).isin(1, 7)


def listing_day(date: Column, start: Column) -> Column:
    """What starts before 05:00 is listed under the day before."""
    return F.when(start < "05:00", F.date_sub(date, 1)).otherwise(date)


def time_bucket(start: Column) -> Column:
    return F.when(start.isNull(), "allday").when(start < "05:00", "late").when(start < "12:00", "morning").when(start < "17:00", "afternoon").when(start < "21:00", "evening").otherwise("late")


def time_status(s: Column, e: Column, now: Column, end_unknown: Column) -> Column:
    soon = s - F.expr("INTERVAL 30 MINUTES")
    return F.when(now < soon, "upcoming").when(now < s, "soon").when(now < e, F.when(end_unknown, "started").otherwise("live")).otherwise("past")


def _span(seconds: Column) -> Column:
    m = F.greatest(F.lit(1), F.floor(seconds / 60 + 0.5)).cast("long")
    rest = F.when(m % 60 > 0, F.concat(F.lit(" "), (m % 60).cast("string"), F.lit(" min"))).otherwise("")
    return F.when(m < 60, F.concat(m.cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit(" h"), rest))


def relative_time(s: Column, e: Column, now: Column, end_unknown: Column) -> Column:
    st = time_status(s, e, now, end_unknown)
    left = F.unix_timestamp(s) - F.unix_timestamp(now)
    return F.when(st.isin("upcoming", "soon"), F.concat(F.lit("in "), _span(left))).when(st.isin("live", "started"), F.concat(F.lit("Started "), _span(-left), F.lit(" ago"))).otherwise("Ended")


def when_range(when: str, today: Column) -> tuple[Column, Column]:
    """First and last day that today, weekend, week or month mean on a day."""
    w = weekday(today)
    if when == "today":
        return today, today
    if when == "weekend":
        return F.when(w.isin(0, 5, 6), today).otherwise(F.date_add(today, F.lit(5) - w)), F.when(w == 0, today).otherwise(F.date_add(today, F.lit(7) - w))
    if when == "week":
        return today, F.date_add(today, 6)
    if when == "month":
        return today, F.last_day(today)
    raise ValueError(when)


def date_word(date: Column, today: Column) -> Column:
    a, b = when_range("weekend", today)
    return F.when(date == today, "Today").when(date < today, "").when(date == F.date_add(today, 1), "Tomorrow").when(date.between(a, b), "This weekend").otherwise("")


def day_word(s: Column, now: Column) -> Column:
    """The word for an upcoming start; a start after midnight within six hours is tonight."""
    at, today = ny_time(s), F.to_date(ny_time(now))
    tonight = (F.to_date(at) != today) & (s > now) & (F.unix_timestamp(s) - F.unix_timestamp(now) <= 6 * 3600) & (F.hour(at) < 5)
    return F.when(tonight, "Tonight").otherwise(date_word(F.to_date(at), today))


def format_time(t: Column) -> Column:
    """ "19:30" is "7:30 PM"."""
    h = F.substring(t, 1, 2).cast("int")
    return F.concat(F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string"), F.lit(":"), F.substring(t, 4, 2), F.when(h < 12, " AM").otherwise(" PM"))


def format_range(start: Column, end: Column) -> Column:
    """ "16:00", "21:00" is "4:00–9:00 PM"; both halves are named if they differ or midnight is between."""
    a, b = format_time(start), format_time(end)
    same = (F.right(a, F.lit(2)) == F.right(b, F.lit(2))) & (end >= start)
    return F.when(start.isNull(), "").when(end.isNull(), a).when(same, F.concat(F.regexp_replace(a, " [AP]M$", ""), F.lit("–"), b)).otherwise(F.concat(a, F.lit("–"), b))


def format_day(date: Column) -> Column:
    return F.date_format(date, "EEE, MMM d")


def format_date_range(start: Column, end: Column) -> Column:
    """ "Oct 3–10", "Sep 30–Nov 1"; both years if it would read backwards."""
    a, b = F.date_format(start, "MMM d"), F.date_format(end, "MMM d")
    years = F.year(end) - F.year(start)
    long = (years > 1) | ((years == 1) & (F.month(end) >= F.month(start)))
    return (
        F.when(end.isNull() | (end == start), a)
        .when(long, F.concat(F.date_format(start, "MMM d, yyyy"), F.lit("–"), F.date_format(end, "MMM d, yyyy")))
        .when(F.month(start) == F.month(end), F.concat(a, F.lit("–"), F.dayofmonth(end).cast("string")))
        .otherwise(F.concat(a, F.lit("–"), b))
    )


def format_month(date: Column) -> Column:
    return F.date_format(date, "MMMM yyyy")


def format_through(end: Column, since: Column) -> Column:
    return F.concat(F.lit("Through "), F.when(F.year(end) == F.year(since), F.date_format(end, "MMM d")).otherwise(F.date_format(end, "MMM d, yyyy")))


def live_state(s: Column, e: Column, now: Column, run: Column, time_unknown: Column, all_day: Column, end_unknown: Column, cancelled: Column) -> Column:
    """Struct of state and label of an instance at ``now``; null state if cancelled."""
    today, day = F.to_date(ny_time(now)), F.to_date(ny_time(s))
    left = F.unix_timestamp(s) - F.unix_timestamp(now)
    soon = F.concat(F.lit("In "), F.greatest(F.lit(1), F.floor(left / 60 + 0.5)).cast("long").cast("string"), F.lit(" min"))
    day_end = F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), ZONE)
    say = lambda st, label: F.struct(F.lit(st).alias("state"), (label if isinstance(label, Column) else F.lit(label)).alias("label"))
    near = now >= s - F.expr("INTERVAL 30 MINUTES")  # not by whole seconds: a start may have fractions
    no_hours = time_unknown | all_day
    return (
        F.when(cancelled | s.isNull() | e.isNull(), F.lit(None).cast("struct<state:string,label:string>"))
        .when(run & (now >= e), say("past", "Ended"))
        .when(run & (now >= s), say("running", ""))
        .when(run & ~no_hours & near, say("soon", soon))
        .when(run, say("upcoming", F.when(no_hours, date_word(day, today)).otherwise(day_word(s, now))))
        .when(time_unknown & (day == today), say("today", "Today"))
        .when(time_unknown & (day > today), say("upcoming", date_word(day, today)))
        .when(time_unknown, say("past", "Ended"))
        .when(all_day & (now >= e), say("past", "Ended"))
        .when(all_day & (now >= s), say("today", "Today"))
        .when(all_day, say("upcoming", date_word(day, today)))
        .when((now < s) & near, say("soon", soon))
        .when(now < s, say("upcoming", day_word(s, now)))
        .when(end_unknown & (now < F.greatest(e, day_end)), say("started", "Started"))
        .when(end_unknown | (now >= e), say("past", "Ended"))
        .otherwise(say("live", "Now"))
    )
