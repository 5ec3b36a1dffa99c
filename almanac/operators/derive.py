"""Small derivations on records: address lines, words for dates and hours, sections, evidence in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.text import name_key


def address_line(address: Column, city: Column, state: Column, zip_: Column) -> Column:
    """Address, city (unless it is in the address already), state and zip."""
    inside = F.contains(F.lower(address), F.lower(city))
    return F.concat_ws(", ", address, F.when(~F.coalesce(inside, F.lit(False)), city), F.nullif(F.concat_ws(" ", state, zip_), F.lit("")))


def date_precision(year: Column, text: Column) -> Column:
    """Words for a timeline date: the text's own day if it has one, else the year; about or BCE if the text or sign says so."""
    about = text.rlike("(?i)\\b(c\\.|ca\\.|circa|about|around)\\s*\\d")
    words = F.when(year < 0, F.concat((-year).cast("string"), F.lit(" BCE"))).otherwise(year.cast("string"))
    return F.when(text.rlike("^\\d{4}-\\d{2}-\\d{2}$"), text).when(about, F.concat(F.lit("about "), words)).otherwise(words)


def transport_section(mode: Column, regions: Column, near_airport: Column) -> Column:
    """The first section whose rule fits: air, water, between regions, local."""
    return F.when(mode.isin("air", "REG AIR", "AIR") | near_airport, "air").when(mode.isin("ferry", "SHIP"), "water").when(F.size(regions) > 1, "between regions").otherwise("local")


def season_word(text: Column) -> Column:
    k = F.lower(text)
    return F.when(k.rlike("not (yet )?(running|open) yet|opens? in|coming soon"), "Not running yet").when(k.rlike("not running|suspended|discontinued|no service"), "Not running").when(k.rlike("season"), "Seasonal")


def room_text(label: Column, venue: Column) -> Column:
    """What a room's label says beyond its venue's name; null if nothing."""
    a, b = F.split(name_key(label), " "), F.split(name_key(venue), " ")
    starts = F.slice(a, F.lit(1), F.size(b)) == b
    rest = F.array_join(F.slice(F.split(F.trim(F.regexp_replace(F.regexp_replace(label, "(?i)^the\\s+", ""), "[\\s,:–-]+", " ")), " "), F.size(b) + 1, F.greatest(F.size(a) - F.size(b), F.lit(0))), " ")
    return F.nullif(F.when(starts, rest).otherwise(label), F.lit(""))


def live_words_display(all_day: Column, hours_text: Column, hours: Column) -> Column:
    """All day, the source's words, or the range."""
    return F.when(F.coalesce(all_day, F.lit(False)), "All day").when(F.trim(hours_text) != "", hours_text).otherwise(hours)


def weekday_mismatch(text: Column, year: Column) -> Column:
    """Array of struct (said, day): weekdays in a text that the calendar of a year denies ("Friday, March 3")."""
    pattern = "(Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day,? (January|February|March|April|May|June|July|August|September|October|November|December) (\\d{1,2})\\b"
    part = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    rows = F.arrays_zip(part(1).alias("w"), part(2).alias("m"), part(3).alias("d"))
    day = lambda r: F.try_to_date(F.concat_ws(" ", year.cast("string"), r["m"], F.lpad(r["d"], 2, "0")), "yyyy MMMM dd")
    found = F.transform(rows, lambda r: F.struct(F.concat(r["w"], F.lit("day")).alias("said"), day(r).alias("day")))
    return F.filter(found, lambda r: r["day"].isNotNull() & (F.date_format(r["day"], "EEEE") != r["said"]))


def coerce_types(df: DataFrame, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(records with wrong-typed strings as null, findings of them); kinds: field -> int, double, date or boolean."""
    out, problems = df, []
    for c, kind in kinds.items():
        value = F.expr(f"try_cast({c} as {kind})")
        problems.append(F.when(F.col(c).isNotNull() & value.isNull(), F.lit(c)))
        out = out.withColumn(c, value)
    id_ = df.columns[0]
    wrong = df.select(id_, F.explode(F.array_compact(F.array(*problems))).alias("field"))
    return out, wrong


def infer_geo_source(source: Column, notes: Column, lat: Column) -> Column:
    """Struct of source and lat: a missing source by the notes' words; without one the point is dropped."""
    said = F.when(notes.rlike("(?i)openstreetmap|\\bosm\\b"), "osm").when(notes.rlike("(?i)census"), "census").when(notes.rlike("(?i)wikipedia|wikidata"), "wikipedia")
    s = F.coalesce(source, said)
    return F.struct(s.alias("source"), F.when(s.isNotNull(), lat).alias("lat"))


def drop_reviewed_aliases(df: DataFrame, aliases: str, drops: DataFrame) -> DataFrame:
    """Records without the aliases (by key) that drops (id, key) lists."""
    d = drops.groupBy("id").agg(F.collect_set("key").alias("_drop"))
    return df.join(d, "id", "left").withColumn(aliases, F.filter(aliases, lambda a: ~F.array_contains(F.coalesce("_drop", F.array().cast("array<string>")), name_key(a)))).drop("_drop")
