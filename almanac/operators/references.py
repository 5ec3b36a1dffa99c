"""References between collections: lookups, dangling ones, aliases, rewritten ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.geo import haversine
from almanac.functions.text import name_key, street_key
from almanac.operators.ranking import numbered, vocab_order
from almanac.operators.spatial import radius_join


def lookup_join(df: DataFrame, key: str, other: DataFrame, other_key: str, prefix: str) -> DataFrame:
    """Left join; the other side's columns get a prefix."""
    named = other.select(*(F.col(c).alias(f"{prefix}{c}") for c in other.columns))
    return df.join(named, F.col(key) == F.col(f"{prefix}{other_key}"), "left")


def dangling_refs(df: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose key is set and not in the target."""
    return df.where(F.col(key).isNotNull()).join(target.select(F.col(target_key).alias(key)), key, "left_anti")


def dangling_array_refs(df: DataFrame, id_: str, refs: str, target: DataFrame, target_key: str) -> DataFrame:
    """id, pos, ref of array entries that are not in the target."""
    return df.select(id_, F.posexplode(refs).alias("pos", "ref")).join(target.select(F.col(target_key).alias("ref")), "ref", "left_anti")


def polymorphic_refs(df: DataFrame, kind: str, key: str, targets: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows whose (kind, key) is in none of the targets, by kind."""
    union = None
    for k, (t, c) in targets.items():
        part = t.select(F.lit(k).alias(kind), F.col(c).alias(key))
        union = part if union is None else union.unionByName(part)
    return df.join(union, [kind, key], "left_anti")


def either_refs(df: DataFrame, key: str, first: DataFrame, second: DataFrame, id_: str, value: str) -> DataFrame:
    """The frame with ``found``: the value in the first target, else in the second one."""
    a = first.select(F.col(id_).alias("_a"), F.col(value).alias("_va"))
    b = second.select(F.col(id_).alias("_b"), F.col(value).alias("_vb"))
    return df.join(a, F.col(key) == F.col("_a"), "left").join(b, F.col(key) == F.col("_b"), "left").withColumn("found", F.coalesce("_va", "_vb")).drop("_a", "_b", "_va", "_vb")


def alias_join(df: DataFrame, text: Column, ref: str, names: DataFrame, last_wins: bool = False) -> DataFrame:
    """Fill a null ref from names (key, id, ord): by the text's key.

    A key of several ids is not used; with last_wins, its last one by ord is.
    """
    keys = names.groupBy("key").agg(F.countDistinct("id").alias("_n"), F.max(F.struct("ord", "id")).alias("_m"))
    keys = keys.select(F.col("key").alias("_key"), F.col("_m.id").alias("_id"), "_n")
    if not last_wins:
        keys = keys.where("_n = 1")
    return df.withColumn("_text", F.when(F.col(ref).isNull(), text)).join(keys, F.col("_text") == F.col("_key"), "left").withColumn(ref, F.coalesce(ref, "_id")).drop("_text", "_key", "_id", "_n")


def remap_refs(df: DataFrame, key: str, remap: DataFrame) -> DataFrame:
    """Rewrite a key through remap (old, new; new null = dropped)."""
    m = remap.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return df.join(m, F.col(key) == F.col("_old"), "left").withColumn(key, F.when(F.col("_old").isNull(), F.col(key)).otherwise(F.col("_new"))).drop("_old", "_new")


def coverage_gap(expected: DataFrame, made: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys without a made row."""
    return expected.select(*keys).distinct().join(made.select(*keys), keys, "left_anti")


def decode_codes(df: DataFrame, codes: str, table: DataFrame) -> DataFrame:
    """The frame with ids (distinct, sorted) of an array of codes and the number of unknown ones."""
    e = df.withColumn("_row", F.monotonically_increasing_id()).select("*", F.explode_outer(codes).alias("_code")).join(table.select(F.col("code").alias("_code"), F.col("id").alias("_id")), "_code", "left")
    own = [c for c in df.columns if c != codes]
    return e.groupBy("_row", *own).agg(F.array_sort(F.collect_set("_id")).alias("ids"), F.count_if(F.col("_code").isNotNull() & F.col("_id").isNull()).alias("unknown")).drop("_row")


def id_space(collections: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """id, owners (sorted), n over all collections."""
    union = None
    for k, (t, c) in collections.items():
        part = t.select(F.col(c).cast("string").alias("id"), F.lit(k).alias("owner"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("id").agg(F.array_sort(F.collect_set("owner")).alias("owners"), F.count("*").alias("n"))


# Words that do not count in a name.
STOP = ["the", "a", "an", "of", "at", "and", "in", "on", "by"]


def _told(names: Column) -> Column:
    """Names as (key, distinct words that count); names without a key are left out."""
    keys = F.filter(F.transform(names, name_key), lambda k: k.isNotNull() & (k != ""))
    words = lambda k: F.array_distinct(F.filter(F.split(k, " "), lambda w: ~w.isin(*STOP)))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), words(k).alias("words")))


def _level(a: Column, b: Column, qualifiers: list[str]) -> Column:
    """3 the same name, 2 the same words, 1 one holds all of the other's two words or more and only qualifiers besides, else 0."""
    more, less = F.array_except(a["words"], b["words"]), F.array_except(b["words"], a["words"])
    inside = lambda small, extra, lack: (F.size(small["words"]) >= 2) & (F.size(lack) == 0) & F.forall(extra, lambda w: w.isin(*qualifiers))
    one = inside(b, more, less) | inside(a, less, more)
    return F.when(a["key"] == b["key"], 3).when((F.size(a["words"]) > 0) & (F.size(more) == 0) & (F.size(less) == 0), 2).when(one, 1).otherwise(0)


def _half(a: Column, b: Column) -> Column:
    """Whether two names share half of the smaller one's words."""
    return F.size(F.array_intersect(a["words"], b["words"])) >= 0.5 * F.greatest(F.lit(1), F.least(F.size(a["words"]), F.size(b["words"])))


def entity_link(subjects: DataFrame, items: DataFrame, forced: DataFrame, rejected: DataFrame, reach: dict[int, float], qualifiers: list[str], farthest: float = 20_000, close: float = 600) -> DataFrame:
    """subject, item, level, d, reason: each subject's external item by name level and distance, or why there is none.

    subjects and items have id, names, lat, lng; subjects also ``done`` (they
    need none). A forced pair (subject, item) wins if the item is near at all; a
    rejected one never counts. Else the best level wins, then the nearest, then
    the least id, within the level's reach. Only items within ``farthest`` are met.
    """
    at = lambda df: df.select("id", "lat", "lng")
    told = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), _told(F.col("names")).alias(f"{p}_names"))
    open_ = subjects.where("not coalesce(done, false)")
    c = radius_join(at(open_), at(items), farthest).join(told(open_, "a"), "a_id").join(told(items, "b"), "b_id")
    mark = lambda df, name: df.select(F.col("subject").alias("a_id"), F.col("item").alias("b_id"), F.lit(True).alias(name)).distinct()
    c = c.join(mark(forced, "forced"), ["a_id", "b_id"], "left").join(mark(rejected, "rejected"), ["a_id", "b_id"], "left")
    pairs = lambda f: F.flatten(F.transform("a_names", lambda a: F.transform("b_names", lambda b: f(a, b))))
    level = F.coalesce(F.array_max(pairs(lambda a, b: _level(a, b, qualifiers))), F.lit(0))
    c = c.select("a_id", "b_id", "d", F.coalesce("forced", F.lit(False)).alias("forced"), F.coalesce("rejected", F.lit(False)).alias("rejected"), level.alias("level"), F.exists(pairs(_half), lambda x: x).alias("alike"))
    may = F.lit(0.0)
    for k, metres in reach.items():
        may = F.when(F.col("level") == k, metres).otherwise(may)
    named = (F.col("level") > 0) & ~F.col("rejected")
    wins = F.when(F.col("forced"), F.struct(F.lit(0).alias("o"), F.lit(0).alias("l"), "d", "b_id", F.greatest("level", F.lit(1)).alias("level")))
    wins = wins.when(named & (F.col("d") <= may), F.struct(F.lit(1).alias("o"), (-F.col("level")).alias("l"), "d", "b_id", "level"))
    best = c.groupBy(F.col("a_id").alias("id")).agg(F.min(wins).alias("m"), F.bool_or(named).alias("far"), F.bool_or(F.col("alike") & (F.col("d") <= max(reach.get(3, 0.0), close))).alias("near"))
    reason = (
        F.when(F.coalesce("done", F.lit(False)), "has one")
        .when(F.col("lat").isNull() | F.col("lng").isNull(), "no coordinates")
        .when(F.col("m.o") == 0, "forced")
        .when(F.col("m").isNotNull(), "linked")
        .when(F.col("far"), "same name, too far")
        .when(F.col("near"), "name differs")
        .otherwise("nothing near")
    )
    return subjects.join(best, "id", "left").select(F.col("id").alias("subject"), F.col("m.b_id").alias("item"), F.col("m.level").alias("level"), F.col("m.d").alias("d"), reason.alias("reason"))


def skip_reason(kinds: list[str], licences: list[str]) -> Column:
    """Why a medium (kind, known, licence, credit, url) can't be an image of its subject; null if it can."""
    return (
        F.when(F.col("kind").isNull() | ~F.col("kind").isin(*kinds), "no image kind")
        .when(~F.col("known"), "subject not known")
        .when(F.col("licence").isNull() | ~F.col("licence").isin(*licences), "licence not accepted")
        .when(F.trim(F.coalesce("credit", F.lit(""))) == "", "no credit line")
        .when(~F.startswith(F.coalesce("url", F.lit("")), F.lit("https://")), "not https")
    )


def image_plan(media: DataFrame, subjects: DataFrame, primary: DataFrame, kinds: list[str], licences: list[str]) -> DataFrame:
    """id, kind, subject, reason, place, job: what to do with each medium.

    media have id, kind, subject, licence, credit, url, ord; subjects kind,
    subject, rank; primary kind, subject, id. Media that can't be used have a
    reason. The others of a subject are its candidates by (ord, id), the named
    primary first (even one that could not be used, if the subject has another);
    ``place`` 0 is the image, the rest are alternates. ``job`` numbers the images
    by the subject's rank, the order of kinds, and the subject.
    """
    known = subjects.select("kind", "subject", "rank", F.lit(True).alias("known"))
    named = primary.select("kind", "subject", "id", F.lit(True).alias("named")).distinct()
    m = media.join(known, ["kind", "subject"], "left").withColumn("known", F.coalesce("known", F.lit(False))).join(named, ["kind", "subject", "id"], "left")
    m = m.withColumn("reason", skip_reason(kinds, licences)).withColumn("named", F.coalesce("named", F.lit(False)))
    by = Window.partitionBy("kind", "subject")
    usable = F.max(F.col("reason").isNull()).over(by)
    m = m.withColumn("taken", F.col("reason").isNull() | (F.col("named") & F.col("known") & usable))
    place = F.row_number().over(Window.partitionBy("kind", "subject", "taken").orderBy(F.desc("named"), "ord", "id")) - 1
    m = m.withColumn("place", F.when(F.col("taken"), place)).withColumn("reason", F.when(~F.col("taken"), F.col("reason")))
    at = vocab_order(F.col("kind"), kinds)
    jobs = numbered(m.withColumn("_at", at), ["rank", "_at", "subject", "id"], F.coalesce(F.col("place") == 0, F.lit(False)))
    return jobs.select("id", "kind", "subject", "reason", "place", F.col("number").alias("job"))


def geocode_refusal(address: Column, names: Column, matched: Column, photon: Column, by_name: Column, metres: Column, farthest: float = 30_000) -> Column:
    """Why a geocoder's match is not clearly the record; null if it is accepted.

    A match by address must agree in house number and street, direction
    included; its address is its first part, or in a Photon match the first part
    that is a number and the one behind it. A match by name must begin with one
    of the record's names, or one must hold the other from six letters on, and
    its house number, if it has one behind the name, must be the record's. None
    may be farther from the area's centre than ``farthest`` metres.
    """
    parts = F.transform(F.split(matched, ","), lambda p: F.trim(p))
    number = lambda first: F.array_min(F.transform(parts, lambda p, i: F.when(p.rlike("(?i)^\\d+[a-z]?$") & (i >= first), i)))
    want = street_key(address)
    plain = street_key(F.get(parts, F.lit(0)))
    split = street_key(F.concat_ws(" ", F.get(parts, number(0)), F.get(parts, number(0) + 1)))
    got = F.coalesce(plain, F.when(photon, split))
    by_address = (
        F.when(want.isNull(), "the record has no house number")
        .when(got.isNull(), "the match has no house number")
        .when(got["no"] != want["no"], "house number differs")
        .when(got["street"] != want["street"], "street differs")
    )
    first, keys = name_key(F.get(parts, F.lit(0))), F.filter(F.transform(names, name_key), lambda k: k != "")
    said = F.exists(keys, lambda k: (k == first) | ((F.length(k) >= 6) & F.contains(first, k)) | ((F.length(first) >= 6) & F.contains(k, first)))
    named = F.when(~F.coalesce(said, F.lit(False)), "name differs").when(want.isNotNull() & number(1).isNotNull() & (F.lower(F.get(parts, number(1))) != want["no"]), "house number differs")
    return F.when(matched.isNull(), "no match").when(metres > farthest, "too far from the area").otherwise(F.when(by_name, named).otherwise(by_address))


def geocode_cascade(records: DataFrame, hits: DataFrame) -> DataFrame:
    """id, ref, step, refusals: each record's first accepted hit by step, and why those before it were not.

    records have id, address, names, lat, lng (the area's centre); hits id,
    step, ref, matched, photon, by_name, lat, lng, one for each record and step.
    """
    h = hits.select("id", "step", "ref", "matched", "photon", "by_name", F.col("lat").alias("_lat"), F.col("lng").alias("_lng")).join(records, "id")
    why = geocode_refusal(F.col("address"), F.col("names"), F.col("matched"), F.col("photon"), F.col("by_name"), haversine(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng")))
    h = h.select("id", "step", "ref", why.alias("why"))
    best = h.groupBy("id").agg(F.min(F.when(F.col("why").isNull(), F.struct("step", "ref"))).alias("m"), F.sort_array(F.collect_list(F.struct("step", "why"))).alias("all"))
    before = F.filter("all", lambda x: x["why"].isNotNull() & (F.col("m").isNull() | (x["step"] < F.col("m.step"))))
    out = best.select("id", F.col("m.ref").alias("ref"), F.col("m.step").alias("step"), F.array_join(F.transform(before, lambda x: x["why"]), "; ").alias("refusals"))
    return records.select("id").join(out, "id", "left").select("id", "ref", "step", F.coalesce("refusals", F.lit("")).alias("refusals"))
