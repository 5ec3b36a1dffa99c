"""Operators on hand-made rows: edge cases that the star-schema tables do not hold."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.functions import dates as D
from almanac.functions import geo as G
from almanac.functions import text as X
from almanac.operators import checks as K
from almanac.operators import consolidate as C
from almanac.operators import facets, graph, pages, schedule
from almanac.operators import references as J
from almanac.operators import spatial as S
from almanac.sources import collections as IO
from almanac.streaming import jobs

EVENT = "id string, date date, end_date date, start string, end string, all_day boolean"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def events(spark, *rows):
    return spark.createDataFrame([(a, b, c, *r) for a, b, c, *r in rows], "id string, d string, z string, start string, end string, all_day boolean").selectExpr("id", "cast(d as date) as date", "cast(z as date) as end_date", "start", "end", "all_day")


def test_instances(spark):
    e = events(
        spark,
        ("late", "2026-10-03", None, "00:30", "02:00", None),
        ("open end", "2026-10-03", None, "19:00", None, None),
        ("no hours", "2026-10-03", None, None, None, None),
        ("over midnight", "2026-10-03", None, "23:00", "01:00", None),
        ("fair", "2026-10-01", "2026-10-14", "10:00", "18:00", None),
        ("long", "2026-10-01", "2026-10-15", None, None, None),
    )
    rows = {}
    for r in schedule.expand_instances(e).collect():
        rows.setdefault(r.id, []).append(r)
    assert str(rows["late"][0].day) == "2026-10-02" and rows["late"][0].late_night
    assert rows["open end"][0].end_unknown and (rows["open end"][0].e - rows["open end"][0].s).seconds == 3600
    assert rows["no hours"][0].time_unknown and (rows["no hours"][0].e - rows["no hours"][0].s).total_seconds() == 86400
    assert str(rows["over midnight"][0].e) == "2026-10-04 05:00:00"
    assert len(rows["fair"]) == 14 and not rows["fair"][0].run
    assert len(rows["long"]) == 1 and rows["long"][0].run and str(rows["long"][0].through) == "2026-10-15"
    clipped = schedule.expand_instances(e, "2026-10-05", "2026-10-10").collect()
    assert sorted(r.id for r in clipped) == ["fair"] * 6 + ["long"]
    assert next(str(r.date) for r in clipped if r.id == "long") == "2026-10-05"
    listed = schedule.expand_instances(e, occurrences=spark.createDataFrame([("fair", "2026-11-01")], "id string, d string").selectExpr("id", "cast(d as date) as date"))
    assert [str(r.date) for r in listed.where("id = 'fair'").collect()] == ["2026-11-01"]
    assert listed.where("id = 'long'").count() == 1


def test_wall_time(spark):
    at = lambda d, t: str(one(spark, D.to_instant(F.lit(d).cast("date"), F.lit(t))))
    assert at("2026-07-01", "12:00") == "2026-07-01 16:00:00" and at("2026-12-01", "12:00") == "2026-12-01 17:00:00"
    assert at("2026-11-01", "01:30") == "2026-11-01 05:30:00"  # the hour that comes twice: the first
    assert at("2027-03-14", "02:30") == "2027-03-14 07:30:00"  # the hour that is left out: an hour later
    assert one(spark, D.format_range(F.lit("23:00"), F.lit("01:00"))) == "11:00 PM–1:00 AM"
    assert one(spark, D.format_range(F.lit("16:00"), F.lit("21:00"))) == "4:00–9:00 PM"
    assert one(spark, D.format_date_range(F.lit("2026-08-28").cast("date"), F.lit("2027-08-13").cast("date"))) == "Aug 28, 2026–Aug 13, 2027"
    assert one(spark, D.format_date_range(F.lit("2026-10-02").cast("date"), F.lit("2027-02-07").cast("date"))) == "Oct 2–Feb 7"


def test_states(spark):
    now = F.lit("2026-10-03 16:00:00").cast("timestamp")  # noon in New York

    def state(s, e, run=False, unknown=False, all_day=False, no_end=False, cancelled=False):
        ts = lambda v: F.lit(v).cast("timestamp")
        r = one(spark, D.live_state(ts(s), ts(e), now, F.lit(run), F.lit(unknown), F.lit(all_day), F.lit(no_end), F.lit(cancelled)))
        return r and (r.state, r.label)

    assert state("2026-10-03 16:20:00", "2026-10-03 18:00:00") == ("soon", "In 20 min")
    assert state("2026-10-03 15:00:00", "2026-10-03 18:00:00") == ("live", "Now")
    assert state("2026-10-03 15:00:00", "2026-10-03 15:30:00", no_end=True) == ("started", "Started")
    assert state("2026-10-02 15:00:00", "2026-10-02 16:00:00", no_end=True) == ("past", "Ended")
    assert state("2026-10-04 15:00:00", "2026-10-04 18:00:00") == ("upcoming", "Tomorrow")
    assert state("2026-10-01 04:00:00", "2026-11-01 04:00:00", run=True) == ("running", "")
    assert state("2026-10-03 04:00:00", "2026-10-04 04:00:00", unknown=True) == ("today", "Today")
    assert state("2026-10-03 15:00:00", "2026-10-03 18:00:00", cancelled=True) is None


def test_month_runs_wrap(spark):
    months = spark.createDataFrame([("w", m) for m in (11, 12, 1, 2, 5)] + [("all", m) for m in range(1, 13)], "k string, month int")
    got = {(r.k, r.first, r.n) for r in schedule.circular_month_runs(months, ["k"]).collect()}
    assert got == {("w", 11, 4), ("w", 5, 1), ("all", 1, 12)}


def test_unknown_end_overlaps_only_what_is_under_way(spark):
    rows = [(1, 1, "2026-01-01 10:00", None), (2, 1, "2026-01-01 10:00", "2026-01-01 11:00"), (3, 1, "2026-01-01 10:30", "2026-01-01 12:00"), (4, 2, "2026-01-01 10:30", None)]
    t = spark.createDataFrame(rows, "id int, day int, s string, e string").selectExpr("id", "day", "cast(s as timestamp) s", "cast(e as timestamp) e")
    assert {(r.a_id, r.b_id) for r in schedule.overlap_join(t).collect()} == {(1, 2), (2, 3)}


def test_text_keys(spark):
    assert one(spark, X.name_key(F.lit("The Café & Bar’s"))) == "cafe and bars"
    assert one(spark, X.alias_key(F.lit("The Café & Bar"))) == "the cafe and bar"
    assert one(spark, X.addr_key(F.lit("1710 N. Highland Avenue, Suite 5"))) == "1710 n highland ave"
    assert one(spark, X.street_key(F.lit("Beach Drive NE"))) is None
    assert one(spark, X.fold_accents(F.lit("Élan ÇA ñandú Straße œuf"))) == "elan ca nandu straße œuf"
    assert one(spark, X.page_key(F.lit("https://www.a.org/x/?q=1"))) == "a.org/x?q=1"
    assert one(spark, X.first_sentence(F.lit("See St. Paul today. More."))) == "See St. Paul today."
    assert one(spark, X.first_sentence(F.lit("J. Smith of Mt. Dora, Inc. sells v. old maps! 12 rooms."))) == "J. Smith of Mt. Dora, Inc. sells v. old maps!"
    assert [one(spark, X.guess_words(F.lit(t))) for t in ("call for hours", "an hour or so", "~ 5 pm", "guessed", "a guest")] == [True, True, True, True, False]
    assert one(spark, X.title_key(F.lit("25th Annual Fair 2026"))) == "fair"
    assert one(spark, X.year_numeral(F.lit("c. 1855"))) == 1855 and one(spark, X.year_numeral(F.lit("about 1855"))) is None


def test_share_code(spark):
    def brute(s):
        h = 2166136261
        for b in s.encode():
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        h %= 36**5
        out = ""
        for _ in range(5):
            h, d = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        return out

    words = ["", "a", "é", "some-place", "x" * 300]
    got = [r.c for r in spark.createDataFrame([(w,) for w in words], "w string").select(X.share_code(F.col("w")).alias("c")).collect()]
    assert got == [brute(w) for w in words]


def test_distances(spark):
    rng = random.Random(3)
    pts = [(k, 27 + rng.random(), -82 + rng.random()) for k in range(120)] + [(999, None, None)]
    t = spark.createDataFrame(pts, "id int, lat double, lng double")
    flat = {(r.a, r.b) for r in t.alias("a").join(t.alias("b"), G.haversine(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng")) <= 9000).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).collect()}
    pairs = S.radius_join(t, t, 9000).collect()
    assert {(r.a_id, r.b_id) for r in pairs} == flat and len(pairs) == len(flat)
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)]
    r = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring))
    assert one(spark, G.ring_area(r)) == 6.0 and one(spark, G.path_length(r)) == 7.0
    assert one(spark, G.ring_holds(F.lit(3.0), F.lit(1.0), r)) and not one(spark, G.ring_holds(F.lit(1.0), F.lit(2.0), r))
    rise = one(spark, G.sun_minutes(F.lit(172), F.lit(27.95), F.lit(-82.46), True))
    assert abs(rise - (10 * 60 + 34)) < 5  # about 06:34 local summer time


def test_references(spark):
    names = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("b", 3, 3)], "key string, id int, ord int")
    rows = spark.createDataFrame([("A", None), ("B", None), ("A", 9), ("?", None)], "t string, ref int")
    assert sorted(str(r.ref) for r in J.alias_join(rows, F.lower("t"), "ref", names).collect()) == ["1", "9", "None", "None"]
    assert sorted(str(r.ref) for r in J.alias_join(rows, F.lower("t"), "ref", names, last_wins=True).collect()) == ["1", "3", "9", "None"]


def test_verified_beats_owner_and_nulls_do_not_win(spark):
    parts = spark.createDataFrame([(1, "a", 0, False, "Old Name", None, ["X"]), (1, "b", 1, True, "New Name", "1", ["x", "y"]), (1, "c", 2, False, "new name", "2", None)], "id int, slice string, owner int, verified boolean, name string, phone string, tags array<string>")
    m = C.consolidate(parts, ["name", "phone"], ["tags"], []).first()
    assert (m.name, m.phone, m.tags, m.parts) == ("New Name", "1", ["x", "y"], 3)
    log = {(r.field, r.slice) for r in C.conflict_log(parts, C.consolidate(parts, ["name", "phone"], [], []), ["name", "phone"]).collect()}
    assert log == {("name", "a"), ("phone", "c")}


def test_id_collisions(spark):
    c = spark.createDataFrame([("places", "x"), ("series", "x"), ("places", "x-series"), ("events", "y"), ("stays", "y"), ("places", "z")], "collection string, id string")
    renames = spark.createDataFrame([("stays", "y", "y-inn")], "collection string, id string, new_id string")
    got = {(r.collection, r.id): r.new_id for r in C.resolve_id_collisions(c, renames, {"series": "series"}).collect()}
    assert got == {("places", "x"): "x", ("series", "x"): "x-series-2", ("events", "y"): "y", ("stays", "y"): "y-inn"}


def test_id_collisions_are_numbered_until_free(spark):
    names = [("p", "x"), ("s", "x"), ("old", "x-s"), ("old", "x-s-2"), ("old", "x-s-4"), ("p", "a"), ("s", "a"), ("t", "a"), ("p", "b"), ("t", "b"), ("q", "c"), ("t", "c"), ("p", "d"), ("q", "d"), ("p", "x-y"), ("s", "x-y"), ("p", None), ("s", None)]
    c = spark.createDataFrame(names, "collection string, id string")
    renames = spark.createDataFrame([("p", "d", "d1"), ("q", "d", "d2"), ("p", "b", "x-s-3"), ("p", "lone", "other")], "collection string, id string, new_id string")
    got = {(r.collection, r.id): (r.new_id, r.action) for r in C.resolve_id_collisions(c, renames, {"s": "s", "t": "y-s"}, [("t", "p")]).collect()}
    assert got == {
        ("p", "x"): ("x", "keep"), ("s", "x"): ("x-s-5", "suffix"), ("t", "a"): ("a", "fold"), ("s", "a"): ("a-s", "suffix"), ("p", "a"): ("a", "keep"),
        ("p", "b"): ("x-s-3", "rename"), ("t", "b"): ("b", "keep"), ("q", "c"): ("c", "keep"), ("t", "c"): ("c-y-s", "suffix"),
        ("p", "d"): ("d1", "rename"), ("q", "d"): ("d", "keep"), ("p", "x-y"): ("x-y", "keep"), ("s", "x-y"): ("x-y-s", "suffix"),
    }
    two = spark.createDataFrame([("q", "m"), ("t", "m"), ("s", "m-y"), ("q", "m-y"), ("q", "m-y-s-2")], "collection string, id string")
    got = {(r.collection, r.id): r.new_id for r in C.resolve_id_collisions(two, renames, {"s": "s", "t": "y-s"}).where("action = 'suffix'").collect()}
    assert got == {("t", "m"): "m-y-s", ("s", "m-y"): "m-y-s-3"}  # both come to m-y-s
    with pytest.raises(ValueError):
        C.resolve_id_collisions(c, renames, {"s": "s2"})


def test_one_operator_or_near(spark):
    rows = [(i, "inn", "o", 27.0, -82.0) for i in range(1, 30)] + [(40, "inn", "p", 27.001, -82.0), (41, "inn", None, 27.0, -81.999), (42, "inn", "q", 28.0, -82.0), (43, "pub", "p", 27.0, -82.0), (44, "inn", "o", None, None), (45, None, "o", 27.0, -82.0)]
    got = sorted((r.a, r.b, r.reason) for r in C.dup_operator(spark.createDataFrame(rows, "id long, name string, operator string, lat double, lng double")).collect())
    assert got == sorted([(1, i, "operator") for i in range(2, 30)] + [(1, 44, "operator")] + [(i, j, "near") for i in range(1, 30) for j in (40, 41)] + [(40, 41, "near")])


def test_classes_of_operators_lose_no_link(spark):
    rows = [(i, f"n{i % 3}", f"o{i % 4}" if i % 7 else None, 27.0 + i % 5 / 1000, -82.0 + i % 11 / 1000) for i in range(90)] + [(90, "lone", "o1", 27.0, -82.0), (91, None, "o1", 27.0, -82.0), (92, "n1", "o1", None, None)]
    df = spark.createDataFrame(rows, "id long, name string, operator string, lat double, lng double")
    pairs = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] is not None and a[1] == b[1]:
                x, y = (math.radians(r[3]) if r[3] is not None else math.inf for r in (a, b))
                near = math.isfinite(x) and math.isfinite(y) and round(2 * 6371008.8 * math.asin(math.sqrt(math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(b[4] - a[4]) / 2) ** 2))) <= 150
                if near or (a[2] is not None and a[2] == b[2]):
                    pairs.add((a[0], b[0]))
    got = C.dup_operator_classes(df).collect()
    named = {r.b: r.a for r in got if r.reason == "operator"}
    assert sorted(r.b for r in got if r.reason == "operator") == [r[0] for r in rows]
    near = {(r.a, r.b) for r in got if r.reason == "near"}
    assert near and {(a, b) for a in named for b in named if a < b and named[a] == named[b]} | near == pairs
    assert all(r.links == sum(r.b in p for p in pairs) for r in got if r.reason == "operator") and all(r.links is None for r in got if r.reason == "near")


def test_two_branches_are_not_duplicates(spark):
    rows = [(1, ["name:pub"], 27.0, -82.0), (2, ["name:pub"], 27.5, -82.0), (3, ["name:pub"], None, None), (4, ["name:pub", "street:1 main"], 27.0001, -82.0), (5, ["street:1 main"], 27.0001, -82.0)]
    got = {(r.a, r.b, r.reasons) for r in C.dup_located(spark.createDataFrame(rows, "id int, keys array<string>, lat double, lng double")).collect()}
    assert got == {(1, 3, "name"), (1, 4, "name"), (2, 3, "name"), (3, 4, "name"), (4, 5, "street")}


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in graph.connected_components(edges).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 63


def test_nearest_one_has_no_bound(spark):
    a = spark.createDataFrame([(1, 10.0, 10.0), (2, -40.0, 170.0), (3, None, 5.0)], "id int, lat double, lng double")
    b = spark.createDataFrame([(7, 10.01, 10.0), (8, 10.0, 10.01), (9, 55.0, -120.0)], "id int, lat double, lng double")
    got = {r.a_id: r.b_id for r in S.nearest_one(a, b).collect()}
    assert got[1] == 8 and got[2] == 9 and got[3] is None
    assert [r.b_id for r in S.nearest_one(a, b.where("id < 0")).collect()] == [None] * 3


def test_boxes_join_is_all_pairs(spark):
    rng = random.Random(3)
    boxes = [(k, y, x, y + rng.random(), x + rng.random() * 2) for k in range(60) for y, x in [(rng.uniform(-5, 5), rng.uniform(-5, 5))]]
    df = spark.createDataFrame(boxes, "id int, s double, w double, n double, e double")
    brute = {(a[0], b[0]) for a in boxes for b in boxes if a[1] - 0.1 <= b[3] and a[3] + 0.1 >= b[1] and a[2] - 0.1 <= b[4] and a[4] + 0.1 >= b[2]}
    got = [(r.a, r.b) for r in S.boxes_join(df, df, 0.1, 0.7).collect()]
    assert set(got) == brute and len(got) == len(brute)


def test_contested_files_settle(spark):
    c = [(1, 1, 2, 1), (1, 2, 1, 2), (2, 2, 2, 1), (2, 1, 1, 2)]  # each wants the file that would sooner have the other
    got = {r.subject: r.file for r in C.assign_best(spark.createDataFrame(c, "subject int, file int, tier int, rank int")).collect()}
    assert got == {1: 1, 2: 2}


def test_assignment_equals_the_serial_one(spark):
    rng = random.Random(5)
    c = [(s, f, s % 3, r) for s in range(30) for r, f in enumerate(rng.sample(range(20), 6))]
    taken, serial = set(), {}
    for s in sorted(range(30), key=lambda s: (s % 3, s)):
        free = [f for q, f, _, _ in sorted(c, key=lambda x: x[3]) if q == s and f not in taken]
        if free:
            serial[s] = free[0]
            taken.add(free[0])
    got = {r.subject: r.file for r in C.assign_best(spark.createDataFrame(c, "subject int, file int, tier int, rank int")).collect()}
    assert got == serial


BROKEN = [
    ({"id": "Bad Id"}, "not a id"),
    ({"name": None}, "required"),
    ({"name": "  "}, "blank"),
    ({"name": "a <b>c</b>"}, "HTML in text"),
    ({"kind": "castle"}, "not in the vocabulary"),
    ({"url": "http://x.org"}, "not a url"),
    ({"date": "2026-02-31"}, "no such day"),
    ({"date": "tomorrow"}, "not a date"),
    ({"time": "25:00"}, "not a time"),
]


@pytest.mark.parametrize(("change", "message"), BROKEN)
def test_each_broken_field_is_found_once(spark, change, message):
    spec = {"id": {"req": True, "kind": "id"}, "name": {"req": True, "text": True}, "kind": {"enum": ["park", "bar"]}, "url": {"kind": "url"}, "date": {"kind": "date"}, "time": {"kind": "time"}}
    good = {"id": "a-1", "name": "Fine", "kind": "park", "url": "https://x.org/a", "date": "2026-02-28", "time": "09:30"}
    schema = "id string, name string, kind string, url string, date string, time string"
    assert K.check_spec(spark.createDataFrame([good], schema), "places", "id", spec).count() == 0
    found = [r.message for r in K.check_spec(spark.createDataFrame([good | change], schema), "places", "id", spec).collect() if r.message != "white space at an edge"]
    assert found == [message]


def test_publishing_stops_at_errors(spark, tmp_path):
    spec = {"name": {"req": True}}
    check = lambda df: K.check_spec(df, "places", "id", spec)
    target, staging = str(tmp_path / "out"), str(tmp_path / "staging")
    IO.gated_publish(spark.createDataFrame([(1, "a")], "id int, name string"), staging, target, check)
    with pytest.raises(K.GateError, match="required"):
        IO.gated_publish(spark.createDataFrame([(2, None)], "id int, name string"), staging, target, check)
    assert [r.id for r in spark.read.parquet(target).collect()] == [1]
    IO.gated_publish(spark.createDataFrame([(3, "c")], "id int, name string"), staging, target, check)
    assert [r.id for r in spark.read.parquet(target).collect()] == [3]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_canonical_json(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, None), ("a", 1, "x")], "id string, n int, extra string")
    IO.write_collections({"places": df}, str(tmp_path), {"places": ["n", "id"]}, form="json")
    lines = [line for p in sorted((tmp_path / "places").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines == ['{"n":1,"id":"a","extra":"x"}', '{"n":2,"id":"b"}']


def test_reading(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    (tmp_path / "a.json").write_text(json.dumps([{"id": "x", "n": 1}, {"id": "y"}]))
    assert IO.read_collection(spark, str(tmp_path / "a.json"), schema).count() == 2
    assert IO.read_collection(spark, str(tmp_path / "none.json"), schema).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        IO.read_collection(spark, str(tmp_path / "none.json"), schema, required=True)
    (tmp_path / "s.json").write_text(json.dumps({"slice": "alpha", "checked": "2026-01-01", "records": {"places": [{"id": "p"}, {"name": "no id"}], "odd": [{"id": "q"}]}}))
    records = T.StructType([T.StructField("places", T.StringType())])
    got = {(r["collection"], r.problem) for r in IO.read_slices(spark, str(tmp_path / "s.json"), records, ["alpha"]).collect()}
    assert got == {("places", None), ("places", "no id"), ("odd", "unknown collection")}
    with pytest.raises(ValueError, match="beta"):
        IO.read_slices(spark, str(tmp_path / "s.json"), records, ["alpha", "beta"])
    IO.write_collections({"places": spark.createDataFrame([("b", 2), ("a", 1)], "id string, n int")}, str(tmp_path / "w"), {"places": ["n", "id"]})
    assert spark.read.parquet(str(tmp_path / "w/places")).columns == ["n", "id"]


def test_records_in_three_wrappings(spark, tmp_path):
    rows = [{"id": "a"}, {"id": "b"}]
    for k, v in enumerate((rows, {"records": {"media": rows}}, {"media": rows})):
        (tmp_path / f"{k}.json").write_text(json.dumps(v))
        df = spark.read.option("multiLine", True).json(str(tmp_path / f"{k}.json"))
        assert sorted(r.id for r in IO.unwrap_records(df, "media").collect()) == ["a", "b"]


def test_page_rules(spark):
    html = "<title>T</title><h1>a</h1><h1>b</h1><img src='x'><p id='k'><p id='k'><a href='http://x.org/'>x</a><a href='../../up'>u</a><a href='b/../c?q=1#k'>c</a><script src='https://z.org/s.js'></script>"
    p = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert {r.problem for r in pages.page_audit(p).collect()} == {"not exactly one h1", "duplicate id", "no description", "no canonical", "image without alt", "image without size", "insecure link", "third-party script"}
    hrefs = [r.href for r in pages.links(p).orderBy("pos").collect()]
    assert hrefs == ["http://x.org/", "../../up", "b/../c?q=1#k"]
    assert one(spark, pages.resolve(F.lit("b/../c?q=1#k"), F.lit("/a/index"))) == "/a/c"
    assert one(spark, pages.climbs(F.lit("../../up"), F.lit("/a/index"))) and not one(spark, pages.climbs(F.lit("../up"), F.lit("/a/index")))


def test_filters(spark):
    t = spark.createDataFrame([(1, ["a", "b"], "x", True), (2, ["c"], "y", None), (3, None, "x", False)], "id int, kinds array<string>, area string, free boolean")
    spec = {"kind": ("list", "kinds"), "area": ("one", "area"), "free": ("bool", "free")}
    ids = lambda state, **k: sorted(r.id for r in t.where(facets.facet_filter(spec, state, **k)).collect())
    assert ids({}) == [1, 2, 3] and ids({"kind": ["b", "c"]}) == [1, 2] and ids({"kind": ["b"], "area": "y"}) == []
    assert ids({"free": True}) == [1] and ids({"area": "q"}, tests={"area": lambda v: F.col("id") == 3}) == [3]
    spec = {"kind": ("list", None, ["a", "b"]), "page": ("one", "1", None)}
    q = lambda u: one(spark, facets.canonical_query(F.lit(u), spec))
    assert q("https://x.org/p?page=2&kind=b,z,a,b&junk=1") == "kind=a,b&page=2" and q("https://x.org/p?page=1") == "" and q("https://x.org/p") == ""


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def actions(spark, rows):
    return spark.createDataFrame(rows, "user long, item string, action string, t string, seq long").selectExpr("user", "item", "action", "cast(t as timestamp) ts", "seq")


def test_saved_sets_stream_and_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(4), rng.choice("abc"), rng.choice(["add", "remove", "toggle", "toggle", "replace", "clear"]), f"2026-01-01 00:{k // 60:02}:{k % 60:02}", k) for k in range(200)]
    for k in range(2):
        actions(spark, rows[100 * k : 100 * k + 100]).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    expected = {}
    for user, item, action, _, _ in rows:
        s = expected.setdefault(user, set())
        if action in ("clear", "replace"):
            s.clear()
        if action in ("add", "replace"):
            s.add(item)
        elif action == "remove":
            s.discard(item)
        elif action == "toggle":
            s ^= {item}
    sets = lambda df: {u: {r["item"] for r in df if r.user == u} for u in {r.user for r in df}}
    assert sets(jobs.saved_set_batch(actions(spark, rows)).collect()) == {u: s for u, s in expected.items() if s}
    seen, touched = {}, []

    def take(df, _):
        for r in sorted(df.collect(), key=lambda r: (r.user, r.ts, r.seq, r["item"] is not None)):
            touched.append(r)
            s = seen.setdefault(r.user, set())
            s.clear() if r["item"] is None else s.add(r["item"]) if r.saved else s.discard(r["item"])

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    source = spark.readStream.schema(jobs.ACTIONS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.saved_set_state(source).writeStream.outputMode("append").foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and {u: s for u, s in seen.items() if s} == {u: s for u, s in expected.items() if s}
    assert len(touched) <= 2 * len(rows)  # changes, not sets


def test_log_compaction_stream(spark, tmp_path):
    rows = [("a", "1", 1), ("b", "x", 2), ("a", "3", 5), ("a", "2", 3)]
    spark.createDataFrame(rows, "key string, value string, seq long").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = {}
    stream = spark.readStream.schema("key string, value string, seq long").parquet(str(tmp_path / "in"))
    q = jobs.log_compaction_stream(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.update({r.key: r.value for r in df.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert seen == {"a": "3", "b": "x"}
    assert {r.key: r.value for r in jobs.log_compaction_batch(spark.createDataFrame(rows, "key string, value string, seq long"), "key", "value", ["seq"]).collect()} == seen


def test_live_board(spark):
    i = spark.sql("select timestamp'2026-01-01 10:00' s, timestamp'2026-01-01 11:00' e union all select timestamp'2026-01-01 12:00', timestamp'2026-01-01 13:00'")
    tick = spark.sql("select timestamp'2026-01-01 10:30' now")
    assert tuple(jobs.live_board(tick, i).first())[1:] == (1, 1)


def board_rows(spark, rows):
    """(id, s, e, seen, flags) as instances; times of 2026-10-DD HH:MM in UTC."""
    at = lambda c: f"cast(concat('2026-10-', {c}, ':00') as timestamp) {c}"
    flags = [f"array_contains(split(flags, ','), '{f}') {f}" for f in ("run", "time_unknown", "all_day", "end_unknown", "cancelled")]
    return spark.createDataFrame(rows, "id long, s string, e string, seen string, flags string").selectExpr("id", at("s"), at("e"), at("seen"), *flags)


def test_state_changes_are_the_live_states(spark):
    rows = [(1, "24 20:00", "25 03:00", "01 00:00", ""), (2, "10 23:00", "11 00:00", "01 00:00", "end_unknown"), (3, "24 04:00", "25 04:00", "01 00:00", "time_unknown"), (4, "24 04:00", "25 04:00", "01 00:00", "all_day"), (5, "05 14:00", "28 22:00", "01 00:00", "run"), (6, "24 20:00", "25 03:00", "01 00:00", "cancelled"), (7, None, None, "01 00:00", "")]
    i = board_rows(spark, rows)
    plan = {r.id: [(c.at.strftime("%d %H:%M"), c.state) for c in r.changes][1:] for r in jobs.state_changes(i).collect()}
    assert plan[1] == [("24 19:30", "soon"), ("24 20:00", "live"), ("25 03:00", "past")]
    assert plan[2] == [("10 22:30", "soon"), ("10 23:00", "started"), ("11 04:00", "past")]
    assert plan[3] == [("24 04:00", "today"), ("25 04:00", "past")] == plan[4]
    assert plan[5] == [("05 13:30", "soon"), ("05 14:00", "running"), ("28 22:00", "past")]
    assert plan[6] == plan[7] == []
    for day in (4, 5, 10, 11, 24, 25, 28):  # at any moment the plan says what live_state says
        for hour in (3, 19):
            now = F.lit(f"2026-10-{day:02} {hour:02}:40:00").cast("timestamp")
            no = F.lit(False)
            direct = i.select("id", D.live_state(F.col("s"), F.col("e"), now, F.coalesce("run", no), F.coalesce("time_unknown", no), F.coalesce("all_day", no), F.coalesce("end_unknown", no), F.coalesce("cancelled", no))["state"].alias("state")).where("state is not null")
            assert sorted(direct.collect()) == sorted(jobs.board_batch(i, now).collect())


def test_live_board_stream_across_its_moments(spark, tmp_path):
    """A stream whose clock passes "soon", start and end; an instance moves, one is cancelled; the batch twin agrees at each tick."""
    first = [(1, "24 20:00", "24 22:00", "24 12:00", ""), (2, "24 21:00", "24 23:00", "24 12:00", ""), (3, "24 20:30", "24 22:00", "24 12:00", "")]
    later = {"24 19:40": [], "24 20:10": [(3, "24 20:30", "24 22:00", "24 20:10", "cancelled")], "24 20:40": [(2, "24 23:00", "24 23:30", "24 20:40", "")], "24 22:05": [], "24 23:10": [(4, "24 23:20", "24 23:50", "24 23:10", "")], "24 23:59": []}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    source, told, said, state, bad = tmp_path / "in", list(first), [], {}, []
    board_rows(spark, first).coalesce(1).write.parquet(str(source / "0"))
    schema = spark.read.parquet(str(source / "0")).schema

    def take(df, _):
        for r in df.collect():
            bad.extend([r] if state.get(r.id) != r.was else [])
            state[r.id] = r.state
            said.append((r.id, r.state))

    def advance():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        q = jobs.live_board_stream(stream).writeStream.outputMode("append").foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None

    advance()
    for k, (tick, rows) in enumerate(later.items(), 1):
        board_rows(spark, [*rows, (None, None, None, tick, "")]).coalesce(1).write.parquet(str(source / str(k)))
        told = [r for r in told if r[0] not in {x[0] for x in rows}] + rows
        advance()
        now = F.lit(f"2026-10-{tick}:00").cast("timestamp")
        assert {i: s for i, s in state.items() if s} == {r.id: r.state for r in jobs.board_batch(board_rows(spark, told), now).collect()}, tick
    assert not bad and (1, "soon") in said and (1, "live") in said and (1, "past") in said and (3, None) in said and (4, "past") in said
    moves = spark.createDataFrame([(1, "soon", None), (1, "live", "soon"), (2, "soon", None), (3, None, "soon"), (3, "soon", None)], "id long, state string, was string")
    assert {r.state: r.n for r in jobs.board_counts(moves).collect()} == {"live": 1, "soon": 1}
