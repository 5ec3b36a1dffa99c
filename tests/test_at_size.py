"""Odd values and forms that large tables need: against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from almanac.functions import dates as D
from almanac.functions import geo
from almanac.operators import clusters, consolidate, spatial
from almanac.plans import merging, registry, space
from almanac.streaming import jobs

# Live states


def instances(spark, rows):
    flags = [f"array_contains(split(flags, ','), '{f}') {f}" for f in ("run", "time_unknown", "all_day", "end_unknown", "cancelled")]
    return spark.createDataFrame(rows, "id long, s string, e string, flags string").selectExpr("id", "cast(s as timestamp) s", "cast(e as timestamp) e", *flags)


def test_soon_begins_at_the_start_s_fraction_of_a_second(spark):
    i = instances(spark, [(1, "2024-01-13 05:30:00.733309", "2024-01-13 06:30:00.733309", "")])
    assert [(c.at.strftime("%H:%M:%S.%f"), c.state) for c in jobs.state_changes(i).first().changes][1:] == [("05:00:00.733309", "soon"), ("05:30:00.733309", "live"), ("06:30:00.733309", "past")]


def test_changes_written_down_at_once_are_those_of_all_moments(spark):
    r = random.Random(3)
    at = lambda m: f"2024-01-{1 + m // 1440:02} {m // 60 % 24:02}:{m % 60:02}:{r.randrange(60):02}.{r.randrange(1000):03}"
    rows = []
    for i in range(120):
        m = r.randrange(1440 * 4)
        rows.append((i, at(m), at(max(0, m + r.choice([-40, -10, 1, 30, 400, 2000]))), r.choice(["", "", "end_unknown", "cancelled"])))
    rows += [(900, None, at(5), ""), (901, at(5), None, "end_unknown"), (902, "1899-12-31 23:50:00", "1900-01-01 02:00:00", ""), (903, "2024-01-02 10:00:00", "2024-01-02 10:00:00", "")]
    i = instances(spark, rows)
    flags = ("run", "time_unknown", "all_day", "end_unknown", "cancelled")
    now = F.col("now")
    marks = i.select(F.explode(F.array("s", "e", F.col("s") - F.expr("interval 30 minutes"))).alias("m")).where("m is not null").select(F.explode(F.array("m", F.col("m") - F.expr("interval 1 microsecond"))).alias("now")).distinct()
    both = i.crossJoin(marks).select("id", "now", D.live_state(F.col("s"), F.col("e"), now, *(F.col(f) for f in flags))["state"].alias("want"), "s", "e", *flags)
    told = jobs.state_changes(both).select("id", "now", "want", F.try_element_at(F.filter("changes", lambda c: c["at"] <= now), F.lit(-1))["state"].alias("got"), "changes")
    assert told.where("now >= '1900-01-01' and not got <=> want").collect() == []
    sizes = told.select("id", F.size("changes").alias("n"), F.array_distinct("changes.state").alias("s")).distinct()
    assert sizes.where("n <> size(s)").collect() == []


# Clusters


@pytest.mark.parametrize("crowd", [3, 20_000])
def test_points_of_crowded_cells_are_dealt_and_no_repeated_rows_are_broadcast(spark, monkeypatch, crowd, capsys):
    monkeypatch.setattr(clusters, "CROWD", crowd)
    r = random.Random(11)
    points = [(i, i % 2, r.choice([5.0, r.random() * 8]), r.choice([5.0, r.random() * 8])) for i in range(220)]
    rows = spark.createDataFrame(points, "id long, k long, x double, y double")
    kept = []
    for p in points:
        if not any(q[1] == p[1] and abs(p[2] - q[2]) < 0.7 and abs(p[3] - q[3]) < 0.7 for q in kept):
            kept.append(p)
    assert sorted(x.id for x in clusters.distinct_points(rows, ["k"], ["id"], 0.7).collect()) == sorted(p[0] for p in kept)
    placed = clusters._placed(rows, ["k"], ["id"], 0.7, clusters.BOX[1])
    met = clusters._meet(placed, placed.limit(20), ["k"], 0.7, clusters.BOX[0], lambda p, f: p > f)
    met.select("p").explain()
    assert capsys.readouterr().out.count("BroadcastHashJoin") <= 2  # of a list of crowded cells only


# Distances


def globe(spark, n, seed):
    r = random.Random(seed)
    spots = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(5)] + [(89.99, 10.0), (0.0, 179.99)]
    near = lambda c: (max(-89.999, min(89.999, c[0] + r.gauss(0, 0.02))), (c[1] + r.gauss(0, 0.02) + 540) % 360 - 180)
    rows = [(i, *(near(r.choice(spots)) if r.random() < 0.8 else r.choice(spots))) for i in range(n)]
    return rows + [(n, None, 1.0)], spark.createDataFrame([*rows, (n, None, 1.0)], "id long, lat double, lng double")


def metres(p, q):
    h = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1.0, math.sqrt(h)))


def test_the_nearest_within_a_distance_by_growing_circles(spark, monkeypatch):
    a, x = globe(spark, 60, 1)
    b, y = globe(spark, 90, 1)
    want = {}
    for p in a[:-1]:
        near = sorted((round(metres(p, q), 6), q[0]) for q in b[:-1] if metres(p, q) <= 4000)
        want[p[0]] = [k for _, k in near][:3]
    asked = []
    whole = spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda *args: asked.append(args[2]) or whole(*args))
    for repeated in "ab":
        got = {}
        for r in sorted(spatial.nearest_within(x, y, 4000, 3, repeated).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.a_id, []).append(r.b_id)
        assert got == {k: v for k, v in want.items() if v}
    assert min(asked) < 100  # most are found close by, not among all within the distance


@pytest.mark.parametrize("reach", [0.5, 1500.0, 2e7, 3e7])
def test_straight_lines_tell_the_same_pairs(spark, reach):
    a, x = globe(spark, 40, 2)
    b, y = globe(spark, 40, 2)
    want = sorted((p[0], q[0]) for p in a[:-1] for q in b[:-1] if metres(p, q) <= reach)
    for repeated in "ab":
        assert sorted((r.a_id, r.b_id) for r in spatial.radius_join(x, y, reach, repeated).collect()) == want
        told = {(r.a_id, r.b_id): r.metres for r in spatial.radius_metres(x, y, reach, repeated).collect()}
        assert sorted(told) == want and all(abs(told[k] - metres(a[k[0]], b[k[1]])) <= 0.5 + 1e-6 for k in want)


def test_whole_metres_are_rounded_half_up(spark):
    some = [0.0, 0.49999999999999994, 0.5, 1.5, 2.4999999999999996, 7999.5, 123456.49999999999, 4503599627370495.5]
    got = spark.createDataFrame([(d,) for d in some], "d double").select("d", geo.whole(F.col("d")).alias("n"), F.round("d").cast("bigint").alias("r")).collect()
    assert [r.n for r in got] == [math.floor(r.d) + (r.d - math.floor(r.d) >= 0.5) for r in got] == [r.r for r in got]


def test_fallback_takes_the_near_ones_or_else_the_nearest(spark):
    a, x = globe(spark, 50, 3)
    b, y = globe(spark, 60, 4)
    y = y.withColumn("lat", F.col("lat") * 0.2).unionByName(x.withColumn("lat", F.col("lat") + 0.003).where("id % 3 = 0"))
    b = [(r.id, r.lat, r.lng) for r in y.collect() if r.lat is not None]
    want = set()
    for p in a[:-1]:
        d = sorted((metres(p, q), q[0]) for q in b if metres(p, q) <= 9000)
        near = bool(d) and d[0][0] <= 900
        want |= {(p[0], k, i + 1, near) for i, (m, k) in enumerate(d[:4]) if not near or m <= 900}
    for repeated in "ab":
        assert {(r.a_id, r.b_id, r["rank"], r.near) for r in spatial.radius_fallback(x, y, 900, 9000, 4, repeated).collect()} == want
    assert len({w[3] for w in want}) == 2


def test_near_events_repeats_the_stays_not_the_events(spark, capsys):
    space.near_events(registry.Tables(spark, "/root/testdata/sf0.001")).explain("extended")
    optimized = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert "collect_list(id" in optimized  # a place's events meet a stay as one row
    cells = [line for line in optimized.splitlines() if "Generate explode" in line and "transform" in line]
    assert cells and not any("b_id" in line for line in cells)


# Pairs of records


def test_located_pairs_come_once_without_being_brought_together(spark, capsys):
    r = random.Random(5)
    rows = [(i, [r.choice(["name:a", "name:b", "name:c", None]), r.choice(["street:x", "street:y"]), "name:a" if i % 9 == 0 else "street:z"], *r.choice([(27.0 + r.random() / 50, -82.0), (None, -82.0)])) for i in range(70)]
    df = spark.createDataFrame(rows, "id int, keys array<string>, lat double, lng double")
    want = set()
    for p in rows:
        for q in rows:
            both = {k for k in p[1] if k} & {k for k in q[1] if k}
            unknown = p[2] is None or q[2] is None
            if p[0] < q[0] and both and (unknown or math.floor(metres((0, *p[2:]), (0, *q[2:])) + 0.5) <= 800):
                want.add((p[0], q[0], ",".join(sorted({k.split(":")[0] for k in both}))))
    pairs = consolidate.dup_located(df, 800)
    got = [(x.a, x.b, x.reasons) for x in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    pairs.explain()
    assert "hashpartitioning(a#" not in capsys.readouterr().out


def test_addresses_are_brought_to_one_a_street_and_number_first(spark, capsys):
    merging.geocode_cascade(registry.Tables(spark, "/root/testdata/sf0.001")).explain("extended")
    optimized = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert optimized.count("min(struct(ref") == 3  # of addresses by street, of those by name, of hits by name
