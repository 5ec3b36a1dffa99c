"""Interval sweeps, title likeness, clusters in order, distances on the sphere: against plain versions."""

import datetime
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from almanac.operators import clusters, evidence, graph, intervals, likeness, polygons, references, spatial

DAY = datetime.date(2026, 1, 1)


def spans(r, n):
    out = []
    for i in range(n):
        s = r.choice([None, *range(20)])
        out.append((i, r.choice(["a", "a", "a", "b", None]), s, None if s is None or r.random() < 0.1 else s + r.choice([-2, 0, 0, 1, 3, 15])))
    return out


@pytest.fixture(scope="module")
def two(spark):
    r = random.Random(4)
    a, b = spans(r, 80), spans(r, 60) + [(99, "a", 5, 5), (99, "a", 5, 5)]
    schema = "id long, k string, s long, e long"
    return a, b, spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)


def whole(*rows):
    return all(v is not None for row in rows for v in row)


@pytest.mark.parametrize("block", [1, 5, 512])
def test_sweeps_against_all_pairs(monkeypatch, two, block):
    monkeypatch.setattr(intervals, "BLOCK", block)
    a, b, x, y = two
    ids = lambda df: sorted(tuple(r) for r in df.select("x.id", "p.id").collect())
    meets = lambda p, q: whole(p, q) and p[1] == q[1] and p[2] <= q[3] and q[2] <= p[3]
    assert ids(intervals.meeting(x, y, ["k"], "s", "e")) == sorted((p[0], q[0]) for p in a for q in b if meets(p, q))
    if block != 5:
        return
    inside = lambda p, q: whole(p, q[1:3]) and p[1] == q[1] and p[2] <= q[2] <= p[3]
    assert ids(intervals.covered(x, y, ["k"], "s", "e", "s")) == sorted((p[0], q[0]) for p in a for q in b if inside(p, q))
    own = sorted(tuple(sorted(p)) for p in ids(intervals.overlapping(x, ["k"], "s", "e")))
    assert own == sorted((p[0], q[0]) for p in a for q in a if p[0] < q[0] and meets(p, q))
    assert intervals.overlapping(x.limit(0), ["k"], "s", "e").collect() == []


def test_a_crowded_day_costs_its_pairs(spark):
    n = 200_000  # a day of minutes apart: all pairs of the day would be 2 * 10^10
    t = spark.range(n).select("id", F.lit(1).alias("day"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 15).alias("e"))
    assert intervals.overlapping(t, ["day"], "s", "e").count() == n - 1


# Title likeness


def key(title):
    t = re.sub(r"^the\s+", "", re.sub(r"[^a-z0-9]+", " ", re.sub(r"['’`]", "", (title or "").lower().replace("&", " and "))).strip())
    return re.sub(r"\s+", " ", re.sub(r"\b(20\d\d|annual|\d+(st|nd|rd|th))\b", " ", t)).strip()


def plain_events(rows):
    words = lambda t: {w for w in key(t).split() if len(w) > 2 and w not in ("and", "the", "for", "with", "vs")}
    out = set()
    for a in rows:
        for b in rows:
            if not a[0] < b[0] or a[4] is None or b[4] is None or (a[5] or a[4]) < b[4] or (b[5] or b[4]) < a[4]:
                continue
            spot = lambda r: r[2] or re.sub(r"^the\s+", "", (r[3] or "").lower())
            x, y = words(a[1]), words(b[1])
            shared = len(x & y)
            if key(a[1]) and key(a[1]) == key(b[1]):
                out.add((a[0], b[0], "same title, overlapping dates", None))
            elif spot(a) and spot(a) == spot(b) and shared >= 2 and shared / max(1, min(len(x), len(y))) >= 0.6:
                out.add((a[0], b[0], f"same place, {shared} title words shared", shared))
    return out


def every_pair(spark, events):
    """The operator's pairs of classes, spread over their members."""
    pairs = likeness.dup_events(events).collect()
    members = {}
    for r in likeness.event_classes(events).collect():
        members.setdefault(r["class"], []).append(r.id)
    out = set()
    for r in pairs:
        assert (r.n_a, r.n_b) == (len(members[r.a]), len(members[r.b]))
        out |= {(min(i, j), max(i, j), r.reason, r.shared) for i in members[r.a] for j in members[r.b] if i != j}
    return out, pairs


EVENTS = "id long, title string, place string, location_text string, date date, end_date date"


def test_titles_against_all_pairs(spark):
    r = random.Random(7)
    some = ["Jazz", "Night", "Market", "Harbor", "Run", "the", "and", "Lights", "of", "Old", "Town", "Holiday", "Parade", "2026", "Annual", "25th", "Art", "Walk", "Food", "Fest"]
    rows = []
    for i in range(260):
        d = None if i % 50 == 0 else DAY + datetime.timedelta(days=r.randrange(40))
        title = r.choice([None, "", "2026", *[" ".join(r.choice(some) for _ in range(r.randint(1, 7)))] * 30])
        rows.append((i, title, r.choice([None, "p1", "p2"]), r.choice([None, "The Pier", "the pier", "Hall"]), d, None if d is None or r.random() < 0.3 else d + datetime.timedelta(days=r.randrange(9))))
    rows += [(1000 + i, "25th Annual Fair 2026", "hot", None, DAY, None) for i in range(40)] + [(2000, "Fair", "hot", None, DAY, None), (2001, "Fair", None, None, DAY, DAY)]
    got, pairs = every_pair(spark, spark.createDataFrame(rows, EVENTS))
    want = plain_events(rows)
    assert got == want and len(want) > 900
    assert len(pairs) < len(want) - 600  # copies are not spread into pairs
    assert likeness.dup_events(spark.createDataFrame([], EVENTS)).collect() == []


def test_events_of_the_listings(spark):
    rows = [(1, "Lantern Night 2026", "mill", None, datetime.date(2026, 5, 9), None), (2, "Lantern Night", None, None, datetime.date(2026, 5, 9), None), (3, "Lantern Night", None, None, datetime.date(2027, 5, 8), None)]
    assert [(r.a, r.b) for r in likeness.dup_events(spark.createDataFrame(rows, EVENTS)).collect()] == [(1, 2)]


# Clusters in seed order


def serial_groups(points, radius):
    """Seeds in order; a point joins the nearest group of the first column of cells that has one."""
    groups, cells = [], {}
    for p in points:
        cx, cy = math.floor(p[1] / radius), math.floor(p[2] / radius)
        hit, best = None, math.inf
        for i in (-1, 0, 1):
            if hit is not None:
                break
            for j in (-1, 0, 1):
                for g in cells.get((cx + i, cy + j), []):
                    d = math.sqrt((p[1] - groups[g][0][1]) ** 2 + (p[2] - groups[g][0][2]) ** 2)
                    if d < radius and d < best:
                        hit, best = g, d
        if hit is None:
            cells.setdefault((cx, cy), []).append(len(groups))
            groups.append([p])
        else:
            groups[hit].append(p)
    return sorted((g[0][0], len(g), round(sum(p[1] for p in g) / len(g), 6), round(sum(p[2] for p in g) / len(g), 6)) for g in groups)


def scattered(seed, n):
    r = random.Random(seed)
    out = [(i, r.choice([r.random() * 10, r.gauss(5, 0.3)]), r.choice([r.random() * 10, r.gauss(5, 0.3)])) for i in range(n)]
    return out + [(n + i, 5.0, 5.0) for i in range(100)] + [(2 * n + i, 0.4 * i, -3.0) for i in range(20)]  # a crowd; a chain


POINTS = "id long, x double, y double"


@pytest.mark.parametrize("radius", [0.5, 2.0])
def test_clusters_are_the_serial_ones(spark, radius):
    points = scattered(3, 400)
    random.Random(1).shuffle(points)
    order = {p[0]: i for i, p in enumerate(sorted(points, key=lambda p: (p[0] * 7919 % 1000, p[0])))}
    rows = spark.createDataFrame([*points, (9999, None, 1.0)], POINTS).withColumn("rank", F.col("id") * 7919 % 1000)
    got = sorted((r.seed.id, r.n, round(r.x, 6), round(r.y, 6)) for r in clusters.grid_cluster(rows, ["rank", "id"], radius).collect())
    assert got == serial_groups(sorted(points, key=lambda p: order[p[0]]), radius)


def test_clusters_of_nothing(spark):
    empty = spark.createDataFrame([(1, None, None)], POINTS)
    assert clusters.grid_cluster(empty, ["id"], 1.0).collect() == [] and clusters.distinct_points(empty, [], ["id"], 1.0).collect() == []


def test_distinct_points_are_the_serial_ones(spark):
    points = [(i, i % 3, round(x, 1), round(y, 1)) for i, x, y in scattered(8, 300)]
    kept = []
    for p in points:
        if not any(q[1] == p[1] and abs(q[2] - p[2]) < 0.7 and abs(q[3] - p[3]) < 0.7 for q in kept):
            kept.append(p)
    rows = spark.createDataFrame(points, "id long, k long, x double, y double")
    assert sorted((r.k, r.id) for r in clusters.distinct_points(rows, ["k"], ["id"], 0.7).collect()) == sorted((p[1], p[0]) for p in kept)


# Distances on the whole sphere


def metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1.0, math.sqrt(h)))


def globe(seed, n):
    r = random.Random(seed)
    some = [(r.choice([r.uniform(-90, 90), r.gauss(80, 0.2), r.gauss(0, 0.2), -89.99, 90.0]), r.choice([r.uniform(-180, 180), r.gauss(180, 0.3), r.gauss(-180, 0.3), 0.0])) for _ in range(n)]
    return [(i, max(-90.0, min(90.0, lat)), (lng + 180) % 360 - 180 if i % 9 else lng) for i, (lat, lng) in enumerate(some)]


SPHERE = "id long, lat double, lng double"


@pytest.mark.parametrize("reach", [500, 20_000, 2_000_000, 15_000_000])
def test_radius_anywhere(spark, reach):
    a, b = globe(1, 150), globe(2, 120)
    got = {(r.a_id, r.b_id) for r in spatial.radius_join(spark.createDataFrame([*a, (999, None, 1.0)], SPHERE), spark.createDataFrame(b, SPHERE), reach).collect()}
    clear = {(p[0], q[0]): metres(p, q) for p in a for q in b}
    assert {k for k, d in clear.items() if d <= reach - 1e-3} <= got <= {k for k, d in clear.items() if d <= reach + 1e-3}
    assert got


def test_date_line_and_far_north(spark):
    t = spark.createDataFrame([(1, 0.0, 179.95), (2, 0.0, -179.95), (3, 0.0, 178.0), (4, 80.0, 10.0), (5, 80.0, 10.9)], SPHERE)
    assert sorted((r.a_id, r.b_id) for r in spatial.radius_join(t, t, 20_000).where("a_id <> b_id").collect()) == [(1, 2), (2, 1), (4, 5), (5, 4)]
    assert {r.a_id: r.b_id for r in spatial.nearest_one(t.where("id = 1"), t.where("id in (2, 3)")).collect()} == {1: 2}


@pytest.mark.parametrize("leaf", [1, 32])
def test_nearest_anywhere(spark, monkeypatch, leaf):
    monkeypatch.setattr(spatial, "LEAF", leaf)
    b = globe(5, 200) + [(1000 + i, 12.5, 12.5) for i in range(50)] + [(2000 + i, 12.5 + i * 1e-5, 12.5) for i in range(100)]
    a = globe(6, 120) + [(500, 12.5, 12.5), (501, -12.5, -167.5), (502, None, 3.0)]
    got = {r.a_id: (r.b_id, r.d) for r in spatial.nearest_one(spark.createDataFrame(a, SPHERE), spark.createDataFrame(b, SPHERE)).collect()}
    assert len(got) == len(a) and got[502] == (None, None) and got[500][0] == 1000
    for p in a[:-1]:
        least = min(metres(p, q) for q in b)
        assert abs(got[p[0]][1] - least) < 1e-3 and abs(metres(p, next(q for q in b if q[0] == got[p[0]][0])) - least) < 1e-3


def test_medoids_against_all_pairs(spark):
    r = random.Random(8)
    crowd = [(i, "crowd", r.gauss(27, 1), r.gauss(-82, 1)) for i in range(1000)]
    rows = [*crowd, (9000, "pair", 1.0, 1.0), (9001, "pair", 2.0, 1.0), (9002, "one", 3.0, 3.0), (9003, "one", None, 3.0), (9004, None, 3.0, 3.0), (9005, "none", None, None)]
    rows += [(9100 + i, "same", 10.0, 179.99) for i in range(40)] + [(9099, "same", 10.0, -179.99), (9098, "same", None, 1.0), (None, "same", -10.0, 0.0)]
    rows += [(9200 + i, "globe", r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g string, lat double, lng double")
    sums = spatial.medoid_sums(df, "g").collect()
    got = {}
    for x in sums:
        got[x.g] = min(got.get(x.g, (math.inf, 0)), (int(x.total), x.id))
    groups = {}
    for row in rows:
        if row[1] is not None and row[2] is not None:
            groups.setdefault(row[1], []).append(row)
    want = {g: min((sum(round(metres(a[1:], b[1:]) * 1e6) for b in members), a[0]) for a in members if a[0] is not None) for g, members in groups.items()}
    assert {g: v[1] for g, v in got.items()} == {g: v[1] for g, v in want.items()}
    assert all(got[g][0] == pytest.approx(want[g][0]) for g in want)
    assert len(sums) == len({(x.g, x.id) for x in sums})  # none twice
    assert sum(x.g == "crowd" for x in sums) < len(crowd) / 4  # and few of many
    assert sorted(x.id for x in sums if x.g == "same") == [9099, 9100]
    far = spatial.medoid_and_far(df, "g", 100000).collect()
    assert {x.g: x.id for x in far if x.medoid} == {g: v[1] for g, v in want.items()}
    least = {g: next(m for m in groups[g] if m[0] == v[1]) for g, v in want.items()}
    assert {(x.g, x.id) for x in far if not x.medoid} == {(m[1], m[0]) for g, members in groups.items() for m in members if metres(m[1:], least[g][1:]) >= 100000}
    assert spatial.medoid(df.limit(0), "g").count() == 0


# Evidence of a text


@pytest.mark.parametrize("limit", [0, 8_000_000])
def test_evidence_against_a_plain_version(spark, monkeypatch, limit):
    monkeypatch.setattr(evidence, "BROADCAST", limit)
    r = random.Random(2)
    some = ["gulf", "gulfport", "casino", "casi", "casinos", "pier", "park", "florida", "sunken", "sunkengarden", "the", "Key West", "Ocala", "ab", "é&x"]
    subjects = [(1, ["Gulfport Casino", None]), (2, ["The Park"]), (3, ["Sunken Gardens", "Key West Pier"]), (4, ["the"]), (5, None)]
    texts = [(i, r.choice([1, 2, 3, 4, 5, 6, None]), r.choice([None, "", *[" ".join(r.choice(some) for _ in range(r.randint(1, 4)))] * 20])) for i in range(300)]
    words = lambda s: {w for w in re.sub(r"[^a-z0-9]+", " ", (s or "").lower().replace("é", "e").replace("&", " and ")).split()}
    want = set()
    for i, k, text in texts:
        names = [n for n in dict(subjects).get(k) or [] if n]
        every = {w for n in names for w in words(n) if len(w) >= 3 and w != "the"}
        tokens = {w for w in every if w not in ("park", "florida")} or every
        if not tokens:
            continue
        said = any(w in tokens or any(len(w) >= 5 and len(t) >= 5 and (w.startswith(t) or t.startswith(w)) for t in tokens) for w in words(text))
        found = re.search(r"(?<!\w)(Key West|Ocala)(?!\w)", text or "")
        far = found[1] if found and not any(found[1] in n for n in names) else None
        want.add((i, k, said, far, said and far is None))
    generic = spark.createDataFrame([("park",), ("florida",)], "word string")
    got = evidence.text_evidence(spark.createDataFrame(texts, "id long, subject long, text string"), spark.createDataFrame(subjects, "subject long, names array<string>"), generic, ["the"], ["Key West", "Ocala"])
    assert {tuple(r) for r in got.collect()} == want and len({w[2:] for w in want}) >= 4


# Polygons


def inside(x, y, rings):
    odd = False
    for ring in rings:
        if len(ring) < 3:
            continue
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def star(r, cx, cy, radius, n):
    return [(cx + radius * r.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), cy + radius * r.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


@pytest.mark.parametrize("few", [2, 8])
def test_polygons_with_holes(spark, monkeypatch, few):
    monkeypatch.setattr(polygons, "FEW", few)
    r = random.Random(6)
    shapes = [(i, [star(r, r.uniform(-3, 3), r.uniform(-3, 3), r.uniform(0.1, 2), r.randint(3, 40))]) for i in range(12)]
    shapes += [(50, [[(-2, -2), (2, -2), (2, 2), (-2, 2)], [(-1, -1), (1, -1), (1, 1), (-1, 1)], [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5)]]), (51, [[(0, 0), (1, 1)]]), (52, []), (53, [star(r, 0, 0, 3, 200)])]
    points = [(i, r.uniform(-4, 4), r.uniform(-4, 4)) for i in range(400)] + [(1000 + i, float(i % 5 - 2), float(i // 5 - 2)) for i in range(25)]
    rows = spark.createDataFrame([(i, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for i, rings in shapes], "id long, rings array<array<struct<x: double, y: double>>>")
    p = spark.createDataFrame([*points, (5000, None, 1.0)], POINTS)
    want = {(i, k) for i, x, y in points for k, rings in shapes if inside(x, y, rings)}
    assert {tuple(x) for x in polygons.points_in_polygons(p, rows, 1.0).collect()} == want and len(want) > 200
    inner = polygons.cover(rows, 1.0).where("edges is null").count()
    assert inner > 30
    assert polygons.points_in_polygons(p, rows.where("id in (51, 52)"), 1.0).collect() == []


# Components


def test_components_of_hubs_and_paths(spark, monkeypatch):
    """A hub and a long path, with joins that split no skewed key; the hub's edges are in the small table."""
    monkeypatch.setattr(graph, "HUB", 1000)
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        hub = spark.range(1, 100_001).select(F.lit(500_000).cast("long").alias("a"), F.col("id").alias("b"))
        path = spark.range(20_000).select((F.col("id") * 7919 % 20_000 + 1_000_000).alias("a"), ((F.col("id") + 1) * 7919 % 20_000 + 1_000_000).alias("b")).where("a <> 1000000")
        rest = spark.createDataFrame([(7_000_000, 7_000_000), (None, 8_000_000), (6_000_001, 6_000_000), (6_000_000, 6_000_001)], "a long, b long")
        labels = graph.connected_components(hub.unionByName(path).unionByName(rest))
        assert {(r.label, r.n) for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()} == {(1, 100_001), (1_000_000, 20_000), (7_000_000, 1), (6_000_000, 2)}
        spread = graph.spread(labels, spark.createDataFrame([(77,), (6_000_001,), (123_456_789,)], "node long"))
        assert {(r.label, r.has) for r in spread.select("label", "has").distinct().collect()} == {(1, True), (1_000_000, False), (7_000_000, False), (6_000_000, True)}
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")


def test_components_against_a_search(spark):
    r = random.Random(11)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for node in sorted(near):
        todo = [node] if node not in want else []
        while todo:
            n = todo.pop()
            if n not in want:
                want[n] = node
                todo += near[n]
    assert {x.node: x.label for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# External items


def test_entity_link_reasons(spark):
    pier = (27.77, -82.62)
    subjects = [(1, ["Pier Museum", None], *pier, False), (2, ["The Old Pier"], *pier, True), (3, ["Sunken Gardens"], None, None, None), (4, ["Salvador Dali"], *pier, False), (5, ["Vine Park"], *pier, None), (6, ["Coliseum Hall"], *pier, False), (7, ["Zoo"], *pier, False), (8, [], *pier, False), (9, ["Dali Salvador"], *pier, False)]
    items = [(11, ["The Pier Museum"], 27.771, -82.62), (12, ["Pier Museum"], 27.772, -82.62), (13, ["Dali Salvador Museum"], 27.7701, -82.62), (14, ["Vine Park"], 27.9, -82.62), (15, ["Coliseum"], 27.7702, -82.62), (16, ["Else Where"], *pier)]
    s = spark.createDataFrame(subjects, "id long, names array<string>, lat double, lng double, done boolean")
    i = spark.createDataFrame(items, "id long, names array<string>, lat double, lng double")
    pairs = lambda rows: spark.createDataFrame(rows, "subject long, item long")
    got = {r.subject: (r.item, r.level, r.reason) for r in references.entity_link(s, i, pairs([(7, 16), (8, 99)]), pairs([(1, 11)]), {3: 5000, 2: 2000, 1: 800}, ["museum"]).collect()}
    assert got == {1: (12, 3, "linked"), 2: (None, None, "has one"), 3: (None, None, "no coordinates"), 4: (13, 1, "linked"), 5: (None, None, "same name, too far"), 6: (None, None, "name differs"), 7: (16, 1, "forced"), 8: (None, None, "nothing near"), 9: (13, 1, "linked")}


def test_geocoder_matches(spark):
    rows = [
        (1, "12 West 9th Avenue, Suite 4", ["x"], "12 W 9TH AVE, SPRINGFIELD, XX", False, False, 10.0, None),
        (2, "12 East 9th Avenue", ["x"], "12 W 9TH AVE, SPRINGFIELD", False, False, 10.0, "street differs"),
        (3, "14 W 9th Ave", ["x"], "12 W 9TH AVE, SPRINGFIELD", False, False, 10.0, "house number differs"),
        (4, "9th Avenue", ["x"], "12 W 9TH AVE, SPRINGFIELD", False, False, 10.0, "the record has no house number"),
        (5, "12 W 9th Ave", ["x"], "Cafe, Springfield", False, False, 10.0, "the match has no house number"),
        (6, "12 W 9th Ave", ["x"], "Cafe, 12, West 9th Avenue, Springfield", True, False, 10.0, None),
        (7, "12 W 9th Ave", ["x"], "Cafe, 12, West 9th Avenue, Springfield", False, False, 10.0, "the match has no house number"),
        (8, "12 W 9th Ave", ["The Café"], "Cafe, 12, West 9th Avenue", True, True, 10.0, None),
        (9, "14 W 9th Ave", [None, "Cafe"], "Cafe, 12, West 9th Avenue", True, True, 10.0, "house number differs"),
        (10, None, ["Museum"], "Museum of Art, 5, Road", True, True, 10.0, None),
        (11, None, ["Art"], "Museum of Art", True, True, 10.0, "name differs"),
        (12, None, None, "Museum", True, True, 10.0, "name differs"),
        (13, "12 W 9th Ave", ["x"], "12 W 9TH AVE", False, False, 30_001.0, "too far from the area"),
        (14, "12 W 9th Ave", ["x"], None, False, False, None, "no match"),
    ]
    t = spark.createDataFrame(rows, "id int, address string, names array<string>, matched string, photon boolean, by_name boolean, metres double, want string")
    got = t.select("id", "want", references.geocode_refusal(*(F.col(c) for c in ("address", "names", "matched", "photon", "by_name", "metres"))).alias("why")).collect()
    assert [(r.id, r.why) for r in got] == [(r.id, r.want) for r in got]
