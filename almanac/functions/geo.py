"""Distances, directions, planar coordinates, areas, sun times. All are Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6371008.8
#: Metres of a degree of latitude.
DEGREE = EARTH * math.pi / 180


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres between two points; null if any coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * EARTH) * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))  # least() would turn a null into 1


def whole(value: Column) -> Column:
    """A number from 0 on rounded half up, as round() does, which goes through decimals for each row."""
    down = value.cast("bigint")
    return down + F.when(value - down >= 0.5, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def walk_minutes(metres: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(metres * 1.3 / 80 + 0.5)).cast("long")


def compass8(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Eight-point direction from the first point to the second."""
    x = (lng2 - lng1) * F.cos(F.radians((lat1 + lat2) / 2))
    angle = F.degrees(F.atan2(x, lat2 - lat1))
    points = F.array(*map(F.lit, ("N", "NE", "E", "SE", "S", "SW", "W", "NW")))
    return F.element_at(points, (F.pmod(F.floor(angle / 45 + 0.5), F.lit(8)) + 1).cast("int"))


def project(lat: Column, lng: Column, box: tuple[float, float, float, float], width: float) -> Column:
    """Struct of planar x and y in a box (south, west, north, east) that is width wide."""
    s, w, n, e = box
    k = math.cos(math.radians((s + n) / 2))
    scale = width / ((e - w) * k)
    return F.struct(((lng - w) * k * scale).alias("x"), ((F.lit(n) - lat) * scale).alias("y"))


def unproject(x: Column, y: Column, box: tuple[float, float, float, float], width: float) -> Column:
    s, w, n, e = box
    k = math.cos(math.radians((s + n) / 2))
    scale = width / ((e - w) * k)
    return F.struct((F.lit(n) - y / scale).alias("lat"), (x / (k * scale) + w).alias("lng"))


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float]) -> Column:
    s, w, n, e = box
    return lat.between(s, n) & lng.between(w, e)


def boxes_meet(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column], margin: float = 0.0) -> Column:
    """Whether two boxes (south, west, north, east) meet, one of them widened by a margin."""
    return (a[0] - margin <= b[2]) & (a[2] + margin >= b[0]) & (a[1] - margin <= b[3]) & (a[3] + margin >= b[1])


def distance_words(metres: Column) -> Column:
    """ "350 m" below a kilometre, miles with a decimal from there on."""
    return F.when(metres < 1000, F.concat(F.greatest(F.lit(10), F.floor(metres / 10 + 0.5) * 10).cast("long").cast("string"), F.lit(" m"))).otherwise(F.concat(F.round(metres / 1609.344, 1).cast("decimal(12,1)").cast("string"), F.lit(" mi")))


def ring_area(ring: Column) -> Column:
    """Area of a closed ring of (x, y), by the shoelace rule."""
    after = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    return F.abs(F.aggregate(F.zip_with(ring, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda a, v: a + v)) / 2


def path_length(path: Column) -> Column:
    """Length of a line of (x, y)."""
    step = F.zip_with(F.slice(path, 1, F.size(path) - 1), F.slice(path, 2, F.size(path) - 1), lambda p, q: F.sqrt(F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2)))
    return F.aggregate(step, F.lit(0.0), lambda a, v: a + v)


def ring_holds(x: Column, y: Column, ring: Column) -> Column:
    """Whether a ring of (x, y) holds a point, by the even-odd rule."""
    after = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, after, lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]))
    return F.size(F.filter(crosses, lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1


def sun_minutes(day_of_year: Column, lat: Column, lng: Column, rising: bool) -> Column:
    """UTC minutes of sunrise or sunset, by the solar-declination series, three fixed-point steps."""
    sign = 1.0 if rising else -1.0

    def bound(value: Column, use) -> Column:
        """use(value), with the value worked out once."""
        return F.transform(F.array(value), use)[0]

    def event(g: Column) -> Column:
        eqtime = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
        decl = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
        angle = lambda d: F.degrees(F.acos(F.lit(math.cos(math.radians(90.833))) / (F.cos(F.radians(lat)) * F.cos(d)) - F.tan(F.radians(lat)) * F.tan(d)))
        return F.lit(720.0) - 4 * (lng + sign * bound(decl, angle)) - eqtime

    def step(minutes: Column, _: Column) -> Column:
        return bound(F.lit(2 * math.pi / 365) * (day_of_year - 1 + (minutes / 60 - 12) / 24), event)

    return F.aggregate(F.sequence(F.lit(1), F.lit(3)), F.lit(720.0) - 4 * lng, step)
