"""Distances and geometry as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: The alphabet of geohashes.
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), value being evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along a great circle."""
    u, v = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    x = u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), x)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from 0 to 360 degrees."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def geohash(lat: Column, lon: Column, precision: int = 6) -> Column:
    """Geohash of a point: the bits of both cell numbers, interleaved, longitude first."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    cell = lambda v, low, span, n: F.least(F.greatest(F.floor((v - low) / span * 2**n), F.lit(0)), F.lit(2**n - 1)).cast("long")
    cells = F.struct(cell(lon, -180.0, 360.0, nx).alias("x"), cell(lat, -90.0, 180.0, ny).alias("y"))
    bit = lambda c, k: F.call_function("shiftright", c, F.lit(k)).bitwiseAND(1)

    def letters(c: Column) -> Column:
        out = []
        for k in range(precision):
            value = None
            for j in range(5):
                at = 5 * k + j
                b = bit(c["x"], nx - 1 - at // 2) if at % 2 == 0 else bit(c["y"], ny - 1 - at // 2)
                value = b if value is None else value * 2 + b
            out.append(F.substring(F.lit(GEOHASH), value.cast("int") + 1, F.lit(1)))
        return F.concat(*out)

    return F.when(lat.isNotNull() & lon.isNotNull(), let(cells, letters))


def quantised(value: Column, step: float) -> Column:
    return F.round(value / step) * step


def geohash_box(code: Column) -> Column:
    """The cell of a geohash as a struct of south, west, north and east; null where a letter is none of the alphabet's."""
    chars = F.filter(F.split(code, ""), lambda c: c != "")
    letters = F.transform(chars, lambda c: F.position(c, F.lit(GEOHASH)) - 1)
    bits = F.flatten(F.transform(letters, lambda c: F.transform(F.array(*(F.lit(k) for k in (4, 3, 2, 1, 0))), lambda k: F.call_function("shiftright", c, k).bitwiseAND(1))))
    start = F.struct(F.lit(-90.0).alias("south"), F.lit(-180.0).alias("west"), F.lit(90.0).alias("north"), F.lit(180.0).alias("east"), F.lit(True).alias("lon"))

    def halve(a: Column, bit: Column) -> Column:
        mid = F.when(a["lon"], (a["west"] + a["east"]) / 2).otherwise((a["south"] + a["north"]) / 2)
        pick = lambda which, one, value: F.when((a["lon"] == which) & (bit == one), mid).otherwise(value)
        return F.struct(pick(False, 1, a["south"]).alias("south"), pick(True, 1, a["west"]).alias("west"), pick(False, 0, a["north"]).alias("north"), pick(True, 0, a["east"]).alias("east"), (~a["lon"]).alias("lon"))

    box = F.aggregate(bits, start, halve, lambda a: F.struct(a["south"].alias("south"), a["west"].alias("west"), a["north"].alias("north"), a["east"].alias("east")))
    return F.when((F.size(chars) > 0) & F.forall(letters, lambda c: c >= 0), box)


def geohash_neighbours(code: Column, precision: int = 6) -> Column:
    """A cell and the cells around it, sorted: over the date line, and none beyond a pole."""

    def around(box: Column) -> Column:
        high, wide = box["north"] - box["south"], box["east"] - box["west"]
        lat, lon = (box["south"] + box["north"]) / 2, (box["west"] + box["east"]) / 2
        steps = F.array(*(F.struct(F.lit(dy).alias("y"), F.lit(dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
        points = F.transform(steps, lambda d: F.struct((lat + d["y"] * high).alias("y"), (F.pmod(lon + d["x"] * wide + 180.0, F.lit(360.0)) - 180.0).alias("x")))
        return F.array_sort(F.array_distinct(F.transform(F.filter(points, lambda p: (p["y"] > -90) & (p["y"] < 90)), lambda p: geohash(p["y"], p["x"], precision))))

    return let(geohash_box(code), lambda box: F.when(box.isNotNull(), around(box)))


def line_length(line: Column) -> Column:
    """Metres along a line, an array of structs of lat and lon."""
    steps = F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda i: haversine(F.get(line, i - 1)["lat"], F.get(line, i - 1)["lon"], F.get(line, i)["lat"], F.get(line, i)["lon"]))
    return F.when(F.size(line) < 2, F.lit(0.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda a, x: a + x))


def steepest(line: Column, least_m: float = 5.0, cap: float = 60.0) -> Column:
    """The steepest of a line's steps longer than `least_m`, in degrees, at most `cap`; points have an elevation."""
    step = lambda i: F.struct(haversine(F.get(line, i - 1)["lat"], F.get(line, i - 1)["lon"], F.get(line, i)["lat"], F.get(line, i)["lon"]).alias("h"), F.abs(F.get(line, i)["elevation"] - F.get(line, i - 1)["elevation"]).alias("v"))
    steps = F.filter(F.transform(F.sequence(F.lit(1), F.size(line) - 1), step), lambda s: s["h"] > least_m)
    grades = F.transform(steps, lambda s: F.degrees(F.atan2(s["v"], s["h"])))
    return F.when(F.size(line) < 2, F.lit(0.0)).otherwise(F.least(F.coalesce(F.array_max(grades), F.lit(0.0)), F.lit(cap)))


def cut_corners(line: Column) -> Column:
    """A line with each corner cut at a quarter and three quarters of its steps, both ends kept."""
    at = lambda a, b, t: F.struct((a["lat"] * (1 - t) + b["lat"] * t).alias("lat"), (a["lon"] * (1 - t) + b["lon"] * t).alias("lon"))
    steps = F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda i: F.array(at(F.get(line, i - 1), F.get(line, i), 0.25), at(F.get(line, i - 1), F.get(line, i), 0.75)))
    return F.when(F.size(line) > 2, F.concat(F.slice(line, 1, 1), F.flatten(steps), F.slice(line, -1, 1))).otherwise(line)


def smoothed_line(line: Column, rounds: int = 2) -> Column:
    """A line with its corners cut so many times; lines of up to two points as they are."""
    line = F.transform(line, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    for _ in range(rounds):
        line = let(line, cut_corners)
    return line


def to_segment(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres from a point to a segment, in the plane that touches the earth at the segment's beginning."""
    kx, ky = F.cos(F.radians(lat1)) * (EARTH_M * 3.141592653589793 / 180), EARTH_M * 3.141592653589793 / 180
    px, py, sx, sy = (lon - lon1) * kx, (lat - lat1) * ky, (lon2 - lon1) * kx, (lat2 - lat1) * ky
    size = sx * sx + sy * sy
    t = F.when(size > 0, F.least(F.greatest((px * sx + py * sy) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.sqrt((px - t * sx) * (px - t * sx) + (py - t * sy) * (py - t * sy))


def tile(lat: Column, lon: Column, zoom: int) -> Column:
    """Web Mercator tile of a point, as a struct of x and y."""
    n = float(2**zoom)
    x = F.floor((lon + 180.0) / 360.0 * n)
    y = F.floor((1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / 3.141592653589793) / 2 * n)
    return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))


def dem_metres(red: Column, green: Column, blue: Column) -> Column:
    """Elevation that a terrain tile's pixel stands for."""
    return -10000 + 0.1 * (red * 65536 + green * 256 + blue)


def sun_position(at: Column, lat: Column, lon: Column, offset_hours: Column) -> Column:
    """The sun's height and azimuth in degrees, from the day of the year and the clock at `offset_hours` from UTC."""
    day = F.dayofyear(at).cast("double")
    b = F.radians((day - 81) * 360.0 / 365.0)
    equation = 9.87 * F.sin(2 * b) - 7.53 * F.cos(b) - 1.5 * F.sin(b)
    clock = F.hour(at) + F.minute(at) / 60.0 + offset_hours
    solar = clock + (4 * (lon - 15 * offset_hours) + equation) / 60
    tilt = F.radians(23.45 * F.sin(F.radians((284 + day) * 360.0 / 365.0)))
    angle, y = F.radians((solar - 12) * 15), F.radians(lat)
    height = F.asin(F.sin(y) * F.sin(tilt) + F.cos(y) * F.cos(tilt) * F.cos(angle))
    toward = F.acos(F.least(F.greatest((F.sin(tilt) - F.sin(height) * F.sin(y)) / (F.cos(height) * F.cos(y)), F.lit(-1.0)), F.lit(1.0)))
    return F.struct(F.degrees(height).alias("height"), F.when(F.sin(angle) > 0, 360 - F.degrees(toward)).otherwise(F.degrees(toward)).alias("azimuth"))
