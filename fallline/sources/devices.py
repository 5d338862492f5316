"""Recordings of devices: FIT, TCX, SQLite and archive metadata, read into points and laps.

Each reader takes binaries(path, content) and gives rows per file, as a file is what one device wrote.
"""

from __future__ import annotations

import sqlite3
import struct
import tempfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the FIT format: its epoch, units of angle, the numbers of messages and of their fields.
FIT_EPOCH = 631_065_600
DEGREES = 180.0 / 2**31
RECORD, LAP = 20, 21
RECORD_FIELDS = {0: "lat", 1: "lon", 2: "alt", 6: "speed", 73: "alt_fine", 253: "time"}
LAP_FIELDS = {2: "start", 7: "elapsed", 9: "distance", 13: "avg_speed", 14: "max_speed", 22: "descent"}
SIGNED = {"lat", "lon"}
#: Queries for the tables that known applications write, the first with rows being taken.
SQLITE_NAMES = {"ts": ("timestamp", "time", "ts", "zdate", "ztimestamp", "date"), "lat": ("latitude", "lat", "zlatitude"), "lon": ("longitude", "lon", "lng", "zlongitude"), "elevation": ("altitude", "elevation", "alt", "zaltitude"), "speed": ("speed", "zspeed")}

FIT_POINTS = "path string, seq int, lat double, lon double, elevation double, at_s long, speed double"
FIT_LAPS = "path string, lap int, start_s long, elapsed_s double, distance_m double, avg_ms double, max_ms double, descent_m double"
TCX_LAPS = "path string, lap int, start string, seconds double, distance_m double, max_ms double, avg_ms double"
TCX_POINTS = "path string, lap int, seq int, ts string, lat double, lon double, elevation double, speed double"
SQLITE_POINTS = "path string, seq int, ts double, lat double, lon double, elevation double, speed double"
ACTIONS = "path string, kind string, start string, stop string, attributes map<string,string>"


def fit_messages(data: bytes) -> Iterator[tuple[int, dict[int, bytes], str]]:
    """(message, {field: bytes}, byte order) of each data message; what is cut off ends the file."""
    if len(data) < 14 or data[8:12] != b".FIT":
        return
    known: dict[int, tuple[int, str, list[tuple[int, int]], int]] = {}
    at, end = data[0], len(data) - 2  # a checksum comes last
    while at < end:
        head, at = data[at], at + 1
        if head & 0x80:  # a compressed time stamp: its message is passed over
            if (kind := head >> 5 & 3) in known:
                at += sum(n for _, n in known[kind][2]) + known[kind][3]
        elif head & 0x40:
            if at + 5 > end:
                return
            order = "<" if data[at + 1] == 0 else ">"
            (number,) = struct.unpack_from(order + "H", data, at + 2)
            count, at = data[at + 4], at + 5
            fields = [(data[at + 3 * k], data[at + 3 * k + 1]) for k in range(count) if at + 3 * k + 3 <= len(data)]
            at, extra = at + 3 * count, 0
            if head & 0x20 and at < len(data):  # fields of a developer are passed over
                more, at = data[at], at + 1
                extra = sum(data[at + 3 * k + 1] for k in range(more) if at + 3 * k + 3 <= len(data))
                at += 3 * more
            known[head & 15] = (number, order, fields, extra)
        else:
            if head & 15 not in known:
                return
            number, order, fields, extra = known[head & 15]
            got, pos = {}, at
            for field, size in fields:
                if pos + size > len(data):
                    return
                got[field] = data[pos : pos + size]
                pos += size
            at = pos + extra
            yield number, got, order


def fit_values(fields: dict[int, bytes], order: str, names: dict[int, str]) -> dict[str, int]:
    """The numbers of fields that are there and valid: the largest number of a size stands for none."""
    out = {}
    for number, name in names.items():
        raw = fields.get(number, b"")
        if len(raw) in (2, 4):
            signed = name in SIGNED
            value = int.from_bytes(raw, "little" if order == "<" else "big", signed=signed)
            if value != (1 << 8 * len(raw) - signed) - 1:
                out[name] = value
    return out


def per_file(binaries: DataFrame, schema: str, read) -> DataFrame:
    """read(content) -> rows, with the path before each."""
    names = [x.split()[0] for x in schema.replace("map<string,string>", "map").split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame([(path, *row) for row in read(bytes(content or b""))], columns=names, dtype=object)

    return binaries.select("path", "content").mapInPandas(run, schema)


def fit_points(binaries: DataFrame) -> DataFrame:
    """Points of FIT files; those without a position are left out."""

    def read(data: bytes) -> Iterator[tuple]:
        seq = 0
        for number, fields, order in fit_messages(data):
            v = fit_values(fields, order, RECORD_FIELDS) if number == RECORD else {}
            if "lat" in v and "lon" in v:
                alt = v.get("alt_fine", v.get("alt"))
                yield seq, v["lat"] * DEGREES, v["lon"] * DEGREES, None if alt is None else alt / 5 - 500, v["time"] + FIT_EPOCH if "time" in v else None, v["speed"] / 1000 if "speed" in v else None
                seq += 1

    return per_file(binaries, FIT_POINTS, read)


def fit_laps(binaries: DataFrame) -> DataFrame:
    """Laps of FIT files; those without a beginning or a length of time are left out."""

    def read(data: bytes) -> Iterator[tuple]:
        lap = 0
        for number, fields, order in fit_messages(data):
            v = fit_values(fields, order, LAP_FIELDS) if number == LAP else {}
            if "start" in v and "elapsed" in v:
                part = lambda k, by, v=v: v[k] / by if k in v else None
                yield lap, v["start"] + FIT_EPOCH, v["elapsed"] / 1000, part("distance", 100), part("avg_speed", 1000), part("max_speed", 1000), part("descent", 1.0)
                lap += 1

    return per_file(binaries, FIT_LAPS, read)


def tag(node) -> str:
    return node.tag.rpartition("}")[2]


def number(x: str | None) -> float | None:
    try:
        return float(x) if x else None
    except ValueError:
        return None


def tcx_tree(data: bytes) -> list:
    try:
        return [x for x in ElementTree.fromstring(data).iter() if tag(x) == "Lap"]
    except ElementTree.ParseError:
        return []


def own(node, name: str) -> str | None:
    return next(((x.text or "").strip() for x in node if tag(x) == name), None)


def tcx_laps(binaries: DataFrame) -> DataFrame:
    """Laps of TCX files, with the mean speed where distance and time are there."""

    def read(data: bytes) -> Iterator[tuple]:
        for k, lap in enumerate(tcx_tree(data)):
            s, m = number(own(lap, "TotalTimeSeconds")), number(own(lap, "DistanceMeters"))
            yield k, lap.get("StartTime"), s, m, number(own(lap, "MaximumSpeed")), m / s if s and m and s > 0 and m > 0 else None

    return per_file(binaries, TCX_LAPS, read)


def tcx_points(binaries: DataFrame) -> DataFrame:
    """Points of TCX files; a speed counts only inside extensions."""

    def read(data: bytes) -> Iterator[tuple]:
        for k, lap in enumerate(tcx_tree(data)):
            seq = 0
            for p in (x for x in lap.iter() if tag(x) == "Trackpoint"):
                place = next((x for x in p if tag(x) == "Position"), None)
                lat, lon = (number(own(place, n)) if place is not None else None for n in ("LatitudeDegrees", "LongitudeDegrees"))
                if lat is None or lon is None:
                    continue
                speed = next((number(y.text) for x in p if tag(x) == "Extensions" for y in x.iter() if tag(y) == "Speed"), None)
                yield k, seq, own(p, "Time"), lat, lon, number(own(p, "AltitudeMeters")), speed
                seq += 1

    return per_file(binaries, TCX_POINTS, read)


def sqlite_points(binaries: DataFrame) -> DataFrame:
    """Points of SQLite files, from the first table, those named like locations before others, whose columns tell time and place."""

    def read(data: bytes) -> Iterator[tuple]:
        with tempfile.NamedTemporaryFile() as f:  # the library reads files only; this one lives as long as the call
            f.write(data)
            f.flush()
            try:
                db = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
                found = db.execute("SELECT m.name, p.name FROM sqlite_master m JOIN pragma_table_info(m.name) p WHERE m.type = 'table'").fetchall()
            except sqlite3.DatabaseError:
                return
            tables: dict[str, list[str]] = {}
            for table, column in found:
                tables.setdefault(table, []).append(column)
            likely = sorted(tables, key=lambda t: (not any(w in t.lower() for w in ("location", "gps", "point", "track")), t))
            for table in likely:
                low = {c.lower(): c for c in tables[table]}
                pick = {k: next((low[n] for n in names if n in low), None) for k, names in SQLITE_NAMES.items()}
                if not (pick["ts"] and pick["lat"] and pick["lon"]):
                    continue
                quoted = lambda c: "NULL" if c is None else '"' + c.replace('"', '""') + '"'
                rows = db.execute(f"SELECT {', '.join(quoted(pick[k]) for k in SQLITE_NAMES)} FROM {quoted(table)} ORDER BY 1").fetchall()
                if rows:
                    yield from ((k, *(None if v is None else float(v) for v in row)) for k, row in enumerate(rows))
                    break
            db.close()

    return per_file(binaries, SQLITE_POINTS, read)


def actions(binaries: DataFrame) -> DataFrame:
    """Runs and lifts of an archive's metadata; actions without both dates are left out."""

    def read(data: bytes) -> Iterator[tuple]:
        try:
            nodes = ElementTree.fromstring(data).iter()
        except ElementTree.ParseError:
            return
        for x in nodes:
            if tag(x).lower() == "action" and x.get("start") and x.get("end"):
                kind = (x.get("type") or "").lower()
                yield kind if kind in ("run", "lift") else "unknown", x.get("start"), x.get("end"), dict(x.attrib)

    rows = per_file(binaries, ACTIONS, read)
    at = lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss Z"))
    return rows.select("path", "kind", at(F.col("start")).alias("start"), at(F.col("stop")).alias("stop"), "attributes").where("start IS NOT NULL AND stop IS NOT NULL")


def workouts(health: DataFrame, since=None) -> DataFrame:
    """Downhill workouts of a health store's export, newest first, with the key of each; those without a route are left out."""
    rows = health.where(F.col("activity").isin("downhillSkiing", "snowboarding") & (F.size("route") > 0))
    rows = rows if since is None else rows.where(F.col("start") >= since)
    return rows.withColumn("key", F.concat(F.lit("healthkit:"), "uuid", F.lit(":"), F.size("route").cast("string"))).orderBy(F.desc("start"))
