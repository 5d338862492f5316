"""Recorded activities: formats told apart, and tracks read into points."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "path string, segment int, seq int, lat double, lon double, elevation double, ts timestamp, speed double"
CSV = "ts double, lat double, lon double, elevation double, course double, speed double"
EXTENSIONS = ("gpx", "tcx", "fit", "slopes")


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def kind(path: Column, content: Column) -> Column:
    """The format by extension, else by the first bytes."""
    by_name = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    head = F.lower(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"))
    found = F.when(F.substring(head, 9, 4) == ".fit", "fit").when(F.startswith(head, F.lit("sqlite format 3")), "sqlite").when(F.startswith(head, F.lit("pk")), "zip")
    backup = F.contains(head, F.lit('"profile"')) & F.contains(head, F.lit('"version"'))
    found = found.when(backup, "backup")
    return F.when(by_name.isin(*EXTENSIONS), by_name).otherwise(found.when(F.contains(head, F.lit("<gpx")), "gpx").when(F.contains(head, F.lit("<trainingcenterdatabase")), "tcx").otherwise("unknown"))


def _number(text: str | None) -> float | None:
    try:
        return float(text) if text else None
    except ValueError:
        return None


def gpx_points(data: bytes) -> Iterator[tuple]:
    """(segment, seq, lat, lon, elevation, time, speed); what was read before an error is kept."""
    parser, segment, seq = ElementTree.XMLPullParser(["start", "end"]), -1, 0
    try:
        parser.feed(data)
    except ElementTree.ParseError:
        pass
    try:
        for event, node in parser.read_events():
            tag = node.tag.rpartition("}")[2]
            if event == "start" and tag == "trkseg":
                segment, seq = segment + 1, 0
            if event == "end" and tag == "trkpt":
                child = {x.tag.rpartition("}")[2]: (x.text or "").strip() for x in node.iter()}
                lat, lon, speed = _number(node.get("lat")), _number(node.get("lon")), _number(child.get("speed"))
                if lat is not None and lon is not None:
                    yield segment, seq, lat, lon, _number(child.get("ele")), child.get("time") or None, speed if speed is not None and speed >= 0 else None
                    seq += 1
    except ElementTree.ParseError:
        return


def tracks(binaries: DataFrame) -> DataFrame:
    """Points of GPX files of binaries(path, content), one row each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                got = pd.DataFrame([(path, *p) for p in gpx_points(content or b"")], columns=["path", "segment", "seq", "lat", "lon", "elevation", "ts", "speed"])
                got["ts"] = pd.to_datetime(got["ts"], errors="coerce", utc=True, format="ISO8601").dt.tz_localize(None)
                yield got

    return binaries.select("path", "content").mapInPandas(run, POINTS)


def zipped(binaries: DataFrame, most: int = 256 << 20) -> DataFrame:
    """(path, name, content, problem) of the members of archives; one that is too large, encrypted or packed otherwise has a problem and no content."""

    def member(z: zipfile.ZipFile, x: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        problem = "encrypted" if x.flag_bits & 1 else "method" if x.compress_type not in (0, 8) else "size" if x.file_size > most else None
        return (None, problem) if problem else (z.read(x), None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "name", "content", "problem"]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for x in z.infolist():  # a member at a time
                            yield pd.DataFrame([(path, x.filename, *member(z, x))], columns=names)
                except zipfile.BadZipFile:
                    yield pd.DataFrame([(path, None, None, "no archive")], columns=names)

    return binaries.select("path", "content").mapInPandas(run, "path string, name string, content binary, problem string")


def gps_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a GPS table with comments, times decoded; those off the globe or within a hundredth of a degree of a zero line are dropped, negative speeds are none."""
    from ..operators.filters import decoded_time

    rows = spark.read.csv(path, schema=CSV, comment="#")
    fine = rows.where("abs(lat) > 0.01 AND abs(lon) > 0.01 AND abs(lat) <= 90 AND abs(lon) <= 180")
    return fine.withColumn("speed", F.when(F.col("speed") >= 0, F.col("speed"))).withColumn("at_s", decoded_time(F.col("ts")))
