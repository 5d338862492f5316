"""Feeds and files about resorts: map extracts, status pages, curated lists, snapshots and backups. Nothing is fetched."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import haversine

OSM = "elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>>"
#: Aerial ways that are no lifts.
NO_LIFTS = ("station", "zip_line", "pylon")


def overpass(texts: DataFrame) -> DataFrame:
    """Trails and lifts of map extracts texts(resort_id, json): ways with two resolved points or more, in order, and whether they are open."""
    e = texts.select("resort_id", F.explode(F.from_json("json", OSM)["elements"]).alias("e")).select("resort_id", "e.*")
    nodes = e.where("type = 'node'").select("resort_id", F.col("id").alias("node"), "lat", "lon")
    t = F.col("tags")
    kind = F.when(t["piste:type"] == "downhill", "trail").when(t["aerialway"].isNotNull() & ~t["aerialway"].isin(*NO_LIFTS), "lift")
    ways = e.where("type = 'way'").withColumn("kind", kind).where("kind IS NOT NULL")
    met = ways.select("resort_id", "id", "kind", "tags", F.posexplode("nodes").alias("i", "node")).join(nodes, ["resort_id", "node"])
    line = F.transform(F.array_sort(F.collect_list(F.struct("i", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    out = met.groupBy("resort_id", "id", "kind").agg(line.alias("line"), F.first("tags").alias("tags")).where("size(line) >= 2")
    return out.select("resort_id", "id", "kind", "line", t["name"].alias("name"), t["piste:difficulty"].alias("difficulty"), (~F.coalesce(t["piste:status"] == "closed", F.lit(False))).alias("is_open"))


def object_after(text: str, marker: str) -> str | None:
    """The JSON object that follows a marker inside other text: braces are balanced outside of strings."""
    start = text.find("{", text.find(marker)) if marker in text else -1
    depth, quoted, escaped = 0, False, False
    for k in range(max(start, 0), len(text) if start >= 0 else 0):
        c = text[k]
        if quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : k + 1]
    return None


def terrain_feed(pages: DataFrame, marker: str = "TerrainStatusFeed") -> DataFrame:
    """Trails and lifts of status pages(resort_id, html) that hold an object with areas."""

    @F.pandas_udf("string")
    def cut(html: pd.Series) -> pd.Series:
        return html.map(lambda x: object_after(x or "", marker))

    item = "array<struct<Name:string,IsOpen:boolean,Difficulty:string>>"
    rows = pages.select("resort_id", F.explode(F.from_json(cut("html"), f"GroomingAreas array<struct<Name:string,Trails:{item},Lifts:{item}>>")["GroomingAreas"]).alias("a"))
    part = lambda kind, c: rows.select("resort_id", F.col("a.Name").alias("area"), F.lit(kind).alias("kind"), F.explode(F.col(f"a.{c}")).alias("x")).select("resort_id", "area", "kind", F.col("x.Name").alias("name"), F.col("x.IsOpen").alias("is_open"))
    return part("trail", "Trails").unionByName(part("lift", "Lifts"))


def resort_feed(texts: DataFrame) -> DataFrame:
    """Trails of feeds texts(json) of several resorts: the first of each name, flags as yes or no, unknown difficulties blue."""
    trail = "array<struct<Name:string,Difficulty:string,StatusEnglish:string,Groomed:string>>"
    schema = f"Resorts array<struct<Name:string,MountainAreas:array<struct<Name:string,Trails:{trail}>>>>"
    rows = texts.select(F.explode(F.from_json("json", schema)["Resorts"]).alias("r")).select(F.col("r.Name").alias("resort"), F.posexplode("r.MountainAreas").alias("i", "a")).select("resort", "i", F.posexplode("a.Trails").alias("k", "t"))
    once = rows.groupBy("resort", F.col("t.Name").alias("name")).agg(F.min_by("t", F.struct("i", "k")).alias("t"))
    difficulty = F.lower(F.regexp_replace("t.Difficulty", "[^A-Za-z]", ""))
    known = F.when(difficulty.isin("green", "blue", "black", "doubleblack"), difficulty).otherwise("blue")
    return once.select("resort", "name", known.alias("difficulty"), (F.lower("t.StatusEnglish") == "open").alias("is_open"), (F.lower("t.Groomed") == "yes").alias("groomed"))


def lift_status(texts: DataFrame) -> DataFrame:
    """(slug, lift, status) of status feeds texts(slug, json)."""
    return texts.select("slug", F.explode(F.from_json("json", "lifts struct<status:map<string,string>>")["lifts"]["status"]).alias("lift", "status"))


def hourly(texts: DataFrame) -> DataFrame:
    """Hours of weather texts(resort_id, json) that hold parallel arrays, up to the end of the shortest; kilometres and centimetres."""
    names = {"time": "string", "temperature_2m": "double", "snowfall": "double", "wind_speed_10m": "double", "visibility": "double"}
    h = F.from_json("json", f"hourly struct<{','.join(f'{k}:array<{v}>' for k, v in names.items())}>")["hourly"]
    rows = texts.select("resort_id", h.alias("h"))
    n = F.least(*(F.size(f"h.{k}") for k in names))
    zipped = F.arrays_zip(*(F.slice(F.col(f"h.{k}"), F.lit(1), n) for k in names))
    x = rows.where(n > 0).select("resort_id", F.posexplode(zipped).alias("i", "x"))
    at = lambda k: F.col("x")[str(k)]
    return x.select("resort_id", "i", at(0).alias("time"), at(1).alias("temperature_c"), at(2).alias("snowfall_cm"), at(3).alias("wind_kph"), (at(4) / 1000).alias("visibility_km"))


def official_items(spark: SparkSession, csv: str | None, items: str | None) -> DataFrame:
    """Items of an official list; JSON goes before CSV, in which ids are separated by bars. Their confidence is full."""
    if items is not None:
        rows = spark.read.schema("name string, kind string, osm_way_ids array<string>").json(items)
    else:
        rows = spark.read.schema("name string, kind string, osm_way_ids string").csv(csv, header=True).withColumn("osm_way_ids", F.split("osm_way_ids", r"\|"))
    return rows.withColumn("source", F.lit("official")).withColumn("confidence", F.lit(1.0))


def area_of(resorts: DataFrame, areas: DataFrame, km: float = 5.0) -> DataFrame:
    """(id, area): the area of the resort's name, else one whose name holds it or is held by it, else the nearest within so many kilometres."""
    a = areas.select(F.col("id").alias("area"), F.lower("name").alias("an"), F.col("lat").alias("alat"), F.col("lon").alias("alon"))
    r = resorts.select("id", F.lower("name").alias("rn"), "lat", "lon")
    d = haversine(F.col("lat"), F.col("lon"), F.col("alat"), F.col("alon"))
    rank = F.when(F.col("rn") == F.col("an"), 0).when(F.contains("rn", "an") | F.contains("an", "rn"), 1).when(d <= km * 1000, 2)
    met = r.join(F.broadcast(a), rank.isNotNull(), "left") if areas.count() <= 10_000 else r.join(a, rank.isNotNull(), "left")
    return met.groupBy("id").agg(F.min_by("area", F.struct(rank, d, "area")).alias("area"))


def graph_blobs(blobs: DataFrame) -> DataFrame:
    """(path, json, sha256) of compressed graphs blobs(path, content): raw deflate; what does not unpack has no text."""

    def unpack(data: bytes) -> str | None:
        try:
            return zlib.decompress(data, -15).decode()
        except (zlib.error, UnicodeDecodeError):
            return None

    @F.pandas_udf("string")
    def text(data: pd.Series) -> pd.Series:
        return data.map(unpack)

    return blobs.select("path", text("content").alias("json"), F.sha2("content", 256).alias("sha256"))


def packed_graphs(graphs: DataFrame) -> DataFrame:
    """The reverse: graphs(path, json) as raw deflate, with its digest for the index."""

    @F.pandas_udf("binary")
    def pack(x: pd.Series) -> pd.Series:
        def one(s: str) -> bytes:
            c = zlib.compressobj(wbits=-15)
            return c.compress(s.encode()) + c.flush()

        return x.map(one)

    return graphs.select("path", pack("json").alias("content")).withColumn("sha256", F.sha2("content", 256))


def graph_nodes(blobs: DataFrame) -> DataFrame:
    """(path, id, lat, lon, elevation) of the nodes of graph_blobs()."""
    node = "struct<lat:double,lon:double,elevation:double>"
    return blobs.select("path", F.explode(F.from_json("json", f"nodes map<string,{node}>")["nodes"]).alias("id", "n")).select("path", "id", "n.*")


def backups(texts: DataFrame) -> DataFrame:
    """Profile and runs of backups texts(path, json) of any version: a wrapper, or a bare profile without runs."""
    profile, run = "struct<id:bigint,display_name:string>", "array<struct<dedup_hash:string,speed_ms:double>>"
    x = F.from_json("json", f"version int, profile {profile}, runs {run}, id bigint, display_name string")
    rows = texts.select("path", x.alias("x"))
    return rows.select("path", F.coalesce("x.version", F.lit(0)).alias("version"), F.coalesce("x.profile.id", "x.id").alias("id"), F.coalesce("x.profile.display_name", "x.display_name").alias("display_name"), F.coalesce("x.runs", F.array().cast(run)).alias("runs"))


def curated(spark: SparkSession, folder: str) -> DataFrame:
    """Curated files of resorts; every list may be missing."""
    item = "array<struct<id:string,name:string,difficulty:string>>"
    return spark.read.schema(f"resortId string, version int, trails {item}, lifts {item}, trailWhitelist array<string>, liftWhitelist array<string>").option("multiLine", True).json(folder)


def boxes(catalog: DataFrame) -> DataFrame:
    """Boxes of resorts(id, lat, lon, lat_span, lon_span)."""
    side = lambda c, s, sign: (F.col(c) + sign * F.col(s) / 2)
    return catalog.select("id", side("lat", "lat_span", -1).alias("min_lat"), side("lat", "lat_span", 1).alias("max_lat"), side("lon", "lon_span", -1).alias("min_lon"), side("lon", "lon_span", 1).alias("max_lon"))


def elevations(points: DataFrame, service: DataFrame, fallback: DataFrame) -> DataFrame:
    """points(lat, lon) with the elevation that one table has for them, else another; those of -500 m or below are none."""
    key = lambda: F.format_string("%.6f,%.6f", F.col("lat"), F.col("lon"))
    table = lambda t, n: t.where("elevation > -500").groupBy(key().alias("key")).agg(F.max("elevation").alias(n))
    return points.withColumn("key", key()).join(table(service, "a"), "key", "left").join(table(fallback, "b"), "key", "left").select(*points.columns, F.coalesce("a", "b").alias("elevation"))
