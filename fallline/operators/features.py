"""Rows of map features: properties as columns, and GeoJSON text made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from .meeting import lapse, signal


def point(lat: Column, lon: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def line_string(line: Column) -> Column:
    return F.struct(F.lit("LineString").alias("type"), F.transform(line, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))


def feature(geometry: Column, *properties: str) -> Column:
    """A GeoJSON feature."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def label(name: Column, vertical: Column, named_from: float, unnamed_from: float) -> Column:
    """A name with its metres of height where they are many enough; an unnamed one has them alone."""
    metres = F.concat(F.floor(vertical + 0.5).cast("string"), F.lit("m"))
    return F.when(name.isNotNull() & (vertical >= named_from), F.concat(name, F.lit(" · "), metres)).when(name.isNotNull(), name).when(vertical >= unnamed_from, metres).otherwise("")


def trails(edges: DataFrame) -> DataFrame:
    """One row for each trail group: sums, the mean gradient, and whether any of it is open."""
    rows = edges.where("kind = 'run'").groupBy("trail_group").agg(F.min("name").alias("name"), F.sum("length_m").alias("length_m"), F.sum("vertical_m").alias("vertical_m"), F.max("gradient").alias("steepest"), F.bool_or("is_open").alias("open"), F.bool_or("moguls").alias("moguls"))
    return rows.withColumn("mean_deg", F.degrees(F.atan2("vertical_m", "length_m"))).withColumn("label", label(F.col("name"), F.col("vertical_m"), 8, 20))


def lifts(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'lift'").select("id", "is_open", "length_m", label(F.col("name"), F.col("vertical_m"), 8, 15).alias("label"))


def cabins(edges: DataFrame) -> DataFrame:
    """Cabins along open lifts of more than 100 m, one to four, evenly apart."""
    n = F.least(F.greatest(F.floor(F.col("length_m") / 250), F.lit(1)), F.lit(4)).cast("int")
    rows = edges.where("kind = 'lift' AND is_open AND length_m > 100").select("id", n.alias("n"))
    return rows.select("id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select("id", "i", (F.col("i") / F.col("n")).alias("phase"))


def friends(positions: DataFrame, nodes: DataFrame, as_of_s: float) -> DataFrame:
    """Friends seen in the last three hours: class, opacity, initials, where they are, and accuracy from 20 m on."""
    rows = positions.withColumn("age", as_of_s - F.col("at_s")).where(F.col("age") <= 3 * 3600).join(nodes.select(F.col("id").alias("node"), F.col("lat").alias("nlat"), F.col("lon").alias("nlon")), "node", "left")
    kind = signal(F.col("age"))
    opacity = F.when(kind == "live", 1.0).when(kind == "stale", 0.75).otherwise(0.45)
    return rows.select("user_id", kind.alias("signal"), opacity.alias("opacity"), text.initials(F.col("name")).alias("initials"), F.coalesce("nlat", "lat").alias("lat"), F.coalesce("nlon", "lon").alias("lon"), F.when(F.col("accuracy_m") >= 20, F.col("accuracy_m")).alias("accuracy_m"))


def traverse_groups(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'traverse'").groupBy("trail_group").agg(F.count("*").alias("n"), F.sum("length_m").alias("length_m"), F.sum("vertical_m").alias("vertical_m"))


def dead_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("id").join(edges.where("is_open").select(F.col("source").alias("id")).distinct(), "id", "left_anti")


def phantoms(edges: DataFrame, validated: Column) -> DataFrame:
    return edges.where(~F.col("is_open") & ~validated & F.col("name").isNotNull() & F.col("kind").isin("run", "lift"))


def place_key(lat: Column, lon: Column) -> Column:
    """Coordinates cut to 1e-4 degrees, toward zero."""
    return F.concat_ws(",", (lat * 10_000).cast("long").cast("string"), (lon * 10_000).cast("long").cast("string"))


def points_of_interest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The highest node, the lowest node of a lift, and both ends of named lifts, one for each place, the former first."""
    lift = edges.where("kind = 'lift'")
    at = lift.select(F.explode(F.array("source", "target")).alias("id")).distinct().join(nodes, "id")
    named = lift.where("name IS NOT NULL").select("name", F.explode(F.array(F.struct(F.lit("base").alias("kind"), F.col("source").alias("id")), F.struct(F.lit("top").alias("kind"), F.col("target").alias("id")))).alias("x")).select("name", "x.kind", "x.id").join(nodes, "id")
    row = F.struct("id", "lat", "lon")
    peak = nodes.agg(F.max_by(row, F.struct("elevation", -F.col("id"))).alias("x")).select("x.*", F.lit("summit").alias("kind"), F.lit(0).alias("rank"))
    foot = at.agg(F.min_by(row, F.struct("elevation", "id")).alias("x")).select("x.*", F.lit("base_area").alias("kind"), F.lit(1).alias("rank"))
    rest = named.select("id", "lat", "lon", "kind", F.lit(2).alias("rank"))
    every = peak.unionByName(foot).unionByName(rest).where("id IS NOT NULL").withColumn("place", place_key(F.col("lat"), F.col("lon")))
    return every.groupBy("place").agg(F.min_by(F.struct("id", "kind"), F.struct("rank", "id", "kind")).alias("x")).select("place", "x.id", "x.kind")


def lift_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each place where a lift begins or ends."""
    every = edges.where("kind = 'lift'").select(F.explode(F.array("source", "target")).alias("id")).distinct().join(nodes, "id").withColumn("place", place_key(F.col("lat"), F.col("lon")))
    return every.groupBy("place").agg(F.min("id").alias("id"))


def temperatures(edges: DataFrame, nodes: DataFrame, base_c: float, base_m: float) -> DataFrame:
    """The temperature of each trail group at the mean height of its edges' ends, to a tenth."""
    n = nodes.select("id", "elevation")
    both = edges.where("kind = 'run'").join(n.select(F.col("id").alias("source"), F.col("elevation").alias("a")), "source").join(n.select(F.col("id").alias("target"), F.col("elevation").alias("b")), "target")
    mean = both.groupBy("trail_group").agg(F.avg((F.col("a") + F.col("b")) / 2).alias("m"))
    return mean.select("trail_group", F.round(lapse(F.lit(base_c), F.col("m"), F.lit(base_m)), 1).alias("temperature_c"))


def sun_colours(groups: DataFrame, exposure: Column) -> DataFrame:
    """Each group's share of sun as a colour from blue to red."""
    red = F.floor(exposure * 255 + 0.5).cast("int")
    return groups.withColumn("colour", F.format_string("#%02X40%02X", red, 255 - red))


def route(line: Column, forward: Column) -> Column:
    """A route's line in its direction, with its corners cut."""
    return geo.smoothed_line(F.when(forward, line).otherwise(F.reverse(line)))


def amenities(places: DataFrame) -> DataFrame:
    """Places with their kind by the first tag that tells, and a name for those without one; one row for each id."""
    kind = F.when(F.col("tags")["amenity"].isin("restaurant", "cafe", "bar", "fast_food"), "food").when(F.col("tags")["amenity"] == "toilets", "toilets").when(F.col("tags")["amenity"] == "parking", "parking").when(F.col("tags")["emergency"].isNotNull(), "first_aid").when(F.col("tags")["shop"].isNotNull(), "shop").otherwise("other")
    rows = places.withColumn("kind", kind).withColumn("label", F.coalesce(F.col("tags")["name"], F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))))
    return rows.groupBy("id").agg(F.min_by(F.struct("kind", "label"), "ordinal").alias("x")).select("id", "x.kind", "x.label")
