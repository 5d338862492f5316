"""Ordered-sequence operators: one window shuffle on the key each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine

ORDER = ("ts", "event_id")


def deltas(fixes: DataFrame) -> DataFrame:
    """Seconds, metres and descent since the previous fix; descents of a metre or less count as none."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    prev = lambda c: F.lag(c).over(w)
    drop = prev("elevation") - F.col("elevation")
    return fixes.select("user_id", "event_id", "ts", "lat", "lon", "elevation", "speed",
        ((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(prev("ts").cast("timestamp"))) / 1e6).alias("dt"),
        haversine(prev("lat"), prev("lon"), F.col("lat"), F.col("lon")).alias("metres"), F.when(drop > 1, drop).otherwise(0.0).alias("descent"))


def sessions(fixes: DataFrame, gap_s: float = 90.0, lift_gain: float = 8.0, lift_speed: float = 5.5) -> DataFrame:
    """Runs and lifts: a fix is on a lift if the last six gained height slowly; a change or a gap begins a group.

    Groups of fewer than two fixes are dropped.
    """
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    six = w.rowsBetween(-5, 0)
    gain = F.last("elevation", True).over(six) - F.first("elevation", True).over(six)
    known = F.count("elevation").over(six)
    rows = deltas(fixes).withColumn("lift", F.coalesce((known >= 2) & (gain > lift_gain) & (F.avg("speed").over(six) < lift_speed), F.lit(False)))
    new = F.coalesce((F.col("lift") != F.lag("lift").over(w)) | (F.col("dt") > gap_s), F.lit(True))
    rows = rows.withColumn("new", new.cast("int"))
    rows = rows.withColumn("grp", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.when(F.col("new") == 0, F.col("metres")).otherwise(0.0)
    out = rows.groupBy("user_id", "grp").agg(F.bool_or("lift").alias("lift"), F.count("*").alias("points"), F.min("ts").alias("start"), F.max("ts").alias("stop"), F.sum(inside).alias("metres"))
    return out.where("points >= 2").select("user_id", "lift", "points", "start", "stop", "metres")


def peaks(fixes: DataFrame, cap: float = 30.0, longest: float = 30.0) -> DataFrame:
    """The highest mean speed over three steps, each of a positive time of at most `longest` seconds."""
    steps = deltas(fixes).where((F.col("dt") > 0) & (F.col("dt") <= longest))
    w = Window.partitionBy("user_id").orderBy(*ORDER).rowsBetween(-2, 0)
    rows = steps.select("user_id", F.when(F.count("*").over(w) == 3, F.sum("metres").over(w) / F.sum("dt").over(w)).alias("v"))
    return rows.groupBy("user_id").agg(F.least(F.max("v"), F.lit(cap)).alias("peak_ms"))


def filled_elevation(fixes: DataFrame) -> DataFrame:
    """Elevations, missing ones on the line between the nearest known by position, flat at the ends."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    rows = fixes.select("user_id", "event_id", "ts", "elevation", F.row_number().over(w).alias("i"))
    at = F.when(F.col("elevation").isNotNull(), F.struct("i", "elevation"))
    rows = rows.withColumn("a", F.last(at, True).over(back)).withColumn("b", F.first(at, True).over(ahead))
    share = (F.col("i") - F.col("a.i")) / (F.col("b.i") - F.col("a.i"))
    line = F.col("a.elevation") + (F.col("b.elevation") - F.col("a.elevation")) * share
    value = F.coalesce("elevation", F.when(F.col("a").isNull(), F.col("b.elevation")).when(F.col("b").isNull(), F.col("a.elevation")).otherwise(line))
    return rows.select("user_id", "event_id", value.alias("elevation"))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in an order; an aggregate, so hot keys are combined before the shuffle."""
    cols = [F.col(c) for c in rows.columns]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("x")).select("x.*")


def numbered(names: DataFrame) -> DataFrame:
    """Equal names of one difficulty told apart by a number."""
    w = Window.partitionBy("name", "difficulty")
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy("trail_group", "id"))
    return names.select("id", F.when(n > 1, F.concat("name", F.lit(" · #"), k.cast("string"))).otherwise(F.col("name")).alias("label"))


def legs(path: DataFrame) -> DataFrame:
    """Consecutive steps of one kind and name merged, with summed lengths."""
    w = Window.partitionBy("trail_group").orderBy("source", "id")
    change = F.coalesce((F.col("kind") != F.lag("kind").over(w)) | ~F.col("name").eqNullSafe(F.lag("name").over(w)), F.lit(True))
    rows = path.withColumn("new", change.cast("int")).withColumn("leg", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("trail_group", "leg").agg(F.min("kind").alias("kind"), F.min("name").alias("name"), F.count("*").alias("steps"), F.sum("length_m").alias("length_m"))


def cumulative(path: DataFrame) -> DataFrame:
    """Running length along each group's steps."""
    w = Window.partitionBy("trail_group").orderBy("source", "id").rowsBetween(Window.unboundedPreceding, 0)
    return path.select("trail_group", "id", F.sum("length_m").over(w).alias("so_far_m"))


def trailing_sums(hourly: DataFrame) -> DataFrame:
    """Snow of the last 24 and 72 entries, by position: only the last 72 rows meet."""
    last = hourly.orderBy(F.desc("time")).limit(72).select("snowfall_cm", F.row_number().over(Window.orderBy(F.desc("time"))).alias("k"))
    return last.agg(F.sum(F.when(F.col("k") <= 24, F.col("snowfall_cm"))).alias("last_24"), F.sum("snowfall_cm").alias("last_72"))


def smoothed(fixes: DataFrame, alpha: float = 0.2) -> DataFrame:
    """The exponential moving average of each user's speed after the last fix.

    It is a sum with weights by position, so no list of a user's history is made; fixes without a speed are passed over.
    """
    w = Window.partitionBy("user_id")
    rows = fixes.where("speed IS NOT NULL").select("user_id", "speed", F.row_number().over(w.orderBy(*ORDER)).alias("k"), F.count("*").over(w).alias("n"))
    weight = F.when(F.col("k") == 1, 1.0).otherwise(alpha) * F.pow(F.lit(1 - alpha), F.col("n") - F.col("k"))
    return rows.groupBy("user_id").agg(F.sum(F.col("speed") * weight).alias("ema_ms"))


def crumbs(requests: DataFrame, fixes: DataFrame) -> DataFrame:
    """The last fix of a user at or before each request's time, through one ordered union."""
    a = fixes.select("user_id", "ts", F.lit(0).alias("ask"), "event_id", F.lit(None).cast("long").alias("id"))
    b = requests.select("user_id", "ts", F.lit(1).alias("ask"), F.lit(None).cast("long").alias("event_id"), "id")
    w = Window.partitionBy("user_id").orderBy("ts", "ask", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return a.union(b).withColumn("crumb", F.last("event_id", True).over(w)).where("ask = 1").select("id", "crumb")
