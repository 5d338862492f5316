"""Where to meet, what a lift costs, and which source to believe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine

#: Sources of names, the most trusted first, and what each adds to confidence.
SOURCES = {"official": 1.0, "skimap": 0.45, "openskimap": 0.35, "overpass": 0.2}
#: Least distances between alternatives, tried in this order, in metres.
RUNGS = (350.0, 200.0, 100.0, 0.0)


def lift_wait(capacity: Column, base: Column, weekend: Column) -> Column:
    """Seconds in a lift's queue, at most 600: larger lifts wait less, weekends more."""
    size = F.when(capacity >= 6, 0.7).when(capacity >= 4, 0.85).otherwise(1.0)
    return F.least(base * size * F.when(weekend, 1.4).otherwise(1.0), F.lit(600.0))


def wind_factor(kph: Column) -> Column:
    return F.when(kph > 80, 3.0).when(kph > 60, 1.5).when(kph > 40, 1.2).otherwise(1.0)


def lapse(temperature_c: Column, elevation_m: Column, base_m: Column) -> Column:
    """Temperature at another elevation, 6.5 degrees a kilometre less."""
    return temperature_c - 6.5 * (elevation_m - base_m) / 1000


def worst_first(penalties: Column, floor: float = 0.25) -> Column:
    """Penalties combined, the worst in full and each further one by a smaller root."""
    ordered = F.array_sort(F.filter(penalties, lambda p: p < 1))
    start = F.struct(F.lit(1.0).alias("v"), F.lit(1).alias("i"))
    product = F.aggregate(ordered, start, lambda a, p: F.struct((a.v * F.pow(p, 1.0 / a["i"])).alias("v"), (a["i"] + 1).alias("i")), lambda a: a.v)
    return F.greatest(product, F.lit(floor))


def meeting_points(times: DataFrame, people: int, k: int) -> DataFrame:
    """The k best nodes that all reach: by the slowest's time and what the others would wait."""
    per = times.groupBy("node").agg(F.countDistinct("person").alias("n"), F.max("seconds").alias("slow"), F.min("seconds").alias("fast")).where(F.col("n") == people)
    return per.select("node", (F.col("slow") + 0.6 * (F.col("slow") - F.col("fast"))).alias("score")).orderBy("score", "node").limit(k)


def diverse(candidates: DataFrame, k: int = 4, rungs: tuple[float, ...] = RUNGS) -> DataFrame:
    """At most k picks per request(request, id, lat, lon, score), in score order, each far from all before.

    A rung is lowered when not enough picks are found. Candidates of one request are few (top-k rows).
    """
    ordered = F.array_sort(F.collect_list(F.struct("score", "id", "lat", "lon")))
    far = lambda p, x, m: F.forall(p, lambda y: haversine(x.lat, x.lon, y.lat, y.lon) >= m)

    def rung(picked: Column, every: Column, metres: float) -> Column:
        known = lambda p, x: F.exists(p, lambda y: y.id == x.id)
        return F.aggregate(every, picked, lambda p, x: F.when((F.size(p) < k) & ~known(p, x) & far(p, x, metres), F.concat(p, F.array(x))).otherwise(p))

    rows = candidates.groupBy("request").agg(ordered.alias("c")).withColumn("p", F.slice("c", 1, 1))
    for metres in rungs:
        rows = rows.withColumn("p", rung(F.col("p"), F.col("c"), metres))
    return rows.select("request", F.posexplode("p").alias("rank", "x")).select("request", "rank", "x.id")


def reconciled(items: DataFrame) -> DataFrame:
    """One row per (kind, key) of items(kind, key, source, name): the best source's name and a confidence."""
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    weight = F.create_map(*(F.lit(x) for kv in SOURCES.items() for x in kv))[F.col("source")]
    once = items.groupBy("kind", "key", "source").agg(F.min("name").alias("name"))
    official = F.bool_or(F.col("source") == "official")
    sure = F.when(official, F.lit(1.0)).otherwise(F.least(F.sum(weight), F.lit(1.0)))
    return once.groupBy("kind", "key").agg(F.min_by("name", rank).alias("name"), sure.alias("confidence"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def pinned(resorts: DataFrame, pins: DataFrame, default: str = "__catalog__") -> DataFrame:
    """Each resort's pin, else the catalog's."""
    own = pins.select(F.col("key").alias("k1"), F.col("version").alias("v1"))
    of_all = F.broadcast(pins.where(F.col("key") == default).agg(F.max("version").alias("v2")))  # one row
    return resorts.select("id").join(own, F.col("id") == F.col("k1"), "left").crossJoin(of_all).select("id", F.coalesce("v1", "v2").alias("version"))


def signal(age_s: Column) -> Column:
    return F.when(age_s < 75, "live").when(age_s <= 300, "stale").otherwise("cold")


def monotone(packets: DataFrame) -> DataFrame:
    """Packets whose generation is 0 or above all before it from the user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("generation") > 0, F.col("generation"))).over(w)
    return packets.withColumn("last", last).where("generation = 0 OR last IS NULL OR generation > last").drop("last")
