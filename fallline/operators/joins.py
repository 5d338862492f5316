"""Joins: social visibility, overlays, points in boxes, as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import kept

#: Rows of a box table that is broadcast; a larger one is met through grid cells.
BOXES = 10_000


def by_email(profiles: DataFrame, emails: DataFrame) -> DataFrame:
    """Profiles whose e-mail is among emails(email), letters in either case."""
    return profiles.join(emails.select(F.lower("email").alias("e")).distinct(), F.lower("email") == F.col("e"), "left_semi")


def by_phone(profiles: DataFrame, phones: DataFrame) -> DataFrame:
    """Profiles whose digits are among phones(phone), one row for each id."""
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    return profiles.join(phones.select(digits("phone").alias("d")).distinct(), digits(F.col("phone")) == F.col("d"), "left_semi").dropDuplicates(["id"])


def friend_ids(friendships: DataFrame) -> DataFrame:
    """(me, friend) of accepted friendships, both ways round: a union, as a join on either end cannot be hashed."""
    rows = friendships.where("status = 'accepted'")
    return rows.select(F.col("requester_id").alias("me"), F.col("addressee_id").alias("friend")).union(rows.select("addressee_id", "requester_id")).distinct()


def friends_of(profiles: DataFrame, friendships: DataFrame) -> DataFrame:
    """Each profile's friends with their names."""
    return friend_ids(friendships).join(profiles.select(F.col("id").alias("friend"), "display_name"), "friend").select("me", "friend", "display_name")


def visible(friendships: DataFrame, blocks: DataFrame) -> DataFrame:
    """(viewer, seen): accepted friends of whom neither blocks the other."""
    blocked = blocks.select(F.col("blocker_id").alias("me"), F.col("blockee_id").alias("friend")).union(blocks.select("blockee_id", "blocker_id")).distinct()
    return friend_ids(friendships).join(blocked, ["me", "friend"], "left_anti").select(F.col("me").alias("viewer"), F.col("friend").alias("seen"))


def pending_strangers(friendships: DataFrame) -> DataFrame:
    """Pending requests between people who are not friends already."""
    known = friend_ids(friendships)
    rows = friendships.where("status = 'pending'")
    return rows.join(known, (F.col("requester_id") == F.col("me")) & (F.col("addressee_id") == F.col("friend")), "left_anti")


def resort_of(fixes: DataFrame, resorts: DataFrame) -> DataFrame:
    """The smallest box that holds each fix, borders included, ties to the smaller id; null outside of all.

    Few boxes are broadcast. More are cut into cells of a tenth of a degree and joined by cell.
    """
    inside = F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lon").between(F.col("min_lon"), F.col("max_lon"))
    size = (F.col("max_lat") - F.col("min_lat")) * (F.col("max_lon") - F.col("min_lon"))
    boxes = resorts.select(F.col("id").alias("resort_id"), "min_lat", "max_lat", "min_lon", "max_lon", size.alias("area"))
    if boxes.count() <= BOXES:
        met = fixes.join(F.broadcast(boxes), inside, "left")
    else:
        span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) * 10), F.floor(F.col(b) * 10)))
        cells = boxes.withColumn("cy", span("min_lat", "max_lat")).withColumn("cx", span("min_lon", "max_lon"))
        met = fixes.withColumn("cy", F.floor(F.col("lat") * 10)).withColumn("cx", F.floor(F.col("lon") * 10)).join(cells, ["cy", "cx"], "left").withColumn("resort_id", F.when(inside, F.col("resort_id")))
    return met.groupBy("event_id").agg(F.min_by("resort_id", F.when(F.col("resort_id").isNotNull(), F.struct(F.round("area", 12), "resort_id"))).alias("resort_id"))


def nearest_in_time(rows: DataFrame, series: DataFrame, at: str, time: str, values: list[str]) -> DataFrame:
    """Each row with the series entry nearest in time, however far; of two as near the later.

    Rows and entries are put into one order. Ranges of it are dealt to tasks, each carries the last
    entry before it and the first after it, and the ranges' own last and first entries, one row for
    each range, fill in where a range begins or ends without one. Repeated rows stay apart. Both windows
    run from their start to the row, the one ahead over the reversed order: a frame to its end would be
    read anew for each row.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    entry = F.struct(F.col(time).alias("t_"), micros(time).alias("us"), *values)
    a = series.where(F.col(time).isNotNull()).select(micros(time).alias("us__"), F.lit(0).alias("ask__"), entry.alias("e__"), *(F.lit(None).cast(t).alias(c) for c, t in rows.dtypes))
    b = rows.select(micros(at).alias("us__"), F.lit(1).alias("ask__"), F.lit(None).cast(a.schema["e__"].dataType).alias("e__"), *rows.columns)
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Ranges are sampled anew whenever they are computed: they are kept, as they are read three times.
    every = kept(a.unionByName(b).repartitionByRange(parts, "us__").withColumn("range__", F.spark_partition_id()))
    w = Window.partitionBy("range__")
    back, ahead = (w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0) for order in (("us__", "ask__"), (F.desc("us__"), F.desc("ask__"))))
    every = every.withColumn("before__", F.last("e__", True).over(back)).withColumn("after__", F.last("e__", True).over(ahead))
    held = every.where("ask__ = 0").groupBy("range__").agg(F.max_by("e__", "us__").alias("last"), F.min_by("e__", "us__").alias("first"))
    order = Window.orderBy("range__")  # one row for each range
    every_range = every.select("range__").distinct().join(held, "range__", "left")
    known = every_range.select(F.col("range__").alias("r__"), F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("p__"), F.first("first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("n__"))
    out = every.where("ask__ = 1").join(F.broadcast(known), F.col("range__") == F.col("r__"), "left")
    p, n = F.coalesce("before__", "p__"), F.coalesce("after__", "n__")
    pick = F.when(n.isNull() | (F.col("us__") - p["us"] < n["us"] - F.col("us__")), p).otherwise(n)
    out = out.withColumn("x__", F.when(F.col("us__").isNotNull(), pick))
    return out.select(*rows.columns, F.col("x__.t_").alias("matched"), *(F.col(f"x__.{v}").alias(v) for v in values))


def edge_overlay(edges: DataFrame, by_id: DataFrame, by_name: DataFrame) -> DataFrame:
    """Overlay labels by full edge id, else by name in lower case."""
    a = by_id.select(F.col("key").alias("k1"), F.col("label").alias("l1"))
    b = by_name.select(F.col("key").alias("k2"), F.col("label").alias("l2"))
    out = edges.join(a, F.col("id") == F.col("k1"), "left").join(b, F.lower("name") == F.col("k2"), "left")
    return out.select("id", F.coalesce("l1", "l2").alias("label"))


def observation(wanted: DataFrame, speeds: DataFrame) -> DataFrame:
    """The speed of each wanted (profile_id, resort_id, edge_id, conditions_fp): exact conditions, else the default, else the most observed.

    Without a resort_id in wanted, speeds has to be of one resort.
    """
    at = [c for c in ("profile_id", "resort_id", "edge_id") if c in wanted.columns]
    s = speeds.select(*at, F.col("conditions_fp").alias("fp"), "rolling_speed_ms", "observation_count")
    rank = F.when(F.col("fp") == F.col("conditions_fp"), 0).when(F.col("fp") == "default", 1).otherwise(2)
    best = F.min_by(F.struct("fp", "rolling_speed_ms"), F.struct(rank, -F.col("observation_count"), "fp"))
    out = wanted.join(s, at, "left").groupBy(*wanted.columns).agg(best.alias("x"))
    return out.select(*wanted.columns, F.col("x.fp").alias("used_fp"), F.col("x.rolling_speed_ms").alias("speed_ms"))


def reached_by_all(distances: DataFrame, people: int) -> DataFrame:
    """Nodes that all people reach, with the slowest's time."""
    return distances.groupBy("node").agg(F.countDistinct("person").alias("n"), F.max("seconds").alias("slowest")).where(F.col("n") == people).select("node", "slowest")


def near_places(nodes: DataFrame, metres: float, a: list[Column], b: list[Column], closed: bool = True, digits: int | None = None) -> DataFrame:
    """(lat1, lon1, lat2, lon2, metres): pairs of the places of nodes(lat, lon), both ways round and each with itself, as near as metres (nearer, unless closed).

    a and b are the columns cy and cx of cells of lat and lon; those of a explode. With digits given, metres
    are rounded once found near: here there are fewer of them than pairs of nodes.
    """
    from ..functions.geo import haversine

    places = kept(nodes.select("lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL").distinct())
    one = places.select("*", *a).select(F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "cell.cy", "cell.cx")
    two = places.select(F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), *b)
    met = one.join(two.hint("merge"), ["cy", "cx"]).withColumn("metres", haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    met = met.where(F.col("metres") <= metres if closed else F.col("metres") < metres)
    return met.select("lat1", "lon1", "lat2", "lon2", "metres" if digits is None else F.round("metres", digits).alias("metres"))


def expanded(pairs: DataFrame, nodes_a: DataFrame, nodes_b: DataFrame) -> DataFrame:
    """near_places() as pairs of the nodes there: nodes_a has lat1 and lon1, nodes_b lat2 and lon2.

    Nodes follow the input, so neither side is broadcast, and tasks are as many as asked for: few bytes become many rows.
    """
    parts = max(64, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    half = nodes_a.join(pairs.hint("merge"), ["lat1", "lon1"])
    return half.repartition(parts, "lat2", "lon2").join(nodes_b.repartition(parts, "lat2", "lon2").hint("merge"), ["lat2", "lon2"])


def neighbours(nodes: DataFrame, metres: float, cell: float = 0.001, digits: int | None = None) -> DataFrame:
    """Pairs of nodes within a distance of less than a cell: each place looks into the cells around it, and its nodes follow."""
    y, x = (F.floor(F.col(c) / cell) for c in ("lat", "lon"))
    around = F.explode(F.array(*(F.struct((y + dy).alias("cy"), (x + dx).alias("cx")) for dy in (-1, 0, 1) for dx in (-2, -1, 0, 1, 2)))).alias("cell")
    pairs = near_places(nodes, metres, [around], [y.alias("cy"), x.alias("cx")], digits=digits)
    at = lambda name, k: nodes.select(F.col("id").alias(name), F.col("lat").alias(f"lat{k}"), F.col("lon").alias(f"lon{k}"))
    return expanded(pairs, at("a", 1), at("b", 2)).where("a < b").select("a", "b", "metres")


def mutual(friendships: DataFrame) -> DataFrame:
    """Friends in common of each accepted pair of profiles, through one equi-join."""
    f = friend_ids(friendships)
    g = f.select(F.col("me").alias("you"), "friend")
    return f.join(g, "friend").where("me < you").groupBy("me", "you").agg(F.count("*").alias("common"))


def looked_up(rows: DataFrame, table: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """Left lookup with a default."""
    return rows.join(table, key, "left").withColumn(value, F.coalesce(value, default))
