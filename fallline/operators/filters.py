"""Filters, top-k, sets and writes that the services use. Times are parameters, never the clock's."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Status changes of a request that are allowed.
TRANSITIONS = {"pending": ("accepted", "declined", "expired"), "accepted": ("expired",)}

#: Difficulties in order.
DIFFICULTIES = {"green": 0, "blue": 1, "black": 2, "doubleBlack": 3, "terrainPark": 4}


def without(c: Column) -> Column:
    """Null or empty."""
    return F.coalesce(c, F.lit("")) == ""


def searched(catalog: DataFrame, term: str) -> DataFrame:
    return catalog.where(F.contains(F.lower("name"), F.lit(term.lower()))).orderBy("name")


def catalog_search(catalog: DataFrame, term: str, on_pass: bool = True) -> DataFrame:
    """Resorts of the pass whose name, region, country or an alias holds the term, by name."""
    every = F.lower(F.concat_ws(" ", "name", "region", "country", F.array_join("aliases", " ")))
    return catalog.where((F.col("on_pass") == on_pass) & F.contains(every, F.lit(term.lower()))).orderBy("name")


def day_search(runs: DataFrame, term: str) -> DataFrame:
    """Days and resorts with their runs, where the written date or the resort's name holds the term."""
    days = runs.groupBy(F.to_date("run_at").alias("day"), "resort_id").agg(F.count("*").alias("runs"))
    low = F.lit(term.lower())
    return days.where(F.contains(F.lower(F.date_format("day", "MMM d, yyyy")), low) | F.contains(F.lower("resort_id"), low))


def is_glade(name: Column) -> Column:
    return F.regexp_like(F.lower(name), F.lit(r"\b(glade|glades|trees|woods|forest)\b"))


def difficulty_rank(difficulty: Column) -> Column:
    """The order of difficulties, null for an unknown one."""
    return F.create_map(*(F.lit(x) for kv in DIFFICULTIES.items() for x in kv))[difficulty]


def solar_local(at: Column, lon: Column) -> Column:
    """Local time by the sun: four minutes for each degree of longitude."""
    return F.timestamp_micros(F.unix_micros(at) + F.round(lon / 15 * 3600 * 1_000_000).cast("long"))


def validated(trails: DataFrame, official: DataFrame, sure: float = 0.85, maybe: float = 0.72) -> DataFrame:
    """trails(id, name) with `verdict` by their greatest similarity to a name of official(official): valid, open or closed.

    `s` is that similarity, null below `maybe`.

    Equal bare names are one. Names meet through the letter pairs they share; no pair of names without a
    common letter pair is made, nor one whose numbers of pairs are too unlike for `maybe`, nor one that
    meets only in pairs beyond the rarest of each: if it reached `maybe`, it would meet in those too.
    What was found goes back to the trails by a join that is never broadcast.
    """
    from ..functions import text

    trail = trails.select("id", text.bare(F.col("name")).alias("a"))
    a = trail.where("a IS NOT NULL").select("a").distinct().withColumn("x", text.bigrams(F.col("a")))
    b = official.select(text.bare(F.col("official")).alias("b")).where("b IS NOT NULL").distinct().withColumn("y", text.bigrams(F.col("b")))
    a, b = kept(a), kept(b)
    each = a.select(F.explode("x").alias("g")).unionAll(b.select(F.explode("y").alias("g"))).groupBy("g").agg(F.count("*").alias("n"))
    # s >= maybe takes maybe * (nx + ny) / 2 pairs in common, so maybe / (2 - maybe) of either's number at least: all but so many of a name's pairs, less one, hold one of those.
    least = maybe / (2 - maybe)

    def rarest(names: DataFrame, name: str, pairs: str) -> DataFrame:
        met = names.select(name, F.size(pairs).alias("m"), F.explode(pairs).alias("g")).join(each, "g")
        listed = met.groupBy(name, "m").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("p"))
        most = (F.col("m") - F.ceil(F.col("m") * least - 1e-9) + 1).cast("int")
        return listed.select(name, "m", F.explode(F.slice("p", F.lit(1), most)).alias("p")).select(name, "m", "p.g")

    one, two = rarest(a, "a", "x").withColumnRenamed("m", "nx"), rarest(b, "b", "y").withColumnRenamed("m", "ny")
    alike = (F.col("nx") >= F.col("ny") * least - 1e-9) & (F.col("ny") >= F.col("nx") * least - 1e-9)
    pairs = one.join(two, "g").where(alike).select("a", "b").distinct()
    shared = F.size(F.array_intersect("x", "y"))
    full = pairs.join(a, "a").join(b, "b").select("a", (2.0 * shared / (F.size("x") + F.size("y"))).alias("s"))
    equal = a.where("size(x) = 0").join(b.where("size(y) = 0"), F.col("a") == F.col("b")).select("a", F.lit(1.0).alias("s"))
    best = full.unionByName(equal).groupBy("a").agg(F.max("s").alias("s"))
    s = F.coalesce("s", F.lit(0.0))
    return trail.join(best.where(F.col("s") >= maybe).hint("merge"), "a", "left").select("id", "s").withColumn("verdict", F.when(s >= sure, "valid").when(s >= maybe, "open").otherwise("closed"))


def open_runs(edges: DataFrame) -> DataFrame:
    return edges.where("is_open AND kind = 'run'")


def fresh(rows: DataFrame, at: str, as_of: Column, minutes: int) -> DataFrame:
    return rows.where(F.col(at) >= as_of - F.make_dt_interval(mins=F.lit(minutes)))


def live_requests(requests: DataFrame, as_of: Column) -> DataFrame:
    """Pending ones that have not expired; without an expiry one does not."""
    return requests.where((F.col("status") == "pending") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows: each task keeps its own first k, and only those meet."""
    return rows.orderBy(*order).limit(k)


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """target with those rows of new whose keys it has not, one for each key."""
    from .windows import latest

    once = latest(new, keys, *(F.col(c) for c in new.columns))
    return target.unionByName(once.join(target.select(*keys).distinct(), keys, "left_anti"))


def upsert(target: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The latest row of each key of both."""
    from .windows import latest

    both = target.withColumn("new__", F.lit(0)).unionByName(new.withColumn("new__", F.lit(1)))
    return latest(both, keys, -F.col("new__"), order).drop("new__")


def expired(requests: DataFrame, as_of: Column) -> DataFrame:
    """Requests with the status after expiry."""
    over = (F.col("status") == "pending") & (F.col("expires_at") <= as_of)
    return requests.withColumn("status", F.when(over, F.lit("expired")).otherwise(F.col("status")))


def illegal(old: DataFrame, new: DataFrame) -> DataFrame:
    """Status changes that are not allowed, as (id, was, status)."""
    both = old.select("id", F.col("status").alias("was")).join(new.select("id", "status"), "id").where("was != status")
    allowed = F.lit(False)
    for was, then in TRANSITIONS.items():
        allowed = allowed | ((F.col("was") == was) & F.col("status").isin(*then))
    return both.where(~allowed)


def next_version(manifests: DataFrame, key: str) -> DataFrame:
    return manifests.groupBy(key).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))


def first_seen(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    from .windows import latest

    return latest(rows, keys, F.col(ordinal))


def decoded_time(value: Column) -> Column:
    """Epoch seconds of a number whose size tells its unit: seconds since 2001, since 1970, or milliseconds."""
    return F.when((value <= 0) | F.isnan(value), None).when(value < 978_307_200, value + 978_307_200).when(value < 3e9, value).otherwise(value / 1000)


def kept(df: DataFrame) -> DataFrame:
    """df in the checkpoint folder, its lineage cut. Where the session names none a temporary one, which only a local master can share."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not (sc.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="fallline-checkpoint-"))
    return df.checkpoint(eager=True)


def reachable(edges: DataFrame, sources: DataFrame, rounds: int | None = None) -> DataFrame:
    """Least length from each source node over open edges, by relaxation of whole frontiers until none changes.

    No length may be negative. With rounds given, over so many edges at most.
    """
    e = edges.where("is_open AND length_m IS NOT NULL").select(F.col("source").alias("node"), F.col("target").alias("to"), "length_m")
    best = sources.select("person", "node", F.lit(0.0).alias("metres")).distinct()
    changed, done = best, 0
    while done != rounds:
        step = changed.join(e, "node").groupBy("person", F.col("to").alias("node")).agg(F.min(F.col("metres") + F.col("length_m")).alias("metres"))
        known = best.select("person", "node", F.col("metres").alias("was"))
        changed = kept(step.join(known, ["person", "node"], "left").where("was IS NULL OR metres < was").drop("was"))
        if changed.isEmpty():
            break
        best = kept(best.union(changed).groupBy("person", "node").agg(F.min("metres").alias("metres")))
        done += 1
    return best
