"""Recorded tracks: lifts told from runs, speeds without pauses, map matching, and folds over ordered fixes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .filters import kept
from .windows import ORDER, deltas

#: Segments and edges of a cell that are measured at a time.
SHAPES, LINES = 256, 4096


def classified(fixes: DataFrame, gain: float = 8.0, speed: float = 5.5) -> DataFrame:
    """Fixes with `lift`: whether the last six, this one included, gained height and moved slowly."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    six = w.rowsBetween(-5, 0)
    up = F.last("elevation", True).over(six) - F.first("elevation", True).over(six)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    took = (us - F.first(us).over(six)) / 1e6
    went = F.sum(F.coalesce("metres", F.lit(0.0))).over(six) - F.first(F.coalesce("metres", F.lit(0.0))).over(six)
    lift = (F.count("elevation").over(six) >= 2) & (up > gain) & (took > 0) & (went / took < speed)
    return deltas(fixes).withColumn("lift", F.coalesce(lift, F.lit(False)))


def phases(fixes: DataFrame, gap_s: float | None = 90.0, least: int = 2) -> DataFrame:
    """Runs and lifts of each user, numbered: a change, or a gap where one is given, begins a group; small groups are dropped."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    new = F.col("lift") != F.lag("lift").over(w)
    rows = classified(fixes)
    rows = rows.withColumn("new", F.coalesce(new if gap_s is None else new | (F.col("dt") > gap_s), F.lit(True)).cast("int"))
    rows = rows.withColumn("grp", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.col("new") == 0
    out = rows.groupBy("user_id", "grp").agg(F.bool_or("lift").alias("lift"), F.count("*").alias("points"), F.sum(F.when(inside, F.col("metres")).otherwise(0.0)).alias("metres"), F.sum(F.when(inside, F.col("dt")).otherwise(0.0)).alias("seconds"))
    return out.where(F.col("points") >= least)


def runs_kept(fixes: DataFrame, least_ms: float = 0.5) -> DataFrame:
    """Runs of at least a mean speed, renumbered; a track none of whose runs has it stays as one."""
    every = phases(fixes)
    fast = every.where(~F.col("lift") & (F.col("seconds") > 0) & (F.col("metres") / F.col("seconds") >= least_ms))
    kept = fast.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("grp")).alias("run"), "points", "metres")
    whole = deltas(fixes).groupBy("user_id").agg(F.count("*").alias("points"), F.sum(F.coalesce("metres", F.lit(0.0))).alias("metres"))
    rest = whole.join(kept.select("user_id").distinct(), "user_id", "left_anti").select("user_id", F.lit(1).alias("run"), "points", "metres")
    return kept.unionByName(rest)


def moving_speed(fixes: DataFrame, slow_ms: float = 1.0, pause_s: float = 10.0) -> DataFrame:
    """Mean speed without pauses: stretches of slow steps that last `pause_s` or more; shorter ones count."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    steps = deltas(fixes).where(F.col("dt").isNotNull()).withColumn("slow", (F.col("dt") > 0) & (F.col("metres") / F.col("dt") < slow_ms))
    steps = steps.withColumn("grp", F.sum((~F.col("slow")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stretch = Window.partitionBy("user_id", "grp")
    paused = F.col("slow") & (F.sum(F.when(F.col("slow"), F.col("dt"))).over(stretch) >= pause_s)
    moving = steps.withColumn("paused", paused).where("dt > 0 AND NOT paused")
    speeds = moving.groupBy("user_id").agg((F.sum("metres") / F.sum("dt")).alias("v"))
    return fixes.select("user_id").distinct().join(speeds, "user_id", "left").select("user_id", F.coalesce("v", F.lit(0.0)).alias("moving_ms"))


def ema(samples: DataFrame, alpha: float = 0.2, low: float = 0.5, high: float = 30.0, warm_up: int = 3) -> DataFrame:
    """The moving average after each user's last speed in (low, high], the first `warm_up` of which are left out.

    An exponential average is a sum with weights by position: no list of a user's history is made.
    """
    w = Window.partitionBy("user_id")
    rows = samples.where((F.col("speed") > low) & (F.col("speed") <= high)).select("user_id", "speed", (F.row_number().over(w.orderBy(*ORDER)) - warm_up).alias("k"), (F.count("*").over(w) - warm_up).alias("n")).where("k > 0")
    weight = F.when(F.col("k") == 1, 1.0).otherwise(alpha) * F.pow(F.lit(1 - alpha), F.col("n") - F.col("k"))
    return rows.groupBy("user_id").agg(F.sum(F.col("speed") * weight).alias("ema_ms"), F.count("*").alias("samples"))


def folded(rows: DataFrame, key: str, order: list[str], schema: str, arrow: pa.Schema, step: Callable[[dict | None, dict], tuple[dict, bool]]) -> DataFrame:
    """The rows of each key that step(state, row) -> (state, kept) keeps, in order.

    For rules in which each decision hangs on the one before. Keys are sorted within partitions and
    run through one after the other: memory is one batch and one state, however long a history is.
    """
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            kept = []
            for row in batch.to_pylist():
                if row[key] != now:
                    now, state = row[key], None
                state, keep = step(state, row)
                if keep:
                    kept.append({n: row[n] for n in names})
            yield pa.RecordBatch.from_pylist(kept, schema=arrow)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


SEEN = pa.schema([("user_id", pa.int64()), ("event_id", pa.int64())])


def crumbs_kept(fixes: DataFrame, seconds: float = 10.0, most: int = 500) -> DataFrame:
    """Fixes kept once so many seconds have passed since the last that was kept, the newest `most` of each user."""
    kept = folded(fixes, "user_id", ["at_s", "event_id"], "user_id long, event_id long", SEEN, lambda s, r: ({"at": r["at_s"]}, True) if s is None or r["at_s"] - s["at"] >= seconds else (s, False))
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return kept.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")


def sent(fixes: DataFrame, moving_s: float = 0.12, idle_s: float = 0.85, moving_ms: float = 1.0) -> DataFrame:
    """Fixes that are broadcast: sooner after the last one sent while moving than at rest."""
    wait = lambda r: moving_s if (r["speed"] or 0.0) >= moving_ms else idle_s
    return folded(fixes, "user_id", ["at_s", "event_id"], "user_id long, event_id long", SEEN, lambda s, r: ({"at": r["at_s"]}, True) if s is None or r["at_s"] - s["at"] >= wait(r) else (s, False))


def throttled(fixes: DataFrame, seconds: float = 5.0) -> DataFrame:
    """Requests let through, one in so many seconds for each user."""
    return sent(fixes, seconds, seconds)


def debounced(events: DataFrame, quiet_s: float = 30.0) -> DataFrame:
    """When a recompute runs: once each time a user has been quiet for so long, for all that came before."""
    w = Window.partitionBy("user_id").orderBy("at_s", "event_id")
    new = F.coalesce(F.col("at_s") - F.lag("at_s").over(w) > quiet_s, F.lit(True))
    rows = events.withColumn("new", new.cast("int")).withColumn("burst", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "burst").agg((F.max("at_s") + quiet_s).alias("runs_at"), F.count("*").alias("events"))


def present(fixes: DataFrame, as_of_s: float, ttl_s: float = 90.0) -> DataFrame:
    """Users whose last fix is no older than the time to live."""
    return fixes.groupBy("user_id").agg(F.max("at_s").alias("seen_s")).where(F.col("seen_s") >= as_of_s - ttl_s)


def subscriptions(fixes: DataFrame) -> DataFrame:
    """Cells to leave and to join as a user moves: a cell and its neighbours against those before."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    rows = fixes.select("user_id", "event_id", "ts", geo.geohash(F.col("lat"), F.col("lon")).alias("cell"))
    moved = rows.withColumn("was", F.lag("cell").over(w)).where("was IS NULL OR was != cell")
    now, was = geo.geohash_neighbours(F.col("cell")), F.coalesce(geo.geohash_neighbours(F.col("was")), F.array().cast("array<string>"))
    return moved.select("user_id", "event_id", F.array_except(was, now).alias("leave"), F.array_except(now, was).alias("join"))


def enriched(fixes: DataFrame, resorts: DataFrame) -> DataFrame:
    """Positions as they are stored: with their cell, and the resort whose box holds them."""
    from .joins import resort_of

    return fixes.select("event_id", geo.geohash(F.col("lat"), F.col("lon")).alias("geohash6")).join(resort_of(fixes, resorts), "event_id", "left")


def in_intervals(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, stop: str, width: float = 600.0) -> DataFrame:
    """Points with the spans of their key that hold them, both ends included; they meet by bins of time."""
    bins = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))).alias("bin")
    cut = spans.select("*", bins)
    return points.withColumn("bin", F.floor(F.col(at) / width)).join(cut, [key, "bin"]).where(F.col(at).between(F.col(start), F.col(stop))).drop("bin")


def vertices(edges: DataFrame) -> DataFrame:
    """(edge, i, vlat, vlon) of edges(id, line)."""
    return edges.select(F.col("id").alias("edge"), F.posexplode("line").alias("i", "v")).select("edge", "i", F.col("v.lat").alias("vlat"), F.col("v.lon").alias("vlon"))


def cells(lat: str, lon: str, size: float, around: int = 0) -> list[Column]:
    """Cell numbers of a point; with `around` those of the cells about it too, as columns that explode."""
    y, x = F.floor(F.col(lat) / size), F.floor(F.col(lon) / size)
    if not around:
        return [y.alias("cy"), x.alias("cx")]
    near = [F.struct((y + dy).alias("cy"), (x + dx).alias("cx")) for dy in range(-around, around + 1) for dx in range(-around, around + 1)]
    return [F.explode(F.array(*near)).alias("cell")]


def gaps(limit_m: float, turn_deg: float) -> Callable[[list, list], tuple[np.ndarray, np.ndarray]]:
    """The measure that `matched` sends to its tasks, which need not be able to import this module."""
    radius = geo.EARTH_M

    def measure(shapes: list, lines: list) -> tuple[np.ndarray, np.ndarray]:
        """For each (steps, degrees) of shapes the place in lines of the best (line, degrees) and its score; -1 for none.

        Steps are lists of points; the gap of a step is the least distance of its points to the line's vertices.
        """
        xy = lambda ps: np.radians(np.array([(p["lat"], p["lon"]) for p in ps], dtype=float).reshape(-1, 2))
        places, at = np.unique(xy([v for line, _ in lines for v in line]), axis=0, return_inverse=True)
        at, first = at.reshape(-1), np.cumsum([0] + [len(line) for line, _ in lines[:-1]])
        most = max(len(line) for line, _ in lines)
        # Column j holds each line's vertex j, the first one again where it has no more.
        columns = [at[first + np.array([j if j < len(line) else 0 for line, _ in lines])] for j in range(most)]
        degrees = np.array([d for _, d in lines])
        pick, score = np.full(len(shapes), -1), np.full(len(shapes), np.inf)
        for k, (steps, way) in enumerate(shapes):
            p = xy([x for step in steps for x in step])
            u, v = np.sin((places[:, 0] - p[:, :1]) / 2), np.sin((places[:, 1] - p[:, 1:]) / 2)
            d = 2 * radius * np.arcsin(np.sqrt(np.minimum(1.0, u * u + np.cos(p[:, :1]) * np.cos(places[:, 0]) * v * v)))
            d = np.fmin.reduceat(d, np.cumsum([0] + [len(step) for step in steps[:-1]]), axis=0)
            turn = np.abs(degrees - way)
            turn = np.minimum(turn, 360 - turn)
            ok = np.flatnonzero((turn <= turn_deg) | (180 - turn <= turn_deg))
            if not len(ok):
                continue
            near = d[:, columns[0][ok]]
            for c in columns[1:]:
                np.fmin(near, d[:, c[ok]], out=near)
            mean = near.mean(axis=0)
            mean[~(mean < limit_m)] = np.inf
            best = int(np.argmin(np.round(mean, 9)))  # the first of equal ones
            if mean[best] < np.inf:
                pick[k], score[k] = ok[best], mean[best]
        return pick, score

    return measure


def matched(points: DataFrame, edges: DataFrame, limit_m: float = 60.0, turn_deg: float = 45.0) -> DataFrame:
    """The run edge of each segment of points(segment, i, lat, lon): least mean distance to the nearest vertex, below the limit, in or against its direction.

    Segments of the same points and edges of the same vertices are one, the latter the smaller id. An
    edge whose mean distance is below the limit has a vertex that near to some point: candidates meet by
    cells wider than the limit, in blocks of so many segments and edges, and each block keeps each
    segment's best edge. Ties go to the smaller edge id.
    """
    size = 2 * limit_m / 111_000  # wide enough in longitude up to 60 degrees
    point = lambda lat, lon: F.struct(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    known = lambda lat, lon: F.col(lat).isNotNull() & F.col(lon).isNotNull()
    ends = lambda order, lat, lon: (F.min_by(F.struct(lat, lon), order).alias("a"), F.max_by(F.struct(lat, lon), order).alias("b"))
    deg = lambda lat, lon: geo.bearing(F.col(f"a.{lat}"), F.col(f"a.{lon}"), F.col(f"b.{lat}"), F.col(f"b.{lon}")).alias("deg")
    step = points.where("segment IS NOT NULL").groupBy("segment", "i").agg(F.array_sort(F.collect_set(F.when(known("lat", "lon"), point("lat", "lon")))).alias("step"), F.min(F.struct("lat", "lon")).alias("p"))
    # Several points of one place in the order: which is the first, or the last, is left open.
    steps = step.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("i", "step"))).alias("x"), F.min_by("p", "i").alias("a"), F.max_by("p", "i").alias("b"))
    steps = steps.select("segment", F.filter("x.step", lambda s: F.size(s) > 0).alias("steps"), deg("lat", "lon")).where(F.col("deg").isNotNull() & (F.size("steps") > 0))
    steps = kept(steps.withColumn("shape", F.sha2(F.to_json(F.struct("steps", "deg")), 256)))
    shapes = steps.groupBy("shape").agg(F.first("steps").alias("steps"), F.first("deg").alias("deg"))
    v = vertices(edges.where("id IS NOT NULL"))
    lines = v.groupBy("edge").agg(F.array_sort(F.collect_set(F.when(known("vlat", "vlon"), point("vlat", "vlon")))).alias("line"), *ends("i", "vlat", "vlon")).select("edge", "line", deg("vlat", "vlon"))
    lines = kept(lines.where("deg IS NOT NULL AND size(line) > 0").groupBy("line", "deg").agg(F.min("edge").alias("edge")))
    # Met by cells, in blocks whose lines lie in the order of their ids.
    cut = lambda df, by, most: df.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("cy", "cx").orderBy(by)) - 1) / most))
    flat = shapes.select("shape", "steps", "deg", F.explode(F.flatten("steps")).alias("p")).select("shape", "steps", "deg", "p.lat", "p.lon")
    asked = flat.select("shape", "steps", "deg", *cells("lat", "lon", size, 1)).select("shape", "steps", "deg", "cell.*").dropDuplicates(["shape", "cy", "cx"])
    asked = cut(asked, "shape", SHAPES).groupBy("cy", "cx", "block").agg(F.collect_list(F.struct("shape", "steps", "deg")).alias("shapes"))
    there = lines.select("edge", "line", "deg", F.explode("line").alias("v")).select("edge", "line", "deg", "v.*").select("edge", "line", "deg", *cells("lat", "lon", size)).dropDuplicates(["edge", "deg", "cy", "cx"])
    there = cut(there, "edge", LINES).groupBy("cy", "cx", "block").agg(F.array_sort(F.collect_list(F.struct("edge", "line", "deg"))).alias("lines"))
    met = asked.join(there.withColumnRenamed("block", "other").hint("merge"), ["cy", "cx"])
    met = met.repartition(max(8, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "cy", "cx", "block", "other").select("shapes", "lines")

    measure = gaps(limit_m, turn_deg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                asked, there = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                pick, score = measure([(x["steps"], x["deg"]) for x in asked], [(x["line"], x["deg"]) for x in there])
                found = [(x["shape"], there[j]["edge"], float(s)) for x, j, s in zip(asked, pick, score, strict=True) if j >= 0]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in enumerate((pa.string(), batch.schema.field(1).type.value_type.field("edge").type, pa.float64()))], names=["shape", "edge", "score"])

    found = met.mapInArrow(run, f"shape string, edge {dict(edges.dtypes)['id']}, score double")
    best = found.groupBy("shape").agg(F.min(F.struct(F.round("score", 9).alias("r"), "edge", "score")).alias("best"))
    return steps.select("segment", "shape").join(best, "shape").select("segment", "best.edge", "best.score")


def by_centroid(points: DataFrame, edges: DataFrame, limit_m: float = 300.0) -> DataFrame:
    """The edge with the vertex nearest to each segment's centroid, below the limit; candidates meet by cells.

    Vertices of one place count once, for the smallest edge id, and so do centroids of one place.
    """
    size = 2 * limit_m / 111_000
    middle = points.where("segment IS NOT NULL").groupBy("segment").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).where("lat IS NOT NULL AND lon IS NOT NULL")
    middle = kept(middle)
    near = middle.select("lat", "lon").distinct().select("lat", "lon", *cells("lat", "lon", size, 1)).select("lat", "lon", "cell.cy", "cell.cx")
    places = vertices(edges).where("vlat IS NOT NULL AND vlon IS NOT NULL").groupBy("vlat", "vlon").agg(F.min("edge").alias("edge"))
    d = geo.haversine(F.col("lat"), F.col("lon"), F.col("vlat"), F.col("vlon"))
    met = near.join(places.select("*", *cells("vlat", "vlon", size)), ["cy", "cx"]).withColumn("d", d).where(F.col("d") < limit_m)
    best = met.groupBy("lat", "lon").agg(F.min(F.struct(F.round("d", 9).alias("r"), "edge", "d")).alias("best"))
    return middle.join(best, ["lat", "lon"]).select("segment", "best.edge", "best.d")


def cohorts(runs: DataFrame, flags: dict[str, tuple[Column, Column]], least: int = 3) -> DataFrame:
    """For each profile and flag the median speed where the one holds over that where the other does, from 0.1 to 2; null with few runs."""
    out = []
    for name, (yes, no) in flags.items():
        a, b = F.when(yes, F.col("speed_ms")), F.when(no, F.col("speed_ms"))
        ratio = F.median(a) / F.median(b)
        out.append(F.when((F.count(a) >= least) & (F.count(b) >= least), F.least(F.greatest(ratio, F.lit(0.1)), F.lit(2.0))).alias(name))
    return runs.groupBy("profile_id").agg(*out)


def corrected(runs: DataFrame, least_runs: int = 5, least: int = 3) -> DataFrame:
    """Median speeds by difficulty, divided by how much longer runs took than predicted where that is out of 0.7 to 1.3.

    runs(profile_id, difficulty, speed_ms, duration_s, predicted_s). Profiles with few runs are not corrected.
    """
    ratio = F.when((F.col("duration_s") > 5) & (F.col("predicted_s") > 0), F.col("duration_s") / F.col("predicted_s"))
    many = runs.groupBy("profile_id").agg(F.count("*").alias("all_runs"))
    per = runs.where("difficulty IS NOT NULL").groupBy("profile_id", "difficulty").agg(F.median("speed_ms").alias("speed"), F.median(ratio).alias("r"), F.count(ratio).alias("n"))
    off = (F.col("all_runs") >= least_runs) & (F.col("n") >= least) & ((F.col("r") > 1.3) | (F.col("r") < 0.7))
    return per.join(many, "profile_id").select("profile_id", "difficulty", F.when(off, F.col("speed") / F.col("r")).otherwise(F.col("speed")).alias("speed_ms"))


def merged_profile(old: Column, new: Column, runs: Column) -> Column:
    """A measured value merged into a profile's: the more runs, the more it weighs, and half at least."""
    weight = F.greatest(F.lit(0.5), 1 - 1 / (runs + 1.0))
    return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(old * (1 - weight) + new * weight)
