"""Trail graphs: edges and nodes from ways, links between them, components, groups, and what is wrong with one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .costs import ride_time
from .filters import kept
from .joins import expanded, near_places
from .tracks import cells


def node_id(p: Column) -> Column:
    """A node's name: its coordinates in units of 1e-5 degrees, halves up."""
    part = lambda v: F.floor(v * 100_000 + 0.5).cast("long").cast("string")
    return F.concat(F.lit("n"), part(p["lat"]), F.lit("_"), part(p["lon"]))


def ends(line: Column) -> tuple[Column, Column, Column]:
    """The elevations that are known, and those of both ends, the nearest known ones standing in for missing ones."""
    known = F.filter(F.transform(line, lambda p: p["elevation"]), lambda e: e.isNotNull())
    first = F.coalesce(F.get(line, F.lit(0))["elevation"], F.get(known, F.lit(0)), F.lit(0.0))
    last = F.coalesce(F.get(line, F.size(line) - 1)["elevation"], F.get(known, F.size(known) - 1), F.lit(0.0))
    return known, first, last


def run_edges(ways: DataFrame) -> DataFrame:
    """Runs of ways(id, line, difficulty, name): downhill by their ends, else away from where the peak lies."""
    known, first, last = ends(F.col("line"))
    peak = F.array_position(known, F.array_max(known)) - 1
    level = F.when((F.size(known) >= 3) & (F.array_max(known) > 0), peak <= F.floor(F.size(known) / 2)).otherwise(F.lit(True))
    down = F.when(first != last, first > last).otherwise(level)
    rows = ways.where(F.size("line") >= 2).select("id", "difficulty", "name", F.when(down, F.col("line")).otherwise(F.reverse("line")).alias("line"), F.abs(first - last).alias("net"), F.coalesce(F.array_max(known), first).alias("top"), F.coalesce(F.array_min(known), last).alias("foot"))
    p = F.col("line")
    return rows.select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("id"), node_id(F.get(p, F.lit(0))).alias("source"), node_id(F.get(p, F.size(p) - 1)).alias("target"), F.lit("run").alias("kind"), "difficulty", "name", geo.line_length(p).alias("length_m"), F.greatest("net", F.col("top") - F.col("foot")).alias("vertical_m"), "line")


def lift_edges(ways: DataFrame) -> DataFrame:
    """Lifts of ways(id, line, name, lift_type), from the lower end up, with the time a ride takes."""
    known, first, last = ends(F.col("line"))
    rows = ways.where(F.size("line") >= 2).select("id", "name", "lift_type", F.when(first > last, F.reverse("line")).otherwise(F.col("line")).alias("line"), F.greatest(F.abs(first - last), F.coalesce(F.array_max(known) - F.array_min(known), F.lit(0.0))).alias("vertical_m"))
    p = F.col("line")
    rows = rows.withColumn("length_m", geo.line_length(p))
    return rows.select(F.concat(F.lit("l"), F.col("id").cast("string")).alias("id"), node_id(F.get(p, F.lit(0))).alias("source"), node_id(F.get(p, F.size(p) - 1)).alias("target"), F.lit("lift").alias("kind"), "name", "lift_type", "length_m", "vertical_m", ride_time(F.col("length_m"), F.col("lift_type")).alias("ride_s"), "line")


def first_nodes(runs: DataFrame, lifts: DataFrame) -> DataFrame:
    """(id, kind): each node as the first edge that names it made it, runs before lifts, by edge id."""
    part = lambda df, order, a, b: df.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(order).alias("o"), F.col("id").alias("e"), F.lit(0).alias("end"), F.lit(a).alias("kind")), F.struct(F.col("target").alias("id"), F.lit(order).alias("o"), F.col("id").alias("e"), F.lit(1).alias("end"), F.lit(b).alias("kind")))).alias("x")).select("x.*")
    every = part(runs, 0, "trailHead", "trailEnd").unionByName(part(lifts, 1, "liftBase", "liftTop"))
    return every.groupBy("id").agg(F.min_by("kind", F.struct("o", "e", "end")).alias("kind"))


def traverses(nodes: DataFrame, edges: DataFrame, metres: float = 200.0, level_m: float = 10.0, down_m: float = 30.0, digits: int | None = None) -> DataFrame:
    """(source, target, metres) of ways across between near nodes that no edge joins: both ways where level, else downhill.

    nodes(id, lat, lon, elevation). Near places meet by cells wider than the distance, and their nodes
    follow. A node knows the near nodes that edges join it to, so that no pair is moved to be held against edges.
    """
    size = 2 * metres / 111_000
    pairs = near_places(nodes, metres, cells("lat", "lon", size, 1), cells("lat", "lon", size), closed=False, digits=digits)
    at = lambda name, k: nodes.select(F.col("id").alias(name), F.col("lat").alias(f"lat{k}"), F.col("lon").alias(f"lon{k}"), F.col("elevation").alias(f"z{k}"))
    joined = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select("target", "source")).where("a != b").distinct()
    ends = joined.join(at("a", 1).hint("merge"), "a").join(at("b", 2).hint("merge"), "b")
    near = ends.where(geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) < metres)
    known = near.groupBy("a").agg(F.collect_set("b").alias("known"))
    both = expanded(pairs, at("a", 1).join(known.hint("merge"), "a", "left"), at("b", 2)).where("a != b AND (known IS NULL OR NOT array_contains(known, b))")
    drop = F.col("z1") - F.col("z2")
    return both.where((F.abs(drop) <= level_m) | drop.between(level_m, down_m)).select(F.col("a").alias("source"), F.col("b").alias("target"), "metres")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of links(a, b), a component being named by its least node.

    Rounds of hooking each component to its least neighbour and following such hooks to their end; a
    round halves what is left at least, and is checkpointed.
    """
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    labels = kept(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    edges = kept(both.where("a != b"))
    while not edges.isEmpty():
        hook = kept(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")))
        while True:  # to the end of each chain of hooks
            further = hook.join(hook.select(F.col("a").alias("up"), F.col("up").alias("upper")), "up").select("a", F.col("upper").alias("up"), (F.col("upper") != F.col("up")).alias("moved"))
            further = kept(further)
            hook = further.select("a", "up")
            if further.where("moved").isEmpty():
                break
        labels = kept(labels.join(hook.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        moved = edges.join(hook, "a").select(F.col("up").alias("a"), "b").join(hook.select(F.col("a").alias("b"), F.col("up").alias("to")), "b").select("a", F.col("to").alias("b"))
        edges = kept(moved.where("a != b").distinct())
    return labels


def bridges(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(component, a, b, metres): for each component but the largest the closest pair of nodes to that one.

    nodes(id, lat, lon) of one resort, labels(node, component). The largest component has most nodes, then the least name.
    """
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    main = sizes.agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"))
    at = nodes.join(labels, F.col("id") == F.col("node")).join(F.broadcast(main))  # one row
    here = at.where("component != main").select("component", F.col("id").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    there = at.where("component = main").select(F.col("id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    # Cells of growing width: only components without a partner in one width go on to the next.
    out, left, size = None, kept(here), 0.002
    while not left.isEmpty():
        near = left.select("*", *cells("lat1", "lon1", size, 1)).select("component", "a", "lat1", "lon1", "cell.cy", "cell.cx").join(there.select("*", *cells("lat2", "lon2", size)), ["cy", "cx"])
        near = near.withColumn("metres", geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
        near = near.where(F.col("metres") <= size * 111_000 * F.cos(F.radians("lat1")))  # nothing nearer can lie beyond the cells looked into
        found = kept(near.groupBy("component").agg(F.min(F.struct(F.round("metres", 6).alias("m"), "a", "b")).alias("x")).select("component", "x.a", "x.b", F.col("x.m").alias("metres")))
        out = found if out is None else out.unionByName(found)
        left, size = kept(left.join(found.select("component"), "component", "left_anti")), size * 4
    return out if out is not None else here.select("component", "a", F.lit(None).cast("long").alias("b"), F.lit(0.0).alias("metres"))


def pruned(edges: DataFrame) -> DataFrame:
    """edges(id, source, target, name) less those at a node with one edge or none and no named one."""
    ends_ = edges.select(F.explode(F.array("source", "target")).alias("node"), F.col("name").isNotNull().alias("named"))
    gone = ends_.groupBy("node").agg(F.count("*").alias("n"), F.bool_or("named").alias("named")).where("n <= 1 AND NOT named").select("node")
    for side in ("source", "target"):
        edges = edges.join(gone.withColumnRenamed("node", side), side, "left_anti").select(edges.columns)
    return edges


def trail_groups(edges: DataFrame, key: Column) -> DataFrame:
    """(id, trail_group): edges of one key and difficulty that hang together by nodes; unnamed ones each for itself. Groups are numbered by key."""
    rows = edges.where("kind = 'run'").select("id", "difficulty", "source", "target", F.nullif(key, F.lit("")).alias("key"))
    at = rows.where("key IS NOT NULL").select("id", "key", "difficulty", F.explode(F.array("source", "target")).alias("node"))
    first = at.groupBy("key", "difficulty", "node").agg(F.min("id").alias("a"))
    links = at.join(first, on=[at["key"] == first["key"], at["difficulty"].eqNullSafe(first["difficulty"]), at["node"] == first["node"]]).select("a", F.col("id").alias("b"))
    labels = components(links)
    named = rows.join(labels, F.col("id") == F.col("node"), "left").select("id", F.coalesce("key", F.lit("")).alias("key"), F.coalesce("difficulty", F.lit("")).alias("difficulty"), F.coalesce("component", "id").alias("component"))
    groups = named.select("key", "difficulty", "component").distinct().withColumn("n", F.row_number().over(Window.orderBy("key", "difficulty", "component")) - 1)  # groups of one resort
    return named.join(groups.select("component", "n"), "component").select("id", F.concat(F.lit("tg"), F.col("n").cast("string")).alias("trail_group"))


def diagnostics(edges: DataFrame) -> DataFrame:
    """(problem, node): sinks that are come to and not left, and lift tops from which no run goes on."""
    out, into = edges.select(F.col("source").alias("node")).distinct(), edges.select(F.col("target").alias("node")).distinct()
    tops = edges.where("kind = 'lift'").select(F.col("target").alias("node")).distinct()
    runs = edges.where("kind = 'run'").select(F.col("source").alias("node")).distinct()
    return into.join(out, "node", "left_anti").select(F.lit("sink").alias("problem"), "node").unionByName(tops.join(runs, "node", "left_anti").select(F.lit("top_without_run").alias("problem"), "node"))


def named_by_neighbours(edges: DataFrame) -> DataFrame:
    """(id, name): unnamed runs named by a run of their difficulty that shares an end, round by round, the least name first, until none is left that can be."""
    names = kept(edges.where("kind = 'run'").select("id", "source", "target", "difficulty", "name"))
    while True:
        given = names.where("name IS NOT NULL").select("name", F.col("difficulty").alias("d"), F.explode(F.array("source", "target")).alias("node"))
        asked = names.where("name IS NULL").select("id", "difficulty", F.explode(F.array("source", "target")).alias("node"))
        new = kept(asked.join(given, "node").where("difficulty <=> d").groupBy("id").agg(F.min("name").alias("new")))
        if new.isEmpty():
            return names.select("id", "name")
        names = kept(names.join(new, "id", "left").withColumn("name", F.coalesce("name", "new")).drop("new"))


def reaching_lifts(edges: DataFrame, hops: int = 8) -> DataFrame:
    """Nodes from which a lift can be boarded within so many edges: the number of hops is the feature. Backward from the lifts' feet."""
    open_ = edges.where("is_open").select("source", "target")
    seen = kept(edges.where("is_open AND kind = 'lift'").select(F.col("source").alias("node")).distinct().withColumn("hops", F.lit(0)))
    front = seen
    for k in range(1, hops + 1):
        front = kept(front.join(open_, F.col("node") == F.col("target")).select(F.col("source").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(k)))
        if front.isEmpty():
            break
        seen = kept(seen.unionByName(front))
    return seen


def nearest_node(positions: DataFrame, nodes: DataFrame, tiers: tuple[float, ...] = (36.0, 100.0, 500.0, 1000.0)) -> DataFrame:
    """(id, node, metres): the nearest node of each position(id, lat, lon), looked for in ever wider rings, null beyond the last."""
    out, left = None, positions.select("id", "lat", "lon")
    for metres in tiers:
        size = 2 * metres / 111_000
        near = left.select("*", *cells("lat", "lon", size, 1)).select("id", "lat", "lon", "cell.cy", "cell.cx").join(nodes.select(F.col("id").alias("node"), F.col("lat").alias("nlat"), F.col("lon").alias("nlon")).select("*", *cells("nlat", "nlon", size)), ["cy", "cx"])
        near = near.withColumn("metres", geo.haversine(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon"))).where(F.col("metres") <= metres)
        found = kept(near.groupBy("id").agg(F.min(F.struct(F.round("metres", 6).alias("m"), "node")).alias("x")).select("id", "x.node", F.col("x.m").alias("metres")))
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select("id"), "id", "left_anti")
    return positions.select("id").join(out, "id", "left")


FOLD = 31
_PARTIAL = pa.schema([("part", pa.int64()), ("value", pa.binary()), ("length", pa.int64())])


def fingerprint(rows: DataFrame, order: list[str], text: Column) -> str:
    """Sixteen hex digits of a rolling hash, h * 31 + byte modulo 2^64, over the rows' texts in order.

    The hash of a whole follows from those of its parts and their lengths, so ranges are hashed apart
    and only one number a range meets on the driver.
    """
    parts = max(1, rows.rdd.getNumPartitions())
    dealt = rows.select(*order, text.cast("binary").alias("text__")).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        value, length = 0, 0
        for batch in batches:
            data = np.frombuffer(b"".join(x.as_py() or b"" for x in batch.column("text__")), np.uint8).astype(np.uint64)
            if len(data):
                powers = np.full(len(data), FOLD, np.uint64)
                powers[-1] = 1
                powers = np.cumprod(powers[::-1], dtype=np.uint64)[::-1]  # wraps at 2^64, as is meant
                value = (value * pow(FOLD, len(data), 1 << 64) + int((data * powers).sum(dtype=np.uint64))) % (1 << 64)
                length += len(data)
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "value": value.to_bytes(8, "big"), "length": length}], schema=_PARTIAL)

    total = 0
    for r in sorted(dealt.mapInArrow(run, "part long, value binary, length long").collect(), key=lambda r: r.part):
        total = (total * pow(FOLD, r.length, 1 << 64) + int.from_bytes(bytes(r.value), "big")) % (1 << 64)
    return f"{total:016x}"


def chained(edges: DataFrame) -> DataFrame:
    """(grp, i, id, forward): the edges of each group put end to end, from an end with one edge if there is one, the least node first.

    edges(grp, id, source, target). A group is a trail of a few edges.
    """
    schema = "grp string, i int, id string, forward boolean"

    def walk(frame):
        import pandas as pd

        left, at = dict(zip(frame["id"], zip(frame["source"], frame["target"], strict=True), strict=True)), {}
        for s, t in left.values():
            at[s], at[t] = at.get(s, 0) + 1, at.get(t, 0) + 1
        out, now = [], None
        while left:
            here = sorted(e for e, st in left.items() if now in st)
            if not here:
                nodes = {n for st in left.values() for n in st}
                now = min((n for n in nodes if at[n] == 1), default=min(nodes))
                here = sorted(e for e, st in left.items() if now in st)
            s, t = left.pop(here[0])
            out.append((frame["grp"].iloc[0], len(out), here[0], s == now))
            now = t if s == now else s
        return pd.DataFrame(out, columns=["grp", "i", "id", "forward"])

    return edges.groupBy("grp").applyInPandas(walk, schema)
