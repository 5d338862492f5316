"""Many copies and many rows: operators end in time, and have the results of brute force."""

import json
import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from fallline.functions import geo
from fallline.operators import filters, graphs, joins, social, tracks


@pytest.fixture
def soon(spark):
    """Jobs that run after 60 seconds are cancelled, so that the test fails."""
    timer = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    timer.start()
    yield
    timer.cancel()


def metres(a, b):
    u, v = math.sin(math.radians(b[0] - a[0]) / 2), math.sin(math.radians(b[1] - a[1]) / 2)
    return 2 * geo.EARTH_M * math.asin(math.sqrt(u * u + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * v * v))


def degrees(a, b):
    (la, oa), (lb, ob) = (tuple(map(math.radians, x)) for x in (a, b))
    return math.degrees(math.atan2(math.sin(ob - oa) * math.cos(lb), math.cos(la) * math.sin(lb) - math.sin(la) * math.cos(lb) * math.cos(ob - oa))) % 360


def some_track(rnd, n):
    at = (39.6 + rnd.random() * 0.01, -106.36 + rnd.random() * 0.01)
    return [(at[0] + k * 0.0002 * rnd.random(), at[1] + k * 0.0002 * rnd.random()) for k in range(n)]


def lines_of(spark, edges):
    return spark.createDataFrame([(e, [{"lat": a, "lon": b} for a, b in line]) for e, line in edges.items()], "id string, line array<struct<lat:double,lon:double>>")


def points_of(spark, segments):
    return spark.createDataFrame([(s, i, *p) for s, ps in segments.items() for i, p in ps], "segment long, i int, lat double, lon double")


def test_matched_in_blocks(spark, monkeypatch):
    """Lines of several lengths and copies of them, segments with two points of one number, blocks of a few."""
    monkeypatch.setattr(tracks, "SHAPES", 3)
    monkeypatch.setattr(tracks, "LINES", 5)
    rnd = random.Random(2)
    edges = {f"e{k}": some_track(rnd, rnd.randint(1, 6)) for k in range(40)} | {"e40": [(39.605, None), (39.605, -106.355)]}
    edges |= {f"a{k}": edges[f"e{k}"] for k in range(0, 40, 3)}
    segments = {k: list(enumerate(some_track(rnd, rnd.randint(1, 9)))) for k in range(30)}
    segments |= {k + 30: [*segments[k], (1, (39.604, -106.352))] for k in range(10)} | {k + 40: segments[k] for k in range(10)}
    got = {r.segment: (r.edge, round(r.score, 6)) for r in tracks.matched(points_of(spark, segments), lines_of(spark, edges), 300.0, 45.0).collect()}
    want = {}
    for s, ps in segments.items():
        firsts, lasts = ([p for i, p in ps if i == pick(x for x, _ in ps)] for pick in (min, max))
        for e, line in edges.items():
            if None in line[0]:
                continue
            turn = abs(degrees(min(firsts), min(lasts)) - degrees(line[0], line[-1]))
            turn = min(turn, 360 - turn)
            gap = {}
            for i, p in ps:
                gap[i] = min(gap.get(i, 1e9), *(metres(p, v) for v in line))
            score = sum(gap.values()) / len(gap)
            if score < 300 and (turn <= 45 or 180 - turn <= 45):
                want[s] = min(want.get(s, (1e9, "")), (round(score, 9), e))
    assert len(want) > 25
    assert got == {s: (e, round(d, 6)) for s, (d, e) in want.items()}


def test_matched_copies(spark, soon):
    """20,000 copies of a segment and of an edge are one pair."""
    n = spark.range(20_000)
    points = n.select(F.col("id").alias("segment"), F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).select("segment", "i", (39.6 + 0.0001 * F.col("i")).alias("lat"), F.lit(-106.36).alias("lon"))
    vertex = lambda lat: F.struct(F.lit(lat).alias("lat"), F.lit(-106.36).alias("lon"))
    edges = n.select(F.concat(F.lit("e"), "id").alias("id"), F.array(vertex(39.6), vertex(39.6001)).alias("line"))
    got = tracks.matched(points, edges).groupBy("edge").agg(F.count("*").alias("n"), F.max("score").alias("score")).collect()
    assert [(r.edge, r.n, round(r.score, 6)) for r in got] == [("e0", 20_000, 0.0)]


def test_by_centroid_copies(spark, soon):
    """40,000 copies of a segment and of an edge are one pair; a nearer edge is found, a place without coordinates is none."""
    n = spark.range(40_000)
    points = n.select(F.col("id").alias("segment"), F.lit(0).alias("i"), F.lit(39.6).alias("lat"), F.lit(-106.36).alias("lon"))
    edges = n.select(F.concat(F.lit("e"), "id").alias("id"), F.array(F.struct(F.lit(39.601).alias("lat"), F.lit(-106.36).alias("lon"))).alias("line"))
    got = tracks.by_centroid(points, edges).groupBy("edge").agg(F.count("*").alias("n"), F.max("d").alias("d")).collect()
    assert [(r.edge, r.n, round(r.d, 6)) for r in got] == [("e0", 40_000, round(metres((39.6, -106.36), (39.601, -106.36)), 6))]
    nearer = lines_of(spark, {"z": [(39.6002, -106.36)], "y": [(None, -106.36)]})
    assert [r.edge for r in tracks.by_centroid(points.limit(1), edges.unionByName(nearer)).collect()] == ["z"]


def test_nearest_in_time_of_many(spark, soon):
    """200,000 rows in a few ranges: a row at a time of two as near takes the later, one at an entry that one."""
    at = lambda s: F.timestamp_seconds(s)
    rows = spark.range(200_000).select("id", at(F.col("id") * 10).alias("ts"))
    series = spark.range(0, 2_000_000, 1_000).select(at(F.col("id")).alias("time"), F.col("id").alias("v"))
    got = joins.nearest_in_time(rows, series, "ts", "time", ["v"])
    right = F.least(F.floor((F.col("id") * 10 + 500) / 1000) * 1000, F.lit(1_999_000))
    assert got.where(F.col("v") == right).where("v = unix_seconds(matched)").count() == 200_000


def test_validated_against_all_pairs(spark, soon):
    """Near names, equal ones, too short ones and none, against every pair; 30,000 copies of each of 30 names are 30 names."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 9)))
    official = [word() for _ in range(60)] + ["Black  Diamond!", "Ö", None]
    near = lambda x: x.replace(x[rnd.randrange(len(x))], "ab", 1) if x else x
    trails = [(k, word() if k % 2 else near(rnd.choice(official[:60]))) for k in range(200)] + [(200, "black diamond"), (201, "ö"), (202, None), (203, "")]
    got = {r.id: r.verdict for r in filters.validated(spark.createDataFrame(trails, "id long, name string"), spark.createDataFrame([(x,) for x in official], "official string")).collect()}
    bare = lambda x: "".join(c for c in x.lower() if c.isalnum())
    pairs = lambda x: {x[k : k + 2] for k in range(len(x) - 1)}

    def alike(a, b):
        x, y = pairs(a), pairs(b)
        return 2 * len(x & y) / (len(x) + len(y)) if x and y else float(a == b)

    want = {}
    for k, name in trails:
        s = max((alike(bare(name), bare(x)) for x in official if x is not None), default=0.0) if name is not None else 0.0
        want[k] = "valid" if s >= 0.85 else "open" if s >= 0.72 else "closed"
    assert got == want
    assert len(set(want.values())) == 3
    many = spark.range(900_000).select("id", F.concat(F.lit("a long and common name of number "), F.chr(F.col("id") % 30 + 97)).alias("name"))
    found = filters.validated(many, many.where("id < 30").select(F.col("name").alias("official")))
    assert found.where("verdict = 'valid'").count() == 900_000


@pytest.fixture
def broad(spark):
    """The planner broadcasts whatever it may."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def some_nodes(spark, rnd):
    places = [(39.6 + rnd.random() * 0.004, -106.36 + rnd.random() * 0.004) for _ in range(30)]
    nodes = {k: (*rnd.choice(places), rnd.choice([None, *(float(x) for x in range(60))])) for k in range(200)} | {200: (None, -106.36, 3.0)}
    return nodes, spark.createDataFrame([(k, *v) for k, v in nodes.items()], "id long, lat double, lon double, elevation double")


def test_neighbours_by_places(spark, broad):
    """Many nodes of one place, and one without; nothing that follows the nodes is broadcast."""
    nodes, rows = some_nodes(spark, random.Random(6))
    found = joins.neighbours(rows, 100.0)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(a, b): metres(p, q) for a, p in nodes.items() for b, q in nodes.items() if a < b and None not in (p[0], q[0]) and metres(p, q) <= 100}
    got = found.collect()
    assert len(got) == len(want) > 300
    assert {(r.a, r.b): round(r.metres, 6) for r in got} == {k: round(v, 6) for k, v in want.items()}


def test_traverses_by_places(spark, broad):
    """Edges either way round, twice, to themselves and to nothing; nothing that follows the nodes is broadcast."""
    rnd = random.Random(7)
    nodes, rows = some_nodes(spark, rnd)
    edges = [(rnd.randrange(210), rnd.randrange(210)) for _ in range(3000)] + [(5, 5), (None, 3)]
    found = graphs.traverses(rows, spark.createDataFrame([*edges, *edges[:50]], "source long, target long"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    joined = {(min(x), max(x)) for x in edges if None not in x}
    want = {}
    for a, p in nodes.items():
        for b, q in nodes.items():
            if a < b and None not in p + q and (a, b) not in joined and metres(p, q) < 200:
                d = p[2] - q[2]
                want |= {(a, b): metres(p, q)} if abs(d) <= 10 or 10 <= d <= 30 else {}
                want |= {(b, a): metres(p, q)} if abs(d) <= 10 or 10 <= -d <= 30 else {}
    got = found.collect()
    assert len(got) == len(want) > 300
    assert {(r.source, r.target): round(r.metres, 6) for r in got} == {k: round(v, 6) for k, v in want.items()}


def test_exported_whole_documents(spark):
    """One profile's many runs over several batches in order, others with few, none, a null id or the same id; no document is an array of its runs first."""
    people = spark.createDataFrame([(1, "a"), (2, 'b"ü'), (2, "c"), (3, None), (None, "d")], "id long, display_name string")
    many = spark.range(60_000).select(F.lit(1).alias("profile_id"), F.timestamp_seconds(F.col("id") * 7919 % 60_000).alias("run_at"), F.concat(F.lit("h"), "id").alias("dedup_hash"), F.lit(1.5).alias("speed_ms"))
    few = spark.createDataFrame([(2, None, None, float("nan")), (2, None, "x", 2.0), (None, None, "y", 1.0), (9, None, "z", 1.0)], "profile_id int, run_at timestamp, dedup_hash string, speed_ms double")
    found = social.exported(people, many.unionByName(few))
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r.id, []).append(json.loads(r.document))
    assert {k: len(v) for k, v in got.items()} == {1: 1, 2: 2, 3: 1, None: 1}
    assert [r["dedup_hash"] for r in got[1][0]["runs"]] == [f"h{k}" for k in sorted(range(60_000), key=lambda k: k * 7919 % 60_000)]
    assert sorted(d["profile"]["display_name"] for d in got[2]) == ['b"ü', "c"]
    assert all(d["runs"] == [{"speed_ms": '["NaN"]'}, {"dedup_hash": "x", "speed_ms": "2.0"}] for d in got[2])
    assert got[3] == [{"version": 3, "profile": {"id": 3}, "runs": []}]
    assert got[None] == [{"version": 3, "profile": {"display_name": "d"}, "runs": []}]
