"""Recordings and feeds, from bytes and texts made here."""

import json
import math
import random
import sqlite3
import struct

from pyspark.sql import functions as F

from fallline.functions import geo, text
from fallline.operators import costs, features, graphs, meeting, routes
from fallline.sources import devices, feeds


def fit_file() -> bytes:
    def define(local, number, fields, order="<", dev=b""):
        head = 0x40 | local | (0x20 if dev else 0)
        return struct.pack(order + "BBBHB", head, 0, 0 if order == "<" else 1, number, len(fields)) + b"".join(struct.pack("BBB", *f) for f in fields) + dev

    record = define(0, 20, [(253, 4, 0x86), (0, 4, 0x85), (1, 4, 0x85), (2, 2, 0x84), (6, 2, 0x84)], dev=bytes([1, 0, 2, 0]))
    half = 2**31
    point = lambda t, lat, lon, alt, speed: struct.pack("<BIiiHH", 0, t, int(lat / 180 * half), int(lon / 180 * half), alt, speed) + b"xx"
    lap = define(1, 21, [(2, 4, 0x86), (7, 4, 0x86), (9, 4, 0x86), (14, 2, 0x84)], ">")
    body = record + point(100, 39.6, -106.3, 15000, 4500) + point(107, 39.7, -106.2, 0xFFFF, 0xFFFF) + struct.pack("<BIiiHH", 0, 9, half - 1, 0, 0, 0) + b"xx" + lap + struct.pack(">BIIIH", 1, 100, 7000, 12345, 0xFFFF)
    body += bytes([0x80]) + b"\0" * 18 + point(120, 39.8, -106.1, 15010, 1000)
    return struct.pack("<BBHI4sH", 14, 16, 0, len(body), b".FIT", 0) + body + b"\0\0"


def test_fit(spark):
    df = spark.createDataFrame([("a", fit_file()), ("b", b"no"), ("c", fit_file()[:60])], "path string, content binary")
    got = devices.fit_points(df).where("path = 'a'").orderBy("seq").collect()
    assert [(round(r.lat, 5), round(r.lon, 5), r.elevation, r.at_s, r.speed) for r in got] == [(39.6, -106.3, 2500.0, 631065700, 4.5), (39.7, -106.2, None, 631065707, None), (39.8, -106.1, 2502.0, 631065720, 1.0)]
    (lap,) = devices.fit_laps(df.where("path = 'a'")).collect()
    assert (lap.start_s, lap.elapsed_s, lap.distance_m, lap.max_ms, lap.avg_ms) == (631065700, 7.0, 123.45, None, None)
    assert devices.fit_points(df.where("path != 'a'")).where("path = 'b'").count() == 0


TCX = b"""<TrainingCenterDatabase xmlns="x"><Activities><Activity><Lap StartTime="2024-01-01T10:00:00Z"><TotalTimeSeconds>10</TotalTimeSeconds><DistanceMeters>55</DistanceMeters>
<Track><Trackpoint><Time>2024-01-01T10:00:00Z</Time><Position><LatitudeDegrees>39.6</LatitudeDegrees><LongitudeDegrees>-106.3</LongitudeDegrees></Position><AltitudeMeters>3000</AltitudeMeters><Speed>9</Speed>
<Extensions><TPX><Speed>4.5</Speed></TPX></Extensions></Trackpoint><Trackpoint><Time>t</Time></Trackpoint></Track></Lap><Lap StartTime="x"/></Activity></Activities></TrainingCenterDatabase>"""


def test_tcx(spark):
    df = spark.createDataFrame([("a", TCX), ("b", b"<bad")], "path string, content binary")
    laps = devices.tcx_laps(df).orderBy("lap").collect()
    assert [(r.seconds, r.distance_m, r.avg_ms) for r in laps] == [(10.0, 55.0, 5.5), (None, None, None)]
    assert [(r.lap, r.lat, r.elevation, r.speed) for r in devices.tcx_points(df).collect()] == [(0, 39.6, 3000.0, 4.5)]


def test_sqlite(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "x.db")
    db.execute("CREATE TABLE other (time, latitude, longitude)")
    db.execute("INSERT INTO other VALUES (1, 2, 3)")
    db.execute("CREATE TABLE ZLOCATION (ZTIMESTAMP REAL, ZLATITUDE REAL, ZLONGITUDE REAL, ZALTITUDE REAL)")
    db.executemany("INSERT INTO ZLOCATION VALUES (?, ?, ?, ?)", [(20, 39.7, -106, 1), (10, 39.6, -106, None)])
    db.commit()
    db.close()
    df = spark.createDataFrame([("a", (tmp_path / "x.db").read_bytes()), ("b", b"junk")], "path string, content binary")
    assert [(r.seq, r.ts, r.lat, r.elevation, r.speed) for r in devices.sqlite_points(df).collect()] == [(0, 10.0, 39.6, None, None), (1, 20.0, 39.7, 1.0, None)]


def test_actions_and_workouts(spark):
    xml = b'<Activity><actions><Action type="Run" start="2024-01-01 10:00:00 +0100" end="2024-01-01 10:05:00 +0100"/><Action type="x" start="2024-01-01 10:00:00 +0000" end="2024-01-01 10:00:01 +0000"/><Action type="Lift"/></actions></Activity>'
    got = devices.actions(spark.createDataFrame([("a", xml)], "path string, content binary")).select("kind", F.unix_seconds("start").alias("s"), F.unix_seconds("stop").alias("e")).collect()
    assert [tuple(r) for r in got] == [("run", 1704099600, 1704099900), ("unknown", 1704103200, 1704103201)]
    h = spark.createDataFrame([("u1", "downhillSkiing", 5, [1, 2]), ("u2", "running", 9, [1]), ("u3", "snowboarding", 7, []), ("u4", "snowboarding", 8, [1])], "uuid string, activity string, start int, route array<int>")
    assert [r.key for r in devices.workouts(h).collect()] == ["healthkit:u4:1", "healthkit:u1:2"]


def test_overpass(spark):
    e = [{"type": "node", "id": k, "lat": 39.0 + k, "lon": -106.0} for k in range(3)]
    e += [{"type": "way", "id": 10, "nodes": [2, 0, 99], "tags": {"piste:type": "downhill", "name": "A", "piste:status": "closed"}}, {"type": "way", "id": 11, "nodes": [1, 99], "tags": {"aerialway": "gondola"}}, {"type": "way", "id": 12, "nodes": [1, 2], "tags": {"aerialway": "gondola"}}, {"type": "way", "id": 13, "nodes": [1, 2], "tags": {"aerialway": "zip_line"}}]
    got = feeds.overpass(spark.createDataFrame([("r", json.dumps({"elements": e}))], "resort_id string, json string")).orderBy("id").collect()
    assert [(r.id, r.kind, r.is_open, [p.lat for p in r.line]) for r in got] == [(10, "trail", False, [41.0, 39.0]), (12, "lift", True, [40.0, 41.0])]


def test_status_feeds(spark):
    area = {"GroomingAreas": [{"Name": "front {", "Trails": [{"Name": 'A \\" }', "IsOpen": True}], "Lifts": [{"Name": "L", "IsOpen": False}]}]}
    html = f"<script>x.TerrainStatusFeed = {json.dumps(area)}; other = {{}}</script>"
    got = feeds.terrain_feed(spark.createDataFrame([("r", html), ("q", "nothing")], "resort_id string, html string")).collect()
    assert sorted((r.kind, r.name, r.is_open) for r in got) == [("lift", "L", False), ("trail", 'A \\" }', True)]
    many = {"Resorts": [{"Name": "R", "MountainAreas": [{"Name": "a", "Trails": [{"Name": "T", "Difficulty": "Double-Black", "StatusEnglish": "Open", "Groomed": "yes"}, {"Name": "T", "Difficulty": "green"}, {"Name": "U", "Difficulty": "?", "StatusEnglish": "closed"}]}]}]}
    got = feeds.resort_feed(spark.createDataFrame([(json.dumps(many),)], "json string")).orderBy("name").collect()
    assert [(r.name, r.difficulty, r.is_open, r.groomed) for r in got] == [("T", "doubleblack", True, True), ("U", "blue", False, None)]
    got = feeds.lift_status(spark.createDataFrame([("s", '{"lifts": {"status": {"A": "open", "B": "closed"}}}')], "slug string, json string")).collect()
    assert sorted((r.lift, r.status) for r in got) == [("A", "open"), ("B", "closed")]


def test_hourly_stops_at_the_shortest(spark):
    h = {"hourly": {"time": ["a", "b", "c"], "temperature_2m": [1.0, 2.0], "snowfall": [0.0, 0.5, 1.0], "wind_speed_10m": [5.0, 6.0, 7.0], "visibility": [1000.0, 2000.0, 3000.0]}}
    got = feeds.hourly(spark.createDataFrame([("r", json.dumps(h))], "resort_id string, json string")).orderBy("i").collect()
    assert [(r.time, r.temperature_c, r.visibility_km) for r in got] == [("a", 1.0, 1.0), ("b", 2.0, 2.0)]


def test_files(spark, tmp_path):
    (tmp_path / "o.csv").write_text("name,kind,osm_way_ids\nA,trail,1|2\n")
    assert [(r.name, r.osm_way_ids, r.confidence) for r in feeds.official_items(spark, str(tmp_path / "o.csv"), None).collect()] == [("A", ["1", "2"], 1.0)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c/alta.json").write_text('{"resortId": "alta",\n "version": 1}')
    (r,) = feeds.curated(spark, str(tmp_path / "c")).collect()
    assert (r.resortId, r.version, r.trails) == ("alta", 1, None)
    graphs_ = spark.createDataFrame([("p", '{"nodes": {"n1": {"lat": 1.0, "lon": 2.0, "elevation": 3.0}}}')], "path string, json string")
    blobs = feeds.packed_graphs(graphs_)
    back = feeds.graph_blobs(blobs.unionByName(spark.createDataFrame([("bad", b"x", "")], blobs.schema)))
    assert {x.path: x.json is not None for x in back.collect()} == {"p": True, "bad": False}
    assert [(x.id, x.elevation) for x in feeds.graph_nodes(back).collect()] == [("n1", 3.0)]
    texts = [("w", '{"version": 3, "profile": {"id": 7, "display_name": "a"}, "runs": [{"dedup_hash": "h", "speed_ms": 1.5}]}'), ("b", '{"id": 8, "display_name": "b"}')]
    got = {x.path: (x.version, x.id, x.display_name, len(x.runs)) for x in feeds.backups(spark.createDataFrame(texts, "path string, json string")).collect()}
    assert got == {"w": (3, 7, "a", 1), "b": (0, 8, "b", 0)}
    r = spark.createDataFrame([("r", "Vail", 39.6, -106.3), ("s", "Other", 39.61, -106.3), ("t", "Far", 10.0, 10.0)], "id string, name string, lat double, lon double")
    a = spark.createDataFrame([("a1", "vail mountain", 39.0, -106.3), ("a2", "vail", 0.0, 0.0), ("a3", "x", 39.62, -106.3)], "id string, name string, lat double, lon double")
    assert {x.id: x.area for x in feeds.area_of(r, a).collect()} == {"r": "a2", "s": "a3", "t": None}
    (b,) = feeds.boxes(spark.createDataFrame([("r", 39.0, -106.0, 0.5, 1.0)], "id string, lat double, lon double, lat_span double, lon_span double")).collect()
    assert (b.min_lat, b.max_lat, b.min_lon, b.max_lon) == (38.75, 39.25, -106.5, -105.5)
    p = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)], "lat double, lon double")
    one = spark.createDataFrame([(1.0, 2.0, 10.0), (3.0, 4.0, -9999.0)], "lat double, lon double, elevation double")
    two = spark.createDataFrame([(1.0, 2.0, 99.0), (3.0, 4.0, 20.0)], "lat double, lon double, elevation double")
    assert {x.lat: x.elevation for x in feeds.elevations(p, one, two).collect()} == {1.0: 10.0, 3.0: 20.0, 5.0: None}


def test_reference_cases_of_functions(spark):
    """Known cases of keys, phones, times and cells."""
    one = spark.range(1)
    pick = lambda *c: one.select(*c).first()
    phones = lambda raw, region: set(pick(text.phone_candidates(F.lit(raw), F.lit(region)).alias("x")).x)
    assert phones("+1 604 555 1234", "US") == phones("(604) 555-1234", "US") == {"16045551234", "6045551234"}
    assert phones("12-34", "US") == set() and phones("+420 777 123 456", "US") == {"420777123456", "777123456"}
    key = lambda t, w, s, v: pick(text.conditions_key(*(F.lit(float(x)) for x in (t, w, s, v)), F.lit(30), F.lit(True), F.lit(False), F.lit(False)).alias("x")).x
    assert key(-3, 12, 4, 100) == key(-2, 19, 4, 15) == "cloud=25|gladed=0|moguls=1|snow=5|tempC=-5|ungroomed=0|vis=15|wind=10"
    assert "snow=0" in key(0, 0, 0, 0)
    times = [pick(F.unix_micros(text.iso_time(F.lit(x))).alias("x")).x for x in ("2024-03-12T12:30:00Z", "2024-03-12T12:30:00.123Z", "2024-03-12T14:30:00+02:00", "", "not a date", "2024-13-12T12:30:00Z")]
    assert times == [1710246600000000, 1710246600123000, 1710246600000000, None, None, None]
    cell = lambda lat, lon, n=6: pick(geo.geohash(F.lit(lat), F.lit(lon), n).alias("x")).x
    assert cell(47.6062, -122.3321) == "c23nb6" and cell(47.6062, -122.3321, 5) == "c23nb"
    assert pick(geo.geohash_box(F.lit("aaaaaa")).alias("x")).x is None
    around = pick(geo.geohash_neighbours(F.lit(cell(0.001, 179.999))).alias("x")).x
    assert len(around) == 9 and cell(0.001, -179.999) in around
    assert len(pick(geo.geohash_neighbours(F.lit(cell(89.999, 0.0))).alias("x")).x) == 6


def test_one_to_all_against_a_queue(spark):
    """Branching ways with cycles, ties and lifts that close, against a search with a queue."""
    import heapq

    rnd = random.Random(7)
    rows = []
    for k in range(120):
        kind = rnd.choice(["run", "run", "lift", "traverse"])
        rows.append((f"e{k:03}", rnd.randrange(30), rnd.randrange(30), kind, rnd.random() < 0.9, "chairLift", rnd.randrange(8), None if rnd.random() < 0.5 else float(rnd.randrange(70)), float(rnd.randrange(200, 600)), rnd.randrange(4), float(rnd.choice([300, 600])), float(rnd.randrange(50)), float(rnd.randrange(45)), rnd.choice([True, False, None]), rnd.random() < 0.3, rnd.random() < 0.3, 2100.0, None, 0, 0.0))
    schema = "id string, source long, target long, kind string, is_open boolean, lift_type string, capacity int, wait_min double, ride_s double, difficulty int, length_m double, vertical_m double, gradient double, groomed boolean, moguls boolean, gladed boolean, mid_m double, observed_ms double, observations int, observed_var double"
    edges = spark.createDataFrame(rows, schema)
    c, s = costs.Conditions(hour=15.6), costs.Skier()
    got = {r.node: (r.seconds, r.via) for r in routes.one_to_all(edges, spark.createDataFrame([(0, 0)], "person int, node long"), c, s).collect()}
    fixed = {r.id: r.s for r in edges.where("kind != 'lift'").select("id", costs.seconds(c, s, F.lit(0.0)).alias("s")).collect()}

    def cost(e, at):
        if e[3] != "lift":
            return fixed[e[0]]
        hour = 15.6 + at / 3600
        if not e[4] or not 7 <= math.floor(hour) < 21:
            return None
        usual = min(90 * (0.7 if e[6] >= 6 else 0.85 if e[6] >= 4 else 1.0) * (0.9 if math.floor(hour) == 15 else 1.0), 600.0)
        wait = usual
        if e[7] is not None and e[7] <= 60:
            live = e[7] * 60
            wait = 0.7 * live + 0.3 * usual if live * 3 < usual or live > usual * 3 else live
        return e[8] + wait

    best, queue, done = {0: (0.0, None)}, [(0.0, 0)], set()
    while queue:
        at, node = heapq.heappop(queue)
        if node in done:
            continue
        done.add(node)
        for e in rows:
            if e[1] == node and (t := cost(e, at)) is not None:
                new = (at + t, e[0])
                if e[2] not in best or new[0] < best[e[2]][0] - 1e-9 or (abs(new[0] - best[e[2]][0]) < 1e-9 and best[e[2]][1] and new[1] < best[e[2]][1]):
                    best[e[2]] = new
                    heapq.heappush(queue, (new[0], e[2]))
    assert got.keys() == best.keys()
    assert all(math.isclose(got[n][0], best[n][0], rel_tol=1e-9) and (n == 0 or got[n][1] == best[n][1]) for n in best)


def test_fingerprint_chain_names_and_diversity(spark):
    rnd = random.Random(2)
    rows = [(k, "".join(rnd.choice("abcdé") for _ in range(rnd.randint(0, 40)))) for k in range(500)]
    want = 0
    for _, x in rows:
        for b in x.encode():
            want = (want * 31 + b) % 2**64
    df = spark.createDataFrame(rows, "k int, x string")
    assert graphs.fingerprint(df.repartition(5), ["k"], F.col("x")) == f"{want:016x}"
    assert graphs.fingerprint(df.where("k > 0"), ["k"], F.col("x")) != f"{want:016x}"
    e = spark.createDataFrame([("g", "b", 2, 3), ("g", "a", 2, 1), ("g", "c", 4, 3)], "grp string, id string, source long, target long")
    assert [(r.id, r.forward) for r in graphs.chained(e).orderBy("i").collect()] == [("a", False), ("b", True), ("c", False)]
    e = spark.createDataFrame([("a", 1, 2, "blue", "Main", "run"), ("b", 2, 3, "blue", None, "run"), ("c", 3, 4, "blue", None, "run"), ("d", 3, 5, "black", None, "run")], "id string, source long, target long, difficulty string, name string, kind string")
    assert {r.id: r.name for r in graphs.named_by_neighbours(e).collect()} == {"a": "Main", "b": "Main", "c": "Main", "d": None}
    c = spark.createDataFrame([(1, k, 39.6 + 0.0005 * k, -106.0, float(k)) for k in range(12)], "request int, id int, lat double, lon double, score double")
    assert [r.id for r in meeting.diverse(c, 3, (350.0, 0.0)).orderBy("rank").collect()] == [0, 7, 1]
    (f,) = spark.createDataFrame([(1.0, 2.0, "x")], "lat double, lon double, name string").select(features.feature(features.point(F.col("lat"), F.col("lon")), "name").alias("f")).collect()
    assert json.loads(f.f) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [2.0, 1.0]}, "properties": {"name": "x"}}
