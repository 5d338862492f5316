"""Queries over scalar functions, filters, sets and extra SQL operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, text, units
from ..operators import filters
from .registry import HAV, R, add

KEY = r"trim(regexp_replace(lower(strip_accents(name)), '[^\p{L}\p{N}]+', ' ', 'g'))"
add("str03_trail_key", "f_trails", lambda t: t.select("id", text.trail_key(F.col("name")).alias("key")), f"SELECT id, {KEY} AS key FROM f_trails")
add("str05_vocabulary", "f_trails", lambda t: t.select("id", filters.is_glade(F.col("name")).alias("glade"), filters.difficulty_rank(F.col("difficulty")).alias("rank")), "SELECT id, regexp_matches(lower(name), '\\b(glade|glades|trees|woods|forest)\\b') AS glade, CASE difficulty WHEN 'green' THEN 0 WHEN 'blue' THEN 1 WHEN 'black' THEN 2 END AS rank FROM f_trails")
CODES = ", ".join(f"('{k}', '{v}')" for k, v in text.DIAL_CODES.items())
add("str07_phone_candidates", "f_contacts", lambda c: c.select("id", F.array_join(text.phone_candidates(F.col("raw"), F.col("region")), ",").alias("found")), f"""
SELECT id, CASE WHEN length(d) < 7 THEN '' WHEN trim(raw) LIKE '+%' OR trim(raw) LIKE '00%' THEN array_to_string(list_sort(list_distinct([d, CASE WHEN length(d) - length(known) >= 7 THEN substr(d, length(known) + 1) END])), ',')
 ELSE array_to_string(list_sort(list_distinct([d, CASE WHEN own IS NULL THEN NULL WHEN starts_with(d, own) AND length(d) > length(own) + 6 THEN substr(d, length(own) + 1) ELSE own || d END])), ',') END AS found
FROM (SELECT c.*, regexp_replace(raw, '\\D', '', 'g') AS d, (SELECT code FROM (VALUES {CODES}) t(r, code) WHERE r = upper(region)) AS own,
 (SELECT max_by(code, length(code)) FROM (VALUES {CODES}) t(r, code) WHERE starts_with(regexp_replace(c.raw, '\\D', '', 'g'), code)) AS known FROM f_contacts c)""")
add("str08_labels", "f_trails", lambda t: t.select("id", text.bare_label(F.col("name"), F.col("difficulty")).alias("label"), text.initials(F.col("name")).alias("initials")), """
SELECT id, CASE WHEN starts_with(lower(name), difficulty || ' ') THEN trim(substr(name, length(difficulty) + 1)) ELSE name END AS label,
 upper(array_to_string(list_transform(list_slice(list_filter(string_split_regex(trim(name), '\\s+'), lambda w: w <> ''), 1, 2), lambda w: w[1]), '')) AS initials FROM f_trails""")
add("str09_units", "f_weather", lambda w: w.select("id", units.distance(F.col("wind_kph") * 37).alias("metric"), units.distance(F.col("wind_kph") * 37, False).alias("imperial"), units.duration(F.col("wind_kph") * 97).alias("took"), units.elevation(F.col("vis_km") * 100, False).alias("height")), """
SELECT id, CASE WHEN wind_kph * 37 >= 1000 THEN printf('%.1fKM', wind_kph * 37 / 1000) ELSE CAST(CAST(trunc(wind_kph * 37) AS BIGINT) AS VARCHAR) || 'M' END AS metric,
 CASE WHEN wind_kph * 37 * 3.28084::DOUBLE >= 5280 THEN printf('%.1fMI', wind_kph * 37 * 3.28084::DOUBLE / 5280) ELSE CAST(CAST(trunc(wind_kph * 37 * 3.28084::DOUBLE) AS BIGINT) AS VARCHAR) || 'FT' END AS imperial,
 CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS took,
 CAST(CAST(trunc(vis_km * 100 * 3.28084::DOUBLE) AS BIGINT) AS VARCHAR) || 'FT' AS height FROM (SELECT *, CAST(trunc(wind_kph * 97) AS BIGINT) AS s FROM f_weather)""")
add("str10_full_conditions_key", "f_weather", lambda w: w.select("id", text.conditions_key(*(F.col(c) for c in ("temp_c", "wind_kph", "snow_cm", "vis_km", "cloud", "moguls", "ungroomed", "gladed"))).alias("key")), """
SELECT id, array_to_string(list_sort(list_filter(['tempC=' || CAST(floor(temp_c / 5) * 5 AS BIGINT), 'wind=' || CAST(floor(wind_kph / 10) * 10 AS BIGINT), 'snow=' || CAST(ceil(snow_cm / 5) * 5 AS BIGINT),
 'vis=' || CAST(floor(least(vis_km, 15) / 3) * 3 AS BIGINT), 'cloud=' || (cloud // 25 * 25), 'moguls=' || CAST(moguls AS INTEGER), 'ungroomed=' || CAST(ungroomed AS INTEGER), 'gladed=' || CAST(gladed AS INTEGER)], lambda x: x IS NOT NULL)), '|') AS key FROM f_weather""")
add("str11_dedup_hash", "f_runs", lambda r: r.select("run_id", text.dedup_hash(F.lit("gpx"), F.col("run_at").cast("timestamp"), F.col("resort_id"), F.col("edge_id"), F.col("duration_s")).alias("hash"), text.dedup_hash(F.lit("live"), F.col("run_at").cast("timestamp"), F.col("resort_id"), F.col("edge_id")).alias("live")), """
SELECT run_id, concat_ws('|', 'gpx', CAST(floor(floor(epoch(run_at)) / 15) AS BIGINT), resort_id, coalesce(edge_id, 'unmatched|d' || CAST(round(duration_s / 10) AS BIGINT))) AS hash, concat_ws('|', 'live', CAST(floor(floor(epoch(run_at)) / 15) AS BIGINT), resort_id, coalesce(edge_id, 'unmatched')) AS live FROM f_runs""")
add("str13_patterns", "f_trails f_contacts", lambda t, c: t.where(F.col("name").ilike("%GREEN%")).select("id", F.lit("name").alias("by")).unionByName(c.where(F.regexp_like(text.digits(F.col("raw")), F.lit("^1?604"))).select("id", F.lit("phone").alias("by"))), r"SELECT id, 'name' AS by FROM f_trails WHERE name ILIKE '%GREEN%' UNION ALL SELECT id, 'phone' FROM f_contacts WHERE regexp_matches(regexp_replace(raw, '\D', '', 'g'), '^1?604')")
add("dt01_iso_time", "f_stamps", lambda s: s.select("event_id", F.unix_micros(text.iso_time(F.col("stamp"))).alias("us")), r"SELECT event_id, CASE WHEN regexp_matches(stamp, '^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:?\d\d)$') THEN epoch_us(TRY_CAST(stamp AS TIMESTAMPTZ)) END AS us FROM f_stamps")
add("dt02_solar_local", "f_fixes", lambda x: x.select("event_id", *(f(filters.solar_local(F.col("ts").cast("timestamp"), F.lit(-106.4))).alias(n) for f, n in ((F.hour, "hour"), (F.dayofweek, "weekday"))), F.to_date("ts").alias("day")), "SELECT event_id, CAST(hour(t) AS INTEGER) AS hour, CAST(dayofweek(t) + 1 AS INTEGER) AS weekday, CAST(ts AS DATE) AS day FROM (SELECT *, ts + to_microseconds(CAST(round(-106.4 / 15 * 3600 * 1000000) AS BIGINT)) AS t FROM f_fixes)")
add("math03_steps", "f_weather", lambda w: w.select("id", geo.quantised(F.col("temp_c"), 0.5).alias("temp"), geo.quantised(F.col("wind_kph"), 5.0).alias("wind"), geo.quantised(F.col("vis_km"), 0.5).alias("vis"), geo.quantised(F.col("snow_cm"), 1.0).alias("snow"), (F.floor((F.col("cloud") + 5) / 10) * 10).alias("cloud")), "SELECT id, round(temp_c / 0.5) * 0.5 AS temp, round(wind_kph / 5) * 5.0 AS wind, round(vis_km / 0.5) * 0.5 AS vis, round(snow_cm) AS snow, CAST((cloud + 5) // 10 * 10 AS BIGINT) AS cloud FROM f_weather")
SUN = {"b": "radians((dayofyear(ts) - 81) * 360.0::DOUBLE / 365)", "tilt": "radians(23.45::DOUBLE * sin(radians((284 + dayofyear(ts)) * 360.0::DOUBLE / 365)))"}
add("math05_sun", "f_fixes", lambda x: x.select("event_id", geo.sun_position(F.col("ts").cast("timestamp"), F.col("lat"), F.col("lon"), F.lit(-7.0)).alias("s")).select("event_id", "s.height", "s.azimuth"), f"""
SELECT event_id, {R("degrees(h)", 4)} AS height, {R("CASE WHEN sin(a) > 0 THEN 360 - degrees(z) ELSE degrees(z) END", 4)} AS azimuth FROM (SELECT *, acos(least(greatest((sin(tilt) - sin(h) * sin(y)) / (cos(h) * cos(y)), -1), 1)) AS z FROM (
 SELECT *, asin(sin(y) * sin(tilt) + cos(y) * cos(tilt) * cos(a)) AS h FROM (SELECT event_id, {SUN["tilt"]} AS tilt, radians(lat) AS y,
 radians((hour(ts) + minute(ts) / 60.0::DOUBLE - 7 + (4 * (lon + 105) + 9.87::DOUBLE * sin(2 * {SUN["b"]}) - 7.53::DOUBLE * cos({SUN["b"]}) - 1.5::DOUBLE * sin({SUN["b"]})) / 60 - 12) * 15) AS a FROM f_fixes)))""", 4)
add("math06_geohash_cells", "f_nodes", lambda n: n.select("id", geo.geohash_box(geo.geohash(F.col("lat"), F.col("lon"))).alias("b"), "lat", "lon", F.size(geo.geohash_neighbours(geo.geohash(F.col("lat"), F.col("lon")))).alias("around")).select("id", (F.col("lat").between(F.col("b.south"), F.col("b.north")) & F.col("lon").between(F.col("b.west"), F.col("b.east"))).alias("inside"), F.round((F.col("b.north") - F.col("b.south")) * 2**15, 6).alias("high"), "around"), "SELECT id, true AS inside, 180.0::DOUBLE AS high, 9 AS around FROM f_nodes")
add("ras01_tile", "f_nodes", lambda n: n.select("id", geo.tile(F.col("lat"), F.col("lon"), 14).alias("t"), geo.dem_metres(F.lit(1), F.col("id") % 256, F.col("id") % 7).alias("metres")).select("id", "t.x", "t.y", "metres"), f"SELECT id, CAST(floor((lon + 180) / 360 * 16384) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384) AS BIGINT) AS y, {R('-10000 + 0.1::DOUBLE * (65536 + id % 256 * 256 + id % 7)')} AS metres FROM f_nodes")
add("flt01_client_query", "f_requests", lambda q: q.where(F.col("status").isin("pending", "accepted") & ((F.col("sender_id") == 7) | (F.col("receiver_id") == 7) | (F.col("sender_id") != F.col("receiver_id")))).orderBy(F.desc("created_at"), "id").limit(100).select("id", "status"), "SELECT id, status FROM f_requests WHERE status IN ('pending', 'accepted') AND (sender_id = 7 OR receiver_id = 7 OR sender_id <> receiver_id) ORDER BY created_at DESC, id LIMIT 100")
add("flt04_catalog", "f_resorts", lambda r: filters.catalog_search(r.select("id", "name", F.lit("Rockies").alias("region"), F.lit("USA").alias("country"), F.array(F.lower("id")).alias("aliases"), (F.length("id") < 3).alias("on_pass")), "A").select("id", "name"), "SELECT id, name FROM f_resorts WHERE length(id) < 3 AND contains(lower(name || ' Rockies USA ' || lower(id)), 'a')")
add("flt05_day_search", "f_runs", lambda r: filters.day_search(r, "jan").select("day", "resort_id", "runs"), "SELECT CAST(run_at AS DATE) AS day, resort_id, count(*) AS runs FROM f_runs WHERE contains(lower(strftime(run_at, '%b %-d, %Y')), 'jan') OR contains(lower(resort_id), 'jan') GROUP BY ALL")
add("flt07_phantoms", "f_trails f_names", lambda t, n: filters.validated(t.select("id", "name"), n.select("official").distinct()).select("id", "verdict"), """
SELECT id, CASE WHEN s >= 0.85 THEN 'valid' WHEN s >= 0.72 THEN 'open' ELSE 'closed' END AS verdict FROM (SELECT t.id, max(CASE WHEN length(a) < 2 OR length(b) < 2 THEN CAST(a = b AS INTEGER) ELSE 2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)) END) AS s FROM (
 SELECT id, a, list_distinct([substr(a, CAST(i AS INTEGER), 2) for i in range(1, length(a))]) AS x FROM (SELECT id, regexp_replace(lower(name), '[^\\p{L}\\p{N}]', '', 'g') AS a FROM f_trails)) t, (
 SELECT b, list_distinct([substr(b, CAST(i AS INTEGER), 2) for i in range(1, length(b))]) AS y FROM (SELECT DISTINCT regexp_replace(lower(official), '[^\\p{L}\\p{N}]', '', 'g') AS b FROM f_names)) GROUP BY t.id)""")
add("set05_keywords", "f_edges", lambda e: e.select("source").intersect(e.select("target")).union(e.select("source").subtract(e.select("target")).select((-F.col("source")).alias("source"))).distinct(), "SELECT * FROM ((SELECT source FROM f_edges INTERSECT SELECT target FROM f_edges) UNION (SELECT -source FROM (SELECT source FROM f_edges EXCEPT SELECT target FROM f_edges)))")
add("jn19_outer_joins", "f_nodes f_edges", lambda n, e: n.select(F.col("id").alias("node")).join(e.select(F.col("target").alias("to")).distinct().hint("shuffle_hash"), F.col("node") == F.col("to"), "full").select("node", "to"), 'SELECT node, "to" FROM (SELECT id AS node FROM f_nodes) FULL JOIN (SELECT DISTINCT target AS "to" FROM f_edges) ON node = "to"')
add("agg18_cube", "f_runs", lambda r: r.cube("resort_id", "difficulty").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.countDistinct("profile_id").alias("people")).where("n >= 10"), "SELECT resort_id, difficulty, CAST(grouping(resort_id, difficulty) AS BIGINT) AS level, count(*) AS n, count(DISTINCT profile_id) AS people FROM f_runs GROUP BY CUBE (resort_id, difficulty) HAVING count(*) >= 10")


def ranked(fixes: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("speed")
    near = w.rangeBetween(-2, 0)
    return fixes.select("event_id", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense"), F.count("*").over(near).alias("near"))


add("win16_ranks", "f_fixes", ranked, "SELECT event_id, CAST(rank() OVER w AS INTEGER) AS rank, CAST(dense_rank() OVER w AS INTEGER) AS dense, count(*) OVER (PARTITION BY user_id ORDER BY speed RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM f_fixes WINDOW w AS (PARTITION BY user_id ORDER BY speed)")
add("json01_fields", "f_stamps", lambda s: s.select("event_id", F.to_json(F.struct("stamp", F.array(F.lit(1), F.lit(2)).alias("xs"))).alias("j")).select("event_id", F.get_json_object("j", "$.stamp").alias("stamp"), F.size(F.from_json("j", "xs array<int>")["xs"]).alias("n")), "SELECT event_id, stamp, 2 AS n FROM f_stamps")
LINE = "[{{'lat': 39.6 + (p_partkey % 9) * 0.001, 'lon': -106.36, 'elevation': 2500 - p_partkey % 50}}, {{'lat': 39.6, 'lon': -106.36 + (p_partkey % 7) * 0.001, 'elevation': 2400}}, {{'lat': 39.59, 'lon': -106.35, 'elevation': 2300}}]"


def lines(nodes: DataFrame) -> DataFrame:
    point = lambda lat, lon, e: F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), e.cast("double").alias("elevation"))
    k = F.col("id")
    line = F.array(point(39.6 + (k % 9) * 0.001, F.lit(-106.36), 2500 - k % 50), point(F.lit(39.6), -106.36 + (k % 7) * 0.001, F.lit(2400)), point(F.lit(39.59), F.lit(-106.35), F.lit(2300)))
    return nodes.select("id", line.alias("line"))


D1 = HAV.format(a1="(39.6 + (id % 9) * 0.001)", a2="-106.36", b1="39.6", b2="(-106.36 + (id % 7) * 0.001)")
D2 = HAV.format(a1="39.6", a2="(-106.36 + (id % 7) * 0.001)", b1="39.59", b2="-106.35")
add("math01_line_length", "f_nodes", lambda n: lines(n).select("id", geo.line_length(F.col("line")).alias("metres")), f"SELECT id, {R(f'{D1} + {D2}', 3)} AS metres FROM f_nodes", 3)
add("math02_steepest", "f_nodes", lambda n: lines(n).select("id", geo.steepest(F.col("line")).alias("deg")), f"SELECT id, {R(f'least(60, greatest(CASE WHEN {D1} > 5 THEN degrees(atan2(abs(100 - id % 50), {D1})) ELSE 0 END, degrees(atan2(100, {D2}))))', 4)} AS deg FROM f_nodes", 4)
add("math07_smoothed", "f_nodes", lambda n: lines(n).select("id", geo.smoothed_line(F.col("line"), 1).alias("s")).select("id", F.size("s").alias("points"), F.col("s")[1]["lat"].alias("lat"), F.col("s")[4]["lon"].alias("lon")), f"SELECT id, 6 AS points, {R('0.75 * (39.6 + (id % 9) * 0.001) + 0.25 * 39.6')} AS lat, {R('0.25 * (-106.36 + (id % 7) * 0.001) + 0.75 * -106.35')} AS lon FROM f_nodes")
