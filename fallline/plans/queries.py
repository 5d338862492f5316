"""The registered queries over the operators, each with the DuckDB SQL that gives the same rows.

Each name begins with the number the operator has in the blueprint's inventory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import aggregates, filters, joins, meeting, windows
from .registry import AS_OF, FRIENDS, HAV, ORACLES, QUERIES, R, add, as_of

__all__ = ["ORACLES", "QUERIES"]

add("agg01_profile_stats", "f_runs f_profiles", aggregates.profile_stats, f"""
SELECT p.id AS profile_id, count(DISTINCT CAST(run_at AS DATE)) AS days_skied, count(r.run_id) AS runs_count, {R("coalesce(sum(vertical_m), 0)")} AS vertical_m, {R("coalesce(max(coalesce(peak_speed_ms, speed_ms)), 0)")} AS top_speed_ms,
 {R("coalesce(sum(duration_s), 0)")} AS total_duration_s, {R("coalesce(sum(distance_m), 0)")} AS total_distance_m, {R("coalesce(max(max_grade_deg), 0)")} AS top_grade_deg, {R("coalesce(avg(nullif(speed_ms, 0)), 0)")} AS avg_speed_ms, max(run_at) AS last_import_at
FROM f_profiles p LEFT JOIN f_runs r ON r.profile_id = p.id GROUP BY p.id""")
add("agg02_edge_means", "f_runs", aggregates.edge_means, f"""
SELECT profile_id, edge_id, count(*) AS observation_count, {R("avg(speed_ms)")} AS mean_speed_ms, {R("max(peak_speed_ms)")} AS peak_ms, {R("avg(duration_s)")} AS mean_duration_s FROM f_runs WHERE edge_id IS NOT NULL GROUP BY ALL""")
add("agg03_edge_speeds", "f_runs", lambda r: aggregates.edge_speeds(r, as_of()), f"""
SELECT profile_id, resort_id, edge_id, fp AS conditions_fp, count(*) AS observation_count, {R("sum(speed_ms * w) / sum(w)")} AS rolling_speed_ms, {R("max(peak_speed_ms)")} AS rolling_peak_ms, {R("sum(duration_s * w) / sum(w)")} AS rolling_duration_s,
 {R("greatest(0, sum(speed_ms * speed_ms * w) / sum(w) - (sum(speed_ms * w) / sum(w)) ** 2)")} AS rolling_speed_variance_ms2, max(run_at) AS last_observed_at
FROM (SELECT *, coalesce(conditions_fp, 'default') AS fp, exp(-greatest(0, (epoch(TIMESTAMP '{AS_OF}') - epoch(run_at)) / 86400.0) / (60 / ln(2))) AS w FROM f_runs WHERE edge_id IS NOT NULL) GROUP BY ALL""")
add("agg04_median_speeds", "f_runs", aggregates.median_speeds, f"SELECT profile_id, difficulty, {R('median(speed_ms)')} AS median_speed_ms, count(*) AS n FROM f_runs WHERE difficulty IS NOT NULL GROUP BY ALL")
add("agg06_cohort_ratio", "f_runs", lambda r: aggregates.cohort_ratio(r, F.col("max_grade_deg") > 5), f"""
SELECT profile_id, {R("CASE WHEN count(*) FILTER (max_grade_deg > 5) >= 3 AND count(*) FILTER (NOT max_grade_deg > 5) >= 3 THEN least(greatest(median(speed_ms) FILTER (max_grade_deg > 5) / median(speed_ms) FILTER (NOT max_grade_deg > 5), 0.1), 2.0) END")} AS ratio FROM f_runs GROUP BY ALL""")
add("agg08_nested", "f_edges", aggregates.nested, "SELECT source, string_agg(id, ',' ORDER BY id) AS edge_ids, count(*) AS n FROM f_edges GROUP BY ALL")
add("agg09_days", "f_runs", aggregates.days, f"""
SELECT profile_id, day, CAST(sum(n) AS BIGINT) AS runs, {R("sum(v)", 5)} AS vertical_m, arg_min(resort_id, CAST(-n AS VARCHAR)) FILTER (false) AS x, min(resort_id) FILTER (k = 1) AS resort_id, count(*) - 1 AS others
FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, day ORDER BY n DESC, resort_id) AS k FROM (SELECT profile_id, CAST(run_at AS DATE) AS day, resort_id, count(*) AS n, sum(vertical_m) AS v FROM f_runs GROUP BY ALL)) GROUP BY profile_id, day""".replace("arg_min(resort_id, CAST(-n AS VARCHAR)) FILTER (false) AS x, ", ""), 5)
add("agg10_resort_stats", "f_edges", aggregates.resort_stats, "SELECT kind, count(DISTINCT coalesce(trail_group, id)) AS groups, count(DISTINCT name) AS names, count(*) AS edges FROM f_edges GROUP BY ALL")
add("agg11_trail_groups", "f_edges", aggregates.trail_groups, f"""
SELECT trail_group, {R("sum(length_m)")} AS length_m, {R("sum(vertical_m)")} AS vertical_m, max(gradient) AS max_gradient, {R("degrees(atan2(sum(vertical_m), sum(length_m)))")} AS slope_deg, bool_or(is_groomed) AS any_groomed, bool_or(is_open) AS any_open FROM f_edges WHERE kind = 'run' GROUP BY ALL""")
add("agg12_tallies", "f_requests", aggregates.tallies, "SELECT count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'declined') AS declined, count(*) AS every FROM f_requests")
add("agg13_distinct_names", "f_edges", lambda e: e.select("name", "kind").distinct(), "SELECT DISTINCT name, kind FROM f_edges")
add("agg14_degrees", "f_edges", aggregates.degrees, "SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT source AS node, 1 AS o, 0 AS i FROM f_edges WHERE is_open UNION ALL SELECT target, 0, 1 FROM f_edges WHERE is_open) GROUP BY node")
add("agg15_quantiles", "f_runs", aggregates.quantiles, f"SELECT resort_id, {R('quantile_cont(speed_ms, 0.1)')} AS p10, {R('quantile_cont(speed_ms, 0.5)')} AS p50, {R('quantile_cont(speed_ms, 0.9)')} AS p90 FROM f_runs GROUP BY ALL")
add("agg17_content_hash", "f_edges", aggregates.content_hash, "SELECT trail_group, sha256(string_agg(concat_ws('|', id, source, target, kind, name), chr(10) ORDER BY id)) AS content_sha256 FROM f_edges GROUP BY ALL")
add("agg18_rollup", "f_runs", aggregates.by_sets, "SELECT resort_id, difficulty, count(*) AS n, CAST(grouping(resort_id, difficulty) AS BIGINT) AS level FROM f_runs GROUP BY ROLLUP (resort_id, difficulty)")

add("flt02_unnamed", "f_runs", lambda r: r.where(filters.without(F.col("edge_id"))).select("run_id"), "SELECT run_id FROM f_runs WHERE coalesce(edge_id, '') = ''")
add("flt03_in_box", "f_nodes", lambda n: n.where(F.col("lat").between(39.61, 39.62)).select("id"), "SELECT id FROM f_nodes WHERE lat BETWEEN CAST(39.61 AS DOUBLE) AND CAST(39.62 AS DOUBLE)")
add("flt04_search", "f_resorts", lambda r: filters.searched(r, "AN").select("id", "name"), "SELECT id, name FROM f_resorts WHERE contains(lower(name), 'an')")
add("flt08_fresh", "f_fixes", lambda x: filters.fresh(x, "ts", F.lit("2024-01-20 00:00:00").cast("timestamp"), 180).select("event_id"), "SELECT event_id FROM f_fixes WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 180 MINUTE")
add("flt09_open_runs", "f_edges", lambda e: filters.open_runs(e).select("id", "name"), "SELECT id, name FROM f_edges WHERE is_open AND kind = 'run'")
add("flt11_live_requests", "f_requests", lambda r: filters.live_requests(r, F.lit("1999-01-01").cast("timestamp")).select("id"), "SELECT id FROM f_requests WHERE status = 'pending' AND (expires_at IS NULL OR expires_at > TIMESTAMP '1999-01-01')")

add("jn01_by_email", "f_profiles f_friendships", lambda p, f: joins.by_email(p, f.select(F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("addressee_id").cast("string"), 9, "0"), F.lit("@MAIL.example")).alias("email"))).select("id", "email"), "SELECT id, email FROM f_profiles WHERE id IN (SELECT addressee_id FROM f_friendships)")
add("jn02_by_phone", "f_profiles f_friendships", lambda p, f: joins.by_phone(p, f.select(F.concat(F.lit("1.604-"), (1_000_000 + F.col("addressee_id")).cast("string")).alias("phone"))).select("id"), "SELECT id FROM f_profiles WHERE id IN (SELECT addressee_id FROM f_friendships)")
add("jn03_friend_ids", "f_friendships", joins.friend_ids, f"SELECT * FROM (WITH {FRIENDS} SELECT * FROM fr)")
add("jn04_friends", "f_profiles f_friendships", joins.friends_of, f"SELECT * FROM (WITH {FRIENDS} SELECT me, friend, display_name FROM fr JOIN f_profiles ON id = friend)")
add("flt06_visible", "f_friendships f_blocks", joins.visible, f"SELECT * FROM (WITH {FRIENDS} SELECT me AS viewer, friend AS seen FROM fr WHERE NOT EXISTS (SELECT 1 FROM f_blocks b WHERE (b.blocker_id = me AND b.blockee_id = friend) OR (b.blocker_id = friend AND b.blockee_id = me)))")
add("jn06_pending_strangers", "f_friendships", lambda f: joins.pending_strangers(f).select("id", "requester_id", "addressee_id"), f"SELECT * FROM (WITH {FRIENDS} SELECT id, requester_id, addressee_id FROM f_friendships p WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM fr WHERE me = p.requester_id AND friend = p.addressee_id))")
add("jn07_resort_of", "f_fixes f_resorts", joins.resort_of, """
SELECT event_id, min(id) FILTER (k = 1) AS resort_id FROM (SELECT f.event_id, r.id, row_number() OVER (PARTITION BY f.event_id ORDER BY round((max_lat - min_lat) * (max_lon - min_lon), 12), r.id) AS k
FROM f_fixes f LEFT JOIN f_resorts r ON f.lat BETWEEN min_lat AND max_lat AND f.lon BETWEEN min_lon AND max_lon) GROUP BY event_id""")
add("jn11_weather_at", "f_fixes f_hourly", lambda x, h: joins.nearest_in_time(x.select("event_id", "ts"), h, "ts", "time", ["wind_kph"]).select("event_id", "matched", "wind_kph"), f"""
SELECT event_id, time AS matched, {R("wind_kph")} AS wind_kph FROM (SELECT event_id, time, wind_kph, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(ts) - epoch_us(time)), time DESC) AS k
FROM f_fixes CROSS JOIN f_hourly) WHERE k = 1""")
add("jn12_crumbs", "f_fixes", lambda x: windows.crumbs(x.select(F.col("event_id").alias("id"), "user_id", (F.col("ts") + F.expr("INTERVAL '1' HOUR")).alias("ts")), x), """
SELECT q.event_id AS id, b.event_id AS crumb FROM f_fixes q ASOF JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM f_fixes GROUP BY ALL) b ON q.user_id = b.user_id AND q.ts + INTERVAL 1 HOUR >= b.ts""")
add("jn13_overlay", "f_edges f_names f_fixes", lambda e, n, x: joins.edge_overlay(e, x.select(F.concat(F.lit("t"), "event_id").alias("key"), F.lit("by id").alias("label")), n.select(F.lower("official").alias("key")).distinct().withColumn("label", F.concat(F.lit("by name "), "key"))), """
SELECT id, CASE WHEN id IN (SELECT 't' || event_id FROM f_fixes) THEN 'by id' WHEN lower(name) IN (SELECT lower(official) FROM f_names) THEN 'by name ' || lower(name) END AS label FROM f_edges""")
add("jn15_observation", "f_runs", lambda r: joins.observation(r.select("profile_id", "resort_id", "edge_id").where("edge_id IS NOT NULL").distinct().withColumn("conditions_fp", F.lit("R")), aggregates.edge_speeds(r, as_of())), f"""
SELECT profile_id, resort_id, edge_id, 'R' AS conditions_fp, fp AS used_fp, {R("speed")} AS speed_ms FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, resort_id, edge_id ORDER BY CASE fp WHEN 'R' THEN 0 WHEN 'default' THEN 1 ELSE 2 END, n DESC, fp) AS k
FROM (SELECT profile_id, resort_id, edge_id, coalesce(conditions_fp, 'default') AS fp, count(*) AS n, sum(speed_ms * w) / sum(w) AS speed
 FROM (SELECT *, exp(-greatest(0, (epoch(TIMESTAMP '{AS_OF}') - epoch(run_at)) / 86400.0) / (60 / ln(2))) AS w FROM f_runs WHERE edge_id IS NOT NULL) GROUP BY ALL)) WHERE k = 1""")
add("jn17_neighbours", "f_nodes", lambda n: joins.neighbours(n, 100.0, digits=4), f"SELECT a.id AS a, b.id AS b, {R(HAV.format(a1='a.lat', a2='a.lon', b1='b.lat', b2='b.lon'), 4)} AS metres FROM f_nodes a JOIN f_nodes b ON a.id < b.id AND {HAV.format(a1='a.lat', a2='a.lon', b1='b.lat', b2='b.lon')} <= 100", 4, done=True)
add("jn18_lookup", "f_profiles f_resorts", lambda p, r: joins.looked_up(p.select("id", F.col("current_resort_id").alias("resort")), r.where("id != 'r3'").select(F.col("id").alias("resort"), "name"), "resort", "name", F.lit("none")), "SELECT p.id, p.current_resort_id AS resort, coalesce(r.name, 'none') AS name FROM f_profiles p LEFT JOIN f_resorts r ON r.id = p.current_resort_id AND r.id <> 'r3'")

PATHS = "SELECT 1 AS person, 1 AS node UNION ALL SELECT 2, 2 UNION ALL SELECT 3, 3"
#: Every walk that comes to no node twice: no bound on steps.
REACH_ALL = f"""WITH RECURSIVE src AS ({PATHS}), walk AS (SELECT person, CAST(node AS BIGINT) AS node, CAST(0 AS DOUBLE) AS metres, [CAST(node AS BIGINT)] AS seen FROM src
 UNION ALL SELECT w.person, e.target, w.metres + e.length_m, list_append(w.seen, e.target) FROM walk w JOIN f_edges e ON e.source = w.node AND e.is_open WHERE NOT list_contains(w.seen, e.target))"""


def paths(edges: DataFrame) -> DataFrame:
    return filters.reachable(edges, edges.sparkSession.createDataFrame([(1, 1), (2, 2), (3, 3)], "person int, node long"))


add("rte01_least_lengths", "f_edges", lambda e: paths(e), f"SELECT * FROM ({REACH_ALL} SELECT person, node, {R('min(metres)')} AS metres FROM walk GROUP BY ALL)")
add("jn16_reached_by_all", "f_edges", lambda e: joins.reached_by_all(paths(e).withColumnRenamed("metres", "seconds"), 3), f"SELECT * FROM ({REACH_ALL} SELECT node, {R('max(m)')} AS slowest FROM (SELECT person, node, min(metres) AS m FROM walk GROUP BY ALL) GROUP BY node HAVING count(*) = 3)")
add("rte04_meeting", "f_edges", lambda e: meeting.meeting_points(paths(e).withColumnRenamed("metres", "seconds"), 3, 5), f"SELECT * FROM ({REACH_ALL} SELECT node, {R('max(m) + 0.6 * (max(m) - min(m))')} AS score FROM (SELECT person, node, min(metres) AS m FROM walk GROUP BY ALL) GROUP BY node HAVING count(*) = 3 ORDER BY max(m) + 0.6 * (max(m) - min(m)), node LIMIT 5)")

add("win01_deltas", "f_fixes", lambda x: windows.deltas(x).select("event_id", "dt", "metres", "descent"), f"""
SELECT event_id, {R("(epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0", 3)} AS dt, {R(HAV.format(a1="lag(lat) OVER w", a2="lag(lon) OVER w", b1="lat", b2="lon"), 3)} AS metres, CASE WHEN lag(elevation) OVER w - elevation > 1 THEN lag(elevation) OVER w - elevation ELSE 0 END AS descent
FROM f_fixes WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""", 3)
add("win03_sessions", "f_fixes", lambda x: windows.sessions(x, 43_200.0).drop("metres"), """
SELECT user_id, bool_or(lift) AS lift, count(*) AS points, min(ts) AS start, max(ts) AS stop FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM (
 SELECT *, CASE WHEN lag(lift) OVER w IS NULL OR lift <> lag(lift) OVER w OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 43200000000 THEN 1 ELSE 0 END AS new FROM (
  SELECT *, coalesce(count(elevation) OVER s >= 2 AND last_value(elevation IGNORE NULLS) OVER s - first_value(elevation IGNORE NULLS) OVER s > 8 AND avg(speed) OVER s < 5.5, false) AS lift
  FROM f_fixes WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, grp HAVING count(*) >= 2""")
add("win07_trailing", "f_hourly", windows.trailing_sums, "SELECT sum(snowfall_cm) FILTER (k <= 24) AS last_24, sum(snowfall_cm) FILTER (k <= 72) AS last_72 FROM (SELECT snowfall_cm, row_number() OVER (ORDER BY time DESC) AS k FROM f_hourly)")
add("win08_elevation", "f_fixes", windows.filled_elevation, f"""
SELECT user_id, event_id, {R("coalesce(elevation, CASE WHEN a IS NULL THEN be WHEN b IS NULL THEN ae ELSE ae + (be - ae) * (i - a) / CAST(b - a AS DOUBLE) END)")} AS elevation FROM (
 SELECT *, last_value(CASE WHEN elevation IS NOT NULL THEN i END IGNORE NULLS) OVER p AS a, last_value(elevation IGNORE NULLS) OVER p AS ae, first_value(CASE WHEN elevation IS NOT NULL THEN i END IGNORE NULLS) OVER n AS b, first_value(elevation IGNORE NULLS) OVER n AS be
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM f_fixes)
 WINDOW p AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
add("win09_latest", "f_fixes", lambda x: windows.latest(x, ["user_id"], -F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id")).select("user_id", "event_id"), "SELECT user_id, event_id FROM f_fixes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
add("win10_numbered", "f_edges", windows.numbered, "SELECT id, CASE WHEN count(*) OVER (PARTITION BY name, difficulty) > 1 THEN name || ' · #' || row_number() OVER (PARTITION BY name, difficulty ORDER BY trail_group, id) ELSE name END AS label FROM f_edges")
add("win11_legs", "f_edges", lambda e: windows.legs(e).select("trail_group", "kind", "name", "steps", "length_m"), f"""
SELECT trail_group, min(kind) AS kind, min(name) AS name, count(*) AS steps, {R("sum(length_m)")} AS length_m FROM (SELECT *, sum(new) OVER (PARTITION BY trail_group ORDER BY source, id ROWS UNBOUNDED PRECEDING) AS leg FROM (
 SELECT *, CASE WHEN lag(kind) OVER w IS NULL OR kind <> lag(kind) OVER w OR name IS DISTINCT FROM lag(name) OVER w THEN 1 ELSE 0 END AS new FROM f_edges WINDOW w AS (PARTITION BY trail_group ORDER BY source, id))) GROUP BY trail_group, leg""")
add("win12_cumulative", "f_edges", windows.cumulative, f"SELECT trail_group, id, {R('sum(length_m) OVER (PARTITION BY trail_group ORDER BY source, id ROWS UNBOUNDED PRECEDING)')} AS so_far_m FROM f_edges")
add("win13_ema", "f_fixes", windows.smoothed, f"""
SELECT user_id, {R("list_reduce(list(speed ORDER BY ts, event_id), lambda a, x: 0.2 * x + 0.8 * a)")} AS ema_ms FROM f_fixes GROUP BY user_id""")
add("win15_friendship_pick", "f_friendships", lambda f: windows.latest(f, ["requester_id"], F.when(F.col("status") == "accepted", 0).when(F.col("status") == "pending", 1).otherwise(2), -F.unix_micros(F.col("created_at").cast("timestamp")), F.col("id")).select("requester_id", "id", "status"),
    "SELECT requester_id, id, status FROM f_friendships QUALIFY row_number() OVER (PARTITION BY requester_id ORDER BY list_position(['accepted', 'pending'], status) NULLS LAST, created_at DESC, id) = 1")

add("top01_ranked", "f_edges", lambda e: filters.top(e.select("id", "length_m"), 25, F.desc("length_m"), F.col("id")), f"SELECT id, {R('length_m')} AS length_m FROM f_edges ORDER BY f_edges.length_m DESC, id LIMIT 25")
add("top05_best_match", "f_edges", lambda e: e.groupBy("target").agg(F.min_by("id", F.struct("length_m", "id")).alias("id")), "SELECT target, id FROM f_edges QUALIFY row_number() OVER (PARTITION BY target ORDER BY length_m, id) = 1")
add("top07_summit_base", "f_nodes", lambda n: n.agg(F.min_by("id", F.struct(-F.col("elevation"), "id")).alias("summit"), F.min_by("id", F.struct("elevation", "id")).alias("base")), "SELECT (SELECT id FROM f_nodes ORDER BY elevation DESC, id LIMIT 1) AS summit, (SELECT id FROM f_nodes ORDER BY elevation, id LIMIT 1) AS base")

add("set01_common", "f_edges", lambda e: e.select(F.col("source").alias("node")).intersect(e.select("target")), "SELECT source AS node FROM f_edges INTERSECT SELECT target FROM f_edges")
add("set02_difference", "f_edges", lambda e: e.select(F.col("source").alias("node")).exceptAll(e.select("target").distinct()).distinct(), "SELECT source AS node FROM f_edges EXCEPT SELECT target FROM f_edges")
add("set03_union", "f_names f_edges", lambda n, e: n.select(F.col("official").alias("name")).unionByName(e.select("name")).groupBy("name").count().withColumnRenamed("count", "n"), "SELECT name, count(*) AS n FROM (SELECT official AS name FROM f_names UNION ALL SELECT name FROM f_edges) GROUP BY name")
add("set04_first_seen", "f_edges", lambda e: filters.first_seen(e, ["name"], "source").select("name", "id"), "SELECT name, id FROM f_edges QUALIFY row_number() OVER (PARTITION BY name ORDER BY source) = 1")

add("str01_feed_name", "f_names", lambda n: n.select("id", text.feed_name(F.col("name")).alias("key")), "SELECT id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(lower(name), 'express', ''), 'quad', ''), 'triple', ''), 'double', ''), 'detach', ''), 'fixed', ''), 'high-speed', ''), 'high speed', ''), '[^\\p{L}\\p{N} ]', '', 'g'), ' +', ' ', 'g')) AS key FROM f_names")
add("str02_ingest_name", "f_names", lambda n: n.select("id", text.ingest_name(F.col("name")).alias("key")), r"SELECT id, lower(regexp_replace(regexp_replace(regexp_replace(trim(name), '^The\s+', ''), '\s+', ' ', 'g'), '[.,;:]+$', '')) AS key FROM f_names")
add("str04_slug", "f_names", lambda n: n.select("id", text.slug(F.col("name")).alias("slug")), "SELECT id, coalesce(nullif(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'unknown-resort') AS slug FROM f_names")
add("str06_osm_id", "f_edges", lambda e: e.select("id", text.osm_id(F.col("id")).alias("osm_id")), "SELECT id, CASE WHEN contains(x, '_s') THEN regexp_replace(x, '^(.*)_s.*$', '\\1') ELSE regexp_replace(x, '^(.*)_ix.*$', '\\1') END AS osm_id FROM (SELECT id, regexp_replace(id, '^[tl]', '') AS x FROM f_edges)")
add("str10_conditions_key", "f_hourly", lambda h: h.select("time", text.conditions_key(F.col("temperature_c"), F.col("wind_kph"), F.col("snowfall_cm")).alias("key")), "SELECT time, concat_ws('|', 'snow=' || CAST(CAST(ceil(snowfall_cm / 5) * 5 AS BIGINT) AS VARCHAR), 'tempC=' || CAST(CAST(floor(temperature_c / 5) * 5 AS BIGINT) AS VARCHAR), 'wind=' || CAST(CAST(floor(wind_kph / 10) * 10 AS BIGINT) AS VARCHAR)) AS key FROM f_hourly")
add("str12_sha256", "f_edges", lambda e: e.select("id", F.sha2(F.concat_ws("|", "id", "name"), 256).alias("hash")), "SELECT id, sha256(concat_ws('|', id, name)) AS hash FROM f_edges")
add("fz01_similarity", "f_names", lambda n: n.select("id", text.similarity(text.feed_name(F.col("name")), F.lower("official")).alias("s")), f"SELECT id, {R('1 - levenshtein(k, lower(official)) / CAST(greatest(length(k), length(official), 1) AS DOUBLE)')} AS s FROM (SELECT *, trim(regexp_replace(regexp_replace(replace(replace(replace(lower(name), 'express', ''), 'quad', ''), 'high-speed', ''), '[^\\p{{L}}\\p{{N}} ]', '', 'g'), ' +', ' ', 'g')) AS k FROM f_names)")
add("fz02_dice", "f_names", lambda n: n.select("id", text.dice(F.col("name"), F.col("official")).alias("s")), f"""
SELECT id, {R("2.0 * len(list_intersect(x, y)) / (len(x) + len(y))")} AS s FROM (SELECT id, list_distinct([substr(a, CAST(i AS INTEGER), 2) for i in range(1, length(a))]) AS x, list_distinct([substr(b, CAST(i AS INTEGER), 2) for i in range(1, length(b))]) AS y FROM (SELECT id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(official), '[^a-z0-9]', '', 'g') AS b FROM f_names))""")
add("dt02_buckets", "f_fixes", lambda x: x.select("event_id", F.dayofweek("ts").alias("weekday"), (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 900) * 900).alias("bucket")), "SELECT event_id, CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday, CAST(floor(floor(epoch(ts)) / 900) * 900 AS BIGINT) AS bucket FROM f_fixes")
add("math01_bearing", "f_nodes", lambda n: n.select("id", geo.bearing(F.lit(39.6), F.lit(-106.4), F.col("lat"), F.col("lon")).alias("deg"), geo.haversine(F.lit(39.6), F.lit(-106.4), F.col("lat"), F.col("lon")).alias("metres")), f"""
SELECT id, {R("fmod(degrees(atan2(sin(radians(lon - -106.4)) * cos(radians(lat)), cos(radians(39.6)) * sin(radians(lat)) - sin(radians(39.6)) * cos(radians(lat)) * cos(radians(lon - -106.4)))) + 360, 360)", 4)} AS deg, {R(HAV.format(a1="39.6", a2="-106.4", b1="lat", b2="lon"), 4)} AS metres FROM f_nodes""", 4)
add("math03_quantised", "f_nodes", lambda n: n.select("id", geo.quantised(F.col("elevation"), 10.0).alias("elevation")), "SELECT id, round(elevation / 10.0) * 10.0 AS elevation FROM f_nodes")

add("snk02_insert_ignore", "f_runs", lambda r: filters.insert_ignore(r.where("run_id % 2 = 0").groupBy("profile_id", "dedup_hash").agg(F.min("run_id").alias("run_id")), r.where("run_id % 2 <> 0").select("profile_id", "dedup_hash", "run_id"), ["profile_id", "dedup_hash"]), "SELECT profile_id, dedup_hash, coalesce(min(run_id) FILTER (run_id % 2 = 0), min(run_id)) AS run_id FROM f_runs GROUP BY profile_id, dedup_hash")
add("snk03_upsert", "f_fixes", lambda x: filters.upsert(x.where("event_id % 2 = 0").select("user_id", "event_id"), x.where("event_id % 2 <> 0").select("user_id", "event_id"), ["user_id"], -F.col("event_id")), "SELECT user_id, coalesce(max(event_id) FILTER (event_id % 2 <> 0), max(event_id)) AS event_id FROM f_fixes GROUP BY user_id")
add("snk07_expired", "f_requests", lambda r: filters.expired(r, F.lit("1999-01-01").cast("timestamp")).select("id", "status"), "SELECT id, CASE WHEN status = 'pending' AND expires_at <= TIMESTAMP '1999-01-01' THEN 'expired' ELSE status END AS status FROM f_requests")
add("snk08_illegal", "f_requests", lambda r: filters.illegal(r, r.withColumn("status", F.when(F.col("id") % 2 == 0, "accepted").otherwise("declined"))), "SELECT id, status AS was, s AS status FROM (SELECT id, status, CASE WHEN id % 2 = 0 THEN 'accepted' ELSE 'declined' END AS s FROM f_requests) WHERE status <> s AND NOT (status = 'pending')")
add("snk14_next_version", "f_edges", lambda e: filters.next_version(e.select("trail_group", F.col("source").alias("version")), "trail_group"), "SELECT trail_group, max(source) + 1 AS version FROM f_edges GROUP BY ALL")
add("src09_decoded_time", "f_runs", lambda r: r.select("run_id", filters.decoded_time(F.col("distance_m") * F.pow(F.lit(10.0), F.col("run_id") % 8)).alias("unix_s")), f"SELECT run_id, {R('CASE WHEN v <= 0 THEN NULL WHEN v < 978307200 THEN v + 978307200 WHEN v < 3e9 THEN v ELSE v / 1000 END', 2)} AS unix_s FROM (SELECT run_id, distance_m * CAST(10 AS DOUBLE) ** (run_id % 8) AS v FROM f_runs)", 2)


def geohash_sql(precision: int = 6) -> str:
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    x, y = f"CAST(floor((lon + 180.0) / 360.0 * {2**nx}) AS BIGINT)", f"CAST(floor((lat + 90.0) / 180.0 * {2**ny}) AS BIGINT)"
    bit = lambda at: f"(({x} >> {nx - 1 - at // 2}) & 1)" if at % 2 == 0 else f"(({y} >> {ny - 1 - at // 2}) & 1)"
    parts = [f"substr('{geo.GEOHASH}', CAST(" + " + ".join(f"{bit(5 * k + j)} * {2 ** (4 - j)}" for j in range(5)) + " AS INTEGER) + 1, 1)" for k in range(precision)]
    return " || ".join(parts)


add("math06_geohash", "f_nodes", lambda n: n.select("id", geo.geohash(F.col("lat"), F.col("lon")).alias("cell")), f"SELECT id, {geohash_sql()} AS cell FROM f_nodes")
add("math04_worst_first", "f_edges", lambda e: e.select("id", meeting.worst_first(F.array(F.col("gradient") / 50, F.col("vertical_m") / 150, F.lit(0.9))).alias("factor")), f"""
SELECT id, {R("greatest(coalesce(p[1], 1) * coalesce(p[2], 1) ** (1.0 / 2) * coalesce(p[3], 1) ** (1.0 / 3), 0.25)")} AS factor FROM (SELECT id, list_sort(list_filter([gradient / 50, vertical_m / 150, 0.9], lambda x: x < 1)) AS p FROM f_edges)""")
add("cost02_lift_wait", "f_edges", lambda e: e.where("kind = 'lift'").select("id", meeting.lift_wait((F.col("source") % 8), F.lit(180.0), F.col("source") % 7 >= 5).alias("wait_s")), f"SELECT id, {R('least(180.0 * CASE WHEN source % 8 >= 6 THEN 0.7 WHEN source % 8 >= 4 THEN 0.85 ELSE 1 END * CASE WHEN source % 7 >= 5 THEN 1.4 ELSE 1 END, 600)')} AS wait_s FROM f_edges WHERE kind = 'lift'")
add("cost01_wind", "f_hourly", lambda h: h.select("time", meeting.wind_factor(F.col("wind_kph")).alias("factor")), "SELECT time, CASE WHEN wind_kph > 80 THEN 3.0 WHEN wind_kph > 60 THEN 1.5 WHEN wind_kph > 40 THEN 1.2 ELSE 1.0 END AS factor FROM f_hourly")
add("cost06_lapse", "f_nodes", lambda n: n.select("id", meeting.lapse(F.lit(-4.0), F.col("elevation"), F.lit(2000.0)).alias("temperature_c")), f"SELECT id, {R('-4.0 - 6.5 * (elevation - 2000) / 1000')} AS temperature_c FROM f_nodes")
ITEMS = "CASE id % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'skimap' WHEN 2 THEN 'openskimap' ELSE 'overpass' END"
add("er01_reconciled", "f_names", lambda n: meeting.reconciled(n.select(F.lit("run").alias("kind"), F.lower("official").alias("key"), F.expr(ITEMS).alias("source"), "name")), f"""
SELECT 'run' AS kind, key, min(name) FILTER (k = 1) AS name, {R("CASE WHEN bool_or(source = 'official') THEN 1 ELSE least(sum(w), 1) END")} AS confidence, string_agg(source, ',' ORDER BY source) AS sources FROM (
 SELECT *, row_number() OVER (PARTITION BY key ORDER BY w DESC) AS k FROM (SELECT lower(official) AS key, {ITEMS} AS source, min(name) AS name, CASE id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.45 WHEN 2 THEN 0.35 ELSE 0.2 END AS w FROM f_names GROUP BY ALL)) GROUP BY key""")
add("er06_pinned", "f_resorts", lambda r: meeting.pinned(r, r.where("id < 'r2'").select(F.col("id").alias("key"), F.length("name").alias("version")).union(r.sparkSession.createDataFrame([("__catalog__", 99)], "key string, version int"))), "SELECT id, CASE WHEN id < 'r2' THEN CAST(length(name) AS INTEGER) ELSE 99 END AS version FROM f_resorts")
add("stm01_latest_wins", "f_fixes", lambda x: windows.latest(x, ["user_id"], -F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id")).select("user_id", "event_id"), "SELECT user_id, event_id FROM f_fixes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
add("stm03_signal", "f_fixes", lambda x: x.select("event_id", meeting.signal(F.col("event_id") % 600).alias("signal")), "SELECT event_id, CASE WHEN event_id % 600 < 75 THEN 'live' WHEN event_id % 600 <= 300 THEN 'stale' ELSE 'cold' END AS signal FROM f_fixes")
add("stm13_monotone", "f_fixes", lambda x: meeting.monotone(x.withColumn("generation", F.col("event_id") % 23)).select("event_id"), "SELECT event_id FROM (SELECT event_id, event_id % 23 AS g, max(CASE WHEN event_id % 23 > 0 THEN event_id % 23 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM f_fixes) WHERE g = 0 OR m IS NULL OR g > m")

from . import graph_queries, social_queries, text_queries, track_queries  # noqa: E402, F401  each registers its queries
