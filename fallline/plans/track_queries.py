"""Queries over tracks: sessions, speeds, matching, folds and their aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import joins, meeting, tracks, windows
from .registry import HAV, R, add

STEP = HAV.format(a1="lag(lat) OVER w", a2="lag(lon) OVER w", b1="lat", b2="lon")
STEPS = f"st AS (SELECT *, at_s - lag(at_s) OVER w AS dt, {STEP} AS m FROM f_track WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"
LIFTS = f"""{STEPS}, c0 AS (SELECT *, last_value(elevation IGNORE NULLS) OVER s - first_value(elevation IGNORE NULLS) OVER s AS up, count(elevation) OVER s AS known, at_s - first_value(at_s) OVER s AS took, sum(coalesce(m, 0)) OVER s - first_value(coalesce(m, 0)) OVER s AS went
 FROM st WINDOW s AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)), c AS (SELECT *, coalesce(known >= 2 AND up > 8 AND took > 0 AND went / took < 5.5, false) AS lift FROM c0)"""


def grouped(gap: bool, least: int) -> str:
    late = " OR dt > 90" if gap else ""
    return f"""{LIFTS}, n AS (SELECT *, CASE WHEN lag(lift) OVER w IS NULL OR lift <> lag(lift) OVER w{late} THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS grp FROM n),
 ph AS (SELECT user_id, CAST(grp AS BIGINT) AS grp, bool_or(lift) AS lift, count(*) AS points, sum(CASE WHEN new = 0 THEN m ELSE 0 END) AS metres, sum(CASE WHEN new = 0 THEN dt ELSE 0 END) AS seconds FROM g GROUP BY user_id, grp HAVING count(*) >= {least})"""


add("win02_classified", "f_track", lambda t: tracks.classified(t).select("event_id", "lift"), f"SELECT * FROM (WITH {LIFTS} SELECT event_id, lift FROM c)")
add("win03_phases", "f_track", lambda t: tracks.phases(t), f"SELECT * FROM (WITH {grouped(True, 2)} SELECT user_id, grp, lift, points, {R('metres', 4)} AS metres, seconds FROM ph)", 4)
add("stm06_recorded", "f_track", lambda t: tracks.phases(t, None, 4).where("NOT lift"), f"SELECT * FROM (WITH {grouped(False, 4)} SELECT user_id, grp, lift, points, {R('metres', 4)} AS metres, seconds FROM ph WHERE NOT lift)", 4)
add("win06_runs_kept", "f_track", tracks.runs_kept, f"""SELECT * FROM (WITH {grouped(True, 2)}, k AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY grp) AS INTEGER) AS run, points, metres FROM ph WHERE NOT lift AND seconds > 0 AND metres / seconds >= 0.5)
 SELECT user_id, run, points, {R('metres', 4)} AS metres FROM (SELECT * FROM k UNION ALL SELECT user_id, 1, count(*), sum(coalesce(m, 0)) FROM st WHERE user_id NOT IN (SELECT user_id FROM k) GROUP BY user_id))""", 4)
add("win04_moving_speed", "f_track", lambda t: tracks.moving_speed(t, 5.0, 10.0), f"""
SELECT * FROM (WITH {STEPS}, s AS (SELECT *, dt > 0 AND m / dt < 5 AS slow FROM st WHERE dt IS NOT NULL), g AS (SELECT *, sum(CASE WHEN slow THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS grp FROM s),
 p AS (SELECT *, slow AND sum(CASE WHEN slow THEN dt END) OVER (PARTITION BY user_id, grp) >= 10 AS paused FROM g)
 SELECT u.user_id, {R('coalesce(v, 0)')} AS moving_ms FROM (SELECT DISTINCT user_id FROM f_track) u LEFT JOIN (SELECT user_id, sum(m) / sum(dt) AS v FROM p WHERE dt > 0 AND NOT paused GROUP BY user_id) USING (user_id))""")
add("win05_peaks", "f_track", windows.peaks, f"""
SELECT * FROM (WITH {STEPS}, s AS (SELECT * FROM st WHERE dt > 0 AND dt <= 30) SELECT user_id, {R('least(max(v), 30)')} AS peak_ms FROM (SELECT user_id, CASE WHEN count(*) OVER w = 3 THEN sum(m) OVER w / sum(dt) OVER w END AS v FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) GROUP BY user_id)""")
add("win13_gated_ema", "f_track", tracks.ema, f"""
SELECT user_id, {R("list_reduce(x[4:], lambda a, b: 0.2::DOUBLE * b + 0.8::DOUBLE * a)")} AS ema_ms, CAST(len(x) - 3 AS BIGINT) AS samples FROM (SELECT user_id, list(speed ORDER BY event_id) AS x FROM f_track WHERE speed > 0.5 AND speed <= 30 GROUP BY user_id) WHERE len(x) > 3""")
THIN = """WITH RECURSIVE r AS (SELECT user_id, min(k) AS k, min(at_s) AS at_s FROM f_track GROUP BY user_id UNION ALL
 SELECT r.user_id, n.k, n.at_s FROM r, LATERAL (SELECT k, at_s FROM f_track t WHERE t.user_id = r.user_id AND t.at_s >= r.at_s + {gap} ORDER BY t.k LIMIT 1) n)"""
add("win14_crumbs", "f_track", lambda t: tracks.crumbs_kept(t, 20.0, 50), f"SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM ({THIN.format(gap=20)} SELECT r.user_id, event_id FROM r JOIN f_track t ON t.user_id = r.user_id AND t.k = r.k)) WHERE i <= 50")
add("stm10_replayed", "f_track", lambda t: tracks.crumbs_kept(t.where("at_s <= 400"), 10.0).groupBy("user_id").agg(F.max("event_id").alias("last"), F.count("*").alias("crumbs")), f"SELECT user_id, max(event_id) AS last, count(*) AS crumbs FROM ({THIN.format(gap=10)} SELECT r.user_id, event_id FROM r JOIN f_track t ON t.user_id = r.user_id AND t.k = r.k WHERE t.at_s <= 400) GROUP BY user_id")
add("stm05_sent", "f_track", lambda t: tracks.sent(t, 7.0, 14.0, 5.0).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last")), """
SELECT user_id, CAST(list_reduce(x, lambda s, r: CASE WHEN s.at_s IS NULL OR r.at_s - s.at_s >= CASE WHEN r.speed >= 5 THEN 7 ELSE 14 END THEN {'at_s': r.at_s, 'speed': r.speed, 'event_id': r.event_id, 'n': s.n + 1} ELSE s END, {'at_s': CAST(NULL AS DOUBLE), 'speed': CAST(0 AS DOUBLE), 'event_id': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT)}).n AS BIGINT) AS n,
 list_reduce(x, lambda s, r: CASE WHEN s.at_s IS NULL OR r.at_s - s.at_s >= CASE WHEN r.speed >= 5 THEN 7 ELSE 14 END THEN {'at_s': r.at_s, 'speed': r.speed, 'event_id': r.event_id, 'n': s.n + 1} ELSE s END, {'at_s': CAST(NULL AS DOUBLE), 'speed': CAST(0 AS DOUBLE), 'event_id': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT)}).event_id AS last
FROM (SELECT user_id, list({'at_s': CAST(at_s AS DOUBLE), 'speed': speed, 'event_id': event_id, 'n': CAST(0 AS BIGINT)} ORDER BY event_id) AS x FROM f_track GROUP BY user_id)""")
add("stm15_throttled", "f_track", lambda t: tracks.throttled(t, 15.0), f"SELECT user_id, event_id FROM ({THIN.format(gap=15)} SELECT r.user_id, event_id FROM r JOIN f_track t ON t.user_id = r.user_id AND t.k = r.k)")
add("stm07_debounced", "f_track", lambda t: tracks.debounced(t), f"SELECT * FROM (WITH {STEPS}, b AS (SELECT *, sum(CASE WHEN dt IS NULL OR dt > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS burst FROM st) SELECT user_id, CAST(burst AS BIGINT) AS burst, CAST(max(at_s) + 30 AS DOUBLE) AS runs_at, count(*) AS events FROM b GROUP BY user_id, burst)")
add("stm02_present", "f_track", lambda t: tracks.present(t.select("user_id", F.col("at_s").cast("double").alias("at_s")), 1000.0), "SELECT user_id, CAST(max(at_s) AS DOUBLE) AS seen_s FROM f_track GROUP BY user_id HAVING max(at_s) >= 910")
add("stm04_subscriptions", "f_track", lambda t: tracks.subscriptions(t).groupBy("user_id").agg(F.count_if((F.size("leave") > F.size("join")) & (F.size("join") == 0)).alias("odd"), F.min(F.size("join")).alias("least")).select("user_id", "odd", (F.col("least") > 0).alias("moves")), "SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS odd, true AS moves FROM f_track")
add("stm11_enriched", "f_fixes f_resorts", lambda x, r: tracks.enriched(x, r).select("event_id", "resort_id", F.length("geohash6").alias("n")), """
SELECT event_id, min(id) FILTER (k = 1) AS resort_id, 6 AS n FROM (SELECT f.event_id, r.id, row_number() OVER (PARTITION BY f.event_id ORDER BY round((max_lat - min_lat) * (max_lon - min_lon), 12), r.id) AS k
FROM f_fixes f LEFT JOIN f_resorts r ON f.lat BETWEEN min_lat AND max_lat AND f.lon BETWEEN min_lon AND max_lon) GROUP BY event_id""")
add("stm16_windows", "f_fixes", lambda x: x.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), "n"), "SELECT start_us, count(*) AS n FROM (SELECT unnest([epoch_us(date_trunc('hour', ts)), epoch_us(date_trunc('hour', ts)) - 3600000000]) AS start_us FROM f_fixes) GROUP BY start_us")


def laps(track: DataFrame) -> DataFrame:
    return track.groupBy("user_id", F.floor(F.col("k") / 30).alias("lap")).agg(F.min("at_s").alias("start_s"), F.max("at_s").alias("stop_s"))


add("jn10_in_laps", "f_track", lambda t: tracks.in_intervals(t.select("user_id", "event_id", "at_s"), laps(t), "user_id", "at_s", "start_s", "stop_s").select("event_id", "lap"), "SELECT event_id, CAST(floor(k / 30) AS BIGINT) AS lap FROM f_track")
add("src05_lap_points", "f_track", lambda t: tracks.in_intervals(t.select("user_id", "event_id", "at_s"), laps(t).withColumn("stop_s", F.col("stop_s") - 14), "user_id", "at_s", "start_s", "stop_s").groupBy("user_id", "lap").agg(F.count("*").alias("points")), "SELECT user_id, lap, count(*) AS points FROM (SELECT *, CAST(floor(k / 30) AS BIGINT) AS lap, max(at_s) OVER (PARTITION BY user_id, floor(k / 30)) AS stop_s FROM f_track) WHERE at_s <= stop_s - 14 GROUP BY ALL")
SEGMENTS = "sg AS (SELECT user_id * 1000 + floor(k / 8) AS segment, k AS i, lat, lon FROM f_track)"
EDGES = "v AS (SELECT e.id AS edge, 0 AS i, n.lat AS vlat, n.lon AS vlon, e.kind FROM f_edges e JOIN f_nodes n ON n.id = e.source UNION ALL SELECT e.id, 1, n.lat, n.lon, e.kind FROM f_edges e JOIN f_nodes n ON n.id = e.target), ev AS (SELECT edge, i, vlat, vlon FROM v WHERE kind = 'run')"


def run_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("id", F.struct("lat", "lon").alias("p"))
    a = edges.where("kind = 'run'").select("id", "source", "target").join(n.select(F.col("id").alias("source"), F.col("p").alias("a")), "source").join(n.select(F.col("id").alias("target"), F.col("p").alias("b")), "target")
    return a.select("id", F.array("a", "b").alias("line"))


def segments(track: DataFrame) -> DataFrame:
    return track.select((F.col("user_id") * 1000 + F.floor(F.col("k") / 8)).alias("segment"), F.col("k").alias("i"), "lat", "lon")


BRG = "fmod(degrees(atan2(sin(radians({b2} - {a2})) * cos(radians({b1})), cos(radians({a1})) * sin(radians({b1})) - sin(radians({a1})) * cos(radians({b1})) * cos(radians({b2} - {a2})))) + 360, 360)"
SB = BRG.format(a1="arg_min(lat, i)", a2="arg_min(lon, i)", b1="arg_max(lat, i)", b2="arg_max(lon, i)")
EB = BRG.format(a1="arg_min(vlat, i)", a2="arg_min(vlon, i)", b1="arg_max(vlat, i)", b2="arg_max(vlon, i)")
add("jn08_matched", "f_track f_edges f_nodes", lambda t, e, n: tracks.matched(segments(t), run_lines(e, n), 400.0, 45.0).select("segment", "edge", "score"), f"""
SELECT * FROM (WITH {SEGMENTS}, {EDGES}, sd AS (SELECT segment, {SB} AS d FROM sg GROUP BY segment), ed AS (SELECT edge, {EB} AS d FROM ev GROUP BY edge),
 ok AS (SELECT segment, edge FROM (SELECT segment, edge, least(abs(sd.d - ed.d), 360 - abs(sd.d - ed.d)) AS t FROM sd, ed) WHERE t <= 45 OR 180 - t <= 45),
 gp AS (SELECT ok.segment, ok.edge, sg.i, min({HAV.format(a1='lat', a2='lon', b1='vlat', b2='vlon')}) AS gap FROM ok JOIN sg ON sg.segment = ok.segment JOIN ev ON ev.edge = ok.edge GROUP BY ALL),
 sc AS (SELECT segment, edge, avg(gap) AS score FROM gp GROUP BY ALL HAVING avg(gap) < 400)
 SELECT CAST(segment AS BIGINT) AS segment, edge, {R('score', 4)} AS score FROM sc QUALIFY row_number() OVER (PARTITION BY segment ORDER BY round(score, 9), edge) = 1)""", 4)
add("jn09_by_centroid", "f_track f_edges f_nodes", lambda t, e, n: tracks.by_centroid(segments(t), run_lines(e, n)).select("segment", "edge", "d"), f"""
SELECT * FROM (WITH {SEGMENTS}, {EDGES}, m AS (SELECT segment, avg(lat) AS lat, avg(lon) AS lon FROM sg GROUP BY segment), p AS (SELECT segment, edge, min({HAV.format(a1='lat', a2='lon', b1='vlat', b2='vlon')}) AS d FROM m, ev GROUP BY ALL)
 SELECT CAST(segment AS BIGINT) AS segment, edge, {R('d', 4)} AS d FROM p WHERE d < 300 QUALIFY row_number() OVER (PARTITION BY segment ORDER BY round(d, 9), edge) = 1)""", 4)
FLAGS = {"moguls": ("max_grade_deg > 7", "max_grade_deg <= 7"), "ungroomed": ("vertical_m > 40", "vertical_m <= 40"), "narrow": ("distance_m < 1200", "distance_m >= 2000"), "exposed": ("max_grade_deg > 8", "max_grade_deg < 3"), "gladed": ("difficulty = 'black'", "difficulty <> 'black'")}
add("agg06_cohorts", "f_runs", lambda r: tracks.cohorts(r.where("edge_id IS NOT NULL").withColumn("speed_ms", F.col("speed_ms").cast("double")), {k: (F.expr(a), F.expr(b)) for k, (a, b) in FLAGS.items()}), "SELECT profile_id, " + ", ".join(f"CASE WHEN count(*) FILTER ({a}) >= 3 AND count(*) FILTER ({b}) >= 3 THEN round(least(greatest(median(s) FILTER ({a}) / median(s) FILTER ({b}), 0.1::DOUBLE), 2), 6) END AS {k}" for k, (a, b) in FLAGS.items()) + " FROM (SELECT *, CAST(speed_ms AS DOUBLE) AS s FROM f_runs) WHERE edge_id IS NOT NULL GROUP BY profile_id")
add("agg05_corrected", "f_runs", lambda r: tracks.corrected(r.select("profile_id", "difficulty", F.col("speed_ms").cast("double").alias("speed_ms"), F.col("duration_s").cast("double").alias("duration_s"), (F.col("distance_m") / 10.0 / (1 + F.length("resort_id") + F.coalesce(F.length("difficulty"), F.lit(0)) % 3)).cast("double").alias("predicted_s"))), f"""
SELECT profile_id, difficulty, {R("CASE WHEN every >= 5 AND n >= 3 AND (r > 1.3 OR r < 0.7) THEN speed / r ELSE speed END")} AS speed_ms FROM (SELECT profile_id, difficulty, median(CAST(speed_ms AS DOUBLE)) AS speed, median(q) AS r, count(q) AS n FROM (
 SELECT *, CASE WHEN duration_s > 5 THEN CAST(duration_s AS DOUBLE) / (CAST(distance_m AS DOUBLE) / 10 / (1 + length(resort_id) + coalesce(length(difficulty), 0) % 3)) END AS q FROM f_runs) WHERE difficulty IS NOT NULL GROUP BY ALL) JOIN (SELECT profile_id, count(*) AS every FROM f_runs GROUP BY profile_id) USING (profile_id)""")
add("agg07_merged_profile", "f_runs", lambda r: r.groupBy("profile_id").agg(F.avg(F.col("speed_ms").cast("double")).alias("new"), F.count("*").alias("n")).select("profile_id", tracks.merged_profile(F.when(F.col("profile_id") % 3 > 0, F.col("profile_id").cast("double")), F.col("new"), F.col("n")).alias("speed_ms")), f"SELECT profile_id, {R('CASE WHEN profile_id % 3 = 0 THEN a ELSE profile_id * (1 - w) + a * w END')} AS speed_ms FROM (SELECT profile_id, avg(CAST(speed_ms AS DOUBLE)) AS a, greatest(0.5, 1 - 1 / (count(*) + 1.0)) AS w FROM f_runs GROUP BY profile_id)")
add("agg09_day_list", "f_runs", lambda r: r.groupBy("profile_id", F.to_date("run_at").alias("day"), "resort_id").agg(F.count("*").alias("n"), F.sum("distance_m").alias("d")).groupBy("profile_id", "day").agg(F.sum("n").alias("runs"), F.max_by("resort_id", F.struct("n", F.col("resort_id"))).alias("resort"), (F.count("*") - 1).alias("others"), F.sum("d").cast("double").alias("distance_m")), f"SELECT profile_id, day, CAST(sum(n) AS BIGINT) AS runs, arg_max(resort_id, {{'n': n, 'r': resort_id}}) AS resort, count(*) - 1 AS others, {R('CAST(sum(d) AS DOUBLE)')} AS distance_m FROM (SELECT profile_id, CAST(run_at AS DATE) AS day, resort_id, count(*) AS n, sum(distance_m) AS d FROM f_runs GROUP BY ALL) GROUP BY profile_id, day")
add("agg12_telemetry", "f_runs", lambda r: r.groupBy("resort_id").agg(F.count("*").alias("files"), F.sum(F.col("duration_s").cast("double")).alias("total"), F.avg(F.col("duration_s").cast("double")).alias("mean"), F.max(F.col("duration_s").cast("double")).alias("longest")), f"SELECT resort_id, count(*) AS files, {R('sum(CAST(duration_s AS DOUBLE))', 3)} AS total, {R('avg(CAST(duration_s AS DOUBLE))', 3)} AS mean, {R('max(CAST(duration_s AS DOUBLE))', 3)} AS longest FROM f_runs GROUP BY resort_id", 3)
add("src27_recomputed", "f_runs", lambda r: r.select("run_id", F.nullif(F.col("max_grade_deg").cast("double"), F.lit(0.0)).alias("grade"), F.coalesce(F.nullif(F.col("vertical_m").cast("double"), F.lit(0.0)), F.lit(-1.0)).alias("vertical_m")), f"SELECT run_id, {R('nullif(CAST(max_grade_deg AS DOUBLE), 0)')} AS grade, {R('coalesce(nullif(CAST(vertical_m AS DOUBLE), 0), -1)')} AS vertical_m FROM f_runs")
