"""Queries over costs, routes, trail graphs, map features and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import costs, features, graphs, meeting, routes
from .registry import HAV, R, add

CONDITIONS = costs.Conditions(wind_kph=45.0, visibility_km=3.0, fresh_cm=8.0)
SKIER = costs.Skier()
BASE = "CASE WHEN observations >= 3 AND observed_ms > 0 THEN observed_ms ELSE CASE coalesce(difficulty, 1) WHEN 0 THEN 4.0::DOUBLE WHEN 1 THEN 6 WHEN 2 THEN 5 ELSE 3 END END"
DAMP = f"CASE WHEN ({BASE}) < 5 THEN 0.7::DOUBLE ELSE 1 END"
HERE = "(-5 - 6.5::DOUBLE * (mid_m - 2000) / 1000)"


def soft(x: str) -> str:
    return f"1 - (1 - {x}::DOUBLE) * ({DAMP})"


def worst(items: str) -> str:
    return f"greatest(0.25, coalesce(list_aggregate(list_transform(list_sort(list_filter([{items}], lambda x: x < 1)), lambda p, i: pow(p, 1.0::DOUBLE / i)), 'product'), 1))"


TRAIL = worst(f"CASE WHEN moguls THEN {soft('0.6')} END, CASE WHEN groomed IS NULL THEN {soft('0.85')} WHEN NOT groomed THEN {soft('0.7')} END, CASE WHEN gladed THEN {soft('0.5')} END, CASE WHEN {HERE} < -3 THEN {soft('0.85')} END, CASE WHEN gradient > 22.5 THEN greatest(0.3, 1 - (least((gradient - 22.5) / 2.5, 1) + greatest(gradient - 25, 0) / 90) * 0.6::DOUBLE) END")
WEATHER = worst(f"CASE WHEN NOT gladed THEN 1 / 1.15::DOUBLE END, 1 / (1 + 2 * 0.05::DOUBLE * CASE WHEN gradient > 25 THEN 1.5 ELSE 1 END), CASE WHEN NOT coalesce(groomed, false) THEN 1 / (1 + 8 * 0.025::DOUBLE * CASE WHEN groomed IS NULL THEN 0.5 ELSE 1 END) END, CASE WHEN {HERE} < -15 THEN 0.8::DOUBLE WHEN {HERE} < -8 THEN 0.85::DOUBLE WHEN {HERE} < -3 THEN 0.95::DOUBLE END")
SPEED = f"({BASE}) * greatest({TRAIL}, 0.35) * greatest({WEATHER}, 0.6) * CASE WHEN coalesce(groomed, false) THEN 1.016::DOUBLE ELSE 1 END"


def cost_sql(at: str, gates: bool = True) -> str:
    hour = f"floor(9.8::DOUBLE + ({at}) / 3600)"
    usual = f"least(CASE lift_type WHEN 'gondola' THEN 180 WHEN 'chairLift' THEN 90 WHEN 'tBar' THEN 45 ELSE 90 END * CASE WHEN capacity >= 6 THEN 0.7::DOUBLE WHEN capacity >= 4 THEN 0.85::DOUBLE ELSE 1 END * CASE {hour} WHEN 8 THEN 0.5::DOUBLE WHEN 9 THEN 0.8::DOUBLE WHEN 10 THEN 1.5 WHEN 11 THEN 1.5 WHEN 12 THEN 1.2::DOUBLE WHEN 13 THEN 1.3::DOUBLE WHEN 14 THEN 1.3::DOUBLE WHEN 15 THEN 0.9::DOUBLE ELSE 1 END, 600)"
    wait = f"CASE WHEN wait_min BETWEEN 0 AND 60 THEN CASE WHEN wait_min * 180 < {usual} OR wait_min * 60 > {usual} * 3 THEN 0.7::DOUBLE * wait_min * 60 + 0.3::DOUBLE * {usual} ELSE wait_min * 60 END ELSE {usual} END"
    fit = "AND coalesce(difficulty, 1) <= 1" if gates else ""
    return f"CASE kind WHEN 'lift' THEN CASE WHEN is_open AND {hour} >= 7 AND {hour} < 21 THEN (coalesce(ride_s, 360) + {wait}) * 1.2::DOUBLE END WHEN 'run' THEN CASE WHEN is_open {fit} AND {SPEED} > 0.1 THEN length_m / ({SPEED}) END ELSE CASE WHEN is_open THEN length_m / 1.5 + 6 * greatest(vertical_m, 0) END END"


VARIANCE = "CASE WHEN observations >= 3 AND observed_ms > 0 AND observed_var > 0 THEN pow(({c}) / observed_ms, 2) * observed_var ELSE pow(({c}) * CASE kind WHEN 'lift' THEN 0.3::DOUBLE WHEN 'run' THEN 0.15::DOUBLE ELSE 0.1::DOUBLE END, 2) END"
add("cost01_traverse_time", "f_graph", lambda g: g.select("id", costs.seconds(CONDITIONS, SKIER, F.lit(0.0)).alias("now_s"), costs.seconds(CONDITIONS, SKIER, F.lit(1800.0), False).alias("later_s")), f"SELECT id, {R(cost_sql('0'))} AS now_s, {R(cost_sql('1800', False))} AS later_s FROM f_graph")
add("cost02_hourly_wait", "f_graph", lambda g: g.select("id", costs.lift_wait(F.col("lift_type"), F.col("capacity"), F.col("source") % 24, F.col("source") % 7 > 4).alias("wait_s")), f"SELECT id, {R('least(CASE lift_type WHEN $$gondola$$ THEN 180 WHEN $$chairLift$$ THEN 90 WHEN $$tBar$$ THEN 45 ELSE 90 END * CASE WHEN capacity >= 6 THEN 0.7::DOUBLE WHEN capacity >= 4 THEN 0.85::DOUBLE ELSE 1 END * CASE source % 24 WHEN 8 THEN 0.5::DOUBLE WHEN 9 THEN 0.8::DOUBLE WHEN 10 THEN 1.5 WHEN 11 THEN 1.5 WHEN 12 THEN 1.2::DOUBLE WHEN 13 THEN 1.3::DOUBLE WHEN 14 THEN 1.3::DOUBLE WHEN 15 THEN 0.9::DOUBLE ELSE 1 END * CASE WHEN source % 7 > 4 THEN 1.4::DOUBLE ELSE 1 END, 600)')} AS wait_s FROM f_graph")
add("cost03_allowed", "f_graph", lambda g: g.crossJoin(F.broadcast(g.sparkSession.createDataFrame([(k, v[0], v[1]) for k, v in costs.SKILLS.items()], "skill string, hardest int, comfort double"))).where("kind = 'run' AND difficulty <= hardest AND gradient <= comfort").groupBy("skill").agg(F.count("*").alias("runs")), "SELECT skill, count(*) AS runs FROM f_graph, (VALUES ('beginner', 0, 15), ('intermediate', 1, 25), ('advanced', 3, 35), ('expert', 3, 45)) t(skill, hardest, comfort) WHERE kind = 'run' AND difficulty <= hardest AND gradient <= comfort GROUP BY skill")
add("cost04_variance", "f_graph", lambda g: g.select("id", costs.variance(F.lit(100.0)).alias("variance")), f"SELECT id, {R(VARIANCE.format(c='100'))} AS variance FROM f_graph")
add("cost06_sun_factor", "f_graph", lambda g: g.select("id", costs.exposure(F.col("gradient"), F.lit(180.0), F.when(F.col("moguls"), None).otherwise(F.col("source") % 360), F.lit(0.2), F.col("capacity") * 10).alias("x"), "gradient").select("id", "x", costs.sun_factor(F.col("x"), F.col("gradient") / 10 - 5).alias("factor")), f"""
SELECT id, {R('x')} AS x, CASE WHEN x > 0.7 AND t > -1 THEN 0.75 WHEN x < 0.2 AND t < -3 THEN 0.8 WHEN x > 0.3 THEN 1.05 ELSE 1 END::DOUBLE AS factor FROM (SELECT id, gradient / 10 - 5 AS t, CASE WHEN gradient <= 0 THEN 0 WHEN moguls THEN 0.5 ELSE greatest(cos(radians(least(abs(180 - source % 360), 360 - abs(180 - source % 360)))), 0) * sin(radians(gradient)) * (1 - 0.2::DOUBLE * 0.7::DOUBLE) * (1 - capacity * 10 / 100.0::DOUBLE * 0.7::DOUBLE) END AS x FROM f_graph)""")


def starts(graph: DataFrame, *nodes: int) -> DataFrame:
    return graph.sparkSession.createDataFrame([(k, n) for k, n in enumerate(nodes)], "person int, node long")


def labels(graph: DataFrame, *nodes: int, gates: bool = True) -> DataFrame:
    return routes.one_to_all(graph, starts(graph, *nodes), CONDITIONS, SKIER, gates)


def walk_sql(*nodes: int, gates: bool = True) -> str:
    """Walks from each start over edges that can be taken; as one open edge leaves each node, a walk is the only way."""
    first = " UNION ALL ".join(f"SELECT {k} AS person, CAST({n} AS BIGINT) AS node, CAST(0 AS DOUBLE) AS t, CAST(0 AS DOUBLE) AS v, CAST(NULL AS VARCHAR) AS via, 0 AS k, [CAST({n} AS BIGINT)] AS seen" for k, n in enumerate(nodes))
    c = cost_sql("w.t", gates)
    return f"WITH RECURSIVE walk AS ({first} UNION ALL SELECT w.person, e.target, w.t + ({c}), w.v + {VARIANCE.format(c=c)}, e.id, w.k + 1, list_append(w.seen, e.target) FROM walk w JOIN f_graph e ON e.source = w.node WHERE ({c}) IS NOT NULL AND NOT list_contains(w.seen, e.target))"


add("rte01_one_to_all", "f_graph", lambda g: labels(g, 31, 40).select("person", "node", "seconds", "variance", "via"), f"SELECT * FROM ({walk_sql(31, 40)} SELECT person, node, {R('t', 4)} AS seconds, {R('v', 4)} AS variance, via FROM walk)", 4)
add("rte02_path", "f_graph", lambda g: routes.paths_to(labels(g, 31, 40), starts(g, 50, 50)).groupBy("person", "target").agg(F.count("*").alias("edges"), F.max_by("edge", "step").alias("first"), F.min_by("edge", "step").alias("last")), f"SELECT * FROM ({walk_sql(31, 40)} SELECT w.person, CAST(50 AS BIGINT) AS target, CAST(max(k) AS BIGINT) AS edges, arg_min(via, k) AS first, arg_max(via, k) AS last FROM walk w WHERE via IS NOT NULL AND k <= (SELECT k FROM walk x WHERE x.person = w.person AND x.node = 50) GROUP BY w.person)")


def two(g: DataFrame, n: DataFrame) -> DataFrame:
    tops = g.where("kind = 'lift'").select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("is_lift", F.lit(True))
    marked = n.join(tops, "id", "left").select("id", "elevation", F.coalesce("is_lift", F.lit(False)).alias("is_lift"))
    return routes.two_skier_scores(labels(g, 31, 40), marked, g, starts(g, 31, 40))


BOTH = f"{walk_sql(31, 40)}, both_ AS (SELECT node, max(t) AS slow, min(t) AS fast, sum(v) AS variance FROM walk GROUP BY node HAVING count(DISTINCT person) = 2)"
add("rte03_two_skiers", "f_graph f_nodes", two, f"""
SELECT * FROM ({BOTH}, r AS (SELECT b.*, n.elevation, b.node NOT IN (31, 40) AS fine, b.node IN (SELECT unnest([source, target]) FROM f_graph WHERE kind = 'lift') AS lift, coalesce((SELECT count(*) FROM f_graph WHERE is_open AND source = b.node), 0) AS ways,
 least(30, greatest(5, 0.05::DOUBLE * (max(slow) OVER () - min(slow) OVER ()))) AS k, min(elevation) OVER () AS lo, max(elevation) OVER () AS hi FROM both_ b LEFT JOIN f_nodes n ON n.id = b.node),
 s AS (SELECT node, slow, fast, fine, slow - fast <= 300 AS near, slow + 0.6::DOUBLE * (slow - fast) + 0.5 * sqrt(variance) + k * (CASE WHEN hi - lo > 100 AND (elevation - lo) / (hi - lo) < 0.15::DOUBLE THEN 3 WHEN hi - lo > 100 AND (elevation - lo) / (hi - lo) > 0.85::DOUBLE THEN 0.5 ELSE 0 END - least(ways / 6.0::DOUBLE, 1) - CASE WHEN lift THEN 0.5 ELSE 0 END) AS score FROM r),
 f AS (SELECT * FROM s WHERE fine OR NOT (SELECT bool_or(fine) FROM s)) SELECT node, {R('slow', 4)} AS slow, {R('fast', 4)} AS fast, {R('score', 4)} AS score FROM f WHERE near OR NOT (SELECT bool_or(near) FROM f))""", 4)
add("rte04_n_skiers", "f_graph", lambda g: meeting.meeting_points(labels(g, 31, 35, 40), 3, 5), f"SELECT * FROM ({walk_sql(31, 35, 40)} SELECT node, {R('max(t) + 0.6::DOUBLE * (max(t) - min(t))')} AS score FROM walk GROUP BY node HAVING count(*) = 3 ORDER BY max(t) + 0.6::DOUBLE * (max(t) - min(t)), node LIMIT 5)")
add("rte05_failure", "f_graph", lambda g: routes.failure(labels(g, 51, 55), labels(g, 51, 55, gates=False), 2), f"SELECT CASE WHEN (SELECT count(*) FROM ({walk_sql(51, 55)} SELECT node FROM walk GROUP BY node HAVING count(DISTINCT person) = 2)) > 0 THEN 'ok' WHEN (SELECT count(*) FROM ({walk_sql(51, 55, gates=False)} SELECT node FROM walk GROUP BY node HAVING count(DISTINCT person) = 2)) > 0 THEN 'too_hard' ELSE 'no_way' END AS status")
add("rte07_reroute", "f_graph", lambda g: g.select("id", routes.reroute(F.col("length_m"), F.col("length_m") - F.col("vertical_m"), F.col("gradient") * 2).alias("change")), "SELECT id, vertical_m >= greatest(30, 0.1::DOUBLE * length_m) AND gradient * 2 >= 30 AS change FROM f_graph")
add("rte09_memo_key", "f_graph", lambda g: g.groupBy("trail_group").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "id", F.col("is_open").cast("string")))), "|").alias("k")).select("trail_group", F.sha2("k", 256).alias("key")), "SELECT trail_group, sha256(string_agg(id || ':' || is_open, '|' ORDER BY id || ':' || is_open)) AS key FROM f_graph GROUP BY trail_group")
LEGS = lambda g: g.select(F.col("trail_group").alias("route"), F.col("source").alias("leg"), "kind", "name", F.col("gradient").alias("seconds"), "length_m")
CUM = "(SELECT trail_group AS route, source AS leg, gradient AS seconds, sum(gradient) OVER (PARTITION BY trail_group ORDER BY source ROWS UNBOUNDED PRECEDING) AS stop FROM f_graph)"
add("win12_position", "f_graph", lambda g: routes.position_at(LEGS(g), F.lit(40.0)), f"SELECT route, leg, {R('(40 - stop + seconds) / seconds')} AS fraction FROM {CUM} WHERE stop - seconds <= 40 AND stop > 40 AND seconds > 0")
add("prj01_ghosts", "f_graph", lambda g: routes.ghosts(LEGS(g), F.lit(90.0)), f"SELECT route, CAST(i AS INTEGER) AS i, leg, {R('(45 * i - stop + seconds) / seconds')} AS fraction FROM {CUM}, (SELECT unnest([1, 2]) AS i) WHERE stop - seconds < 45 * i AND stop >= 45 * i AND seconds > 0")
add("prj02_rescaled", "f_graph", lambda g: routes.rescaled(LEGS(g), F.lit(600.0)).select("route", "leg", "share"), f"SELECT trail_group AS route, source AS leg, {R('600 * gradient / sum(gradient) OVER (PARTITION BY trail_group)')} AS share FROM f_graph")
add("prj03_totals", "f_graph", lambda g: g.groupBy("trail_group").agg(F.sum("length_m").alias("length_m"), F.sum("vertical_m").alias("vertical_m")), f"SELECT trail_group, {R('sum(length_m)')} AS length_m, {R('sum(vertical_m)')} AS vertical_m FROM f_graph GROUP BY trail_group")
add("nav01_maneuvers", "f_graph", lambda g: routes.maneuvers(LEGS(g).withColumnRenamed("leg", "step")).select("route", "leg", "kind", "length_m", "icon"), f"""
SELECT route, leg, kind, length_m, CASE WHEN nx IS NULL THEN 'arrive' WHEN kind <> 'lift' AND nx = 'lift' THEN 'board' WHEN kind = 'lift' AND nx <> 'lift' THEN 'unload' ELSE 'continue' END AS icon FROM (SELECT *, lead(kind) OVER (PARTITION BY route ORDER BY leg) AS nx FROM (
 SELECT route, CAST(leg AS BIGINT) AS leg, min(kind) AS kind, {R('sum(length_m)')} AS length_m FROM (SELECT *, sum(new) OVER (PARTITION BY route ORDER BY source ROWS UNBOUNDED PRECEDING) AS leg FROM (SELECT *, trail_group AS route, CASE WHEN lag(kind) OVER w IS NULL OR kind <> lag(kind) OVER w OR name IS DISTINCT FROM lag(name) OVER w THEN 1 ELSE 0 END AS new FROM f_graph WINDOW w AS (PARTITION BY trail_group ORDER BY source))) GROUP BY route, leg))""")
add("nav02_recalculate", "f_graph", lambda g: g.select("id", routes.may_recalculate(F.col("gradient"), F.col("vertical_m"), F.col("capacity") * 2).alias("act")), "SELECT id, CASE WHEN gradient >= 30 AND vertical_m >= 50 THEN 'auto' WHEN capacity * 2 >= 8 THEN 'button' ELSE 'wait' END AS act FROM f_graph")
D = HAV.format(a1="39.61", a2="-106.35", b1="n.lat", b2="n.lon")
add("top03_fallback_pairs", "f_nodes f_edges", lambda n, e: routes.fallback_pairs(n.withColumn("person", F.lit(1)), e.select("source", "is_open").union(e.select("target", "is_open")).toDF("source", "is_open"), graphs.geo.haversine(F.lit(39.61), F.lit(-106.35), F.col("lat"), F.col("lon"))), f"""
SELECT 1 AS person, CAST(row_number() OVER (ORDER BY round({D}, 9), n.id) AS INTEGER) AS k, n.id FROM f_nodes n JOIN (SELECT s FROM (SELECT source AS s FROM f_edges WHERE is_open UNION ALL SELECT target FROM f_edges WHERE is_open) GROUP BY s HAVING count(*) >= 2) ON s = n.id QUALIFY k <= 5""")
add("top06_ordered", "f_manifests", lambda m: m.orderBy(F.desc("built_at"), "id").limit(50).select("id", "resort_id"), "SELECT id, resort_id FROM f_manifests ORDER BY built_at DESC, id LIMIT 50")


def ways(w: DataFrame, lift: bool) -> DataFrame:
    p = lambda k: F.struct(F.col(f"lat{k}").alias("lat"), F.col(f"lon{k}").alias("lon"), F.col(f"e{k}").alias("elevation"))
    return w.where(F.col("is_lift") == lift).select("id", "name", "difficulty", "lift_type", F.array(p(0), p(1), p(2)).alias("line"))


NODE = "'n' || CAST(floor(lat{0} * 100000 + 0.5) AS BIGINT) || '_' || CAST(floor(lon{0} * 100000 + 0.5) AS BIGINT)"
WAYS = f"(SELECT *, coalesce(e0, e1) AS a, coalesce(e2, e1) AS b, greatest(coalesce(e0, e1), e1, coalesce(e2, e1)) AS hi, least(coalesce(e0, e1), e1, coalesce(e2, e1)) AS lo, {NODE.format(0)} AS n0, {NODE.format(2)} AS n2, {HAV.format(a1='lat0', a2='lon0', b1='lat1', b2='lon1')} + {HAV.format(a1='lat1', a2='lon1', b1='lat2', b2='lon2')} AS m FROM f_ways)"
DOWN = "CASE WHEN a <> b THEN a > b WHEN e0 IS NOT NULL AND e2 IS NOT NULL THEN list_position([e0, e1, e2], hi) <= 2 ELSE true END"
add("gra01_runs", "f_ways", lambda w: graphs.run_edges(ways(w, False)).drop("line", "name", "difficulty"), f"SELECT 't' || id AS id, CASE WHEN {DOWN} THEN n0 ELSE n2 END AS source, CASE WHEN {DOWN} THEN n2 ELSE n0 END AS target, 'run' AS kind, {R('m', 3)} AS length_m, {R('hi - lo', 3)} AS vertical_m FROM {WAYS} WHERE NOT is_lift", 3)
RIDE = "m / CASE lift_type WHEN 'gondola' THEN 5 WHEN 'chairLift' THEN 2.5 ELSE 3 END"
add("gra02_lifts", "f_ways", lambda w: graphs.lift_edges(ways(w, True)).drop("line", "name", "lift_type"), f"SELECT 'l' || id AS id, CASE WHEN a > b THEN n2 ELSE n0 END AS source, CASE WHEN a > b THEN n0 ELSE n2 END AS target, 'lift' AS kind, {R('m', 3)} AS length_m, {R('hi - lo', 3)} AS vertical_m, {R(RIDE, 3)} AS ride_s FROM {WAYS} WHERE is_lift", 3)
add("gra03_first_nodes", "f_ways", lambda w: graphs.first_nodes(graphs.run_edges(ways(w, False)), graphs.lift_edges(ways(w, True))), f"""
SELECT n AS id, arg_min(kind, {{'o': o, 'e': e, 'x': x}}) AS kind FROM (SELECT unnest([{{'n': s, 'o': o, 'e': e, 'x': 0, 'kind': ka}}, {{'n': t, 'o': o, 'e': e, 'x': 1, 'kind': kb}}], recursive := true) FROM (
 SELECT CASE WHEN {DOWN} THEN n0 ELSE n2 END AS s, CASE WHEN {DOWN} THEN n2 ELSE n0 END AS t, 0 AS o, 't' || id AS e, 'trailHead' AS ka, 'trailEnd' AS kb FROM {WAYS} WHERE NOT is_lift
 UNION ALL SELECT CASE WHEN a > b THEN n2 ELSE n0 END, CASE WHEN a > b THEN n0 ELSE n2 END, 1, 'l' || id, 'liftBase', 'liftTop' FROM {WAYS} WHERE is_lift)) GROUP BY n""")
PAIR = HAV.format(a1="a.lat", a2="a.lon", b1="b.lat", b2="b.lon")
add("gra08_traverses", "f_nodes f_edges", lambda n, e: graphs.traverses(n.withColumn("elevation", F.col("elevation") % 40), e, digits=4), f"""
SELECT * FROM (WITH p AS (SELECT a.id AS a, b.id AS b, {PAIR} AS m, fmod(a.elevation, 40) - fmod(b.elevation, 40) AS d FROM f_nodes a JOIN f_nodes b ON a.id < b.id WHERE {PAIR} < 200 AND NOT EXISTS (SELECT 1 FROM f_edges WHERE least(source, target) = a.id AND greatest(source, target) = b.id))
SELECT a AS source, b AS target, {R('m', 4)} AS metres FROM p WHERE abs(d) <= 10 OR d BETWEEN 10 AND 30 UNION ALL SELECT b, a, {R('m', 4)} FROM p WHERE abs(d) <= 10 OR -d BETWEEN 10 AND 30)""", 4, done=True)
CHAIN = "l AS (SELECT source AS a, target AS b FROM f_graph WHERE is_open AND kind <> 'lift' UNION SELECT target, source FROM f_graph WHERE is_open AND kind <> 'lift'), w AS (SELECT a AS node, a AS reach FROM l UNION SELECT w.node, l.b FROM w JOIN l ON w.reach = l.a)"
OPEN = lambda g: g.where("is_open AND kind <> 'lift'")
add("gra09_components", "f_graph", lambda g: graphs.components(OPEN(g).select(F.col("source").alias("a"), F.col("target").alias("b"))), f"SELECT * FROM (WITH RECURSIVE {CHAIN} SELECT node, min(reach) AS component FROM w GROUP BY node)")
add("gra10_bridges", "f_graph f_nodes", lambda g, n: graphs.bridges(n, graphs.components(OPEN(g).select(F.col("source").alias("a"), F.col("target").alias("b")))).select("component", "metres"), f"""
SELECT * FROM (WITH RECURSIVE {CHAIN}, c AS (SELECT node, min(reach) AS component FROM w GROUP BY node), m AS (SELECT arg_max(component, {{'n': n, 'c': -component}}) AS main FROM (SELECT component, count(*) AS n FROM c GROUP BY component)), pos AS (SELECT c.*, lat, lon FROM c JOIN f_nodes ON id = node)
SELECT a.component, {R('min(' + PAIR + ')', 4)} AS metres FROM pos a, pos b, m WHERE a.component <> main AND b.component = main GROUP BY a.component)""", 4)
add("gra11_reaching_lifts", "f_graph", lambda g: graphs.reaching_lifts(g), "SELECT node, CAST(min(h) AS INTEGER) AS hops FROM (WITH RECURSIVE w AS (SELECT DISTINCT source AS node, 0 AS h FROM f_graph WHERE is_open AND kind = 'lift' UNION SELECT e.source, h + 1 FROM w JOIN f_graph e ON e.target = w.node AND e.is_open WHERE h < 8) SELECT * FROM w) GROUP BY node")
add("gra12_pruned", "f_graph", lambda g: graphs.pruned(g).select("id"), "SELECT * FROM (WITH e AS (SELECT source AS n, name FROM f_graph UNION ALL SELECT target, name FROM f_graph), gone AS (SELECT n FROM e GROUP BY n HAVING count(*) <= 1 AND count(name) = 0) SELECT id FROM f_graph WHERE source NOT IN (FROM gone) AND target NOT IN (FROM gone))")
KEYED = lambda g: g.withColumn("difficulty", F.col("difficulty").cast("string"))
add("gra13_trail_groups", "f_graph", lambda g: graphs.trail_groups(KEYED(g), text.trail_key(F.substring("name", 1, 4))), """
SELECT * FROM (WITH RECURSIVE r AS (SELECT id, CAST(difficulty AS VARCHAR) AS d, nullif(trim(regexp_replace(lower(strip_accents(name[1:4])), '[^a-z0-9]+', ' ', 'g')), '') AS k, source, target FROM f_graph WHERE kind = 'run'),
 pl AS (SELECT id, k, d, source AS n FROM r WHERE k IS NOT NULL UNION SELECT id, k, d, target FROM r WHERE k IS NOT NULL), l AS (SELECT DISTINCT a.id AS a, b.id AS b FROM pl a JOIN pl b ON a.k = b.k AND a.d IS NOT DISTINCT FROM b.d AND a.n = b.n),
 w AS (SELECT id, id AS reach FROM r UNION SELECT w.id, l.b FROM w JOIN l ON l.a = w.reach), c AS (SELECT w.id, min(reach) AS c FROM w GROUP BY w.id), g AS (SELECT r.id, coalesce(k, '') AS k, coalesce(d, '') AS d, c FROM r JOIN c ON c.id = r.id)
 SELECT id, 'tg' || (dense_rank() OVER (ORDER BY k, d, c) - 1) AS trail_group FROM g)""")
add("gra14_diagnostics", "f_graph", lambda g: graphs.diagnostics(OPEN(g).unionByName(g.where("kind = 'lift'"))), "SELECT * FROM (WITH e AS (SELECT * FROM f_graph WHERE is_open OR kind = 'lift') SELECT 'sink' AS problem, target AS node FROM e WHERE target NOT IN (SELECT source FROM e) GROUP BY target UNION ALL SELECT 'top_without_run', target FROM e WHERE kind = 'lift' AND target NOT IN (SELECT source FROM e WHERE kind = 'run') GROUP BY target)")
add("gra16_nearest_node", "f_fixes f_nodes", lambda x, n: graphs.nearest_node(x.select(F.col("event_id").alias("id"), "lat", "lon"), n, (36.0, 100.0)), f"""
SELECT f.event_id AS id, n.id AS node, round(n.m, 4) AS metres FROM f_fixes f LEFT JOIN (SELECT f.event_id, n.id, round({HAV.format(a1='f.lat', a2='f.lon', b1='n.lat', b2='n.lon')}, 6) AS m, row_number() OVER (PARTITION BY f.event_id ORDER BY round({HAV.format(a1='f.lat', a2='f.lon', b1='n.lat', b2='n.lon')}, 6), n.id) AS k FROM f_fixes f JOIN f_nodes n ON {HAV.format(a1='f.lat', a2='f.lon', b1='n.lat', b2='n.lon')} <= 100) n ON n.event_id = f.event_id AND k = 1""", 4)
add("grp03_test_runs", "f_graph", lambda g: (lambda groups, ends: groups.join(g.where("kind = 'run'").select("trail_group", F.explode(F.array("source", "target")).alias("node")).join(ends, "node", "left_semi").select("trail_group").distinct(), "trail_group", "left_semi"))(g.where("kind = 'run' AND name IS NOT NULL AND difficulty IS NOT NULL").groupBy("trail_group").agg(F.sum("length_m").alias("length_m")).where("length_m >= 60"), g.where("kind = 'lift'").select(F.explode(F.array("source", "target")).alias("node")).distinct()), f"SELECT trail_group, {R('sum(length_m)')} AS length_m FROM f_graph WHERE kind = 'run' AND name IS NOT NULL AND difficulty IS NOT NULL AND trail_group IN (SELECT trail_group FROM f_graph r WHERE kind = 'run' AND EXISTS (SELECT 1 FROM f_graph l WHERE l.kind = 'lift' AND (l.source IN (r.source, r.target) OR l.target IN (r.source, r.target)))) GROUP BY trail_group HAVING sum(length_m) >= 60")
VERT = "CAST(CAST(floor({v} + 0.5) AS BIGINT) AS VARCHAR) || 'm'"
LABEL = "CASE WHEN {n} IS NOT NULL AND {v} >= {a} THEN {n} || ' · ' || " + VERT + " WHEN {n} IS NOT NULL THEN {n} WHEN {v} >= {b} THEN " + VERT + " ELSE '' END"
add("fea01_trails", "f_graph", lambda g: features.trails(g), f"SELECT *, {R('degrees(atan2(vertical_m, length_m))')} AS mean_deg, {LABEL.format(n='name', v='vertical_m', a=8, b=20)} AS label FROM (SELECT trail_group, min(name) AS name, {R('sum(length_m)')} AS length_m, sum(vertical_m) AS vertical_m, max(gradient) AS steepest, bool_or(is_open) AS open, bool_or(moguls) AS moguls FROM f_graph WHERE kind = 'run' GROUP BY trail_group)")
add("fea02_cabins", "f_graph", features.cabins, f"SELECT id, i, {R('i / n')} AS phase FROM (SELECT id, unnest(range(0, CAST(n AS INTEGER)))::INTEGER AS i, n FROM (SELECT id, CAST(least(greatest(floor(length_m / 250), 1), 4) AS DOUBLE) AS n FROM f_graph WHERE kind = 'lift' AND is_open AND length_m > 100))")
add("fea03_lifts", "f_graph", features.lifts, f"SELECT id, is_open, {R('length_m')} AS length_m, {LABEL.format(n='name', v='vertical_m', a=8, b=15)} AS label FROM f_graph WHERE kind = 'lift'")
add("fea05_points", "f_nodes", lambda n: n.select("id", F.get_json_object(features.feature(features.point(F.col("lat"), F.col("lon")), "id"), "$.geometry.type").alias("type"), F.get_json_object(features.feature(features.point(F.col("lat"), F.col("lon")), "id"), "$.properties.id").alias("of")), "SELECT id, 'Point' AS type, CAST(id AS VARCHAR) AS of FROM f_nodes")
add("fea07_friends", "f_track f_nodes", lambda t, n: features.friends(t.select("user_id", F.col("at_s").cast("double").alias("at_s"), "lat", "lon", (F.col("event_id") % 3000).alias("node"), F.concat(F.lit("ann "), F.col("event_id").cast("string")).alias("name"), F.col("speed").alias("accuracy_m")), n, 700.0).select("user_id", "signal", "opacity", "initials", "accuracy_m", "lat"), """
SELECT user_id, CASE WHEN 700 - at_s < 75 THEN 'live' WHEN 700 - at_s <= 300 THEN 'stale' ELSE 'cold' END AS signal, CASE WHEN 700 - at_s < 75 THEN 1.0 WHEN 700 - at_s <= 300 THEN 0.75 ELSE 0.45 END::DOUBLE AS opacity, 'A' || CAST(event_id AS VARCHAR)[1] AS initials, CASE WHEN speed >= 20 THEN speed END AS accuracy_m, round(coalesce(n.lat, t.lat), 6) AS lat FROM f_track t LEFT JOIN f_nodes n ON n.id = event_id % 3000 WHERE 700 - at_s <= 10800""")
add("fea08_traverse_groups", "f_graph", features.traverse_groups, f"SELECT trail_group, count(*) AS n, {R('sum(length_m)')} AS length_m, sum(vertical_m) AS vertical_m FROM f_graph WHERE kind = 'traverse' GROUP BY trail_group")
add("fea09_dead_ends", "f_nodes f_graph", features.dead_ends, "SELECT id FROM f_nodes WHERE id NOT IN (SELECT source FROM f_graph WHERE is_open)")
add("fea10_phantoms", "f_graph", lambda g: features.phantoms(g, F.col("moguls")).select("id"), "SELECT id FROM f_graph WHERE NOT is_open AND NOT moguls AND name IS NOT NULL AND kind IN ('run', 'lift')")
PLACE = "CAST(CAST(trunc(lat * 10000) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(trunc(lon * 10000) AS BIGINT) AS VARCHAR)"
add("fea11_points_of_interest", "f_nodes f_graph", features.points_of_interest, f"""
SELECT * FROM (WITH e AS (SELECT (SELECT arg_max(id, {{'e': elevation, 'i': -id}}) FROM f_nodes) AS id, 'summit' AS kind, 0 AS k UNION ALL SELECT (SELECT arg_min(id, {{'e': elevation, 'i': id}}) FROM f_nodes WHERE id IN (SELECT unnest([source, target]) FROM f_graph WHERE kind = 'lift')), 'base_area', 1
 UNION ALL SELECT source, 'base', 2 FROM f_graph WHERE kind = 'lift' AND name IS NOT NULL UNION ALL SELECT target, 'top', 2 FROM f_graph WHERE kind = 'lift' AND name IS NOT NULL)
SELECT {PLACE} AS place, arg_min(e.id, {{'k': k, 'i': e.id, 'x': kind}}) AS id, arg_min(kind, {{'k': k, 'i': e.id, 'x': kind}}) AS kind FROM e JOIN f_nodes n ON n.id = e.id GROUP BY place)""")
add("fea13_lift_ends", "f_graph f_nodes", features.lift_ends, f"SELECT {PLACE} AS place, min(id) AS id FROM f_nodes WHERE id IN (SELECT unnest([source, target]) FROM f_graph WHERE kind = 'lift') GROUP BY place")
add("fea14_sun_colours", "f_graph", lambda g: features.sun_colours(g.select("id", "gradient"), F.col("gradient") / 50).select("id", "colour"), "SELECT id, printf('#%02X40%02X', CAST(floor(gradient / 50 * 255 + 0.5) AS INTEGER), 255 - CAST(floor(gradient / 50 * 255 + 0.5) AS INTEGER)) AS colour FROM f_graph")
add("fea15_temperatures", "f_graph f_nodes", lambda g, n: features.temperatures(g, n, -4.0, 2000.0), "SELECT trail_group, round(-4 - 6.5::DOUBLE * (avg((a.elevation + b.elevation) / 2) - 2000) / 1000, 1) AS temperature_c FROM f_graph JOIN f_nodes a ON a.id = source JOIN f_nodes b ON b.id = target WHERE kind = 'run' GROUP BY trail_group")
add("top07_places", "f_nodes", lambda n: n.withColumn("place", features.place_key(F.col("lat"), F.col("lon"))).groupBy("place").agg(F.min("id").alias("id")), f"SELECT {PLACE} AS place, min(id) AS id FROM f_nodes GROUP BY place")
add("er02_disagreements", "f_manifests", lambda m: m.groupBy("resort_id").pivot("source", ["official", "openskimap", "overpass"]).count().withColumn("filled", F.expr("int(official > 0) + int(openskimap > 0) + int(overpass > 0)")).where("filled >= 2 AND greatest(official, openskimap, overpass) != least(official, openskimap, overpass)").select("resort_id", "official", "openskimap", "overpass"), "SELECT resort_id, count(*) FILTER (source = 'official') AS official, count(*) FILTER (source = 'openskimap') AS openskimap, count(*) FILTER (source = 'overpass') AS overpass FROM f_manifests GROUP BY resort_id HAVING count(DISTINCT source) >= 2 AND len(list_distinct([count(*) FILTER (source = 'official'), count(*) FILTER (source = 'openskimap'), count(*) FILTER (source = 'overpass')])) > 1")
add("er03_accepted", "f_manifests", lambda m: m.where(~F.startswith(F.coalesce("notes", F.lit("")), F.lit("REJECT:"))).select("id"), "SELECT id FROM f_manifests WHERE coalesce(notes, '') NOT LIKE 'REJECT:%'")
add("er04_applied", "f_manifests", lambda m: m.groupBy("resort_id").agg(F.max("version").alias("current"), F.max_by("content_hash", F.struct("version", "id")).alias("was")).withColumn("new", F.lit("h3")).select("resort_id", F.when(F.col("new") == F.col("was"), F.col("current")).otherwise(F.col("current") + 1).alias("version"), (F.col("new") == F.col("was")).alias("skipped")), "SELECT resort_id, CAST(CASE WHEN h = 'h3' THEN v ELSE v + 1 END AS INTEGER) AS version, h = 'h3' AS skipped FROM (SELECT resort_id, max(version) AS v, arg_max(content_hash, {'v': version, 'i': id}) AS h FROM f_manifests GROUP BY resort_id)")
add("er05_blob", "f_manifests", lambda m: m.where("version = 3").withColumn("k", F.row_number().over(Window.partitionBy("resort_id").orderBy(F.desc("built_at"), F.desc("id")))).where("k = 1").select("resort_id", "id"), "SELECT resort_id, id FROM f_manifests WHERE version = 3 QUALIFY row_number() OVER (PARTITION BY resort_id ORDER BY built_at DESC, id DESC) = 1")
add("er07_reusable", "f_manifests", lambda m: m.where("built_at >= TIMESTAMP'1998-06-01 00:00:00'").groupBy("resort_id", F.to_date("built_at").alias("day")).agg(F.count_if(F.col("source") == "official").alias("a"), F.count_if(F.col("source") == "overpass").alias("b")).where("a > 0 AND b > 0").select("resort_id", "day"), "SELECT resort_id, CAST(built_at AS DATE) AS day FROM f_manifests WHERE built_at >= TIMESTAMP '1998-06-01' GROUP BY ALL HAVING count(*) FILTER (source = 'official') > 0 AND count(*) FILTER (source = 'overpass') > 0")
add("er08_review", "f_manifests", lambda m: m.where("confidence < 0.7").orderBy("id").limit(20).select("id", "confidence"), "SELECT id, confidence FROM f_manifests WHERE confidence < 0.7 ORDER BY id LIMIT 20")
add("er09_candidates", "f_trails f_names", lambda t, n: t.select(F.lower("name").alias("key"), F.lit("trails").alias("source"), "id").unionByName(n.select(F.lower("official").alias("key"), F.lit("names").alias("source"), "id")).join(t.select(F.lower("name").alias("key")).distinct(), "key", "left_semi"), "SELECT * FROM (SELECT lower(name) AS key, 'trails' AS source, id FROM f_trails UNION ALL SELECT lower(official), 'names', id FROM f_names) WHERE key IN (SELECT lower(name) FROM f_trails)")
add("er10_protocol", "f_manifests f_resorts", lambda m, r: r.select(F.col("id").alias("resort_id"), (F.length("id") + 4).alias("have")).join(m.groupBy("resort_id").agg(F.max("version").alias("v")), "resort_id", "left").select("resort_id", F.when(F.col("v").isNull(), "not_built").when(F.col("v") <= F.col("have"), "cache_valid").otherwise("fetch").alias("answer")), "SELECT r.id AS resort_id, CASE WHEN v IS NULL THEN 'not_built' WHEN v <= length(r.id) + 4 THEN 'cache_valid' ELSE 'fetch' END AS answer FROM f_resorts r LEFT JOIN (SELECT resort_id, max(version) AS v FROM f_manifests GROUP BY resort_id) m ON m.resort_id = r.id")
add("jn14_geometry_override", "f_graph f_names", lambda g, n: g.join(n.groupBy(F.lower("official").alias("key")).agg(F.max("id").alias("override")), F.lower("name") == F.col("key"), "left").select("id", F.coalesce("override", F.lit(-1).cast("long")).alias("override")), "SELECT g.id, coalesce(o.i, -1) AS override FROM f_graph g LEFT JOIN (SELECT lower(official) AS k, max(id) AS i FROM f_names GROUP BY k) o ON o.k = lower(g.name)")
add("snk10_unprocessed", "f_nodes f_edges", lambda n, e: n.select("id").join(e.select(F.col("target").alias("id")).distinct(), "id", "left_anti").orderBy("id").limit(100), "SELECT id FROM f_nodes WHERE id NOT IN (SELECT target FROM f_edges) ORDER BY id LIMIT 100")
add("snk12_cache_gate", "f_manifests", lambda m: m.where((F.col("version") >= 3) & (F.col("built_at") >= F.expr("TIMESTAMP'1998-08-01 00:00:00' - INTERVAL '30' DAY"))).select("id"), "SELECT id FROM f_manifests WHERE version >= 3 AND built_at >= TIMESTAMP '1998-07-02'")

RUNS = lambda g: g.where("kind = 'run'")
add("agg16_fingerprint", "f_graph", lambda g: g.sparkSession.createDataFrame([(graphs.fingerprint(g, ["id"], F.concat_ws("|", "id", F.col("is_open").cast("string"), F.col("difficulty").cast("string"))),)], "fingerprint string"), None)
add("arr01_chained", "f_graph", lambda g: graphs.chained(RUNS(g).select(F.col("trail_group").alias("grp"), "id", "source", "target")), None)
add("gra15_named_by_neighbours", "f_graph", lambda g: graphs.named_by_neighbours(g.withColumn("difficulty", F.col("difficulty").cast("string"))), None)
add("top02_diverse", "f_nodes", lambda n: meeting.diverse(n.select((F.col("id") % 10).alias("request"), "id", "lat", "lon", F.col("elevation").alias("score")).withColumn("k", F.row_number().over(Window.partitionBy("request").orderBy("score", "id"))).where("k <= 40").drop("k")), None)
add("fea04_route", "f_graph f_nodes", lambda g, n: RUNS(g).join(n.select(F.col("id").alias("source"), F.struct("lat", "lon").alias("a")), "source").join(n.select(F.col("id").alias("target"), F.struct("lat", "lon").alias("b")), "target").select("id", features.route(F.array("a", "b"), F.col("moguls")).alias("line")).select("id", F.col("line")[0]["lat"].alias("from_lat"), F.size("line").alias("points")), "SELECT g.id, round(CASE WHEN moguls THEN a.lat ELSE b.lat END, 6) AS from_lat, 2 AS points FROM f_graph g JOIN f_nodes a ON a.id = source JOIN f_nodes b ON b.id = target WHERE kind = 'run'")
add("fea06_user_location", "f_fixes", lambda x: x.select("event_id", F.get_json_object(features.feature(features.point(F.round("lat", 4), F.round("lon", 4)), "event_id"), "$.properties.event_id").cast("long").alias("of")), "SELECT event_id, event_id AS of FROM f_fixes")
add("fea12_amenities", "f_trails", lambda t: features.amenities(t.select((F.col("id") % 500).alias("id"), F.col("id").alias("ordinal"), F.create_map(F.lit("amenity"), F.when(F.col("p_size") % 3 == 0, "cafe").when(F.col("p_size") % 3 == 1, "toilets").otherwise("bench"), F.lit("name"), F.when(F.col("p_size") % 2 == 0, F.col("name"))).alias("tags"))), """
SELECT id, arg_min(kind, o) AS kind, arg_min(coalesce(n, upper(kind[1]) || kind[2:]), o) AS label FROM (SELECT id % 500 AS id, id AS o, CASE p_size % 3 WHEN 0 THEN 'food' WHEN 1 THEN 'toilets' ELSE 'other' END AS kind, CASE WHEN p_size % 2 = 0 THEN name END AS n FROM f_trails) GROUP BY id""")
