"""Deterministic projections of the driver's tables into the shapes the operators work on.

Each is one SELECT that Spark and DuckDB both run. `view` gives it as a DataFrame; `ctes` gives the
same text as common table expressions for a DuckDB query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "f_runs": """SELECT l.l_orderkey * 10 + l.l_linenumber AS run_id, o.o_custkey % 20 AS profile_id,
 concat('r', CAST(l.l_suppkey % 3 AS VARCHAR(20))) AS resort_id,
 CASE WHEN l.l_linenumber % 7 = 0 THEN NULL ELSE concat('e', CAST(l.l_partkey % 25 AS VARCHAR(20))) END AS edge_id,
 CASE WHEN l.l_returnflag = 'N' THEN NULL ELSE l.l_returnflag END AS conditions_fp,
 CASE l.l_partkey % 4 WHEN 0 THEN 'green' WHEN 1 THEN 'blue' WHEN 2 THEN 'black' ELSE NULL END AS difficulty,
 l.l_quantity / 4.0 AS speed_ms, CASE WHEN l.l_linenumber % 3 = 0 THEN NULL ELSE l.l_quantity / 3.0 END AS peak_speed_ms,
 l.l_extendedprice / 100.0 AS duration_s, l.l_tax * 1000.0 AS vertical_m, l.l_extendedprice / 10.0 AS distance_m,
 l.l_discount * 100.0 AS max_grade_deg, l.l_shipdate AS run_at, concat('h', CAST(l.l_orderkey % 500 AS VARCHAR(20)), '_', CAST(l.l_linenumber AS VARCHAR(20))) AS dedup_hash
 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "f_profiles": """SELECT c_custkey AS id, c_name AS display_name, c_custkey % 4 AS skill, concat('r', CAST(c_nationkey AS VARCHAR(20))) AS current_resort_id,
 concat(c_name, '@Mail.example') AS email, concat('+1 (604) ', CAST(1000000 + c_custkey AS VARCHAR(20))) AS phone FROM customer""",
    "f_friendships": """SELECT o_orderkey AS id, o_custkey AS requester_id, o_orderkey % 500 + 1 AS addressee_id,
 CASE WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'pending' END AS status, o_orderdate AS created_at FROM orders WHERE o_custkey <> o_orderkey % 500 + 1""",
    "f_requests": """SELECT o_orderkey AS id, o_custkey AS sender_id, o_orderkey % 300 + 1 AS receiver_id,
 CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'pending' ELSE 'declined' END AS status,
 o_orderdate AS created_at, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate + INTERVAL '10' MINUTE END AS expires_at FROM orders""",
    "f_blocks": "SELECT DISTINCT o_custkey AS blocker_id, o_orderkey % 500 + 1 AS blockee_id FROM orders WHERE o_orderkey % 97 = 0 AND o_custkey <> o_orderkey % 500 + 1",
    "f_fixes": """SELECT user_id, event_id, ts, CAST(39.60 + (event_id % 200) * 0.0005 AS DOUBLE) AS lat, CAST(-106.36 + (event_id % 150) * 0.0005 AS DOUBLE) AS lon,
 CAST(CASE WHEN event_id % 5 = 0 THEN NULL ELSE 2500 + (event_id * 7) % 400 END AS DOUBLE) AS elevation, CAST((event_id % 17) * 1.25 AS DOUBLE) AS speed FROM events""",
    "f_resorts": """SELECT concat('r', CAST(n_nationkey AS VARCHAR(20))) AS id, n_name AS name, CAST(39.60 + (n_nationkey % 5) * 0.01 AS DOUBLE) AS min_lat, CAST(39.64 + (n_nationkey % 5) * 0.015 AS DOUBLE) AS max_lat,
 CAST(-106.36 + (n_nationkey % 4) * 0.01 AS DOUBLE) AS min_lon, CAST(-106.33 + (n_nationkey % 4) * 0.02 AS DOUBLE) AS max_lon FROM nation""",
    "f_nodes": "SELECT p_partkey AS id, CAST(39.60 + (p_partkey % 40) * 0.001 AS DOUBLE) AS lat, CAST(-106.36 + (p_partkey % 37) * 0.001 AS DOUBLE) AS lon, CAST(2000.0 + p_partkey % 900 AS DOUBLE) AS elevation FROM part",
    "f_edges": """SELECT concat(CASE WHEN p_size % 3 = 0 THEN 'l' ELSE 't' END, CAST(p_partkey AS VARCHAR(20)), CASE p_partkey % 4 WHEN 0 THEN '_s1' WHEN 1 THEN '_ix2' WHEN 2 THEN '_s2_ix1' ELSE '' END) AS id,
 p_partkey AS source, p_partkey % 300 + 1 AS target, CASE WHEN p_size % 3 = 0 THEN 'lift' ELSE 'run' END AS kind, p_name AS name, concat('g', CAST(p_partkey % 60 AS VARCHAR(20))) AS trail_group,
 p_retailprice AS length_m, CAST(p_size * 4.0 AS DOUBLE) AS vertical_m, CAST(p_size * 1.0 AS DOUBLE) AS gradient, p_size % 2 = 0 AS is_groomed, p_partkey % 9 <> 0 AS is_open, p_brand AS difficulty FROM part""",
    "f_hourly": """SELECT date_trunc('hour', ts) AS time, avg(value) AS temperature_c, CAST(count(*) * 1.0 AS DOUBLE) AS snowfall_cm, max(value) AS wind_kph FROM events GROUP BY date_trunc('hour', ts)""",
    "f_contacts": """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN concat(' +1 (604) 555-', lpad(CAST(c_custkey AS VARCHAR(20)), 4, '0')) WHEN 1 THEN concat('00420 777 ', lpad(CAST(c_custkey AS VARCHAR(20)), 6, '0'))
 WHEN 2 THEN concat('604-555-', lpad(CAST(c_custkey AS VARCHAR(20)), 4, '0')) WHEN 3 THEN concat('1604555', lpad(CAST(c_custkey AS VARCHAR(20)), 4, '0')) ELSE '12-34 56' END AS raw,
 CASE c_custkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'cz' WHEN 2 THEN 'GB' ELSE 'ZZ' END AS region FROM customer""",
    "f_stamps": """SELECT event_id, concat(CAST(CAST(ts AS DATE) AS VARCHAR(20)), CASE event_id % 6 WHEN 0 THEN 'T12:30:00Z' WHEN 1 THEN 'T12:30:00.250Z' WHEN 2 THEN 'T12:30:00+02:00' WHEN 3 THEN ' 12:30' WHEN 4 THEN 'T25:00:00Z' ELSE '' END) AS stamp FROM events""",
    "f_weather": """SELECT event_id AS id, ts, CAST(CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 41 - 20 END AS DOUBLE) AS temp_c, CAST(event_id % 95 AS DOUBLE) AS wind_kph, CAST(CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id % 61) / 2.0 END AS DOUBLE) AS snow_cm,
 CAST((event_id % 101) / 5.0 AS DOUBLE) AS vis_km, CAST(event_id % 101 AS INTEGER) AS cloud, event_id % 2 = 0 AS moguls, event_id % 3 = 0 AS ungroomed, event_id % 5 = 0 AS gladed FROM events""",
    "f_trails": "SELECT p_partkey AS id, concat(CASE p_partkey % 4 WHEN 0 THEN 'É' WHEN 1 THEN 'São-' WHEN 2 THEN 'black ' ELSE '' END, p_name, CASE WHEN p_partkey % 5 = 0 THEN ' Glades!' ELSE '' END) AS name, CASE p_partkey % 3 WHEN 0 THEN 'black' WHEN 1 THEN 'blue' ELSE 'green' END AS difficulty, p_size FROM part",
    "f_track": """SELECT user_id, event_id, k, 7.0 * k + 200.0 * floor(k / 40) AS at_s, CAST('2024-01-05 09:00:00' AS TIMESTAMP) + CAST(7 * k + 200 * CAST(floor(k / 40) AS INTEGER) AS INTEGER) * INTERVAL '1' SECOND AS ts,
 CAST(39.60 + 0.004 * sin(CAST(k AS DOUBLE) / 9) + user_id % 7 * 0.001 AS DOUBLE) AS lat, CAST(-106.36 + 0.0003 * (k % 25) AS DOUBLE) AS lon,
 CASE WHEN k % 9 = 0 THEN NULL ELSE CAST(2500.0 + 40 * sin(CAST(k AS DOUBLE) / 6) AS DOUBLE) END AS elevation, CAST((event_id % 17) * 1.25 AS DOUBLE) AS speed
 FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS k FROM events) numbered""",
    "f_graph": """SELECT concat('e', CAST(p_partkey AS VARCHAR(20))) AS id, CAST(p_partkey AS BIGINT) AS source, CAST(p_partkey % 300 + 1 AS BIGINT) AS target, CASE p_size % 4 WHEN 0 THEN 'lift' WHEN 1 THEN 'traverse' ELSE 'run' END AS kind, p_partkey % 29 <> 0 AS is_open,
 CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_name END AS name, CAST(CASE WHEN p_partkey % 53 = 0 THEN 3 ELSE p_partkey % 2 END AS INTEGER) AS difficulty, concat('g', CAST(p_partkey % 60 AS VARCHAR(20))) AS trail_group, CAST(p_retailprice AS DOUBLE) AS length_m, CAST(p_size * 4.0 AS DOUBLE) AS vertical_m, CAST(p_size * 1.0 AS DOUBLE) AS gradient,
 CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS groomed, p_partkey % 4 = 0 AS moguls, p_partkey % 5 = 0 AS gladed, CASE p_partkey % 4 WHEN 0 THEN 'gondola' WHEN 1 THEN 'chairLift' WHEN 2 THEN 'tBar' END AS lift_type, CAST(p_partkey % 8 AS INTEGER) AS capacity,
 CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(200 + p_size * 10 AS DOUBLE) END AS ride_s, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey % 70 AS DOUBLE) END AS wait_min, CAST(1800 + p_partkey % 900 AS DOUBLE) AS mid_m,
 CASE WHEN p_partkey % 7 = 0 THEN CAST(5.5 AS DOUBLE) END AS observed_ms, CAST(p_partkey % 6 AS INTEGER) AS observations, CAST(1.5 AS DOUBLE) AS observed_var FROM part""",
    "f_ways": """SELECT p_partkey AS id, p_name AS name, p_brand AS difficulty, CASE p_partkey % 4 WHEN 0 THEN 'gondola' WHEN 1 THEN 'chairLift' WHEN 2 THEN 'tBar' END AS lift_type, p_size % 3 = 0 AS is_lift,
 CAST(39.60 + (p_partkey % 40) * 0.001 AS DOUBLE) AS lat0, CAST(-106.36 + (p_partkey % 37) * 0.001 AS DOUBLE) AS lon0, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(2000 + p_partkey % 50 AS DOUBLE) END AS e0,
 CAST(39.601 + (p_partkey % 40) * 0.001 AS DOUBLE) AS lat1, CAST(-106.359 + (p_partkey % 37) * 0.001 AS DOUBLE) AS lon1, CAST(2000 + p_size AS DOUBLE) AS e1,
 CAST(39.602 + (p_partkey % 35) * 0.001 AS DOUBLE) AS lat2, CAST(-106.358 + (p_partkey % 31) * 0.001 AS DOUBLE) AS lon2, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(2000 + p_partkey % 25 AS DOUBLE) END AS e2 FROM part""",
    "f_manifests": """SELECT CONCAT('r', CAST(o_custkey % 25 AS VARCHAR(20))) AS resort_id, CAST(o_orderkey % 7 + 1 AS INTEGER) AS version, concat('h', CAST(o_orderkey % 13 AS VARCHAR(20))) AS content_hash, CASE WHEN o_orderkey % 5 = 0 THEN 'REJECT: wrong' WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'fine' END AS notes,
 o_orderdate AS built_at, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence, o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'openskimap' ELSE 'overpass' END AS source FROM orders""",
    "f_names": "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat('The ', p_name, ' Express.') WHEN 1 THEN upper(p_name) ELSE concat(p_name, ' High-Speed Quad') END AS name, p_name AS official FROM part",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = SQL[name]
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " "
