"""Queries over people, requests and the writes that follow from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import social
from .registry import FRIENDS, add, as_of

PENDING = "pe AS (SELECT requester_id AS me, addressee_id AS other, true AS sent FROM f_friendships WHERE status = 'pending' UNION ALL SELECT addressee_id, requester_id, false FROM f_friendships WHERE status = 'pending')"
add("soc01_suggestions", "f_profiles f_friendships f_blocks", lambda p, f, b: social.suggestions(p, f.select(F.concat(F.lit("customer#"), F.lpad(F.col("addressee_id").cast("string"), 9, "0"), F.lit("@mail.EXAMPLE")).alias("email")), f.select(F.concat(F.lit("1.604-"), (1_000_000 + F.col("requester_id")).cast("string")).alias("phone")), f, b.select(F.col("blockee_id").alias("id")), 7).select("id"), f"""
SELECT * FROM (WITH {FRIENDS}, {PENDING} SELECT id FROM f_profiles WHERE (id IN (SELECT addressee_id FROM f_friendships) OR id IN (SELECT requester_id FROM f_friendships)) AND id <> 7
 AND id NOT IN (SELECT friend FROM fr WHERE me = 7) AND id NOT IN (SELECT other FROM pe WHERE me = 7) AND id NOT IN (SELECT blockee_id FROM f_blocks))""")
add("soc02_relationships", "f_profiles f_friendships f_blocks", lambda p, f, b: social.relationships(p, f, b, 7), f"""
SELECT * FROM (WITH {FRIENDS}, {PENDING} SELECT id, CASE WHEN id IN (SELECT blockee_id FROM f_blocks WHERE blocker_id = 7) THEN 'blocked' WHEN id IN (SELECT friend FROM fr WHERE me = 7) THEN 'friends'
 WHEN id IN (SELECT other FROM pe WHERE me = 7 AND sent) THEN 'pendingSent' WHEN id IN (SELECT other FROM pe WHERE me = 7) THEN 'pendingReceived' ELSE 'none' END AS status FROM f_profiles WHERE id <> 7)""")
add("soc03_pruned", "f_friendships", lambda f: social.pending_with(f).join(social.friend_ids(f).withColumnRenamed("friend", "other"), ["me", "other"], "left_anti").select("me", "other", "sent"), f"SELECT * FROM (WITH {FRIENDS}, {PENDING} SELECT me, other, sent FROM pe WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.me = pe.me AND friend = other))")
add("soc04_to_refresh", "f_fixes", lambda x: social.to_refresh(x.select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("ts")).alias("last_loaded")), F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id"), "SELECT event_id FROM f_fixes WHERE event_id % 3 = 0 OR ts < TIMESTAMP '2024-01-14 00:00:00'")
add("soc05_name_taken", "f_profiles", lambda p: social.name_taken(p, "  customer#00000000_ ", 3), "SELECT true AS taken FROM f_profiles WHERE display_name ILIKE 'customer#00000000_' AND id <> 3 LIMIT 1")
add("soc06_mutual_requests", "f_requests", lambda q: social.mutual_requests(q), """
SELECT id, sender_id, receiver_id, CASE WHEN k > 1 THEN 'cancelled' WHEN EXISTS (SELECT 1 FROM f_requests b WHERE b.status = 'pending' AND b.sender_id = a.receiver_id AND b.receiver_id = a.sender_id) THEN 'accepted' ELSE 'pending' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY sender_id, receiver_id ORDER BY created_at DESC, id DESC) AS k FROM f_requests WHERE status = 'pending') a""")
add("agg08_snapshot", "f_friendships f_profiles", social.snapshot, f"""
SELECT * FROM (WITH {FRIENDS}, {PENDING}, pp AS (SELECT DISTINCT * FROM pe WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.me = pe.me AND friend = other)),
 a AS (SELECT me, string_agg('{{"id":' || friend || ',"name":"' || display_name || '"}}', ',' ORDER BY friend) AS x FROM fr JOIN f_profiles ON id = friend GROUP BY me),
 b AS (SELECT me, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) FILTER (sent) AS s, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) FILTER (NOT sent) AS r FROM pp GROUP BY me)
SELECT p.id, '{{"friends":[' || coalesce(x, '') || '],"sent":[' || coalesce(s, '') || '],"received":[' || coalesce(r, '') || ']}}' AS snapshot FROM f_profiles p LEFT JOIN a ON a.me = p.id LEFT JOIN b ON b.me = p.id)""")
add("jn05_readers", "f_runs f_friendships", social.readers, f"SELECT * FROM (WITH {FRIENDS} SELECT me AS reader, friend AS profile_id FROM fr WHERE EXISTS (SELECT 1 FROM f_runs WHERE profile_id = friend))")
add("flt06_visible_rows", "f_profiles f_friendships f_blocks", lambda p, f, b: social.visible_rows(p, f, b, F.col("current_resort_id") == "r3"), f"""
SELECT * FROM (WITH {FRIENDS} SELECT id AS viewer, id AS seen, 'self' AS why FROM f_profiles UNION ALL SELECT me, friend, 'friend' FROM fr WHERE me <> friend AND NOT EXISTS (SELECT 1 FROM f_blocks WHERE (blocker_id = me AND blockee_id = friend) OR (blocker_id = friend AND blockee_id = me))
 UNION ALL SELECT NULL, id, 'public' FROM f_profiles WHERE current_resort_id = 'r3')""")
add("snk01_append", "f_runs", lambda r: r.select("run_id").unionByName(r.select((F.col("run_id") + 1).alias("run_id"))).groupBy("run_id").agg(F.count("*").alias("n")), "SELECT run_id, count(*) AS n FROM (SELECT run_id FROM f_runs UNION ALL SELECT run_id + 1 FROM f_runs) GROUP BY run_id")
add("snk04_rebuilt", "f_runs", lambda r: social.rebuilt(r.groupBy("profile_id", "resort_id").agg(F.count("*").alias("n")), r.where("resort_id = 'r1'").groupBy("profile_id").agg(F.count("*").alias("n")).where("profile_id < 10").select("profile_id", F.lit("new").alias("resort_id"), "n"), "profile_id"), "SELECT profile_id, resort_id, count(*) AS n FROM f_runs WHERE profile_id >= 10 OR profile_id NOT IN (SELECT profile_id FROM f_runs WHERE resort_id = 'r1') GROUP BY ALL UNION ALL SELECT profile_id, 'new', count(*) FROM f_runs WHERE profile_id < 10 AND resort_id = 'r1' GROUP BY profile_id")
add("snk05_restored", "f_runs", lambda r: social.rebuilt(r.select("profile_id", "dedup_hash", "distance_m"), r.where("profile_id = 3").select("profile_id", "dedup_hash", F.lit(1.0).alias("distance_m")).distinct(), "profile_id").groupBy("profile_id").agg(F.count("*").alias("runs"), F.sum("distance_m").alias("distance_m")), "SELECT profile_id, CASE WHEN profile_id = 3 THEN count(DISTINCT dedup_hash) ELSE count(*) END AS runs, CASE WHEN profile_id = 3 THEN round(CAST(count(DISTINCT dedup_hash) AS DOUBLE), 6) ELSE round(sum(distance_m), 6) END AS distance_m FROM f_runs GROUP BY profile_id")
add("snk06_account_deleted", "f_friendships f_requests f_profiles", lambda f, q, p: social.without_account(f, p.where("id = 7"), social.OWNED["friendships"]).select("id", F.lit("friendship").alias("kind")).unionByName(social.without_account(q, p.where("id = 7"), social.OWNED["requests"]).select("id", F.lit("request").alias("kind"))), "SELECT id, 'friendship' AS kind FROM f_friendships WHERE requester_id <> 7 AND addressee_id <> 7 UNION ALL SELECT id, 'request' FROM f_requests WHERE sender_id <> 7 AND receiver_id <> 7")
add("snk07_swept", "f_fixes", lambda x: social.swept(x, "ts", F.lit("2024-01-15 00:00:00").cast("timestamp"), 15)[1], "SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-14 23:45:00') AS deleted FROM f_fixes")
add("snk13_notifications", "f_requests", lambda q: social.notifications(q.withColumn("status", F.lit("pending")).where("sender_id > 50"), q), "SELECT id, CASE WHEN sender_id > 50 THEN 'meet_accepted' ELSE 'meet_request' END AS kind, CASE WHEN sender_id > 50 THEN sender_id ELSE receiver_id END AS to FROM f_requests WHERE (sender_id > 50 AND status = 'accepted') OR (sender_id <= 50 AND status = 'pending')")
add("snk14_applied_manifest", "f_trails f_resorts", lambda t, r: social.applied_manifest(r.select(F.col("id").alias("resort_id"), F.length("id").alias("version")), t.groupBy(F.concat(F.lit("r"), (F.col("id") % 40).cast("string")).alias("resort_id")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("name", "difficulty", F.col("p_size").cast("double").alias("length_m"))))).alias("trails"))), "SELECT 'r' || (id % 40) AS resort_id, CAST(CASE WHEN id % 40 < 25 THEN length('r' || (id % 40)) + 1 ELSE 1 END AS INTEGER) AS version, name, difficulty, round(CAST(p_size AS DOUBLE), 6) AS length_m FROM f_trails")
add("stm12_changes", "f_requests", lambda q: social.changes(q.where("id % 3 > 0").select("id", "status"), q.where("id % 5 > 0 OR id % 3 = 0").select("id", F.when(F.col("status") == "pending", "expired").otherwise(F.col("status")).alias("status")), "id").select("op", "id", "after"), """
SELECT CASE WHEN id % 3 = 0 THEN 'insert' WHEN id % 5 = 0 THEN 'delete' ELSE 'update' END AS op, id, CASE WHEN id % 5 > 0 OR id % 3 = 0 THEN '{"id":' || id || ',"status":"' || CASE status WHEN 'pending' THEN 'expired' ELSE status END || '"}' END AS after FROM f_requests
WHERE id % 3 = 0 OR id % 5 = 0 OR (id % 3 > 0 AND id % 5 > 0 AND status = 'pending')""")
add("exp01_backup", "f_profiles f_runs", social.exported, """
SELECT p.id, '{"version":3,"profile":{"id":' || p.id || ',"display_name":"' || display_name || '"},"runs":[' || coalesce(x, '') || ']}' AS document FROM f_profiles p LEFT JOIN (
 SELECT profile_id, string_agg('{"run_at":"' || t || '","dedup_hash":"' || dedup_hash || '","speed_ms":"' || s || '"}', ',' ORDER BY t, dedup_hash, s) AS x FROM (SELECT profile_id, strftime(run_at, '%Y-%m-%dT%H:%M:%SZ') AS t, dedup_hash, CAST(CAST(speed_ms AS DOUBLE) AS VARCHAR) AS s FROM f_runs) GROUP BY profile_id) r ON r.profile_id = p.id""")
add("grp01_resort_picker", "f_resorts", lambda r: social.picker(r.select("name", F.substring("name", 1, 1).alias("region"), (F.length("id") < 3).alias("on")), "a", ["U", "A"], F.col("on")).select("active", "region", F.array_join("names", ",").alias("names")), "SELECT length(id) < 3 AS active, name[1] AS region, string_agg(name, ',' ORDER BY name) AS names FROM f_resorts WHERE contains(lower(name), 'a') OR contains(lower(name[1]), 'a') GROUP BY ALL")
add("grp02_ski_picker", "f_trails", lambda t: social.brands(t.select(F.col("difficulty").alias("brand"), F.col("name").alias("model"), F.col("id").alias("ordinal")), "gl").select("brand", "first", F.size("models").alias("n")), "SELECT difficulty AS brand, min(id) AS first, CAST(count(*) AS INTEGER) AS n FROM f_trails WHERE contains(lower(difficulty), 'gl') OR contains(lower(name), 'gl') GROUP BY difficulty")
add("tal01_import_tallies", "f_requests", lambda q: q.groupBy("receiver_id").agg(F.count_if(F.col("status") == "accepted").alias("runs"), F.count_if(F.col("status") == "pending").alias("duplicates"), F.count_if(F.col("status") == "declined").alias("failures")), "SELECT receiver_id, count(*) FILTER (status = 'accepted') AS runs, count(*) FILTER (status = 'pending') AS duplicates, count(*) FILTER (status = 'declined') AS failures FROM f_requests GROUP BY receiver_id")
add("str07_phones_known", "f_contacts f_profiles", lambda c, p: social.phones_known(c, p.select(F.concat(F.lit("+1 604 555 "), F.lpad(F.col("id").cast("string"), 4, "0")).alias("phone"))), "SELECT id, '+1 604 555 ' || lpad(CAST(id AS VARCHAR), 4, '0') AS stored FROM f_contacts WHERE id % 5 = 0 OR (id % 5 = 2 AND region = 'US') OR id % 5 = 3")
add("flt10_packets", "f_fixes f_friendships", lambda x, f: social.accepted_packets(x, f, 7, F.lit("2024-01-10 00:00:00").cast("timestamp")).select("event_id"), f"SELECT * FROM (WITH {FRIENDS} SELECT event_id FROM f_fixes WHERE user_id <> 7 AND user_id IN (SELECT friend FROM fr WHERE me = 7) AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND lat IS NOT NULL)")
add("stm14_lifecycle", "f_requests", lambda q: social.lifecycle(q, as_of()).groupBy("status").agg(F.count("*").alias("n")), f"""
SELECT status, count(*) AS n FROM (SELECT CASE WHEN a.status <> 'pending' THEN a.status WHEN a.expires_at <= TIMESTAMP '2001-12-31' THEN 'expired' WHEN k > 1 THEN 'cancelled' WHEN EXISTS (SELECT 1 FROM f_requests b WHERE b.status = 'pending' AND (b.expires_at IS NULL OR b.expires_at > TIMESTAMP '2001-12-31') AND b.sender_id = a.receiver_id AND b.receiver_id = a.sender_id) THEN 'accepted' ELSE 'pending' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY sender_id, receiver_id, status = 'pending' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2001-12-31') ORDER BY created_at DESC, id DESC) AS k FROM f_requests) a) GROUP BY status""")
