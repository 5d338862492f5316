"""People: requests, suggestions, snapshots, and the writes that follow from them. Times are parameters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .joins import by_email, by_phone, friend_ids
from .windows import latest

#: Tables that hold rows of an account, and the columns that name it.
OWNED = {"profiles": ("id",), "friendships": ("requester_id", "addressee_id"), "requests": ("sender_id", "receiver_id"), "runs": ("profile_id",), "blocks": ("blocker_id", "blockee_id")}


def pending_with(friendships: DataFrame) -> DataFrame:
    """(me, other, sent) of pending requests, both ways round."""
    rows = friendships.where("status = 'pending'")
    return rows.select(F.col("requester_id").alias("me"), F.col("addressee_id").alias("other"), F.lit(True).alias("sent")).union(rows.select("addressee_id", "requester_id", F.lit(False)))


def suggestions(profiles: DataFrame, emails: DataFrame, phones: DataFrame, friendships: DataFrame, dismissed: DataFrame, me: int) -> DataFrame:
    """Profiles met by e-mail or phone, one row each, less oneself, friends, those with a request pending either way and those dismissed."""
    met = by_email(profiles, emails).unionByName(by_phone(profiles, phones)).dropDuplicates(["id"]).where(F.col("id") != me)
    friends = friend_ids(friendships).where(F.col("me") == me).select(F.col("friend").alias("id"))
    asked = pending_with(friendships).where(F.col("me") == me).select(F.col("other").alias("id"))
    for known in (friends, asked, dismissed.select("id")):
        met = met.join(known, "id", "left_anti")
    return met


def relationships(profiles: DataFrame, friendships: DataFrame, blocks: DataFrame, me: int) -> DataFrame:
    """(id, status): blocked before friends before a request sent before one received before none."""
    blocked = blocks.where(F.col("blocker_id") == me).select(F.col("blockee_id").alias("id"), F.lit(0).alias("rank"))
    friends = friend_ids(friendships).where(F.col("me") == me).select(F.col("friend").alias("id"), F.lit(1).alias("rank"))
    asked = pending_with(friendships).where(F.col("me") == me).select(F.col("other").alias("id"), F.when(F.col("sent"), 2).otherwise(3).alias("rank"))
    first = blocked.union(friends).union(asked).groupBy("id").agg(F.min("rank").alias("rank"))
    names = F.array(*(F.lit(x) for x in ("blocked", "friends", "pendingSent", "pendingReceived", "none")))
    return profiles.select("id").where(F.col("id") != me).join(first, "id", "left").select("id", F.get(names, F.coalesce("rank", F.lit(4))).alias("status"))


def to_refresh(loads: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Those never loaded, or longer ago than so many hours."""
    return loads.where(F.col("last_loaded").isNull() | (F.col("last_loaded") < as_of - F.make_dt_interval(hours=F.lit(hours))))


def name_taken(profiles: DataFrame, name: str, me: int) -> DataFrame:
    """One row if someone else has a name like it; % and _ in it stand for anything."""
    return profiles.where(F.col("display_name").ilike(name.strip()) & (F.col("id") != me)).limit(1).select(F.lit(True).alias("taken"))


def mutual_requests(requests: DataFrame) -> DataFrame:
    """Pending requests with what becomes of them: crossing ones are accepted, of several to one person the newest stays."""
    rows = requests.where("status = 'pending'")
    newest = latest(rows, ["sender_id", "receiver_id"], -F.unix_micros(F.col("created_at").cast("timestamp")), -F.col("id")).select(F.col("id").alias("newest"))
    back = rows.select(F.col("sender_id").alias("receiver_id"), F.col("receiver_id").alias("sender_id"), F.lit(True).alias("crossing")).distinct()
    out = rows.join(newest, F.col("id") == F.col("newest"), "left").join(back, ["sender_id", "receiver_id"], "left")
    return out.select("id", "sender_id", "receiver_id", F.when(F.col("newest").isNull(), "cancelled").when(F.col("crossing"), "accepted").otherwise("pending").alias("status"))


def snapshot(friendships: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row for each profile: its friends and pending requests as JSON, empty lists where there are none."""
    f = friend_ids(friendships).join(profiles.select(F.col("id").alias("friend"), "display_name"), "friend")
    friends = f.groupBy(F.col("me").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("friend").alias("id"), F.col("display_name").alias("name")))).alias("friends"))
    known = friend_ids(friendships)
    asked = pending_with(friendships).join(known.withColumnRenamed("friend", "other"), ["me", "other"], "left_anti").distinct()
    pending = asked.groupBy(F.col("me").alias("id")).agg(F.array_sort(F.collect_set(F.when(F.col("sent"), F.col("other")))).alias("sent"), F.array_sort(F.collect_set(F.when(~F.col("sent"), F.col("other")))).alias("received"))
    out = profiles.select("id").join(friends, "id", "left").join(pending, "id", "left")
    none = F.array().cast("array<bigint>")
    people = F.coalesce("friends", F.array().cast("array<struct<id:bigint,name:string>>"))
    return out.select("id", F.to_json(F.struct(people.alias("friends"), F.coalesce("sent", none).alias("sent"), F.coalesce("received", none).alias("received"))).alias("snapshot"))


def readers(speeds: DataFrame, friendships: DataFrame) -> DataFrame:
    """(reader, profile_id): whose speeds each person may read, through a semi-join."""
    f = friend_ids(friendships).select(F.col("me").alias("reader"), F.col("friend").alias("profile_id"))
    return f.join(speeds.select("profile_id"), "profile_id", "left_semi")


def visible_rows(people: DataFrame, friendships: DataFrame, blocks: DataFrame, public: Column) -> DataFrame:
    """(viewer, seen): oneself, accepted friends of whom neither blocks the other, and rows that all may read."""
    from .joins import visible

    own = people.select(F.col("id").alias("viewer"), F.col("id").alias("seen"))
    friends = visible(friendships, blocks)
    return own.unionByName(friends).distinct().withColumn("why", F.when(F.col("viewer") == F.col("seen"), "self").otherwise("friend")).unionByName(people.where(public).select(F.lit(None).cast("long").alias("viewer"), F.col("id").alias("seen"), F.lit("public").alias("why")))


def without_account(table: DataFrame, account: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """A table less the rows that name one of account(id) in any of the columns."""
    for c in columns:
        table = table.join(account.select(F.col("id").alias(c)), c, "left_anti").select(table.columns)
    return table


def rebuilt(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """target with all rows of the keys in `new` replaced by those of `new`."""
    return target.join(new.select(key).distinct(), key, "left_anti").select(target.columns).unionByName(new)


def swept(rows: DataFrame, at: str, as_of: Column, minutes: int) -> tuple[DataFrame, DataFrame]:
    """What is left when rows older than so many minutes go, and a row that says how many went."""
    old = F.col(at) < as_of - F.make_dt_interval(mins=F.lit(minutes))
    return rows.where(~old), rows.agg(F.count_if(old).alias("deleted"))


def applied_manifest(current: DataFrame, body: DataFrame) -> DataFrame:
    """Rows of JSON manifests body(resort_id, trails), an array of objects, under the version after the current one."""
    top = current.groupBy("resort_id").agg(F.max("version").alias("v"))
    rows = body.join(top, "resort_id", "left").withColumn("version", F.coalesce("v", F.lit(0)) + 1)
    return rows.select("resort_id", "version", F.inline(F.from_json("trails", "array<struct<name:string,difficulty:string,length_m:double>>")))


def notifications(old: DataFrame, new: DataFrame) -> DataFrame:
    """Messages that status changes give rise to, as rows: nothing is sent from here."""
    both = new.join(old.select("id", F.col("status").alias("was")), "id", "left")
    kind = F.when(F.col("was").isNull() & (F.col("status") == "pending"), "meet_request").when((F.col("was") == "pending") & (F.col("status") == "accepted"), "meet_accepted")
    to = F.when(F.col("was").isNull(), F.col("receiver_id")).otherwise(F.col("sender_id"))
    return both.select("id", kind.alias("kind"), to.alias("to")).where("kind IS NOT NULL")


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The change feed between two versions of a table: (op, key) with whole rows as JSON before and after."""
    row = lambda df: F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    a, b = old.select(key, row(old).alias("before")), new.select(key, row(new).alias("after"))
    out = a.join(b, key, "full").where("before IS NULL OR after IS NULL OR before != after")
    return out.select(F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update").alias("op"), key, "before", "after")


def exported(profiles: DataFrame, runs: DataFrame) -> DataFrame:
    """One JSON document for each profile: version 3, its runs by time, dates in ISO-8601, numbers that are not finite as text.

    A profile and its runs meet in one task by a sort that may spill; their texts are put behind one
    another as they come, so that a document is all that is held of it.
    """
    number = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.to_json(F.array(c.cast("string")))).otherwise(c.cast("string"))
    at = F.date_format("run_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = dict(profiles.dtypes)["id"]
    head = F.to_json(F.struct(F.lit(3).alias("version"), F.struct("id", "display_name").alias("profile")))
    heads = profiles.select("id", F.lit(0).alias("o"), F.lit(None).cast("string").alias("run_at"), F.lit(None).cast("string").alias("dedup_hash"), F.lit(None).cast("string").alias("speed_ms"), F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"runs":[')).alias("text"))
    listed = runs.where("profile_id IS NOT NULL").select(F.col("profile_id").cast(kind).alias("id"), F.lit(1).alias("o"), at.alias("run_at"), "dedup_hash", number(F.col("speed_ms")).alias("speed_ms"))
    listed = listed.withColumn("text", F.concat(F.to_json(F.struct("run_at", "dedup_hash", "speed_ms")), F.lit(",")))
    parts = int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = heads.unionByName(listed).repartition(parts, "id").sortWithinPartitions("id", "o", "run_at", "dedup_hash", "speed_ms").select("id", "o", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents(key: pa.Scalar, heads: list[str], body: bytearray) -> Iterator[pa.RecordBatch]:
            """The body begins with the first head; further ones are of profiles of the same id."""
            if body.endswith(b","):
                del body[-1:]
            body += b"]}"
            texts = [body, *(head.encode() + body[len(heads[0].encode()) :] for head in heads[1:])] if heads else []
            for text in texts:
                ends = pa.array([0, len(text)], pa.int32()).buffers()[1]
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], key.type), pa.StringArray.from_buffers(1, ends, pa.py_buffer(text))], names=["id", "document"])

        key, heads, body = None, [], bytearray()
        for batch in batches:
            text = batch.column(2).cast(pa.string())
            order = batch.column(1).to_numpy()
            coded = pc.run_end_encode(batch.column(0))
            start = 0
            for end, now in zip(coded.run_ends.to_pylist(), coded.values, strict=True):
                if key is None or not now.equals(key):
                    if key is not None:
                        yield from documents(key, heads, body)
                    key, heads, body = now, [], bytearray()
                first = end - int(order[start:end].sum())
                for head in text.slice(start, first - start).to_pylist():
                    heads.append(head)
                    if len(heads) == 1:
                        body += head.encode()
                if heads and first < end:
                    _, ends, data = text.buffers()
                    at = memoryview(ends).cast("i")
                    body += memoryview(data)[at[text.offset + first] : at[text.offset + end]]
                start = end
        if key is not None:
            yield from documents(key, heads, body)

    return dealt.mapInArrow(run, f"id {kind}, document string")


def picker(resorts: DataFrame, term: str, regions: list[str], active: Column) -> DataFrame:
    """Resorts that match by name or region, in groups: active ones first, regions in the given order, names sorted."""
    low = F.lit(term.lower())
    rows = resorts.where(F.contains(F.lower("name"), low) | F.contains(F.lower("region"), low))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, regions)), F.col("region")), F.lit(0)), F.lit(len(regions) + 1))
    return rows.groupBy(active.alias("active"), "region", rank.alias("rank")).agg(F.array_sort(F.collect_list("name")).alias("names")).orderBy(F.desc("active"), "rank", "region")


def brands(skis: DataFrame, term: str) -> DataFrame:
    """Skis whose brand or model holds the term, by brand in the order in which brands first come."""
    low = F.lit(term.lower())
    rows = skis.where(F.contains(F.lower("brand"), low) | F.contains(F.lower("model"), low))
    return rows.groupBy("brand").agg(F.min("ordinal").alias("first"), F.array_sort(F.collect_list("model")).alias("models")).orderBy("first")


def phones_known(contacts: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, stored): contacts(id, raw, region) met with stored(phone) through every form a number may have."""
    forms = contacts.select("id", F.explode(text.phone_candidates(F.col("raw"), F.col("region"))).alias("form"))
    return forms.join(stored.select(text.digits(F.col("phone")).alias("form"), F.col("phone").alias("stored")).distinct(), "form").select("id", "stored").distinct()


def accepted_packets(packets: DataFrame, friendships: DataFrame, me: int, since: Column) -> DataFrame:
    """Positions that are shown to one person: of friends, not of oneself, recent and with a place."""
    friends = friend_ids(friendships).where(F.col("me") == me).select(F.col("friend").alias("user_id"))
    return packets.where((F.col("user_id") != me) & (F.col("ts") >= since) & F.col("lat").isNotNull()).join(friends, "user_id", "left_semi")


def lifecycle(requests: DataFrame, as_of: Column) -> DataFrame:
    """(id, status) of all requests once the expired have expired and crossing ones have met."""
    from .filters import expired

    now = expired(requests, as_of)
    met = mutual_requests(now).select("id", F.col("status").alias("new"))
    return now.join(met, "id", "left").select("id", F.coalesce("new", "status").alias("status"))
