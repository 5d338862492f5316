"""Live positions: latest-wins state and windowed counts over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "at double, lat double, lon double"
ACCEPTED = "user_id long, at double, lat double, lon double"


def latest_positions(packets: DataFrame, ttl_ms: int = 90_000) -> DataFrame:
    """Accepted packets of a stream packets(user_id, at, lat, lon): one not later than what is held is dropped.

    State is one row for each user and goes after `ttl_ms` of processing time without a packet.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else (float("-inf"), 0.0, 0.0)
        out = []
        for frame in frames:
            for at, lat, lon in frame.sort_values("at", kind="stable")[["at", "lat", "lon"]].itertuples(index=False):
                if at > held[0]:
                    held = (float(at), float(lat), float(lon))
                    out.append((key[0], *held))
        if out:
            state.update(held)
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["user_id", "at", "lat", "lon"])

    return packets.groupBy("user_id").applyInPandasWithState(run, ACCEPTED, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def cell_counts(fixes: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Fixes and users by window and kind, with late data bounded by a watermark. For streams and batches."""
    return fixes.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))


def versions(spark, table_path: str) -> list[int]:
    """The versions of a table that were written to their end, in order: each is a folder that its writer has marked."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(path)]
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{table_path}/{n}/_SUCCESS"))
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and done(n))


def keep_latest(table_path: str, keys: list[str], order: str):
    """A foreachBatch sink that keeps the latest row of each key: one version of the table for each batch.

    A version is named by its batch and made from the last finished one before it. A batch that comes
    again, also after a crash, overwrites its own version; one that was not finished is not read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest = lambda df: df.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        before = [v for v in versions(spark, table_path) if v < batch_id]
        new = latest(batch)
        if before:
            new = latest(new.unionByName(spark.read.parquet(f"{table_path}/version={before[-1]}").select(*batch.columns)))
        new.write.mode("overwrite").parquet(f"{table_path}/version={batch_id}")

    return write
