"""Roll-ups over runs, edges and requests. One shuffle on the grouping key each, partial sums before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days after which an observation counts e times less; the half-life is 60 days.
DECAY_DAYS = 60 / 0.6931471805599453


def profile_stats(runs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Totals per profile; one without runs gets zeros."""
    best = F.coalesce("peak_speed_ms", "speed_ms")
    own = runs.groupBy("profile_id").agg(
        F.countDistinct(F.to_date("run_at")).alias("days_skied"), F.count("*").alias("runs_count"), F.sum("vertical_m").alias("vertical_m"), F.max(best).alias("top_speed_ms"),
        F.sum("duration_s").alias("total_duration_s"), F.sum("distance_m").alias("total_distance_m"), F.max("max_grade_deg").alias("top_grade_deg"), F.avg(F.nullif("speed_ms", F.lit(0))).alias("avg_speed_ms"), F.max("run_at").alias("last_import_at"),
    )
    out = profiles.select(F.col("id").alias("profile_id")).join(own, "profile_id", "left")
    sums = [c for c in own.columns if c not in ("profile_id", "last_import_at")]
    return out.select("profile_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in sums), "last_import_at")


def edge_means(runs: DataFrame) -> DataFrame:
    """Plain means per profile and edge."""
    return runs.where("edge_id IS NOT NULL").groupBy("profile_id", "edge_id").agg(F.count("*").alias("observation_count"), F.avg("speed_ms").alias("mean_speed_ms"), F.max("peak_speed_ms").alias("peak_ms"), F.avg("duration_s").alias("mean_duration_s"))


def edge_speeds(runs: DataFrame, as_of: Column) -> DataFrame:
    """Decay-weighted speed and variance per profile, resort, edge and conditions, as of a given time."""
    age = (F.unix_micros(as_of) - F.unix_micros(F.col("run_at").cast("timestamp"))) / 86_400_000_000
    rows = runs.where("edge_id IS NOT NULL").select(
        "profile_id", F.coalesce("resort_id", F.lit("unknown")).alias("resort_id"), "edge_id", F.coalesce("conditions_fp", F.lit("default")).alias("conditions_fp"), "speed_ms", "peak_speed_ms", "duration_s", "run_at",
        F.exp(-F.greatest(F.lit(0.0), age) / DECAY_DAYS).alias("w"),
    )
    mean = lambda c: F.sum(F.col(c) * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))
    square = F.sum(F.col("speed_ms") * F.col("speed_ms") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))
    return rows.groupBy("profile_id", "resort_id", "edge_id", "conditions_fp").agg(
        F.count("*").alias("observation_count"), mean("speed_ms").alias("rolling_speed_ms"), F.max("peak_speed_ms").alias("rolling_peak_ms"), mean("duration_s").alias("rolling_duration_s"),
        F.greatest(F.lit(0.0), square - mean("speed_ms") * mean("speed_ms")).alias("rolling_speed_variance_ms2"), F.max("run_at").alias("last_observed_at"),
    )


def median_speeds(runs: DataFrame) -> DataFrame:
    """The median speed of each profile and difficulty, with the mean of the middle two."""
    return runs.where("difficulty IS NOT NULL").groupBy("profile_id", "difficulty").agg(F.median("speed_ms").alias("median_speed_ms"), F.count("*").alias("n"))


def cohort_ratio(runs: DataFrame, inside: Column, least: int = 3) -> DataFrame:
    """Median speed inside a cohort over that outside, clamped to 0.1-2; null where a side is small."""
    out = runs.groupBy("profile_id").agg(F.median(F.when(inside, F.col("speed_ms"))).alias("a"), F.median(F.when(~inside, F.col("speed_ms"))).alias("b"), F.count_if(inside).alias("n"), F.count_if(~inside).alias("m"))
    ratio = F.least(F.greatest(F.col("a") / F.nullif("b", F.lit(0.0)), F.lit(0.1)), F.lit(2.0))
    return out.select("profile_id", F.when((F.col("n") >= least) & (F.col("m") >= least), ratio).alias("ratio"))


def days(runs: DataFrame) -> DataFrame:
    """Per profile and day: runs, vertical, and the most frequent resort with how many others."""
    per = runs.groupBy("profile_id", F.to_date("run_at").alias("day"), "resort_id").agg(F.count("*").alias("n"), F.sum("vertical_m").alias("v"))
    modal = F.min_by("resort_id", F.struct(-F.col("n"), "resort_id"))
    return per.groupBy("profile_id", "day").agg(F.sum("n").alias("runs"), F.sum("v").alias("vertical_m"), modal.alias("resort_id"), (F.count("*") - 1).alias("others"))


def resort_stats(edges: DataFrame) -> DataFrame:
    """Distinct groups, names and edges by kind."""
    return edges.groupBy("kind").agg(F.countDistinct(F.coalesce("trail_group", "id")).alias("groups"), F.countDistinct("name").alias("names"), F.count("*").alias("edges"))


def trail_groups(edges: DataFrame) -> DataFrame:
    """Length, vertical, steepest part, overall slope and flags of each group of runs."""
    total = F.degrees(F.atan2(F.sum("vertical_m"), F.sum("length_m")))
    return edges.where("kind = 'run'").groupBy("trail_group").agg(F.sum("length_m").alias("length_m"), F.sum("vertical_m").alias("vertical_m"), F.max("gradient").alias("max_gradient"), total.alias("slope_deg"), F.bool_or("is_groomed").alias("any_groomed"), F.bool_or("is_open").alias("any_open"))


def tallies(requests: DataFrame) -> DataFrame:
    """How many requests have each outcome, in one row."""
    return requests.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "pending", "declined")), F.count("*").alias("every"))


def degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree of each node over open edges, nodes without one direction included."""
    ends = edges.where("is_open").select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def quantiles(runs: DataFrame) -> DataFrame:
    """Exact quantiles with linear interpolation."""
    return runs.groupBy("resort_id").agg(*(F.percentile("speed_ms", F.lit(q)).alias(f"p{int(100 * q)}") for q in (0.1, 0.5, 0.9)))


def content_hash(edges: DataFrame) -> DataFrame:
    """SHA-256 of each group's rows in id order, to tell whether anything changed."""
    row = F.struct("id", F.concat_ws("|", "id", "source", "target", "kind", "name").alias("r"))
    return edges.groupBy("trail_group").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x.r), "\n"), 256).alias("content_sha256"))


def nested(edges: DataFrame) -> DataFrame:
    """The edges of each source node as one sorted list."""
    return edges.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("edge_ids"), F.count("*").alias("n"))


def by_sets(runs: DataFrame) -> DataFrame:
    """Runs by resort and difficulty with subtotals."""
    return runs.rollup("resort_id", "difficulty").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))
