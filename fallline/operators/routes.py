"""Routes: one-to-all search with costs that hang on the time of arrival, paths, and where people meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .costs import Conditions, Skier, seconds, variance
from .filters import kept


def one_to_all(edges: DataFrame, starts: DataFrame, conditions: Conditions, skier: Skier, gates: bool = True) -> DataFrame:
    """(person, node, seconds, variance, via, previous): the earliest arrival at each node from starts(person, node).

    Each round every node's label is made anew from the labels of the nodes before it, of equal times
    the one by the smaller edge id, until none changes: there is no bound on the number of edges, and
    no label of an earlier round outlives what it was made from. A round is one join by node.
    """
    first = starts.select("person", F.col("node").cast("long").alias("node"), F.lit(0.0).alias("seconds"), F.lit(0.0).alias("variance"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("long").alias("previous")).distinct()
    labels = kept(first)
    while True:
        met = labels.select("person", F.col("node").alias("source"), F.col("seconds").alias("at"), F.col("variance").alias("var")).join(edges, "source")
        cost = seconds(conditions, skier, F.col("at"), gates)
        step = met.withColumn("cost", cost).where("cost IS NOT NULL")
        step = step.select("person", F.col("target").alias("node"), (F.col("at") + F.col("cost")).alias("seconds"), (F.col("var") + variance(F.col("cost"))).alias("variance"), F.col("id").alias("via"), F.col("source").alias("previous"))
        row = F.struct("seconds", F.coalesce("via", F.lit("")).alias("order"), "variance", "via", "previous")
        new = kept(step.unionByName(first).groupBy("person", "node").agg(F.min(row).alias("x")).select("person", "node", "x.seconds", "x.variance", "x.via", "x.previous"))
        same = new.join(labels.select("person", "node", F.col("seconds").alias("was"), F.col("via").alias("by")), ["person", "node"], "left").where("was IS NULL OR was != seconds OR NOT (by <=> via)")
        labels = new
        if same.isEmpty():
            return labels


def paths_to(labels: DataFrame, targets: DataFrame) -> DataFrame:
    """(person, target, step, edge) of the way to each target(person, node), step 0 being the last edge; one join a step."""
    now = targets.select("person", F.col("node").cast("long").alias("target"), F.col("node").cast("long").alias("node"))
    out, step = None, 0
    back = labels.select("person", "node", "via", "previous")
    while True:
        found = kept(now.join(back, ["person", "node"]).where("via IS NOT NULL").select("person", "target", F.lit(step).alias("step"), F.col("via").alias("edge"), F.col("previous").alias("node")))
        if out is not None and found.isEmpty():
            return out
        part = found.drop("node")
        out = part if out is None else out.unionByName(part)
        now, step = found.select("person", "target", "node"), step + 1


def met_by_all(labels: DataFrame, people: int) -> DataFrame:
    """(node, slow, fast, variance) of nodes that all reach."""
    per = labels.groupBy("node").agg(F.countDistinct("person").alias("n"), F.max("seconds").alias("slow"), F.min("seconds").alias("fast"), F.sum("variance").alias("variance"))
    return per.where(F.col("n") == people).drop("n")


def two_skier_scores(labels: DataFrame, nodes: DataFrame, edges: DataFrame, starts: DataFrame, wait: float = 0.6, risk: float = 0.5) -> DataFrame:
    """Nodes that both reach with their score: time, waiting and risk, less for hubs and lifts, more at the foot and the top.

    nodes(id, elevation, is_lift). Starting nodes are left out where others are there, and so are nodes
    at which one would wait more than five minutes.
    """
    both = met_by_all(labels, 2)
    others = both.join(starts.select(F.col("node").cast("long").alias("node")).distinct(), "node", "left_anti")
    out = edges.where("is_open").groupBy(F.col("source").alias("node")).agg(F.count("*").alias("out"))
    rows = both.join(others.select("node", F.lit(True).alias("other")), "node", "left").join(nodes.select(F.col("id").alias("node"), "elevation", "is_lift"), "node", "left").join(out, "node", "left")
    every = Window.partitionBy(F.lit(1))  # the nodes of one resort
    scale = F.least(F.lit(30.0), F.greatest(F.lit(5.0), 0.05 * (F.max("slow").over(every) - F.min("slow").over(every))))
    low, high = F.min("elevation").over(every), F.max("elevation").over(every)
    rows = rows.withColumn("k", scale).withColumn("norm", F.when(high - low > 100, (F.col("elevation") - low) / (high - low)))
    height = F.when(F.col("norm") < 0.15, 3.0).when(F.col("norm") > 0.85, 0.5).otherwise(0.0)
    score = F.col("slow") + wait * (F.col("slow") - F.col("fast")) + risk * F.sqrt("variance") + F.col("k") * (height - F.least(F.coalesce("out", F.lit(0)) / 6.0, F.lit(1.0)) - F.when(F.col("is_lift"), 0.5).otherwise(0.0))
    rows = rows.withColumn("score", score).withColumn("fine", F.coalesce("other", F.lit(False)))
    rows = rows.withColumn("some", F.max("fine").over(every)).where("fine OR NOT some")
    rows = rows.withColumn("close", F.col("slow") - F.col("fast") <= 300).withColumn("any", F.max("close").over(every)).where("close OR NOT any")
    return rows.select("node", "slow", "fast", "score")


def failure(labels: DataFrame, relaxed: DataFrame, people: int) -> DataFrame:
    """One row: whether all can meet, would but for what they may not ski, or cannot."""
    met = lambda x: met_by_all(x, people).agg(F.count("*").alias("n"))
    return met(labels).select(F.col("n").alias("a")).join(met(relaxed).select(F.col("n").alias("b"))).select(F.when(F.col("a") > 0, "ok").when(F.col("b") > 0, "too_hard").otherwise("no_way").alias("status"))


def reroute(old_s: Column, new_s: Column, since_s: Column) -> Column:
    """Whether another way is worth changing to: half a minute or a tenth sooner, and not twice within half a minute."""
    return (old_s - new_s >= F.greatest(F.lit(30.0), 0.1 * old_s)) & (since_s >= 30)


def rescaled(legs: DataFrame, total: Column) -> DataFrame:
    """legs(route, leg, seconds, length_m) with `share`: their times scaled to a total; by length where there are hardly any times, else evenly."""
    w = Window.partitionBy("route")
    s, m, n = F.sum("seconds").over(w), F.sum("length_m").over(w), F.count("*").over(w)
    part = F.when(s > 0.5, F.col("seconds") / s).when(m > 0, F.col("length_m") / m).otherwise(1.0 / n)
    return legs.withColumn("share", part * total)


def position_at(legs: DataFrame, at_s: Column) -> DataFrame:
    """(route, leg, fraction): on which leg a route is after so many seconds, and how far along."""
    w = Window.partitionBy("route").orderBy("leg")
    end = F.sum("seconds").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = legs.withColumn("end", end).withColumn("begin", F.col("end") - F.col("seconds"))
    here = rows.where((F.col("begin") <= at_s) & (at_s < F.col("end")) & (F.col("seconds") > 0))
    return here.select("route", "leg", ((at_s - F.col("begin")) / F.col("seconds")).alias("fraction"))


def ghosts(legs: DataFrame, elapsed_s: Column) -> DataFrame:
    """Evenly spaced positions along a route yet to come: one a minute, twenty at most."""
    n = F.least(F.greatest(F.ceil(elapsed_s / 60), F.lit(1)), F.lit(20)).cast("int")
    times = legs.select("route").distinct().select("route", n.alias("n")).select("route", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).withColumn("at", elapsed_s * F.col("i") / F.col("n"))
    w = Window.partitionBy("route").orderBy("leg")
    rows = legs.withColumn("end", F.sum("seconds").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("seconds"))
    return times.join(rows, "route").where("begin < at AND at <= end AND seconds > 0").select("route", "i", "leg", ((F.col("at") - F.col("begin")) / F.col("seconds")).alias("fraction"))


def maneuvers(steps: DataFrame) -> DataFrame:
    """Legs of steps(route, step, kind, name, length_m) with what comes next and the sign to show."""
    w = Window.partitionBy("route").orderBy("step")
    new = F.coalesce((F.col("kind") != F.lag("kind").over(w)) | ~F.col("name").eqNullSafe(F.lag("name").over(w)), F.lit(True))
    rows = steps.withColumn("new", new.cast("int")).withColumn("leg", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    legs = rows.groupBy("route", "leg").agg(F.min("kind").alias("kind"), F.min("name").alias("name"), F.sum("length_m").alias("length_m"))
    after = F.lead("kind").over(Window.partitionBy("route").orderBy("leg"))
    icon = F.when(after.isNull(), "arrive").when((F.col("kind") != "lift") & (after == "lift"), "board").when((F.col("kind") == "lift") & (after != "lift"), "unload").otherwise("continue")
    return legs.withColumn("next", after).withColumn("icon", icon)


def may_recalculate(since_s: Column, moved_m: Column, off_route_s: Column) -> Column:
    """Half a minute since the last time and fifty metres on, or a button once off the route for eight seconds."""
    return F.when((since_s >= 30) & (moved_m >= 50), "auto").when(off_route_s >= 8, "button").otherwise("wait")


def fallback_pairs(nodes: DataFrame, edges: DataFrame, distance: Column, k: int = 5) -> DataFrame:
    """For each person of nodes joined with positions, the k nearest nodes with two open ways out or more."""
    good = edges.where("is_open").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("out")).where("out >= 2")
    rows = nodes.join(good.select("id"), "id").withColumn("d", distance)
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("person").orderBy(F.round("d", 9), "id"))).where(F.col("k") <= k).select("person", "k", "id")
