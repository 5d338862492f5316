"""Document quality by hierarchical empirical Bayes over sites.

A logistic model of a text's measures, fitted on a bounded sample of labelled rows, gives each
document evidence. Sites add to it: the documents' probabilities are summed up by host and by path,
all documents taking part. Documents carry no address; the host is their source, the one column that
says where they come from, and the path its part in one language, the finest division they name.

A host's posterior is its mean shrunk toward the global mean, a path's its own shrunk toward its
host's, each by n / (n + k) with k = within / between: the variance of documents within paths over
that of the true means of hosts (of paths within their host). Both come from grouped sums by the
moments of an unbalanced one-way layout, so large sites weigh as much as their documents do and what
sparse sites vary by chance is not taken for a difference between sites. A document's log-odds are
its evidence and the log-odds by which its path departs from the global mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS = 20_000
THRESHOLD = 0.5
BROADCAST_GROUPS = 50_000
#: Least and largest number of documents that a prior counts for.
MIN_WEIGHT = 2.0
MAX_WEIGHT = 1e6
CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#*$%&|<>", "mark": b"!?", "stop": b".,;:", "blank": b" \t\n\x0b\x0c\r", "other": range(128, 256)}
_MASKS = np.array([[i in set(x) for i in range(256)] for x in CLASSES.values()], float)


def measures(text: bytes) -> np.ndarray:
    """A text's measures; an empty one's are zeros but for the constant."""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, size = max(1, len(words)), max(1, len(text))
    counts = _MASKS @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = np.log1p(counts / size * 20)
    rest = [np.log1p(len(words)) / 5, len(set(words)) / n, size / n / 10 if words else 0.0, len(set(lines)) / max(1, len(lines)), np.log1p(len(words) / max(1, len(lines))) / 3, min(1.0, len(words) / 50)]
    return np.array([1.0, *shares, *rest])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method. Without both labels: the prior alone."""
    w = np.zeros(x.shape[1] if x.size else len(measures(b"")))
    if len(set(y.tolist())) < 2:
        w[0] = 0.0 if not len(y) else (3.0 if y[0] else -3.0)
        return w
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """(id, y): a bounded sample of labels, the same on each run: the first by hash of doc_id."""
    held = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col(column).cast("int")).alias("y"))
    return held.orderBy(F.xxhash64("id"), "id").limit(rows)


def trained(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = SAMPLE_ROWS) -> np.ndarray:
    common.ship(docs.sparkSession)
    schema = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for batch in batches:
                for y, text in zip(batch.column("y").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                    yield y, measures(text.as_py() or b"")

        yield from common.batches_of(made(), schema)

    sample = F.broadcast(labelled_sample(labels, column, rows))  # of at most `rows` rows
    held = common.documents(docs).join(sample, F.col("doc_id") == F.col("id")).groupBy("id").agg(F.first("y").alias("y"), F.min("text").alias("text"))  # one row for each label
    got = held.select("y", "text").mapInArrow(run, "y int, x array<double>").collect()
    got.sort(key=lambda r: (r.y, r.x))
    return fit(np.array([r.x for r in got]).reshape(len(got), len(measures(b""))), np.array([r.y for r in got]))


def with_evidence(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with `evidence`, the log-odds of the text alone."""
    common.ship(docs.sparkSession)
    nested = docs.columns == ["row__"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (batch.column("row__").field("text") if nested else batch.column("text")).cast(pa.large_binary())
            x = [float(np.clip(measures(t.as_py() or b"") @ weights, -30, 30)) for t in texts]
            yield batch.append_column("evidence", pa.array(x, pa.float64()))

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).cast("double").alias("evidence")).schema)


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def prior_weight(within: Column, between: Column) -> Column:
    """How many documents a prior counts for; where the means differ by no more than chance, a million."""
    return F.when(between > 0, F.least(F.greatest(within / between, F.lit(MIN_WEIGHT)), F.lit(MAX_WEIGHT))).otherwise(F.lit(MAX_WEIGHT))


def site_priors(scored: DataFrame) -> DataFrame:
    """(host, path) -> shift, the log-odds by which the path departs from the mean of all."""
    p = 1 / (1 + F.exp(-F.col("evidence")))
    paths = common.checkpointed(scored.groupBy(F.col("source").alias("host"), F.col("lang").alias("path")).agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("s2")))
    square = F.col("s") * F.col("s") / F.col("n")  # n times the squared mean
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("s2").alias("hs2"), F.count("*").alias("hp"), F.sum(square).alias("hq"), F.sum(F.col("n") * F.col("n")).alias("hnn"))
    own = F.col("hs") * F.col("hs") / F.col("hn")
    total = hosts.agg(
        F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.count("*").alias("hosts"), F.sum("hp").alias("paths"), F.sum(F.col("hs2") - F.col("hq")).alias("rest"),
        F.sum(F.col("hq") - own).alias("of_paths"), F.sum(own).alias("q"), F.sum(F.col("hnn") / F.col("hn")).alias("path_share"), F.sum(F.col("hn") * F.col("hn")).alias("nn"),
    )
    over = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    n = F.col("n")
    total = total.withColumn("mu", over(F.col("s"), n)).withColumn("within", over(F.col("rest"), n - F.col("paths")))
    total = total.withColumn("path_var", over(F.col("of_paths") - (F.col("paths") - F.col("hosts")) * F.col("within"), n - F.col("path_share")))
    # What the means of hosts vary by beyond documents' and paths' own variance.
    chance = (F.col("hosts") - 1) * F.col("within") + (F.col("path_share") - F.col("pnn") / n) * F.greatest(F.col("path_var"), F.lit(0.0))
    of_paths = paths.agg(F.sum(F.col("n") * F.col("n")).alias("pnn"))
    total = total.join(of_paths).withColumn("host_var", over(F.col("q") - n * F.col("mu") * F.col("mu") - chance, n - F.col("nn") / n))
    one = F.broadcast(total.select("mu", prior_weight(F.col("within"), F.col("host_var")).alias("hk"), prior_weight(F.col("within"), F.col("path_var")).alias("pk")))  # one row
    host = hosts.join(one).select(F.col("host").alias("h"), "mu", "pk", ((F.col("hs") + F.col("hk") * F.col("mu")) / (F.col("hn") + F.col("hk"))).alias("post_host"))
    both = paths.join(host, F.col("host").eqNullSafe(F.col("h")))
    post = (F.col("s") + F.col("pk") * F.col("post_host")) / (F.col("n") + F.col("pk"))
    return common.checkpointed(both.select("host", "path", (logit(post) - logit(F.col("mu"))).alias("shift")))


def with_verdict(scored: DataFrame, priors: DataFrame, threshold: float) -> DataFrame:
    """scored with `probability` and `good`. The priors, a row for each site, are broadcast where few."""
    if priors.count() <= BROADCAST_GROUPS:
        priors = F.broadcast(priors)
    out = scored.join(priors, F.col("source").eqNullSafe(F.col("host")) & F.col("lang").eqNullSafe(F.col("path")), "left")
    p = 1 / (1 + F.exp(-(F.col("evidence") + F.coalesce("shift", F.lit(0.0)))))
    return out.withColumn("probability", p).withColumn("good", p >= threshold).drop("host", "path", "shift")


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, evidence, probability and kept of each row of docs(doc_id, text, lang, source).

    labels(doc_id, quality) are for fitting; of repeated ones the better counts. A null or empty text
    is judged by its measures of zero. Null sources and languages are sites of their own. Repeated
    rows are judged each; a null doc_id is passed on. Other columns are not read. Without labels the
    evidence is zero; an empty table gives an empty one. At most `rows` labelled rows are fitted on.
    """
    weights = trained(docs, labels, rows=rows)
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang", "source"]
    scored = common.checkpointed(with_evidence(docs.select(*cols), weights).drop("text"))
    out = with_verdict(scored, site_priors(scored), threshold)
    return out.select("doc_id", "evidence", "probability", F.col("good").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier keeps, with the columns of docs, whatever their names."""
    scored = with_evidence(docs.select(common.whole_rows(docs)), trained(docs, labels, rows=rows))
    scored = scored.select("row__", "evidence", "row__.lang", "row__.source")
    return with_verdict(scored, site_priors(scored), threshold).where("good").select("row__.*")
