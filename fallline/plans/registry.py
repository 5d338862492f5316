"""The registered queries over the operators, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2001-12-31 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def add(name: str, fixtures: str, run: Callable[..., DataFrame], sql: str | None, round_to: int | None = 6, done: bool = False) -> None:
    """run(*fixture views) is the query. Doubles are rounded on both sides where round_to is given; done: run has rounded its own.

    Without sql the query is one that SQL cannot express; a test holds its operator to brute force.
    """
    names = fixtures.split()

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run(*(view(spark, sf_dir, n) for n in names))
        return out if done else rounded(out, round_to)

    query.__name__ = name
    QUERIES[name] = query
    if sql is None:
        return
    body = f"{ctes(*names)}, out__ AS ({sql})"
    # DuckDB leaves what is no double as it is when only such columns are named.
    ORACLES[name] = f"{body} SELECT * FROM out__" if round_to is None else f"{body} SELECT COLUMNS(*) FROM out__"


def rounded(df: DataFrame, to: int | None) -> DataFrame:
    return df if to is None else df.select(*(F.round(c, to).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


R = lambda x, n=6: f"round({x}, {n})"
HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, sin(radians({b1} - {a1}) / 2) ** 2 + cos(radians({a1})) * cos(radians({b1})) * sin(radians({b2} - {a2}) / 2) ** 2)))"
FRIENDS = "fr AS (SELECT DISTINCT me, friend FROM (SELECT requester_id AS me, addressee_id AS friend FROM f_friendships WHERE status = 'accepted' UNION ALL SELECT addressee_id, requester_id FROM f_friendships WHERE status = 'accepted'))"
