"""Connected components of a distributed link table by alternating large-star and small-star steps.

Neither a component nor a node's neighbours are ever gathered: a step is one aggregation for the
smallest neighbour and one equi-join, which adaptive execution splits where a node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollcall.llm.work import written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node that is not the smallest of its component, with that smallest node.

    ``edges`` has long columns u and v. Empty input gives no rows; loops and repeats are ignored.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"),
                                               F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = written(_small(_large(now)).distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now
