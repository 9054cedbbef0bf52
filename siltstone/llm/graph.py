"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """(node, component) of every node of the undirected edges (u, v); component is the smallest node reachable.

    A step keeps a row per edge and looks at neighbourhoods through a min aggregate and a join, never
    through a collected list. The minima are written first: then both sides of the join are plain exchanges, and
    a node with very many neighbours is a skew that Spark can split. Each round is written to the shared folder, which cuts lineage. Empty edges give no rows.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name, narrow=True)
    mark = None
    for _ in range(most):
        now = staged(_small(_large(now)), name, narrow=True)
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()


def _large(e: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest of its neighbourhood."""
    both = e.union(e.select("v", "u").toDF("u", "v"))
    low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", narrow=True)
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them. In e, u > v."""
    low = staged(e.groupBy("u").agg(F.min("v").alias("m")), "least", narrow=True)
    down = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return down.union(low.select("u", F.col("m").alias("v"))).distinct()
