"""Connected components over edges that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, let_go

#: Tasks over which the rows of one join key are dealt.
SALTS = 16


def spread_join(left: DataFrame, right: DataFrame, on: str, by: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """An equality join where any number of rows of ``left`` may share a key: they are dealt over ``salts`` tasks by column ``by``, and the one row that ``right`` has for a key goes to each of them."""
    left = left.withColumn("salt__", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = right.withColumn("salt__", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [on, "salt__"], how).drop("salt__")


def _is_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge, and no smaller end is a larger end."""
    if edges.groupBy("u").count().where("count > 1").limit(1).count():
        return False
    return not edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the smallest node of its component.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the
    edges are stars around their roots; a round takes a few shuffles of the
    edge list, and the number of rounds is logarithmic. Ends may be of any
    type with an order; edges with a null end are passed over.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u != v").distinct()
    edges = cut(edges)
    while not _is_stars(edges):
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = spread_join(both, low, "x", "y").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = cut(large)
        let_go(edges)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, "u", "v").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        let_go(large)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
