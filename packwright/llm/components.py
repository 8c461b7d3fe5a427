"""Connected components of a graph of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm.common import materialize


def _tidy(edges: DataFrame) -> DataFrame:
    return (edges.where(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def connected(edges: DataFrame) -> DataFrame:
    """(id, label) for every node of ``edges`` (a, b: longs); nodes share a label if links join them.

    In every round each node is merged into the neighbour, or itself, that comes first in an
    order drawn anew by hashing, and the links are carried over to what nodes were merged into.
    The order keeps chains from shrinking by one node a round, so the number of rounds grows
    with the logarithm of the longest chain; stars need one. All tables of a round are written, so nothing is
    recomputed and the plan stays short. Loops and repeated links change nothing; no
    links give no rows.
    """
    rounds: list[DataFrame] = []
    left = materialize(_tidy(edges))
    while not left.isEmpty():
        order = lambda c: F.xxhash64(F.col(c), F.lit(len(rounds)))  # noqa: E731, B023
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(order("b").alias("order"), F.col("b"))).alias("first"))
        own = F.struct(order("a").alias("order"), F.col("a").alias("b"))
        merged = materialize(first.select(F.col("a").alias("id"), F.least(own, "first")["b"].alias("label")))
        rounds.append(merged)
        a, b = (merged.select(F.col("id").alias(c), F.col("label").alias(f"new_{c}")) for c in "ab")
        left = materialize(_tidy(left.join(a, "a").join(b, "b").select(
            F.col("new_a").alias("a"), F.col("new_b").alias("b"))))
    if not rounds:
        return left.select(F.col("a").alias("id"), F.col("b").alias("label"))
    labels = rounds[0]
    for later in rounds[1:]:
        step = later.select(F.col("id").alias("label"), F.col("label").alias("next"))
        labels = labels.join(step, "label", "left").select(
            "id", F.coalesce("next", "label").alias("label"))
    return labels
