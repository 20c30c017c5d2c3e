"""Connected components of a graph given as edges between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolina.llm.common import staged


def _compressed(up: DataFrame, rows: int) -> DataFrame:
    """id, up: each id with the root of its tree. Links lead to smaller ids, so each jump halves all paths until none is left. rows: a bound on the ids."""
    while True:
        over = up.select(F.col("id").alias("_id"), F.col("up").alias("_up"))
        up = staged(up.join(over, up.up == over._id).select("id", F.col("_up").alias("up"), (F.col("_up") != F.col("up")).alias("moved")), "cc-up", rows=rows)
        moved, up = up.where("moved").limit(1).count(), up.select("id", "up")
        if not moved:
            return up


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """id, component_id: for every id in a or b of edges the smallest id that its edges reach.

    Each round every id hooks to its smallest neighbour if that is smaller, the trees are compressed to their roots, and the edges
    between roots are the next round's. An id that stays alone is hooked in the round after, so that two rounds at least halve the ids
    still in play: rounds are logarithmic whatever the ids' order, and end when no edge is left. Each round is written to shared
    storage. Edges to itself and repeated edges do no harm; nulls are left out. rows: about how many edges there are, if known.
    """
    own = edges.where("a is not null and b is not null").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    both = staged(own.union(own.select("b", "a")).distinct(), "cc-edges", rows=None if rows is None else 2 * rows)
    left = both.count()
    rounds = []
    while not rounds or left:
        up = _compressed(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("up")), left)
        rounds.append(up)
        a, b = (up.select(F.col("id").alias(c), F.col("up").alias(f"_{c}")) for c in "ab")
        both = staged(both.join(a, "a").join(b, "b").where("_a != _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "cc-edges", rows=left)
        left = both.count()
    told = rounds.pop()
    while rounds:  # each round's roots take their own roots of the later rounds
        top = told.select(F.col("id").alias("_id"), F.col("up").alias("_up"))
        told = rounds.pop().join(top, F.col("up") == F.col("_id"), "left").select("id", F.coalesce("_up", "up").alias("up"))
    return told.withColumnRenamed("up", "component_id")
