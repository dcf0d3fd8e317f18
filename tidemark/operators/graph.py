"""Graph operators on edge tables: star edges, connected components, degrees, the giant-component gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.shared import reliable

#: Edges that one task of a step takes.
EDGES = 100_000


def star_edges(links: DataFrame, group: str, member: str) -> DataFrame:
    """n-1 edges for each group: from its smallest member to each other one."""
    anchor = links.groupBy(group).agg(F.min(member).alias("src"))
    pairs = links.select(group, F.col(member).alias("dst")).distinct()
    return pairs.join(anchor, group).where("dst <> src").select("src", "dst").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", *, rounds: int = 200) -> DataFrame:
    """(id, component) for every id of an edge table; the component is its smallest id.

    Alternates large-star and small-star steps (Kiveris et al., SoCC 2014) until the edges stand
    still.  A step is one minimum by node and one join on the node, so a hub needs no list of its
    neighbours in one task.  The steps run in as many tasks as the edges fill, so few edges make few
    small files.  Loops and repeated edges are harmless; null ends are left out.  Edges that still
    move after ``rounds`` rounds (they need about the logarithm of the longest path) are an error.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    e = reliable(e.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct())
    nodes = e.select(F.col("u").alias("id")).union(e.select("v")).distinct()
    e = e.where("u <> v")
    seen, count = None, e.count()
    for _ in range(rounds):
        tasks = 1 + count // EDGES
        e = e.coalesce(tasks)
        both = e.select("u", "v").union(e.select("v", "u")).coalesce(tasks)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks)
        # every remaining edge goes from a node to a smaller one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        moved = small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).coalesce(tasks).distinct()
        e = reliable(moved.coalesce(tasks))
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            roots = e.groupBy("u").agg(F.min("v").alias("component"))
            return nodes.join(roots, nodes["id"] == roots["u"], "left").select("id", F.coalesce("component", "id").alias("component"))
        seen, count = state, state[0]
    raise RuntimeError(f"the components did not settle in {rounds} rounds")
