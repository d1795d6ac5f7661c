"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import write_and_read


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node that has a link; root is the smallest node reachable.

    Links with a null end and self-links are ignored; repeated links count once; an empty table gives an
    empty result. Each round is a grouped minimum and a join on the node, written to the shared folder, so
    neither links nor components pass through the driver. A node with very many links is an ordinary skewed
    join key, which adaptive execution splits.
    """
    ends = links.select(F.col(f"`{a}`"), F.col(f"`{b}`")).where(F.col(f"`{a}`") != F.col(f"`{b}`"))
    edges = write_and_read(
        ends.select(F.greatest(f"`{a}`", f"`{b}`").alias("u"), F.least(f"`{a}`", f"`{b}`").alias("v")).distinct(),
        "links",
    )
    before = None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select("v", F.col("v").alias("root")).distinct()
            )
        before = now
        edges = write_and_read(_small_star(_large_star(edges)), "links")
    raise RuntimeError("links did not settle; raise max_rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", "m")).distinct()
