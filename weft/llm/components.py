"""Connected components of an edge table, by alternating star contractions on landed tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.shared import land


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One contraction of undirected edges (u > v): the neighbours of a node move to the least of them and itself.

    The large star looks at all neighbours and moves the larger ones, the small star at the smaller ones.  The
    least is found by an aggregate that combines before its shuffle, so a node with very many edges costs no
    task more than its partial results; the join that follows can be split by adaptive execution.
    """
    if small:
        near = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    else:
        near = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = near.join(least, "a")
    out = moved.where("b > a" if not small else "b <> m").select(F.col("b").alias("u"), F.col("m").alias("v"))
    if small:
        out = out.union(least.select(F.col("a").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of an edge the least node of its component.

    Edges may repeat, be given in either direction or be loops; nodes are long integers.  Each round is landed in
    the shared folder; the rounds grow with the logarithm of the nodes, and end when the edges stay the same.
    """
    both = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    live = land(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "component-edges")
    state = None
    for _ in range(most_rounds):
        live = land(_star(_star(live, small=False), small=True), "component-edges")
        now = tuple(live.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("the components did not settle")
    return live.select(F.col("u").alias("node"), F.col("v").alias("component")).union(live.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
