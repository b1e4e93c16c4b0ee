"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(edges: DataFrame, ws: Workspace, label: str = "cc") -> DataFrame:
    """node, component for each node of an edge (columns a, b): one component value for each component.

    Contraction: each node moves to the one of least hash among itself and its neighbours, edges
    follow their ends, loops and repeats go. The hash differs each round, so that chains shrink by a
    constant factor whatever their order. Each round's moves are saved; the rest is their
    composition. Minima are taken before the shuffle, and Spark splits the joins on a hub.
    """
    prio = lambda c, r: F.struct(F.xxhash64(c, F.lit(r)).alias("h"), c.alias("n"))
    live = ws.save(edges.select("a", "b").filter("a <> b").distinct(), f"{label}-e0")
    moves, r = [], 0
    while not live.isEmpty():
        both = live.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(live.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = both.groupBy("u").agg(F.min(prio(F.col("v"), r)).alias("m"))
        move = ws.save(near.select("u", F.least(F.col("m"), prio(F.col("u"), r))["n"].alias("to")), f"{label}-m{r}")
        moves.append(move)
        followed = (
            live.join(move.select(F.col("u").alias("a"), F.col("to").alias("a2")), "a")
            .join(move.select(F.col("u").alias("b"), F.col("to").alias("b2")), "b")
            .filter("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .distinct()
        )
        r += 1
        live = ws.save(followed, f"{label}-e{r}")
        ws.drop(f"{label}-e{r - 1}")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    reached = moves[0].select(F.col("u").alias("node"), F.col("to").alias("component"))
    for move in moves[1:]:
        reached = reached.join(move.withColumnRenamed("u", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return ws.save(reached, f"{label}-labels")
