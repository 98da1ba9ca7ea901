"""Connected components of a graph given as a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import discard, stage, stage_at


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of ``links``; a component is named by its smallest node.

    In each round every node moves to the neighbour that comes first in a hashed order, or stays,
    and the links move along; that halves the remaining nodes or better, whatever the shape of the
    graph. A round is joins on one unique side and aggregates with partial minima, so a node with
    any number of links stays spread over tasks. Each round's tables are stored, which cuts the
    lineage, and deleted once their successor is written. Links with a null end and links from a node to itself are ignored; repeated links
    count once; without links the result is empty.
    """
    one = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(F.col("a") != F.col("b"))
    spark = links.sparkSession
    pairs, held = stage_at(one.union(one.select("b", "a")).distinct(), "links")
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    moves: list[DataFrame] = []
    spent: list[str] = []
    while True:
        best = pairs.groupBy("a").agg(F.min(order("b")).alias("first"))
        move, path = stage_at(best.select(F.col("a").alias("node"), F.least(F.col("first"), order("a"))["n"].alias("to")), "moves")
        moves.append(move)
        spent.append(path)
        left, right = move.select(F.col("node").alias("a"), F.col("to").alias("x")), move.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = pairs.join(left, "a").join(right, "b").filter(F.col("x") != F.col("y"))
        pairs, fresh = stage_at(moved.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        discard(spark, held)
        held = fresh
        if pairs.isEmpty():
            break
    found = moves[0]
    for move in moves[1:]:
        step = move.select(F.col("node").alias("to"), F.col("to").alias("further"))
        found = found.join(step, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
    found = stage(found, "roots")
    discard(spark, held, *spent)
    names = found.groupBy("to").agg(F.min("node").alias("component"))
    return found.join(names, "to").select("node", "component")
