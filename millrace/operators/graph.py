"""Entity graph from triples: build, merge names, and read neighbourhoods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.containment import contained_in

MIN_MERGED_NAME = 3


def build_edges(triples: DataFrame) -> DataFrame:
    """One edge per (src, dst): the latest triple wins; triples with an empty end are skipped."""
    full = triples.where((F.coalesce("src", F.lit("")) != "") & (F.coalesce("dst", F.lit("")) != ""))
    newest = F.max_by(F.struct("relation", "heading", "text", "seq"), "seq")
    return full.groupBy("src", "dst").agg(newest.alias("e")).select("src", "dst", "e.*")


def nodes(edges: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    names = edges.select(F.explode(F.array("src", "dst")).alias("name"))
    return (names if extra is None else names.union(extra.select("name"))).distinct()


def merge_map(names: DataFrame) -> DataFrame:
    """(name, merged): a name longer than three characters maps to the longest other name
    containing it; mappings are not chained. Equal lengths go to the smaller name."""
    short = names.where(F.char_length("name") > MIN_MERGED_NAME).select(F.col("name").alias("needle"))
    pairs = contained_in(short, names.select(F.col("name").alias("text")))
    return (
        pairs.where(F.col("needle") != F.col("text"))
        .groupBy(F.col("needle").alias("name"))
        .agg(F.min_by("text", F.struct(-F.char_length("text"), F.col("text"))).alias("merged"))
    )


def merge_entities(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges relabelled by the mapping; edges that fall together keep the latest."""
    to = lambda end: mapping.select(F.col("name").alias(end), F.col("merged").alias(f"{end}_merged"))
    renamed = edges.join(to("src"), "src", "left").join(to("dst"), "dst", "left")
    return build_edges(
        renamed.select(
            F.coalesce("src_merged", "src").alias("src"),
            F.coalesce("dst_merged", "dst").alias("dst"),
            "relation",
            "heading",
            "text",
            "seq",
        )
    )


def matching_nodes(entities: DataFrame, names: DataFrame) -> DataFrame:
    """(entity, name) where either contains the other, ignoring case."""
    asked = entities.select("entity", F.lower("entity").alias("e")).distinct()
    known = names.select("name", F.lower("name").alias("n")).distinct()
    inside = contained_in(asked.select(F.col("e").alias("needle")), known.select(F.col("n").alias("text"))).select(
        F.col("needle").alias("e"), F.col("text").alias("n")
    )
    around = contained_in(known.select(F.col("n").alias("needle")), asked.select(F.col("e").alias("text"))).select(
        F.col("text").alias("e"), F.col("needle").alias("n")
    )
    return inside.union(around).distinct().join(asked, "e").join(known, "n").select("entity", "name")


def neighbourhood(entities: DataFrame, edges: DataFrame, stop: Sequence[str] = (), query: str = "query_id") -> DataFrame:
    """Distinct texts on the edges at the nodes matching each query's entities.

    Entities in the stop list are left out. A text keeps its smallest heading.
    """
    asked = entities.where(~F.lower("entity").isin(*[s.lower() for s in stop])) if stop else entities
    matched = asked.join(matching_nodes(asked.select("entity"), nodes(edges)), "entity").select(query, "name").distinct()
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("name"), "heading", "text")
    # Parallel edges with one text combine before the join.
    ends = ends.groupBy("name", "text").agg(F.min("heading").alias("heading"))
    return matched.join(ends, "name").groupBy(query, "text").agg(F.min("heading").alias("heading"))
