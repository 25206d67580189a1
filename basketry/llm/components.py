"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), each in one direction, v < u. Large: larger neighbours get the least one of all; small: smaller ones do.

    Only the least neighbour of a node is aggregated; nobody's neighbours are gathered.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def contracted(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """links (a, b) -> written edges (u, v), v < u, that connect the same nodes: after enough rounds, or without a limit, each node with the least that it reaches."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    seen, n = None, 0
    while rounds is None or n < rounds:
        last, edges, n = edges, written(_star(_star(edges, True), False), "edges"), n + 1
        discard(last)
        if rounds is None:
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if tuple(now) == seen:
                break
            seen = tuple(now)
    return edges


def labels(edges: DataFrame) -> DataFrame:
    """Edges as contracted() makes them -> (node, root): nodes with one root are connected; after the last round all that are connected have one."""
    least = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return least.union(roots.join(least.select("node"), "node", "left_anti"))


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root): every node that has a link, with the least node that it reaches."""
    return labels(contracted(links))
