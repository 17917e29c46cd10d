"""Connected components of a link table by alternating star contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import Scratch


def connected_components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``id, component`` (smallest id) for each end of the links ``a, b``.

    Each round is a large star (every larger neighbour is linked to the smallest one) and a small
    star (every smaller neighbour likewise); both keep the components, and O(log n) such rounds leave
    stars. Edges are summed by node with partial aggregation, so a hub is no single group. ``scratch``
    holds the table that the result reads; a later call with it replaces that table.

    Defined results: rows with a null end and self-links are left out, repeated links count once, and
    an empty table gives an empty result.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    scratch = scratch or Scratch(links.sparkSession, "components")
    edges = scratch.keep(edges, "edges")
    count = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while True:
        # large star: u's larger neighbours point to the smallest of u and its neighbours
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch.keep(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == tuple(count):
            break
        count = now
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return roots.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
