"""Journeys of reads over anchors, connectivity, and what a viewer shows.  Input: visits (read, anchor, start)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_visits(visits: DataFrame) -> DataFrame:
    """(read, anchor, start): each anchor once, where the read first meets it."""
    return visits.groupBy("read", "anchor").agg(F.min("start").alias("start"))


def journeys(visits: DataFrame) -> DataFrame:
    """(read, journey): anchors by (start, anchor), each at its first place."""
    steps = F.array_sort(F.collect_list(F.struct("start", "anchor")))
    return first_visits(visits).groupBy("read").agg(F.transform(steps, lambda s: s["anchor"]).alias("journey"))


def journey_edges(visits: DataFrame) -> DataFrame:
    """(a, b, weight): reads that visit a and b one after the other, in either order."""
    order = Window.partitionBy("read").orderBy("start", "anchor")
    pairs = first_visits(visits).select("anchor", F.lead("anchor").over(order).alias("next")).filter("next is not null")
    return pairs.groupBy(F.least("anchor", "next").alias("a"), F.greatest("anchor", "next").alias("b")).agg(F.count("*").alias("weight"))


def connectivity(visits: DataFrame) -> DataFrame:
    """(a, b, common_reads) of anchors that reads share."""
    once = visits.select("read", "anchor").distinct()
    left, right = once.select("read", F.col("anchor").alias("a")), once.select("read", F.col("anchor").alias("b"))
    return left.join(right, "read").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("common_reads"))


def edge_reads(visits: DataFrame, a: str, b: str) -> DataFrame:
    """Reads in which two anchors follow each other, in either order."""
    order = Window.partitionBy("read").orderBy("start", "anchor")
    near = first_visits(visits).withColumn("next", F.lead("anchor").over(order))
    return near.filter(((F.col("anchor") == a) & (F.col("next") == b)) | ((F.col("anchor") == b) & (F.col("next") == a))).select("read").distinct()


def dropped(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def connected_only(nodes: DataFrame, edges: DataFrame, key: str = "anchor") -> DataFrame:
    """Nodes that some edge has."""
    return nodes.join(edges.select(F.explode(F.array("a", "b")).alias(key)).distinct(), key, "left_semi")


def unknown(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return asked.join(known.select(key), key, "left_anti").select(key).distinct()


def apply_drops(visits: DataFrame, anchors: DataFrame, reads: DataFrame) -> DataFrame:
    """All or nothing: raises if an id to drop is unknown, else visits without the anchors and reads named."""
    for ids, key in ((anchors, "anchor"), (reads, "read")):
        if bad := [r[0] for r in unknown(ids, visits, key).limit(5).collect()]:
            raise ValueError(f"unknown {key}: {bad}")
    return dropped(dropped(visits, anchors, "anchor"), reads, "read")
