"""Anchors from paths: traversals of bubbles, their coordinates, and the anchor dictionary.

steps (path, idx, node, fwd, length); bubbles (snarl_id, start, end, inside: array), one row an orientation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import walks


def traversals(steps: DataFrame, bubbles: DataFrame) -> DataFrame:
    """(path, snarl_id, start, first_idx, walk): stretches from a start node over inside nodes to the end node.

    Each step joins the bubbles its node belongs to, so work is spread by (path, bubble), not by path.
    """
    key = ["snarl_id", "start"]
    roles = bubbles.select(*key, F.col("start").alias("node"), F.lit(0).alias("role"))
    roles = roles.unionByName(bubbles.select(*key, F.col("end").alias("node"), F.lit(2).alias("role")))
    within = bubbles.select(*key, "end", F.explode("inside").alias("node")).filter("node <> start and node <> end").select(*key, "node", F.lit(1).alias("role"))
    member = steps.join(roles.unionByName(within).distinct(), "node")
    order = Window.partitionBy("path", *key).orderBy("idx")
    lagged = member.withColumns({"gap": F.col("idx") - F.lag("idx").over(order) != 1, "was": F.lag("role").over(order)})
    new = (F.col("role") == 0) | F.col("gap") | F.col("gap").isNull() | (F.col("was") == 2)
    runs = lagged.withColumn("run", F.count_if(new).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    node = F.struct("idx", F.col("node").alias("id"), F.col("length"), F.col("fwd"), "role")
    walked = runs.groupBy("path", *key, "run").agg(F.array_sort(F.collect_list(node)).alias("w"))
    whole = walked.filter((F.col("w")[0]["role"] == 0) & (F.element_at("w", -1)["role"] == 2))
    walk = F.transform("w", lambda n: F.struct(n["id"].alias("id"), n["length"].alias("length"), n["fwd"].alias("fwd")))
    return whole.select("path", *key, F.col("w")[0]["idx"].alias("first_idx"), walk.alias("walk"))


def both_orientations(snarls: DataFrame) -> DataFrame:
    """Boundaries from the smaller and from the larger end; of equal starts the last id wins."""
    a, b = F.least("start", "end"), F.greatest("start", "end")
    rows = snarls.select("snarl_id", a.alias("start"), b.alias("end"), "inside").unionByName(snarls.select("snarl_id", b.alias("start"), a.alias("end"), "inside"))
    forward = F.col("start") < F.col("end")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("start", forward).orderBy(F.desc("snarl_id")))).filter("rank = 1").drop("rank")


def path_coordinates(steps: DataFrame) -> DataFrame:
    """With bp_end: where a node ends on its path."""
    order = Window.partitionBy("path").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("bp_end", F.sum("length").over(order))


def dictionary(found: DataFrame, least_nodes: int = 2) -> DataFrame:
    """(sentinel, snarl_id, key, walk, paths, length, inner_length, first): each distinct walk once, either direction being the same.

    ``first`` (path, first_idx) is where the walk was met first: the order of anchors that share a sentinel.
    """
    rows = found.filter(F.size("walk") >= least_nodes).withColumns({"key": walks.canonical(F.col("walk"))})
    best = F.min_by("walk", F.struct("path", "first_idx"))
    first = F.min(F.struct("path", "first_idx"))
    out = rows.groupBy("snarl_id", "key").agg(best.alias("walk"), F.array_sort(F.collect_list("path")).alias("paths"), first.alias("first"))
    w = F.col("walk")
    return out.select(walks.sentinel(w).alias("sentinel"), "snarl_id", "key", "walk", "paths", walks.anchor_length(w).alias("length"), walks.inner_length(w).alias("inner_length"), "first")


def positioned(anchors: DataFrame, steps: DataFrame, reference: str) -> DataFrame:
    """Anchors with ``chromosome`` (the reference path, the last by name) and ``position``: the floor mean of their ends' coordinates on the reference path, or the largest of any node (0 at least)."""
    paths = steps.select("path").distinct().filter(F.lower("path").contains(reference.lower())).agg(F.max("path").alias("path"))
    at = path_coordinates(steps.join(F.broadcast(paths), "path", "left_semi")).groupBy("node").agg(F.max_by("bp_end", "idx").alias("pos"))  # one row
    nodes = anchors.select("snarl_id", "key", F.posexplode("walk").alias("i", "n")).select("snarl_id", "key", "i", F.col("n.id").alias("node"))
    placed = nodes.join(at, "node", "left").withColumn("pos", F.coalesce("pos", F.lit(-1)))
    ends = placed.groupBy("snarl_id", "key").agg(F.min_by("pos", "i").alias("a"), F.max_by("pos", "i").alias("b"), F.max("pos").alias("top"))
    pos = F.when((F.col("a") > 0) & (F.col("b") > 0), F.floor((F.col("a") + F.col("b")) / 2)).otherwise(F.greatest("top", F.lit(0)))
    return anchors.join(ends.select("snarl_id", "key", pos.alias("position")), ["snarl_id", "key"]).join(F.broadcast(paths.select(F.col("path").alias("chromosome"))))  # one row
