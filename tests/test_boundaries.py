"""Boundary extension on small graphs: lengths by node, bubbles, and what is expected at a target of 100 bases."""

import pytest
from pyspark.sql import functions as F

from braidwalk.operators import boundaries, graph

CASES = {
    "left": ([10, 40, 1, 1, 90, 10, 10, 100], [(2, (3, 4), 5), (5, (6, 7), 8)], {1: 5, 5: 8}, False),
    "right": ([10, 10, 10, 40, 1, 1, 50, 60, 10, 10, 10], [(1, (2, 3), 4), (4, (5, 6), 7), (8, (9, 10), 11)], {1: 4, 4: 8, 8: 11}, False),
    "branch": ([10, 10, 10, 40, 1, 1, 50, 10, 10, 10], [(1, (2, 3), 4), (4, (5, 6), 7), (7, (8, 9), 10)], {1: 4, 4: 7, 7: 10}, False),
    "correct left": ([10, 1, 1, 50, 60, 1, 1, 20, 10, 1, 1, 10], [(1, (2, 3), 4), (5, (6, 7), 8), (9, (10, 11), 12)], {1: 4, 4: 8, 8: 12}, True),
    "correct right": ([10, 1, 1, 20, 40, 1, 1, 60, 50, 1, 1, 10], [(1, (2, 3), 4), (5, (6, 7), 8), (9, (10, 11), 12)], {1: 5, 5: 9, 9: 12}, False),
    "stops": ([10, 100, 40, 1, 1, 20, 50, 10], [(3, (4, 5), 6)], {2: 6}, False),
}


def edges_of(n, bubbles):
    """Every bubble's arms, and single edges between the nodes that no arm joins."""
    out = {(s, a) for s, arms, _ in bubbles for a in arms} | {(a, e) for _, arms, e in bubbles for a in arms}
    inside = {a for _, arms, _ in bubbles for a in arms}
    backbone = [i for i in range(1, n + 1) if i not in inside]
    spanned = {(s, e) for s, _, e in bubbles}
    return sorted(out | {(a, b) for a, b in zip(backbone, backbone[1:]) if (a, b) not in spanned})


@pytest.mark.parametrize("name", CASES)
def test_boundaries(spark, name):
    lengths, bubbles, want, descending = CASES[name]
    e = edges_of(len(lengths), bubbles)
    edges = spark.createDataFrame([(a, True, b, True) for a, b in e], "src long, src_fwd boolean, dst long, dst_fwd boolean")
    near = graph.sides(edges).select(F.lit(0).cast("long").alias("component"), "node", (F.col("side") == "L").alias("left"), "nbr")
    nodes = spark.createDataFrame([(0, i, n) for i, n in enumerate(lengths, 1)], "component long, id long, length long")
    snarls = spark.createDataFrame([(0, i, s, t, list(arms)) for i, (s, arms, t) in enumerate(bubbles)], "component long, snarl_id long, start long, end long, inside array<long>")
    got = boundaries.extended_boundaries(snarls, nodes, near, 100, descending).collect()
    assert {r["start"]: r["end"] for r in got} == want


def test_simple_bubbles(spark):
    lengths, bubbles, _, _ = CASES["right"]
    edges = spark.createDataFrame(edges_of(len(lengths), bubbles), "src long, dst long")
    got = {(r["start"], tuple(r["inside"]), r["end"]) for r in graph.simple_bubbles(edges).collect()}
    assert got == set(bubbles)
