"""Wider boundaries for bubbles whose boundary nodes are too short for an anchor.

Each bubble grows outwards through unbranched nodes, from its longer boundary node first, until half of the boundary
nodes and all that lies between reach the target; it stops at another bubble's boundary.  Bubbles are taken in order, as
one that has grown stands in the way of the next, so a component of the graph is folded in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from .folding import Graph

OUT = "component long, snarl_id long, start long, end long, inside array<long>"


def widened(bubbles: list[tuple[int, int, list[int]]], graph: Graph, target: int) -> list[tuple[int, int, list[int]]]:
    """(start, end, inside) in the order given, start being the graph-left boundary."""
    taken: set[int] = set()
    out = []
    for start, end, inside in bubbles:
        bound, within = {True: start, False: end}, list(inside)
        have = graph.length[start] // 2 + graph.length[end] // 2
        longer_left = graph.length[start] > graph.length[end]
        for left in (longer_left, not longer_left):
            while have < target and bound[left] not in taken:
                node = bound[left]
                onward = graph.near.get((node, left), [])
                if len(onward) != 1 or onward[0] == node:
                    break
                have += graph.length[node] - graph.length[node] // 2 + graph.length[onward[0]] // 2
                within.append(node)
                bound[left] = onward[0]
        taken |= {bound[True], bound[False]}
        out.append((bound[True], bound[False], within))
    return out


def extended_boundaries(snarls: DataFrame, nodes: DataFrame, edges: DataFrame, target: int = DEFAULT.anchor_length, descending: bool = False) -> DataFrame:
    """snarls (component, snarl_id, start, end, inside), nodes (component, id, length), edges (component, node, left, nbr)."""
    s = snarls.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("start", "end", "snarl_id", "inside")), not descending).alias("snarls"))
    n = nodes.groupBy("component").agg(F.collect_list(F.struct("id", "length")).alias("nodes"))
    e = edges.groupBy("component").agg(F.collect_list(F.struct("node", "left", "nbr")).alias("edges"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for c, snarls_, nodes_, edges_ in zip(pdf["component"], pdf["snarls"], pdf["nodes"], pdf["edges"]):
                g = Graph({x["id"]: x["length"] for x in nodes_})
                for x in edges_:
                    g.near.setdefault((x["node"], x["left"]), []).append(x["nbr"])
                done = widened([(x["start"], x["end"], list(x["inside"])) for x in snarls_], g, target)
                rows += [(c, x["snarl_id"], *w) for x, w in zip(snarls_, done)]
            yield pd.DataFrame(rows, columns=["component", "snarl_id", "start", "end", "inside"])

    return s.join(n, "component").join(e, "component").select("component", "snarls", "nodes", "edges").mapInPandas(run, OUT)
