"""What a viewer of anchors shows and changes: maps, the graph, its layout, drops with undo, and saved states.

anchor_reads (anchor, read, strand, start, end); visits as in journeys.py (read, anchor, start).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import ranked
from . import journeys

#: Fixed values of the layout: space between bubbles and within one, pull, rounds, height and frequency of the wave.
ACROSS, WITHIN, PULL, ROUNDS, HEIGHT, FREQUENCY = 250, 30, 0.1, 150, 2000, 0.08


def snarl_number(snarl: Column) -> Column:
    """The first number of an id like 'snarl_id1-2-3' or '1-2-3'; 0 where there is none."""
    return F.coalesce(F.split(F.regexp_replace(snarl.cast("string"), "snarl_id", ""), "-")[0].try_cast("int"), F.lit(0))


def id_tokens(text: Column) -> Column:
    """Ids of a list that a person typed: commas and white space part them."""
    return F.filter(F.split(F.regexp_replace(text, ",", " "), r"\s+"), lambda x: x != "")


def merged_anchors(anchor_reads: DataFrame) -> DataFrame:
    """(anchor, reads): an anchor's reads, those of its repeats too, in order."""
    return anchor_reads.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("read", "strand", "start", "end"))).alias("reads"))


def snarl_anchors(anchor_reads: DataFrame, sizes: DataFrame) -> DataFrame:
    """(snarl, anchor) of the anchors there are, from the sizes table (snarl_id, Anchor_path), each once."""
    known = sizes.select(F.col("snarl_id").alias("snarl"), F.col("Anchor_path").alias("anchor")).distinct()
    return known.join(anchor_reads.select("anchor"), "anchor", "left_semi").select("snarl", "anchor")


def read_info(anchor_reads: DataFrame) -> DataFrame:
    """(read, strand, journey): '+' for strand 0, at the read's first anchor; the journey as in journeys.py."""
    strand = F.min_by("strand", F.struct("start", "anchor"))
    way = journeys.journeys(anchor_reads.select("read", "anchor", "start"))
    return anchor_reads.groupBy("read").agg(F.when(strand == 0, "+").otherwise("-").alias("strand")).join(way, "read")


def shown_graph(visits: DataFrame, nodes: DataFrame, dropped_anchors: DataFrame, dropped_reads: DataFrame, keep_isolated: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges (a, b, weight)) after drops: journeys run past what is dropped; nodes without edges go."""
    left = journeys.dropped(journeys.dropped(visits, dropped_anchors, "anchor"), dropped_reads, "read")
    edges = journeys.journey_edges(left.join(nodes.select("anchor"), "anchor", "left_semi"))
    alive = journeys.dropped(nodes, dropped_anchors, "anchor")
    return (alive if keep_isolated else journeys.connected_only(alive, edges)), edges


def anchor_info(anchor_reads: DataFrame, anchor: str) -> DataFrame:
    return anchor_reads.filter(F.col("anchor") == anchor).select("read", "strand", "start", "end")


def edge_info(anchor_reads: DataFrame, a: str, b: str) -> DataFrame:
    """(read, anchor, strand, start, end) at both ends of an edge, of the reads that walk it."""
    reads = journeys.edge_reads(anchor_reads.select("read", "anchor", "start"), a, b)
    return anchor_reads.filter(F.col("anchor").isin(a, b)).join(reads, "read", "left_semi").select("read", "anchor", "strand", "start", "end")


def on_journey(journey: DataFrame, read: str) -> DataFrame:
    """(anchor, place) along a read's journey, to highlight."""
    return journey.filter(F.col("read") == read).select(F.posexplode("journey").alias("place", "anchor")).select("anchor", "place")


def start_layout(nodes: DataFrame) -> DataFrame:
    """(snarl, anchor, number, x, y): bubbles in order along a wave under one arch, a bubble's anchors centred on it.

    Bubbles are ordered by their number, then id; a bubble's anchors by id.
    """
    places = ranked(nodes.groupBy("snarl").agg(F.count("*").alias("anchors")).withColumn("number", snarl_number(F.col("snarl"))), "number", "snarl")
    total = places.agg(F.count("*").alias("total"))  # one row
    i = F.col("rank")
    centre = HEIGHT * F.sin(i / F.col("total") * np.pi) * F.sin(i * FREQUENCY)
    within = F.row_number().over(Window.partitionBy("snarl").orderBy("anchor")) - 1
    placed = nodes.withColumn("within", within).join(places.join(F.broadcast(total)), "snarl")
    return placed.select("snarl", "anchor", "number", (i * float(ACROSS)).alias("x"), (centre + (F.col("within") - (F.col("anchors") - 1) / 2) * WITHIN).alias("y"))


def relaxed_layout(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(anchor, x, y): ends of an edge move towards their middle, more for heavy edges between far bubbles, cooling down.

    Distance is that of the bubbles' numbers; neighbours (1 or less) stay.  Each step uses the steps before it, in order
    of the edges, so it runs on the driver: a viewer's graph, thousands of nodes.
    """
    spark = nodes.sparkSession
    rows = start_layout(nodes).orderBy("number", "snarl", "anchor").collect()
    at = {r["anchor"]: np.array([r["x"], r["y"]]) for r in rows}
    number = {r["anchor"]: r["number"] for r in rows}
    pull = []
    for r in edges.orderBy("a", "b").collect():
        if r["a"] in at and r["b"] in at and (far := abs(number[r["a"]] - number[r["b"]])) > 1:
            pull.append((r["a"], r["b"], PULL * np.log1p(r["weight"]) * np.log1p(far)))
    for k in range(rounds):
        for a, b, strength in pull:
            middle, part = (at[a] + at[b]) / 2, strength * (1 - k / rounds)
            at[a], at[b] = at[a] + (middle - at[a]) * part, at[b] + (middle - at[b]) * part
    return spark.createDataFrame([(a, float(p[0]), float(p[1])) for a, p in at.items()], "anchor string, x double, y double")


@dataclass(frozen=True)
class Drops:
    """What a person has dropped, in order; all steps are all or nothing and give a new value."""

    visits: DataFrame
    history: tuple[tuple[str, str], ...] = ()  # (anchor or read, id)

    def ids(self, kind: str) -> DataFrame:
        return self.visits.sparkSession.createDataFrame([(i,) for k, i in self.history if k == kind], f"{kind} string")

    def drop(self, kind: str, *ids: str) -> Drops:
        """Raises if an id is unknown or dropped already."""
        spark = self.visits.sparkSession
        asked = spark.createDataFrame([(i,) for i in ids], f"{kind} string")
        if bad := [r[0] for r in journeys.unknown(asked, self.visits, kind).limit(5).collect()]:
            raise ValueError(f"unknown {kind}: {bad}")
        if twice := [i for i in ids if (kind, i) in self.history]:
            raise ValueError(f"dropped already: {twice}")
        return replace(self, history=self.history + tuple((kind, i) for i in dict.fromkeys(ids)))

    def restore(self, kind: str, *ids: str) -> Drops:
        if bad := [i for i in ids if (kind, i) not in self.history]:
            raise ValueError(f"not dropped: {bad}")
        return replace(self, history=tuple(h for h in self.history if h not in {(kind, i) for i in ids}))

    def undo(self) -> Drops:
        return replace(self, history=self.history[:-1])

    def remaining(self) -> DataFrame:
        return journeys.dropped(journeys.dropped(self.visits, self.ids("anchor"), "anchor"), self.ids("read"), "read")


def save(rows: DataFrame, path: str, version: int) -> str:
    """Write a state beside the ones before it: nothing that is read is overwritten."""
    out = f"{path}/version={version}"
    rows.write.mode("error").parquet(out)
    return out
