"""Extension of anchors: relational parts, and the ordered fold over a chain of snarls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outer_boundaries(anchors: DataFrame) -> DataFrame:
    """(snarl, low_id, occ_low, high_id, occ_high): outermost nodes over a snarl's anchors, with the most bases occupied there."""
    low = F.min(F.struct("low_id", (-F.col("occ_low")).alias("o")))
    high = F.max(F.struct("high_id", F.col("occ_high").alias("o")))
    out = anchors.groupBy("snarl").agg(low.alias("l"), high.alias("h"))
    return out.select("snarl", F.col("l.low_id").alias("low_id"), (-F.col("l.o")).alias("occ_low"), F.col("h.high_id").alias("high_id"), F.col("h.o").alias("occ_high"))


def gate(anchors: DataFrame, target: int = 16) -> DataFrame:
    """(snarl, short, het): whether a bubble's shortest anchor is under the target, and whether it has several."""
    return anchors.groupBy("snarl").agg((F.min("length") < target).alias("short"), (F.count_distinct("key") > 1).alias("het"))


def independently_extended(anchors: DataFrame) -> DataFrame:
    """Whether a snarl's anchors differ in their bounds."""
    return anchors.groupBy("snarl").agg((F.count_distinct(F.struct("low_id", "high_id", "occ_low", "occ_high")) > 1).alias("independent"))


def best_offsets(anchors: DataFrame, reads: DataFrame, target: int = 16, least: int = 3) -> DataFrame:
    """(anchor, offset, reads): how far left to extend an anchor so that most reads allow the length ``target``.

    anchors (anchor, length, free_left, free_right), reads (anchor, left, right: bases a read allows on either side).
    The offset runs over every value the free bases allow; of equal support the largest wins.
    """
    room = anchors.select("anchor", "length", F.greatest(F.lit(0), F.least(F.lit(target) - F.col("length"), "free_left")).alias("most"), F.greatest(F.lit(0), F.lit(target) - F.col("length") - F.col("free_right")).alias("fewest"))
    tried = room.filter("fewest <= most").join(reads, "anchor").withColumn("offset", F.explode(F.sequence("fewest", "most")))
    fits = tried.filter((F.col("left") >= F.col("offset")) & (F.col("right") >= F.lit(target) - F.col("offset") - F.col("length")))
    support = fits.groupBy("anchor", "offset").agg(F.count("*").alias("reads"))
    best = support.groupBy("anchor").agg(F.max(F.struct("reads", "offset")).alias("b"))
    return best.filter(F.col("b.reads") >= least).select("anchor", F.col("b.offset").alias("offset"), F.col("b.reads").alias("reads"))


def extended_into_node(reads: DataFrame, lengths: DataFrame, left: bool, fraction: float = 0.9, least: int = 0) -> DataFrame:
    """Anchors grown over half of their boundary node and half of the one node beyond it, where nearly all reads allow it.

    reads (snarl, anchor, read, strand, start, end, cs_left, cs_right), lengths (snarl, boundary_length, node_length).  An
    anchor grows if ``fraction`` of its reads, and ``least``, have the bases spare; a bubble grows if two of its anchors
    do: those stay with the reads that have them, the others go.  Other bubbles stay as they are (extended is false).
    """
    added = F.floor((F.col("boundary_length") + 1) / 2) + F.floor(F.col("node_length") / 2) + 1
    towards_left = F.lit(left) == (F.col("strand") == 0)
    rows = reads.join(lengths, "snarl").withColumn("added", added)
    rows = rows.withColumn("fits", F.when(towards_left, F.col("cs_left")).otherwise(F.col("cs_right")) >= F.col("added"))
    able = rows.groupBy("snarl", "anchor").agg(F.count_if("fits").alias("k"), F.count("*").alias("n")).filter((F.col("k") >= F.col("n") * fraction) & (F.col("k") >= least))
    grown = able.groupBy("snarl").agg(F.count("*").alias("anchors")).filter("anchors >= 2").select("snarl")
    more = F.col("added") - 1
    moved = rows.join(able.select("snarl", "anchor"), ["snarl", "anchor"], "left_semi").join(grown, "snarl", "left_semi").filter("fits")
    moved = moved.withColumns({
        "start": F.col("start") - more if left else F.col("start"), "end": F.col("end") if left else F.col("end") + more,
        "cs_left": F.col("cs_left") - F.when(towards_left, more).otherwise(0), "cs_right": F.col("cs_right") - F.when(towards_left, 0).otherwise(more),
    })
    return moved.select(*reads.columns, F.lit(True).alias("extended")).unionByName(reads.join(grown, "snarl", "left_anti").withColumn("extended", F.lit(False)))
