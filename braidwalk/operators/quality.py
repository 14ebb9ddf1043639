"""Checks of anchors against reads, and repeat pruning.

anchor_reads (anchor, read, strand, start, end), reads (read, seq[, quality]).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import sequences as sq
from . import intervals


def overlapping(anchor_reads: DataFrame) -> DataFrame:
    return intervals.overlaps(anchor_reads.select("read", "start", "end"), "read")


def sequences_of(anchor_reads: DataFrame, reads: DataFrame) -> DataFrame:
    """With ``piece``: the read's bases in the anchor, in the anchor's direction."""
    j = anchor_reads.join(reads.select("read", "seq"), "read")
    return j.select(*anchor_reads.columns, sq.subsequence(F.col("seq"), F.col("start").cast("int"), F.col("end").cast("int"), F.col("strand")).alias("piece"), F.length("seq").alias("read_length"))


def out_of_range(pieces: DataFrame) -> DataFrame:
    return pieces.filter("start >= read_length or end > read_length").drop("piece")


def identical(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("anchor").agg((F.count_distinct("piece") == 1).alias("identical"), F.count("*").alias("reads"))


def used_reads(anchor_reads: DataFrame, reads: DataFrame) -> DataFrame:
    return reads.join(anchor_reads.select("read"), "read", "left_semi")


def verify(anchor_reads: DataFrame, reads: DataFrame) -> dict[str, DataFrame]:
    pieces = sequences_of(anchor_reads, reads)
    return {"overlaps": overlapping(anchor_reads), "out_of_range": out_of_range(pieces), "identical": identical(pieces), "used_reads": used_reads(anchor_reads, reads)}


def repeated_snarls(anchor_reads: DataFrame, reads: DataFrame, exempt: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(snarl_id) of snarls of which two anchors are equal outside low-complexity stretches.

    anchor_reads has snarl_id; an anchor's sequence is that of its first read.  ``exempt`` (snarl_id): merged, hom and
    independently extended snarls.
    """
    first = anchor_reads.groupBy("snarl_id", "anchor").agg(F.min(F.struct("read", "strand", "start", "end")).alias("r")).select("snarl_id", "anchor", "r.*")
    first = first.join(exempt.select("snarl_id"), "snarl_id", "left_anti")
    pieces = sequences_of(first, reads)
    signed = pieces.select("snarl_id", sq.outside(F.col("piece"), sq.low_complexity(F.col("piece"), settings.dust_window, settings.dust_threshold)).alias("signature"))
    return signed.groupBy("snarl_id", "signature").agg(F.count("*").alias("n")).filter("n > 1").select("snarl_id").distinct()


def pruned(anchors: DataFrame, repeated: DataFrame) -> DataFrame:
    return anchors.join(repeated, "snarl_id", "left_anti")
