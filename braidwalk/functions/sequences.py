"""Column functions over sequences, and the low-complexity filter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement_strict(s: Column) -> Column:
    """Reverse complement of the capital bases; everything else is left out."""
    return F.translate(F.reverse(F.regexp_replace(s, "[^ACGT]", "")), "ACGT", "TGCA")


def complement(s: Column) -> Column:
    return F.translate(s, "ACGTacgt", "TGCAtgca")


def reverse_complement(s: Column) -> Column:
    """Case and other letters are kept, so coordinates hold."""
    return complement(F.reverse(s))


def subsequence(s: Column, start: Column, end: Column, strand: Column) -> Column:
    """Bases [start, end) of a read in the direction of its strand bit."""
    return F.substring(F.when(strand == 1, reverse_complement(s)).otherwise(s), start + 1, end - start)


def outside(s: Column, intervals: Column) -> Column:
    """The sequence without the pieces in ``intervals`` (array of struct(s, e))."""
    zero = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        kept = F.concat(a["kept"], F.substring(s, a["at"] + 1, F.greatest(x["s"].cast("int") - a["at"], F.lit(0))))
        return F.struct(kept.alias("kept"), F.greatest(a["at"], x["e"].cast("int")).alias("at"))

    r = F.aggregate(F.array_sort(intervals), zero, step)
    return F.concat(r["kept"], F.substring(s, r["at"] + 1, F.length(s)))


_BASES = np.full(256, -1, np.int64)
_BASES[list(b"ACGT")] = _BASES[list(b"acgt")] = range(4)


def _repeated(seq: str, window: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(triplet at each end or -1, first end of its unbroken stretch, ends at which an interval may begin to score).

    An interval scores no less without its newest triplet unless that adds more than the ratio it must pass, so only ends
    whose triplet stands often enough in the window count: found from each triplet's sorted places, without a loop.
    """
    base = _BASES[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    n = len(base)
    triplet = np.full(n, -1)
    if n < 3:
        return triplet, np.zeros(n, np.int64), np.zeros(0, np.int64)
    whole = (base[2:] >= 0) & (base[1:-1] >= 0) & (base[:-2] >= 0)
    triplet[2:] = np.where(whole, base[:-2] << 4 | base[1:-1] << 2 | base[2:], -1)
    ends = np.flatnonzero(triplet >= 0)
    begins = np.maximum.accumulate(np.where((triplet >= 0) & (np.concatenate([[-1], triplet[:-1]]) < 0), np.arange(n), 0))
    key = np.sort(triplet[ends] * (n + window) + ends)
    oldest = np.maximum(begins[ends], ends + 3 - window)
    row = triplet[ends] * (n + window)
    count = np.searchsorted(key, row + ends, side="right") - np.searchsorted(key, row + oldest)
    return triplet, begins, ends[(count - 1) * 2 > threshold]


def dust_intervals(seq: str, window: int = 40, threshold: int = 4) -> list[tuple[int, int]]:
    """Low-complexity intervals by symmetric DUST.

    An interval of triplets scores the sum of c (c - 1) / 2 over triplet counts, divided by its number of triplets less
    one.  It is masked if it scores over half of ``threshold`` and no part of it scores more.
    """
    triplet, begins, ends = _repeated(seq, window, threshold)
    perfect: list[tuple[int, int, float]] = []
    masked: list[tuple[int, int]] = []
    stretch = -1
    for i in ends.tolist():
        if begins[i] != stretch:
            stretch = int(begins[i])
            perfect.clear()
        oldest = max(stretch, i + 3 - window)
        perfect[:] = [p for p in perfect if p[0] >= oldest - 2]
        counts: dict[int, int] = {}
        score, top = 0, 0.0
        for length, t in enumerate(triplet[oldest : i + 1][::-1].tolist(), 1):
            start = i - 1 - length
            c = counts.get(t, 0)
            score += c
            counts[t] = c + 1
            if length > 1:
                ratio = score / (length - 1)
                if ratio * 2 > threshold and ratio >= top:
                    inside = max((p[2] for p in perfect if p[0] >= start and p[1] <= i + 1), default=0.0)
                    if ratio >= inside:
                        perfect.append((start, i + 1, ratio))
                        masked.append((start, i + 1))
                top = max(top, ratio)
    out: list[list[int]] = []
    for s, e in sorted(masked):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def low_complexity(s: Column, window: int = 40, threshold: int = 4) -> Column:
    """Masked intervals as array of struct(s, e), in Arrow batches."""

    @F.pandas_udf("array<struct<s:int,e:int>>")
    def masked(seqs: pd.Series) -> pd.Series:
        return seqs.map(lambda x: [{"s": a, "e": b} for a, b in dust_intervals(x or "", window, threshold)])

    return masked(s)
