"""Coverage of snarls, links between snarls by shared reads, and which snarls are reliable.

Input: hits (snarl, read, allele), a row for each match of a read with an allele's anchor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import kept


def snarl_coverage(hits: DataFrame) -> DataFrame:
    return hits.groupBy("snarl").agg(F.count_distinct("read").alias("reads"))


def allelic_coverage(hits: DataFrame) -> DataFrame:
    """Matches of each allele, repeated reads included."""
    return hits.groupBy("snarl", "allele").agg(F.count("*").alias("matches"))


def valid_anchors(hits: DataFrame, more_than: int = 2) -> DataFrame:
    return allelic_coverage(hits).filter(F.col("matches") > more_than)


def zygosity(anchors: DataFrame) -> DataFrame:
    """Anchors (snarl, allele) -> het if a snarl has more than one."""
    return anchors.groupBy("snarl").agg(F.count("*").alias("n")).select("snarl", F.col("n").alias("n_anchors"), F.when(F.col("n") > 1, "het").otherwise("hom").alias("zygosity"))


def _pairs(hits: DataFrame) -> DataFrame:
    """(s1, s2, read, x, y: the alleles the read hits on either side) with s1 < s2.

    Per read, alleles of a snarl are gathered first, so the pairs of a read grow with its snarls, not with its matches.
    """
    per = hits.groupBy("read", "snarl").agg(F.collect_set("allele").alias("alleles"))
    left, right = per.select("read", F.col("snarl").alias("s1"), F.col("alleles").alias("x")), per.select("read", F.col("snarl").alias("s2"), F.col("alleles").alias("y"))
    return left.join(right, "read").filter("s1 < s2")


def _linked(pairs: DataFrame, least: int) -> DataFrame:
    some = lambda c: F.count_distinct(F.get(c, F.lit(0))) > 1
    both = lambda c: F.max(F.size(c)) > 1
    out = pairs.groupBy("s1", "s2").agg(F.count("*").alias("shared"), (some("x") | both("x")).alias("l"), (some("y") | both("y")).alias("r"))
    return out.filter((F.col("shared") >= least) & F.col("l") & F.col("r")).select("s1", "s2", "shared")


def linked_snarls(hits: DataFrame, least: int = 3) -> DataFrame:
    """(s1, s2, shared): snarls that share at least ``least`` reads, which hit two alleles or more on both sides."""
    return _linked(_pairs(hits), least)


def _partitions(pairs: DataFrame, alleles: str) -> DataFrame:
    sets = pairs.select("s1", "s2", "read", F.explode(alleles).alias("allele")).groupBy("s1", "s2", "allele").agg(F.array_sort(F.collect_set("read")).alias("reads"))
    return sets.groupBy("s1", "s2").agg(F.array_sort(F.collect_list("reads")).alias(alleles))


def _parted(hits: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(links, (s1, s2, x, y: how each side parts the shared reads) of linked snarls); reads are paired once."""
    pairs = kept(_pairs(hits))
    links = kept(_linked(pairs, least))
    shared = pairs.join(links.select("s1", "s2"), ["s1", "s2"], "left_semi")
    return links, _partitions(shared, "x").join(_partitions(shared, "y"), ["s1", "s2"])


def compatible_snarls(hits: DataFrame, least: int = 3) -> DataFrame:
    """(s1, s2, compatible) of linked snarls: whether both part their shared reads in the same way."""
    return _parted(hits, least)[1].select("s1", "s2", (F.col("x") == F.col("y")).alias("compatible"))


def matched_partitions(primary: list[set], other: list[set], tolerance: int = 0) -> bool:
    """The same with errors allowed: each set takes the unused partner it shares most with, at most ``tolerance`` apart on either side."""
    if len(primary) != len(other):
        return False
    free = list(other)
    for s in primary:
        if not free:
            return False
        best = max(free, key=lambda o: len(s & o))
        if len(s - best) > tolerance or len(best - s) > tolerance:
            return False
        free.remove(best)
    return True


def _match(tolerance: int):
    @F.pandas_udf("boolean")
    def match(a, b):
        return a.combine(b, lambda x, y: matched_partitions([set(s) for s in x], [set(s) for s in y], tolerance))

    return match


def compatible_within(hits: DataFrame, tolerance: int, least: int = 3) -> DataFrame:
    """As compatible_snarls, with a tolerance; a pair of snarls is a group, of the reads the two share."""
    return _parted(hits, least)[1].select("s1", "s2", _match(tolerance)("x", "y").alias("compatible"))


def reliable_snarls(anchors: DataFrame, compatible: DataFrame, more_than: float = 0.1, add_back_hom: bool = True) -> DataFrame:
    """(snarl, zygosity, n_true, n_linked, reliable) of every snarl with anchors."""
    each = compatible.select(F.explode(F.array("s1", "s2")).alias("snarl"), "compatible")
    votes = each.groupBy("snarl").agg(F.count_if("compatible").alias("n_true"), F.count("*").alias("n_linked"))
    out = zygosity(anchors).join(votes, "snarl", "left").na.fill(0, ["n_true", "n_linked"])
    share = F.when(F.col("n_linked") > 0, F.col("n_true") / F.col("n_linked")).otherwise(0.0)
    ok = share > more_than
    if add_back_hom:
        ok = ok | (F.col("zygosity") == "hom")
    return out.select("snarl", "zygosity", "n_true", "n_linked", ok.alias("reliable"))


def snarl_tables(hits: DataFrame, least: int = 3, tolerance: int = 0) -> dict[str, DataFrame]:
    """The tables kept beside the anchors: coverage, allelic coverage, common reads (both ways), compatibility and partitions."""
    links, parts = _parted(hits, least)
    mirrored = links.select(F.explode(F.array(F.struct(F.col("s1").alias("snarl"), F.col("s2").alias("linked")), F.struct(F.col("s2").alias("snarl"), F.col("s1").alias("linked")))).alias("x"), "shared")
    same = _match(tolerance)("x", "y") if tolerance else F.col("x") == F.col("y")
    return {
        "coverage": snarl_coverage(hits),
        "allelic_coverage": allelic_coverage(hits),
        "common_reads": mirrored.select("x.snarl", "x.linked", "shared"),
        "compatibility": parts.select("s1", "s2", same.alias("compatible")),
        "partitions": parts.select("s1", "s2", F.col("x").alias("primary"), F.col("y").alias("other")),
    }


def subsets(a: Column, b: Column) -> Column:
    """Whether one set of reads lies within the other (the looser comparison of partitions)."""
    return (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
