"""Column functions over alignment lines: difference strings, tags, coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_cs(tag: Column) -> Column:
    """'cs:Z::6*ag+tt' as array of struct(op, n): a substitution counts 1, ':' its number, the others their letters."""
    parts = F.regexp_extract_all(F.substring(tag, 6, 1 << 30), F.lit(r"([+=-][^:*+=-]*|:[0-9]+|[*]..)"), F.lit(1))
    op = lambda x: F.substring(x, 1, 1)
    n = lambda x: F.when(op(x) == "*", 1).when(op(x) == ":", F.substring(x, 2, 1 << 30).try_cast("int")).otherwise(F.length(x) - 1)
    return F.transform(parts, lambda x: F.struct(op(x).alias("op"), n(x).cast("int").alias("n")))


def fields(line: Column) -> Column:
    """White-space fields of a line; two tokens after the name go if the second is not a number."""
    f = F.split(F.trim(line), r"\s+")
    return F.when(F.get(f, F.lit(1)).rlike(r"^[0-9]+$"), f).otherwise(F.concat(F.slice(f, 1, 1), F.slice(f, F.lit(4), F.greatest(F.size(f) - 3, F.lit(0)))))


def divergence(tag: Column) -> Column:
    return F.substring_index(tag, ":", -1).try_cast("double")


def containing_block(blocks: Column, start: Column, end: Column) -> Column:
    """The block that holds [start, end] and one more matched base, as struct(read_start, read_end, match_limit, cs_left, cs_right)."""
    b = F.get(F.filter(blocks, lambda b: (b["ps"] <= start) & (b["pe"] >= end + 1)), F.lit(0))
    return F.when(
        b.isNotNull(),
        F.struct((b["qs"] + start - b["ps"]).alias("read_start"), (b["qs"] + end - b["ps"]).alias("read_end"), (b["pe"] - b["ps"]).alias("match_limit"), (start - b["ps"]).alias("cs_left"), (b["pe"] - end).alias("cs_right")),
    )


def column(f: Column, i: int, narrow: int = 16) -> Column:
    """Field ``i`` of an alignment's columns: two later where the line has two more in front of the tags."""
    return F.when(F.size(f) > narrow, F.get(f, F.lit(i + 2))).otherwise(F.get(f, F.lit(i)))


def strand_bit(forward: Column) -> Column:
    return F.when(forward, 0).otherwise(1)


def flipped_interval(start: Column, end: Column, length: Column, forward: Column) -> Column:
    """struct(start, end) in read direction."""
    return F.when(forward, F.struct(start.alias("start"), end.alias("end"))).otherwise(F.struct((length - end).alias("start"), (length - start).alias("end")))


def allowed_drops(coverage: Column, iteration: int, floor: int = 9, fraction: float = 0.1) -> Column:
    """Reads that an anchor may lose: none in iteration 0; a fraction above the floor in 1; all above it later."""
    if iteration == 0:
        return F.lit(0)
    spare = coverage - floor
    return F.greatest(F.lit(0), F.least(F.floor(coverage * fraction), spare) if iteration == 1 else spare).cast("int")


def kth_smallest(values: Column, k: Column) -> Column:
    return F.get(F.array_sort(values), k)


def variant_type(lengths: Column) -> Column:
    """Aggregate: SNP or MNP if all alleles have one inner length, by whether it is 1; otherwise INDEL."""
    return F.when(F.count_distinct(lengths) == 1, F.when(F.min(lengths) == 1, "SNP").otherwise("MNP")).otherwise("INDEL")
