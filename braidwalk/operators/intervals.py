"""Interval unions, gaps, and overlaps.  Input: rows (key, start, end), half-open."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union(rows: DataFrame, key: str) -> DataFrame:
    """Merged intervals of a key; those that touch are one."""
    order = Window.partitionBy(key).orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.select(key, "start", "end", F.max("end").over(before).alias("far"))
    marked = marked.withColumn("island", F.count_if(F.col("far").isNull() | (F.col("start") > F.col("far"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def gaps(rows: DataFrame, key: str, low: int | None = None, high: DataFrame | None = None) -> DataFrame:
    """What lies between the merged intervals; with ``low`` also before the first, with ``high`` (key, length) after the last."""
    merged = union(rows, key)
    order = Window.partitionBy(key).orderBy("start")
    out = merged.select(key, F.lag("end", 1, low).over(order).alias("start"), F.col("start").alias("end")).filter("start < end")
    if high is not None:
        last = merged.groupBy(key).agg(F.max("end").alias("start"))
        out = out.unionByName(high.join(last, key, "left").select(key, F.coalesce("start", F.lit(low).cast("long")).alias("start"), F.col("length").alias("end")).filter("start < end"))
    return out


def overlaps(rows: DataFrame, key: str) -> DataFrame:
    """(key, start, end) of intervals that begin before the last accepted one ends; a rejected one does not count further.

    The fold runs over a key's sorted intervals in one row, so a key must fit one (a read's anchors do).
    """
    zero = F.struct(F.lit(None).cast("double").alias("far"), F.array().cast("array<struct<start:double,end:double>>").alias("bad"))

    def step(s, x):
        hit = s["far"].isNotNull() & (x["start"] < s["far"])
        return F.struct(F.when(hit, s["far"]).otherwise(x["end"]).alias("far"), F.when(hit, F.concat(s["bad"], F.array(x))).otherwise(s["bad"]).alias("bad"))

    seq = F.array_sort(F.collect_list(F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))))
    return rows.groupBy(key).agg(seq.alias("seq")).select(key, F.explode(F.aggregate("seq", zero, step)["bad"]).alias("x")).select(key, "x.start", "x.end")
