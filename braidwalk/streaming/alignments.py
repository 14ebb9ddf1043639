"""The stateless part of matching over a stream of alignment lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import alignments as al
from ..functions import walks as wk


def accepted_lines(spark: SparkSession, folder: str, settings: Settings = DEFAULT, delay: str = "1 hour") -> DataFrame:
    """Parsed alignments of files as they arrive; equal lines within ``delay`` count once."""
    rows = spark.readStream.text(folder).select(F.trim("value").alias("value"), F.current_timestamp().alias("seen"))
    once = rows.withWatermark("seen", delay).dropDuplicatesWithinWatermark(["value"])
    f = al.fields(F.col("value"))
    n = lambda i: F.get("f", F.lit(i))
    ok = (F.size("f") == settings.gaf_fields) & (n(11).try_cast("int") >= settings.map_quality) & (F.length(n(14)) > settings.cs_length)
    return once.withColumn("f", f).filter(ok).select(n(0).alias("read"), n(1).try_cast("long").alias("read_length"), wk.parse_walk(n(5)).alias("nodes"), n(7).try_cast("long").alias("path_start"), n(8).try_cast("long").alias("path_end"), al.parse_cs(n(14)).alias("cs"))
