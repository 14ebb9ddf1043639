"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in local mode where none is set, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(spark.sparkContext, "_braidwalk_dir", None) or "file://" + tempfile.mkdtemp(prefix="braidwalk-")
        spark.sparkContext._braidwalk_dir = at
    return at


def place(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """Written as a table and read back: cuts lineage, survives lost executors."""
    path = place(df.sparkSession, "g")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """With ``rank``: place from 0 in the order of all rows; ranges are sorted side by side and counted, not in one task."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = kept(spread.withColumns({"_part": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = rows.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + F.col("_i")).drop("_part", "_i", "_start")
