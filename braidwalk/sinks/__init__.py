"""Writers: tables as Parquet, and the text forms other tools read."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import walks as wk


def table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def node_colours(anchors: DataFrame, path: str, colour: str = "#FF0000", once: bool = True) -> None:
    """Node,color: each node once, or (as for extended anchors) once an anchor."""
    rows = anchors.select(F.explode("walk").alias("n")).select(F.col("n.id").alias("Node"), F.lit(colour).alias("color"))
    (rows.distinct() if once else rows).write.mode("overwrite").csv(path, header=True)


def anchor_text(anchors: DataFrame, path: str) -> None:
    """A line an anchor for people: its middle node, walk and nodes."""
    w = F.col("walk")
    line = F.format_string("Sentinel: %s ; Anchor : %s ; Bandage : %s", wk.sentinel(w), wk.walk_text(w), wk.id_list(w))
    anchors.select(line.alias("value")).write.mode("overwrite").text(path)


def reads_processed(alignments: DataFrame, path: str) -> None:
    """Ten columns an accepted alignment: name, length, mostly forward, mapping quality, divergence, place, nodes, signs, differences."""
    n = F.col("nodes")
    js = lambda c: F.to_json(c)
    cols = ["read", "read_length", wk.mostly_forward(n).alias("forward"), "mapq", "dv", "path_start", "path_end", js(F.transform(n, lambda x: x["id"])).alias("nodes"), js(F.transform(n, lambda x: x["fwd"])).alias("signs"), js(F.transform("cs", lambda x: F.concat(x["op"], x["n"].cast("string")))).alias("cs")]
    alignments.select(*cols).write.mode("overwrite").csv(path, sep="\t")


def read_anchor(hits: DataFrame, path: str) -> None:
    """Seven columns a walk hit: read, anchor, whether its walk and its sequence agree, and the block that holds it."""
    cols = ["read", F.col("key").alias("anchor"), F.lit(True).alias("walk_agrees"), F.col("m").isNotNull().alias("sequence_agrees"), "m.match_limit", "m.cs_left", "m.cs_right"]
    hits.select(*cols).write.mode("overwrite").csv(path, header=True)


def coverage_json(coverage: DataFrame, path: str) -> None:
    """A JSON line an anchor: initial and final coverage, and its reads."""
    coverage.select("anchor", "initial", "final", "reads").write.mode("overwrite").json(path)


def reliable_snarls(rows: DataFrame, path: str) -> None:
    cols = ["snarl_id", F.col("n_anchors").alias("zygosity"), F.col("reliable").alias("is_reliable"), F.concat(F.lit("["), F.array_join(F.transform("linked", lambda x: x.cast("string")), ", "), F.lit("]")).alias("linked_snarls")]
    rows.select(*cols).write.mode("overwrite").csv(path, sep="\t", header=True)


def json_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines under its name."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def id_list(reads: DataFrame, path: str) -> None:
    """Read names, a line each."""
    reads.select("read").distinct().write.mode("overwrite").text(path)


def sizes(anchors: DataFrame, path: str) -> None:
    w = F.col("walk")
    cols = [
        wk.sentinel(w).alias("Sentinel_node"), "snarl_id", F.col("length").alias("Anchor_length"), F.col("position").alias("Anchor_pos_in_ref_path"),
        wk.walk_text(w).alias("Anchor_path"), wk.id_list(w).alias("Anchor_nodes_copypaste_bandage"), F.array_join("paths", ",").alias("Paths_associated_with_anchor"),
    ]
    if "reads" in anchors.columns:
        cols.append(F.col("reads").alias("bp_matched_reads"))
    anchors.select(*cols).write.mode("overwrite").csv(path, sep="\t", header=True)


def boundaries(bubbles: DataFrame, path: str) -> None:
    inside = F.concat(F.lit("["), F.array_join(F.transform("inside", lambda x: x.cast("string")), ", "), F.lit("]"))
    bubbles.select("start", "end", inside.alias("inside")).write.mode("overwrite").csv(path)


def anchor_lines(anchor_reads: DataFrame, path: str) -> None:
    """A JSON line an anchor: ["walk", [[read, strand, start, end], ...]]."""
    read = F.concat(F.lit("["), F.to_json(F.struct("read")).substr(F.lit(9), F.length(F.to_json(F.struct("read"))) - 9), F.lit(","), F.concat_ws(",", "strand", "start", "end"), F.lit("]"))
    rows = anchor_reads.select("anchor", read.alias("r")).groupBy("anchor").agg(F.array_join(F.array_sort(F.collect_list("r")), ",").alias("r"))
    rows.select(F.concat(F.lit('["'), "anchor", F.lit('",['), "r", F.lit("]]")).alias("value")).write.mode("overwrite").text(path)


def gfa(nodes: DataFrame, edges: DataFrame, steps: DataFrame, path: str) -> None:
    """S, L and W lines; a path named sample#haplotype#contig gives a W line's fields."""
    sign = lambda c: F.when(F.col(c), "+").otherwise("-")
    s = nodes.select(F.lit(0).alias("k"), F.concat_ws("\t", F.lit("S"), F.col("node_id").cast("string"), "seq").alias("value"))
    e = edges.select(F.lit(1).alias("k"), F.concat_ws("\t", F.lit("L"), F.col("src").cast("string"), sign("src_fwd"), F.col("dst").cast("string"), sign("dst_fwd"), F.lit("0M")).alias("value"))
    walk = F.array_sort(F.collect_list(F.struct("idx", F.col("node").alias("id"), "length", "fwd")))
    w = steps.groupBy("path").agg(walk.alias("w")).withColumn("p", F.split("path", "#"))
    w = w.select(F.lit(2).alias("k"), F.concat_ws("\t", F.lit("W"), F.get("p", F.lit(0)), F.coalesce(F.get("p", F.lit(1)), F.lit("0")), F.coalesce(F.get("p", F.lit(2)), F.lit("*")), F.lit("0"), wk.span(F.col("w")).cast("string"), wk.walk_text(F.col("w"))).alias("value"))
    s.unionByName(e).unionByName(w).orderBy("k", "value").select("value").write.mode("overwrite").text(path)


def gap_bed(gaps: DataFrame, path: str) -> None:
    gaps.write.mode("overwrite").csv(path, sep="\t")


def anchor_bed(anchors: DataFrame, path: str) -> None:
    anchors.select("chromosome", "position", (F.col("position") + F.col("length")).alias("end"), wk.walk_text(F.col("walk")).alias("name")).write.mode("overwrite").csv(path, sep="\t")


def fastq(reads: DataFrame, path: str) -> None:
    reads.select(F.concat_ws("\n", F.concat(F.lit("@"), "read"), "seq", F.lit("+"), "quality").alias("value")).write.mode("overwrite").text(path)


def settings(spark: SparkSession, s: Settings, path: str) -> None:
    spark.createDataFrame([(json.dumps(asdict(s)),)], "value string").coalesce(1).write.mode("overwrite").text(path)
