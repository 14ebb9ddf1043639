"""Text sources: GFA, GAF, FASTA, FASTQ, BED, anchor JSON, sizes tables.  Everything is read by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import alignments as al
from ..functions import walks as wk


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, at): ``at`` orders lines as the files do."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return spark.read.text(path).select("value", at.alias("at"))


def gfa_nodes(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t")
    return spark.read.text(path).filter(F.col("value").startswith("S\t")).select(F.get(f, F.lit(1)).try_cast("long").alias("node_id"), F.length(F.get(f, F.lit(2))).try_cast("long").alias("length"), F.get(f, F.lit(2)).alias("seq"))


def length_histogram(nodes: DataFrame) -> DataFrame:
    """(length, n) of nodes of more than one base."""
    return nodes.filter("length > 1").groupBy("length").agg(F.count("*").alias("n"))


def long_nodes(nodes: DataFrame, over: int = 10_000) -> DataFrame:
    return nodes.filter(F.col("length") > over).select("node_id", "length")


def gfa_edges(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t")
    return spark.read.text(path).filter(F.col("value").startswith("L\t")).select(F.get(f, F.lit(1)).try_cast("long").alias("src"), (F.get(f, F.lit(2)) == "+").alias("src_fwd"), F.get(f, F.lit(3)).try_cast("long").alias("dst"), (F.get(f, F.lit(4)) == "+").alias("dst_fwd"))


def gfa_steps(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, node, fwd, length) of W and P lines; steps on nodes that do not exist are left out."""
    f = F.split("value", "\t")
    text = spark.read.text(path)
    w = text.filter(F.col("value").startswith("W\t")).select(F.concat_ws("#", F.get(f, F.lit(1)), F.get(f, F.lit(2)), F.get(f, F.lit(3))).alias("path"), wk.parse_walk(F.get(f, F.lit(6))).alias("w"))
    parts = F.transform(F.split(F.get(f, F.lit(2)), ","), lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).try_cast("long").alias("id"), x.endswith("+").alias("fwd")))
    p = text.filter(F.col("value").startswith("P\t")).select(F.get(f, F.lit(1)).alias("path"), parts.alias("w"))
    steps = w.unionByName(p).select("path", F.posexplode("w").alias("idx", "n")).select("path", "idx", F.col("n.id").alias("node"), F.col("n.fwd").alias("fwd"))
    return steps.join(gfa_nodes(spark, path).select(F.col("node_id").alias("node"), "length"), "node").select("path", "idx", "node", "fwd", "length")


def path_names(steps: DataFrame) -> DataFrame:
    """Names of the embedded paths, in order."""
    return steps.select("path").distinct().orderBy("path")


def gaf(spark: SparkSession, path: str, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(alignments, rejects): distinct lines, first kept; rejects carry a reason."""
    once = lines(spark, path).groupBy(F.trim("value").alias("value")).agg(F.min("at").alias("at"))
    f = al.fields(F.col("value"))
    n = lambda i: F.get("f", F.lit(i))
    rows = once.select("value", "at", f.alias("f"))
    bad = (
        F.when(F.size("f") != settings.gaf_fields, "fields")
        .when(F.coalesce(n(11).try_cast("int"), F.lit(-1)) < settings.map_quality, "mapping quality")
        .when(F.length(n(14)) <= settings.cs_length, "cs")
    )
    rows = rows.withColumn("reason", bad)
    good = rows.filter("reason is null").select(
        "at", n(0).alias("read"), n(1).try_cast("long").alias("read_length"), n(4).alias("strand"), wk.parse_walk(n(5)).alias("nodes"),
        n(7).try_cast("long").alias("path_start"), n(8).try_cast("long").alias("path_end"), n(11).try_cast("int").alias("mapq"), al.parse_cs(n(14)).alias("cs"), al.divergence(n(15)).alias("dv"),
    )
    return good, rows.filter("reason is not null").select("at", "value", "reason")


def alignment_table(spark: SparkSession, path: str) -> DataFrame:
    """(value, read, mapq, dv) of lines with TABs and 16 columns, or 18 of which two stand before the tags."""
    f = F.split(F.trim("value"), "\t")
    rows = spark.read.text(path).filter(F.trim("value") != "").select("value", f.alias("f"))
    return rows.select("value", F.get("f", F.lit(0)).alias("read"), al.column(F.col("f"), 11).try_cast("int").alias("mapq"), al.divergence(al.column(F.col("f"), 15)).alias("dv"))


def divergent(lines_: DataFrame, least: float = 0.5) -> DataFrame:
    return lines_.filter(F.col("dv") >= least)


def gaf_problems(alignments: DataFrame) -> DataFrame:
    """Alignments on the minus strand, or whose path interval is turned."""
    why = F.when(F.col("strand") == "-", "strand").when(F.col("path_end") < F.col("path_start"), "path")
    return alignments.withColumn("reason", why).filter("reason is not null").select("read", "at", "reason")


def with_lengths(alignments: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alignments with walk, unknown nodes): node lengths joined in."""
    steps = alignments.select("at", F.posexplode("nodes").alias("pos", "n")).select("at", "pos", F.col("n.id").alias("node_id"), F.col("n.fwd").alias("fwd"))
    known = steps.join(nodes.select("node_id", "length"), "node_id", "left")
    node = F.struct("pos", F.col("node_id").alias("id"), "length", "fwd")
    walk = known.groupBy("at").agg(F.array_sort(F.collect_list(node)).alias("w"), F.bool_and(F.col("length").isNotNull()).alias("whole"))
    walk = walk.filter("whole").select("at", F.transform("w", lambda x: F.struct(x["id"].alias("id"), x["length"].alias("length"), x["fwd"].alias("fwd"))).alias("walk"))
    return alignments.join(walk, "at"), known.filter("length is null").select("node_id").distinct()


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq); a record's id is its header up to white space.  Records are split at '>' on a line's start."""
    r = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>", "").alias("v")).filter("v <> ''")
    return r.select(F.regexp_extract("v", r"^(\S*)", 1).alias("id"), F.regexp_replace(F.regexp_replace("v", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))


def chromosome_sizes(records: DataFrame) -> DataFrame:
    """(chrom, length) of FASTA records, names whole."""
    return records.groupBy(F.col("id").alias("chrom")).agg(F.sum(F.length("seq")).alias("length"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(value, n): lines by number, from 0, in the order of the files by name and of the lines in them.

    The reader deals the splits of files over its partitions by size, not by place, so rows a split are counted first: a
    line's number is its place in the split and the rows of all splits before.  No row leaves the JVM.
    """
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    rows = spark.read.text(path).select("value", *split, F.monotonically_increasing_id().alias("i"))
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("rows"), F.min("i").alias("least"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    starts = counts.select("file", "block", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("least")).alias("start"))
    return rows.join(F.broadcast(starts), ["file", "block"]).select("value", (F.col("start") + F.col("i")).alias("n"))


def fastq(spark: SparkSession, *paths: str) -> DataFrame:
    """(header, sequence, plus_line, quality); the header ends at the first TAB.  Gzip by file name, as Spark's reader does."""
    out = None
    for p in paths:
        rows = numbered(spark, p).select(F.floor(F.col("n") / 4).alias("record"), (F.col("n") % 4).alias("k"), "value")
        four = rows.groupBy("record").agg(*[F.max(F.when(F.col("k") == i, F.col("value"))).alias(c) for i, c in enumerate(("h", "sequence", "plus_line", "quality"))])
        four = four.select(F.regexp_replace(F.split("h", "\t")[0], "^@", "").alias("header"), "sequence", "plus_line", "quality")
        out = four if out is None else out.unionByName(four)
    return out


def bed(spark: SparkSession, path: str, chrom: str | None = None) -> DataFrame:
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.size(f) >= 3).select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).try_cast("long").alias("start"), F.get(f, F.lit(2)).try_cast("long").alias("end")).filter("start is not null and end is not null")
    return rows.filter(F.col("chrom") == chrom) if chrom else rows


def _anchor_items(spark: SparkSession, path: str) -> DataFrame:
    """(item): each anchor's JSON text.  A line an anchor is read by lines; only a single document is read whole."""
    text = spark.read.text(path).filter(F.trim("value") != "")
    head = text.select(F.regexp_replace("value", r"\s", "").alias("v")).limit(1).collect()
    if head and not head[0]["v"].startswith("[[") and head[0]["v"] not in ("[", "[]"):
        return text.select(F.trim("value").alias("item"))
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "array<string>")).alias("item"))


def anchors_json(spark: SparkSession, path: str) -> DataFrame:
    """(anchor, read, strand, start, end) of an anchor file; reads of a repeated anchor are rows of one anchor."""
    return anchors_json_checked(spark, path)[0]


def anchors_json_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects (item, reason)): items that are no pair, and reads that are no quadruple, are left out and reported."""
    items = _anchor_items(spark, path).withColumn("a", F.from_json("item", "array<string>"))
    reads = items.filter(F.size("a") == 2).select(F.get("a", F.lit(0)).alias("anchor"), F.explode(F.from_json(F.get("a", F.lit(1)), "array<string>")).alias("item"))
    reads = reads.withColumn("r", F.from_json("item", "array<string>"))
    r = lambda i: F.get("r", F.lit(i))
    rows = reads.filter(F.size("r") == 4).select("anchor", r(0).alias("read"), r(1).try_cast("int").alias("strand"), r(2).try_cast("long").alias("start"), r(3).try_cast("long").alias("end"))
    bad = items.filter(F.coalesce(F.size("a"), F.lit(0)) != 2).select("item", F.lit("anchor").alias("reason"))
    return rows, bad.unionByName(reads.filter(F.coalesce(F.size("r"), F.lit(0)) != 4).select("item", F.lit("read").alias("reason")))


def coverage_json(spark: SparkSession, path: str) -> DataFrame:
    """(anchor, initial, final, reads): of a line an anchor, or of one document of maps by anchor."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    if first and '"anchor"' in first[0]["value"]:
        return spark.read.schema("anchor string, initial int, final int, reads array<string>").json(path)
    m = "struct<initial_coverage:map<string,int>,final_coverage:map<string,int>,anchor_reads:map<string,array<string>>>"
    j = spark.read.text(path, wholetext=True).select(F.from_json("value", m).alias("j"))
    out = j.select(F.explode("j.initial_coverage").alias("anchor", "initial"))
    for field, name in (("final_coverage", "final"), ("anchor_reads", "reads")):
        out = out.join(j.select(F.explode(f"j.{field}").alias("anchor", name)), "anchor", "full")
    return out


def beds(spark: SparkSession, paths: list[str], chrom: str | None = None) -> DataFrame:
    """The intervals of several files as one table."""
    out = bed(spark, paths[0], chrom)
    for p in paths[1:]:
        out = out.unionByName(bed(spark, p, chrom))
    return out


def sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)
