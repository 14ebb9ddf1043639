"""The three ways in: build a dictionary, find anchors of reads, verify them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..config import DEFAULT, Settings
from ..functions import alignments as al
from ..functions import walks as wk
from ..operators import boundaries, extension, folding, graph, journeys, linkage, matching, quality, stats, traversal, viewer
from ..shared import kept
from ..ship import ship
from ..sources import files


def build(spark: SparkSession, gfa: str, out: str, snarls: DataFrame | None = None, settings: Settings = DEFAULT, extend: bool = False) -> DataFrame:
    """Dictionary of anchors of a graph; ``snarls`` (snarl_id, start, end, inside), or the leaf bubbles found here.

    With ``extend``, bubbles whose boundary nodes are short grow outwards first (boundaries.py).
    """
    nodes, edges, steps = files.gfa_nodes(spark, gfa), files.gfa_edges(spark, gfa), files.gfa_steps(spark, gfa)
    bubbles = snarls if snarls is not None else graph.leaf_bubbles(edges)
    usable = bubbles
    if extend:
        bubbles = widened(bubbles, nodes, edges, settings)
    bubbles = kept(traversal.both_orientations(bubbles))
    touched = steps.join(bubbles.select(F.col("start").alias("node")), "node", "left_semi").select("path").distinct()
    found = traversal.traversals(steps.join(touched, "path", "left_semi"), bubbles)
    anchors = traversal.positioned(traversal.dictionary(found, settings.nodes_in_anchor), steps, settings.reference_name)
    sinks.table(anchors, f"{out}/anchors")
    sinks.table(nodes.drop("seq"), f"{out}/nodes")
    sinks.table(edges, f"{out}/edges")
    anchors = spark.read.parquet(f"{out}/anchors")
    sinks.table(graph.usage(anchors, usable), f"{out}/usage")
    sinks.node_colours(anchors, f"{out}/bandage.csv")
    sinks.sizes(anchors, f"{out}/sizes.tsv")
    sinks.anchor_text(anchors, f"{out}/anchors.txt")
    sinks.anchor_bed(anchors, f"{out}/anchors.bed")
    sinks.boundaries(bubbles.filter("start < end"), f"{out}/forward.csv")
    sinks.boundaries(bubbles.filter("start > end"), f"{out}/reverse.csv")
    return anchors


def widened(bubbles: DataFrame, nodes: DataFrame, edges: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Bubbles with boundaries grown to the anchor length."""
    parts = kept(components(edges))
    of = bubbles.join(parts.withColumnRenamed("node", "start"), "start").select("component", "snarl_id", "start", "end", "inside")
    near = graph.sides(edges).select("node", (F.col("side") == "L").alias("left"), "nbr").join(parts, "node")
    placed = nodes.select(F.col("node_id").alias("node"), "length").join(parts, "node").withColumnRenamed("node", "id")
    return boundaries.extended_boundaries(of, placed, near, settings.anchor_length).select("snarl_id", "start", "end", "inside")


def get_anchors(spark: SparkSession, dictionary: str, alignments: str, fasta: str, out: str, settings: Settings = DEFAULT) -> DataFrame:
    """Anchors of reads: match, keep reliable snarls, extend and merge, prune repeats; every step's tables are written."""
    ship(spark)
    anchors, nodes, edges = (spark.read.parquet(f"{dictionary}/{t}") for t in ("anchors", "nodes", "edges"))
    lines, rejects = files.gaf(spark, alignments, settings)
    lines = kept(lines)
    walked, unknown = files.with_lengths(lines, nodes)
    sinks.settings(spark, settings, f"{out}/settings")
    sinks.table(rejects.select("value", "reason"), f"{out}/rejects")
    if bad := unknown.limit(5).collect():
        raise ValueError(f"nodes that the graph lacks: {[r[0] for r in bad]}")
    sinks.reads_processed(lines, f"{out}/reads_processed.tsv")
    found = kept(matching.agreed_hits(matching.with_strand(matching.walk_hits(walked, anchors)), walked))
    sinks.read_anchor(found, f"{out}/read_anchor.csv")
    sinks.table(matching.match_counts(found), f"{out}/match_counts")
    sinks.table(matching.first_matches(found), f"{out}/matches")
    matches = spark.read.parquet(f"{out}/matches")
    hits = matches.select(F.col("snarl_id").alias("snarl"), "read", F.col("key").alias("allele"))
    valid = kept(linkage.valid_anchors(hits, settings.anchor_reads))
    chosen_hits = hits.join(valid.select("snarl", "allele"), ["snarl", "allele"], "left_semi")
    tables = {k: kept(v) for k, v in linkage.snarl_tables(chosen_hits, settings.linkage, settings.partition_tolerance).items()}
    tables["variant_type"] = anchors.groupBy("snarl_id").agg(al.variant_type(F.col("inner_length")).alias("variant"))
    sinks.json_tables(tables, f"{out}/snarls")
    sinks.table(linkage.reliable_snarls(valid, tables["compatibility"], settings.reliable_fraction, settings.add_back_hom), f"{out}/reliable_snarls")
    reliable = spark.read.parquet(f"{out}/reliable_snarls")
    linked = tables["common_reads"].groupBy("snarl").agg(F.array_sort(F.collect_list("linked")).alias("linked"))
    listed = reliable.join(linked, "snarl", "left").join(linkage.zygosity(valid).select("snarl", "n_anchors"), "snarl")
    sinks.reliable_snarls(listed.withColumnRenamed("snarl", "snarl_id").withColumn("linked", F.coalesce("linked", F.array().cast("array<long>"))), f"{out}/reliable_snarls.tsv")
    good = reliable.filter("reliable").select(F.col("snarl").alias("snarl_id"))
    chosen = valid.select(F.col("snarl").alias("snarl_id"), F.col("allele").alias("key")).join(good, "snarl_id", "left_semi")
    alive, reads = anchors.join(chosen, ["snarl_id", "key"], "left_semi"), matches.join(chosen, ["snarl_id", "key"], "left_semi")
    named = valid.select(F.col("snarl").alias("snarl_id"), F.col("allele").alias("key")).join(anchors.select("snarl_id", "key", wk.walk_text(F.col("walk")).alias("anchor")), ["snarl_id", "key"])
    primary = kept(matches.join(named, ["snarl_id", "key"]).select("anchor", "read", "strand", "start", "end"))
    sinks.anchor_lines(primary, f"{out}/primary.jsonl")
    parts = kept(components(edges))
    of = alive.select("snarl_id", "key", "walk", "paths", F.col("walk")[0]["id"].alias("node")).join(parts, "node").drop("node")
    near = graph.sides(edges).select("node", (F.col("side") == "L").alias("left"), "nbr").join(parts, "node")
    done = folding.extend_components(of, reads, nodes.select(F.col("node_id").alias("node"), "length").join(parts, "node").withColumnRenamed("node", "id"), near, settings)
    sinks.table(done, f"{out}/extended")
    done = spark.read.parquet(f"{out}/extended")
    final = done.filter("dropped_in is null").select("snarl_id", "members", wk.walk_text(F.col("walk")).alias("anchor"), "key", "read", "strand", "start", "end")
    seqs = files.fasta(spark, fasta).select(F.col("id").alias("read"), "seq")
    n = final.groupBy("snarl_id").agg(F.count_distinct("key").alias("n"), F.max(F.size("members")).alias("m"))
    first, last = F.col("walk")[0]["id"], F.element_at("walk", -1)["id"]
    bounds = done.filter("dropped_in is null").select("snarl_id", "key", F.least(first, last).alias("low_id"), F.greatest(first, last).alias("high_id"), F.col("low").alias("occ_low"), F.col("high").alias("occ_high")).distinct()
    apart = kept(extension.independently_extended(bounds.withColumnRenamed("snarl_id", "snarl")).filter("independent").select(F.col("snarl").alias("snarl_id")))
    exempt = n.filter("n = 1 or m > 1").select("snarl_id").unionByName(apart)
    sinks.table(quality.pruned(final, quality.repeated_snarls(final, seqs, exempt, settings)), f"{out}/pruned")
    pruned = spark.read.parquet(f"{out}/pruned")
    sinks.anchor_lines(final, f"{out}/extended.jsonl")
    sinks.anchor_lines(pruned, f"{out}/extended.pruned.jsonl")
    after(done, primary, apart, final, anchors, out)
    return pruned


def after(done: DataFrame, primary: DataFrame, apart: DataFrame, final: DataFrame, anchors: DataFrame, out: str) -> None:
    """What is kept beside the extended anchors: who dropped out where, who extended alone, coverage, sizes and colours."""
    dropped = done.filter("dropped_in is not null").select("snarl_id", F.col("key").alias("anchor"), F.col("dropped_in").alias("iteration"), "read")
    alone = done.filter("dropped_in is null").join(apart, "snarl_id", "left_semi").select("snarl_id", "key", "low", "high", "length", "read")
    hits = final.select(F.col("snarl_id").alias("snarl"), "read", F.col("key").alias("allele"))
    sinks.json_tables({"read_tracker": dropped, "independent": alone, "coverage": linkage.snarl_coverage(hits), "allelic_coverage": linkage.allelic_coverage(hits)}, f"{out}/after")
    sinks.coverage_json(stats.anchor_coverage(primary.select("anchor", "read"), final.select("anchor", "read")), f"{out}/coverage.json")
    whole = done.filter("dropped_in is null").groupBy("snarl_id", "key").agg(F.first("walk").alias("walk"), F.first("length").alias("length"), F.first("paths").alias("paths"), F.count("*").alias("reads"))
    at = anchors.select("key", "position").groupBy("key").agg(F.max("position").alias("position"))
    whole = whole.withColumn("one", F.split("key", r"\+")[0]).join(at.withColumnRenamed("key", "one"), "one", "left")
    sinks.sizes(whole, f"{out}/extended_sizes.tsv")
    sinks.node_colours(whole, f"{out}/extended_bandage.csv", "#e25759", once=False)


def view(spark: SparkSession, anchors: str, sizes: str, out: str) -> None:
    """A viewer's tables from an anchor file and a sizes table: anchors, bubbles, connectivity, reads, and the layout."""
    rows = kept(files.anchors_json(spark, anchors))
    visits = rows.select("read", "anchor", "start")
    snarls = kept(viewer.snarl_anchors(rows, files.sizes(spark, sizes)))
    edges = kept(journeys.journey_edges(visits))
    places = viewer.relaxed_layout(snarls, edges)
    sinks.json_tables({"anchors": viewer.merged_anchors(rows), "snarls": snarls, "connectivity": journeys.connectivity(visits), "reads": viewer.read_info(rows), "nodes": places, "edges": edges}, out)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable, by repeated minima over edges."""
    both = graph.sides(edges).select("node", "nbr").distinct()
    at = kept(both.groupBy("node").agg(F.min("nbr").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        around = both.join(at.select(F.col("node").alias("nbr"), F.col("component").alias("c")), "nbr").groupBy("node").agg(F.min("c").alias("c"))
        hop = at.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = at.join(around, "node").join(hop, "component").select("node", F.least("component", "c", "up").alias("now"), F.col("component").alias("was"))
        new = kept(new)
        at = new.select("node", F.col("now").alias("component"))
        if not new.filter("now <> was").limit(1).count():
            return at


def verify(spark: SparkSession, anchors: str, *fastqs: str) -> dict[str, DataFrame]:
    rows = files.anchors_json(spark, anchors)
    reads = files.fastq(spark, *fastqs).select(F.col("header").alias("read"), F.col("sequence").alias("seq"), "quality")
    return quality.verify(rows, reads)
