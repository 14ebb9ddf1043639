"""Command line: build, get-anchors (get_anchors), verify-output (verify_output), plot-stats (plot_stats), view, gaps."""

from __future__ import annotations

import argparse


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="braidwalk")
    sub = p.add_subparsers(dest="what", required=True)
    b = sub.add_parser("build")
    b.add_argument("--graph", required=True)
    b.add_argument("--snarls", help="Parquet table (snarl_id, start, end, inside)")
    b.add_argument("--output-prefix", required=True)
    b.add_argument("--extend", action="store_true", help="grow bubbles whose boundary nodes are short")
    g = sub.add_parser("get-anchors", aliases=["get_anchors"])
    for o in ("dictionary", "alignment", "fasta", "output"):
        g.add_argument(f"--{o}", required=True)
    v = sub.add_parser("verify-output", aliases=["verify_output"])
    v.add_argument("--anchors", required=True)
    v.add_argument("--out-fastq")
    v.add_argument("fastq", nargs="+")
    s = sub.add_parser("plot-stats", aliases=["plot_stats"])
    s.add_argument("--anchors-count", required=True)
    s.add_argument("--output", required=True)
    w = sub.add_parser("view")
    for o in ("anchors", "sizes", "output"):
        w.add_argument(f"--{o}", required=True)
    g = sub.add_parser("gaps")
    g.add_argument("--fasta", required=True)
    g.add_argument("--chromosome", required=True)
    g.add_argument("--output", required=True)
    g.add_argument("bed", nargs="+")
    a = p.parse_args(args)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from . import sinks
    from .operators import intervals, stats
    from .plans import pipelines
    from .sources import files

    spark = SparkSession.builder.appName("braidwalk").getOrCreate()
    if a.what == "build":
        pipelines.build(spark, a.graph, a.output_prefix, spark.read.parquet(a.snarls) if a.snarls else None, extend=a.extend)
    elif a.what.startswith("get"):
        pipelines.get_anchors(spark, a.dictionary, a.alignment, a.fasta, a.output)
    elif a.what.startswith("verify"):
        found = pipelines.verify(spark, a.anchors, *a.fastq)
        for name in ("overlaps", "out_of_range"):
            print(name, found[name].count())
        print("anchors that differ", found["identical"].filter("not identical").count())
        if a.out_fastq:
            sinks.fastq(found["used_reads"], a.out_fastq)
            sinks.id_list(found["used_reads"], f"{a.out_fastq}.id")
    elif a.what == "view":
        pipelines.view(spark, a.anchors, a.sizes, a.output)
    elif a.what == "gaps":
        size = files.chromosome_sizes(files.fasta(spark, a.fasta)).filter(F.col("chrom") == a.chromosome)
        sinks.gap_bed(intervals.gaps(files.beds(spark, a.bed, a.chromosome), "chrom", 0, size), a.output)
    else:
        n = spark.read.parquet(a.anchors_count).groupBy("snarl_id", "key").agg(F.count("*").alias("reads"))
        stats.histogram(n, "reads").orderBy("reads").write.mode("overwrite").csv(a.output, header=True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
