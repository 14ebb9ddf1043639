"""Queries that write text forms and read them again, over rows made of the relational tables, and the rows in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .config import DEFAULT
from .functions import walks as wk
from .operators import intervals, linkage, stats
from .queries import query, t
from .queries_genome import ANCHORS, HITS, STEPS, alignments, anchors, duck, edges, sized, steps
from .shared import place
from .sources import files


def text(spark: SparkSession, lines: DataFrame, kind: str) -> str:
    """The path of a text file of the column ``value``."""
    path = place(spark, kind)
    lines.select("value").write.text(path)
    return path


def written(spark: SparkSession, kind: str, write: Callable[[str], None]) -> DataFrame:
    """The lines a sink writes."""
    path = place(spark, kind)
    write(path)
    return spark.read.text(path)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return steps(spark, d).select(F.col("node").alias("node_id"), "length", F.expr("repeat('A', cast(length as int))").alias("seq")).distinct()


NODES = f"{STEPS}, nodes AS (SELECT DISTINCT node, length FROM steps)"
EDGES = f"{STEPS}, edges AS (SELECT DISTINCT node AS src, nxt AS dst FROM (SELECT node, lead(node) OVER (PARTITION BY path ORDER BY idx) AS nxt FROM steps WHERE fwd) WHERE nxt IS NOT NULL)"


def gfa(spark: SparkSession, d: str) -> str:
    """A graph file by our own writer."""
    path = place(spark, "gfa")
    signed = edges(spark, d).select("src", F.lit(True).alias("src_fwd"), "dst", F.lit(True).alias("dst_fwd"))
    sinks.gfa(nodes(spark, d), signed, steps(spark, d), path)
    return path


@query(duck(f"WITH {NODES} SELECT node AS node_id, length, repeat('A', CAST(length AS INT)) AS seq FROM nodes"))
def gfa_nodes(spark, d):
    return files.gfa_nodes(spark, gfa(spark, d)).withColumn("length", F.col("length").cast("long"))


@query(duck(f"WITH {EDGES} SELECT src, true AS src_fwd, dst, true AS dst_fwd FROM edges"))
def gfa_edges(spark, d):
    return files.gfa_edges(spark, gfa(spark, d))


@query(duck(f"WITH {STEPS} SELECT path, CAST(idx AS INT) AS idx, node, fwd, length FROM steps"))
def gfa_steps(spark, d):
    return files.gfa_steps(spark, gfa(spark, d)).withColumn("length", F.col("length").cast("long"))


@query(duck(f"WITH {NODES} SELECT CAST(length AS INT) AS length, count(*) AS n FROM nodes WHERE length > 1 GROUP BY 1"))
def gfa_length_histogram(spark, d):
    return files.length_histogram(files.gfa_nodes(spark, gfa(spark, d))).withColumn("length", F.col("length").cast("int"))


@query(duck(f"WITH {NODES} SELECT node AS node_id, CAST(length AS INT) AS length FROM nodes WHERE length > 21"))
def gfa_long_nodes(spark, d):
    return files.long_nodes(files.gfa_nodes(spark, gfa(spark, d)), 21).withColumn("length", F.col("length").cast("int"))


#: Alignment lines of every kind: repeated, with too few fields, of low quality, without differences, with two fields more.
GAF = """gaf AS (SELECT o_orderkey AS r, concat('r', CAST(o_orderkey AS VARCHAR(9)), CASE WHEN o_orderkey % 11 = 0 THEN ' a b' ELSE '' END, ' 90 0 90 ', CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE '+' END, ' >', CAST(o_custkey AS VARCHAR(9)), '<7 200 ',
 CASE WHEN o_orderkey % 17 = 0 THEN '99 40' ELSE '3 93' END, ' 90 90 ', CAST(o_orderkey % 4 AS VARCHAR(9)), CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE ' x:i:1' END, ' y:i:2 ', CASE WHEN o_orderkey % 6 = 0 THEN 'cs:Z::' ELSE concat('cs:Z::', CAST(o_custkey AS VARCHAR(9)), '*ag:5') END, ' dv:f:0.', CAST(o_orderkey % 90 + 10 AS VARCHAR(9))) AS value FROM {orders})"""


def gaf_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(f"WITH {GAF} SELECT * FROM gaf", orders=t(spark, d, "orders", "o_orderkey", "o_custkey")).select("value")
    return rows.unionByName(rows)  # every line twice


ACCEPTED = duck(f"{GAF}, good AS (SELECT * FROM gaf JOIN orders ON r = o_orderkey WHERE r % 7 <> 0 AND r % 4 >= 1 AND r % 6 <> 0)")


@query(f"WITH {ACCEPTED} SELECT 'r' || r AS read, CAST(90 AS BIGINT) AS read_length, CASE WHEN r % 5 = 0 THEN '-' ELSE '+' END AS strand, o_custkey || '+,7-' AS nodes, CASE WHEN r % 17 = 0 THEN 99 ELSE 3 END AS path_start, CASE WHEN r % 17 = 0 THEN 40 ELSE 93 END AS path_end, CAST(r % 4 AS INT) AS mapq, ':' || o_custkey || ',*1,:5' AS cs, CAST('0.' || (r % 90 + 10) AS DOUBLE) AS dv FROM good")
def gaf_source(spark, d):
    good, _ = files.gaf(spark, text(spark, gaf_lines(spark, d), "gaf"), DEFAULT)
    walk = F.array_join(F.transform("nodes", lambda n: F.concat(n["id"].cast("string"), F.when(n["fwd"], "+").otherwise("-"))), ",")
    ops = F.array_join(F.transform("cs", lambda x: F.concat(x["op"], x["n"].cast("string"))), ",")
    return good.select("read", "read_length", "strand", walk.alias("nodes"), F.col("path_start").cast("int").alias("path_start"), F.col("path_end").cast("int").alias("path_end"), "mapq", ops.alias("cs"), "dv")


@query(duck(f"WITH {GAF} SELECT value, CASE WHEN r % 7 = 0 THEN 'fields' WHEN r % 4 < 1 THEN 'mapping quality' ELSE 'cs' END AS reason FROM gaf WHERE r % 7 = 0 OR r % 4 < 1 OR r % 6 = 0"))
def gaf_rejects(spark, d):
    _, bad = files.gaf(spark, text(spark, gaf_lines(spark, d), "gaf"), DEFAULT)
    return bad.select("value", "reason")


@query(f"WITH {ACCEPTED} SELECT 'r' || r AS read, CASE WHEN r % 5 = 0 THEN 'strand' ELSE 'path' END AS reason FROM good WHERE r % 5 = 0 OR r % 17 = 0")
def gaf_problems(spark, d):
    good, _ = files.gaf(spark, text(spark, gaf_lines(spark, d), "gaf"), DEFAULT)
    return files.gaf_problems(good).select("read", "reason")


@query(f"WITH {ACCEPTED} SELECT DISTINCT o_custkey AS node_id FROM good WHERE o_custkey % 3 <> 0 UNION SELECT 7")
def gaf_unknown_nodes(spark, d):
    good, _ = files.gaf(spark, text(spark, gaf_lines(spark, d), "gaf"), DEFAULT)
    known = t(spark, d, "customer", "c_custkey").filter("c_custkey % 3 = 0 and c_custkey <> 7").select(F.col("c_custkey").alias("node_id"), F.lit(5).cast("long").alias("length"))
    return files.with_lengths(good, known)[1]


#: 16 columns, or 18 with two more in front of the last.
WIDE = """SELECT value FROM (SELECT concat_ws('\t', concat('r', CAST(o_orderkey AS VARCHAR(9))), '9', '0', '9', '+', '>1', '9', '0', '9', CASE WHEN o_orderkey % 2 = 0 THEN 'u\tv\t9' ELSE '9' END, '9', CAST(o_orderkey % 60 AS VARCHAR(9)), 'a', 'b', 'cs:Z::9', concat('dv:f:0.', CAST(o_orderkey % 90 + 10 AS VARCHAR(9)))) AS value FROM {orders})"""


@query(r"SELECT 'r' || o_orderkey AS read, CAST(o_orderkey % 60 AS INT) AS mapq, CAST('0.' || (o_orderkey % 90 + 10) AS DOUBLE) AS dv FROM orders")
def wide_alignments(spark, d):
    lines = spark.sql(WIDE, orders=t(spark, d, "orders", "o_orderkey"))
    return files.alignment_table(spark, text(spark, lines, "gaf")).select("read", "mapq", "dv")


@query(r"SELECT 'r' || o_orderkey AS read, CAST('0.' || (o_orderkey % 90 + 10) AS DOUBLE) AS dv FROM orders WHERE CAST('0.' || (o_orderkey % 90 + 10) AS DOUBLE) >= 0.5")
def divergent_alignments(spark, d):
    lines = spark.sql(WIDE, orders=t(spark, d, "orders", "o_orderkey"))
    return files.divergent(files.alignment_table(spark, text(spark, lines, "gaf"))).select("read", "dv")


def fasta_lines(spark: SparkSession, d: str) -> str:
    """One file, so that records stand in order: a header and sequence lines of parts of one size."""
    x = t(spark, d, "part", "p_partkey", "p_size")
    lines = F.concat(F.array(F.concat(F.lit(">s"), "p_partkey", F.lit(" size "), "p_size")), F.expr("transform(sequence(1, 1 + p_size % 4), i -> repeat('ACGT', cast(1 + p_size % 3 as int)))"))
    path = place(spark, "fasta")
    x.select("p_partkey", F.posexplode(lines).alias("k", "value")).orderBy("p_partkey", "k").select("value").coalesce(1).write.text(path)
    return path


RECORDS = "records AS (SELECT 's' || p_partkey AS id, repeat('ACGT', CAST((1 + p_size % 4) * (1 + p_size % 3) AS INT)) AS seq FROM part)"


@query(f"WITH {RECORDS} SELECT * FROM records")
def fasta_source(spark, d):
    return files.fasta(spark, fasta_lines(spark, d))


@query(f"WITH {RECORDS} SELECT id AS chrom, length(seq) AS length FROM records")
def chromosome_sizes(spark, d):
    return files.chromosome_sizes(files.fasta(spark, fasta_lines(spark, d)))


@query("SELECT 'p' || p_partkey AS header, repeat('ACGT', CAST(1 + p_size % 3 AS INT)) AS sequence, '+' AS plus_line, '@' || repeat('I', CAST(3 + 4 * (p_size % 3) AS INT)) AS quality FROM part")
def fastq_source(spark, d):
    x = t(spark, d, "part", "p_partkey", "p_size")
    lines = F.array(F.concat(F.lit("@p"), "p_partkey", F.lit("\tmore")), F.expr("repeat('ACGT', cast(1 + p_size % 3 as int))"), F.lit("+"), F.expr("concat('@', repeat('I', cast(3 + 4 * (p_size % 3) as int)))"))
    path = place(spark, "fastq")
    x.select("p_partkey", F.posexplode(lines).alias("k", "value")).orderBy("p_partkey", "k").select("value").coalesce(1).write.text(path)
    return files.fastq(spark, path)


@query("SELECT '@p' || p_partkey || chr(10) || repeat('AC', CAST(p_size AS INT)) || chr(10) || '+' || chr(10) || repeat('I', CAST(2 * p_size AS INT)) AS record FROM part")
def fastq_sink(spark, d):
    reads = t(spark, d, "part", "p_partkey", "p_size").select(F.concat(F.lit("p"), "p_partkey").alias("read"), F.expr("repeat('AC', cast(p_size as int))").alias("seq"), F.expr("repeat('I', cast(2 * p_size as int))").alias("quality"))
    path = place(spark, "fastq")
    sinks.fastq(reads, path)
    back = files.fastq(spark, path)
    return back.select(F.concat_ws("\n", F.concat(F.lit("@"), "header"), "sequence", "plus_line", "quality").alias("record"))


BEDS = """iv AS (SELECT 'chr' || o_custkey % 5 AS chrom, CAST(o_orderkey * 7 AS BIGINT) AS s, CAST(o_orderkey * 7 + 1 + o_custkey % 30 AS BIGINT) AS e FROM orders)"""


def bed_files(spark: SparkSession, d: str) -> list[str]:
    x = t(spark, d, "orders", "o_orderkey", "o_custkey")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("o_custkey") % 5), F.col("o_orderkey") * 7, F.col("o_orderkey") * 7 + 1 + F.col("o_custkey") % 30, F.lit("name"))
    odd = F.col("o_orderkey") % 2
    junk = spark.createDataFrame([("track x",), ("chr1\tx\t5",)], "value string")
    return [text(spark, x.filter(odd == 0).select(line.alias("value")), "bed"), text(spark, x.filter(odd == 1).select(line.alias("value")).unionByName(junk), "bed")]


@query(f'WITH {BEDS} SELECT chrom, s AS start, e AS "end" FROM iv')
def bed_source(spark, d):
    return files.beds(spark, bed_files(spark, d))


@query(f"""WITH {BEDS}, m AS (SELECT *, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM iv WHERE chrom = 'chr3'),
k AS (SELECT *, sum(CASE WHEN far IS NULL OR s > far THEN 1 ELSE 0 END) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
u AS (SELECT min(s) AS s, max(e) AS e FROM k GROUP BY island), g AS (SELECT lag(e, 1, 0) OVER (ORDER BY s) AS s, s AS e FROM u UNION ALL SELECT max(e), 999999 FROM u)
SELECT 'chr3' || chr(9) || s || chr(9) || e AS value FROM g WHERE s < e""")
def gap_bed(spark, d):
    rows = files.beds(spark, bed_files(spark, d), "chr3")
    size = spark.createDataFrame([("chr3", 999999)], "chrom string, length long")
    return written(spark, "gaps", lambda p: sinks.gap_bed(intervals.gaps(rows, "chrom", 0, size), p))


#: Anchor files: matches by order, some items broken.
MATCHES = "m AS (SELECT 'a' || o_custkey AS anchor, 'r' || o_orderkey AS read, CAST(o_orderkey % 2 AS INT) AS strand, CAST(o_orderkey AS BIGINT) AS s, CAST(o_orderkey + 16 AS BIGINT) AS e FROM orders)"


def matches(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "orders", "o_orderkey", "o_custkey")
    return x.select(F.concat(F.lit("a"), "o_custkey").alias("anchor"), F.concat(F.lit("r"), "o_orderkey").alias("read"), (F.col("o_orderkey") % 2).cast("int").alias("strand"), F.col("o_orderkey").cast("long").alias("start"), (F.col("o_orderkey") + 16).cast("long").alias("end"))


@query(f'WITH {MATCHES} SELECT anchor, read, strand, s AS start, e AS "end" FROM m')
def anchor_lines(spark, d):
    path = place(spark, "anchors")
    sinks.anchor_lines(matches(spark, d), path)
    return files.anchors_json(spark, path)


@query(f'WITH {MATCHES} SELECT anchor, read, strand, s AS start, e AS "end" FROM m')
def anchor_document(spark, d):
    lines = written(spark, "anchors", lambda p: sinks.anchor_lines(matches(spark, d), p))
    one = lines.agg(F.concat(F.lit("[\n  "), F.array_join(F.collect_list("value"), ",\n  "), F.lit("\n]")).alias("value"))
    path = place(spark, "document")
    one.coalesce(1).write.text(path)
    return files.anchors_json(spark, path)


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'anchor' ELSE 'read' END AS reason FROM orders WHERE o_orderkey % 3 < 2) GROUP BY 1")
def anchor_rejects(spark, d):
    k = F.col("o_orderkey")
    line = F.when(k % 3 == 0, F.concat(F.lit('["a'), k, F.lit('"]'))).when(k % 3 == 1, F.concat(F.lit('["a'), k, F.lit('",[["r",0,1]]]'))).otherwise(F.concat(F.lit('["a'), k, F.lit('",[["r",0,1,2]]]')))
    _, bad = files.anchors_json_checked(spark, text(spark, t(spark, d, "orders", "o_orderkey").select(line.alias("value")), "anchors"))
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {MATCHES} SELECT anchor, CAST(count(*) AS INT) AS initial, CAST(count(*) FILTER (s % 3 = 0) AS INT) AS final, string_agg(read, ',' ORDER BY read) AS reads FROM m GROUP BY 1")
def coverage_file(spark, d):
    rows = matches(spark, d).select("anchor", "read", "start")
    path = place(spark, "coverage")
    sinks.coverage_json(stats.anchor_coverage(rows, rows.filter("start % 3 = 0")), path)
    return files.coverage_json(spark, path).select("anchor", "initial", "final", F.array_join("reads", ",").alias("reads"))


SIZES = f"{ANCHORS}, sizes AS (SELECT b + allele AS Sentinel_node, site AS snarl_id, inner_length + 2 AS Anchor_length, site * 3 AS Anchor_pos_in_ref_path, walk AS Anchor_path, replace(replace(walk[2:], '>', ','), '<', ',') AS Anchor_nodes_copypaste_bandage, paths AS Paths_associated_with_anchor FROM anchors)"


def placed(spark: SparkSession, d: str) -> DataFrame:
    return anchors(spark, d).withColumn("position", F.col("snarl_id") * 3)


@query(duck(f"WITH {SIZES} SELECT * FROM sizes"))
def sizes_table(spark, d):
    path = place(spark, "sizes")
    sinks.sizes(placed(spark, d), path)
    number = ("Sentinel_node", "snarl_id", "Anchor_length", "Anchor_pos_in_ref_path")
    return files.sizes(spark, path).withColumns({c: F.col(c).cast("long") for c in number})


@query(duck(f"WITH {SIZES} SELECT Anchor_path, snarl_id % 9 AS bp_matched_reads FROM sizes"))
def extended_sizes_table(spark, d):
    path = place(spark, "sizes")
    sinks.sizes(placed(spark, d).withColumn("reads", F.col("snarl_id") % 9), path)
    return files.sizes(spark, path).select("Anchor_path", F.col("bp_matched_reads").cast("long").alias("bp_matched_reads"))


@query(duck(f"WITH {SIZES} SELECT 'Sentinel: ' || Sentinel_node || ' ; Anchor : ' || Anchor_path || ' ; Bandage : ' || Anchor_nodes_copypaste_bandage AS value FROM sizes"))
def anchor_text(spark, d):
    return written(spark, "text", lambda p: sinks.anchor_text(anchors(spark, d), p))


@query(duck(f"WITH {ANCHORS} SELECT node || ',#FF0000' AS value FROM (SELECT b AS node FROM anchors UNION SELECT b + allele FROM anchors UNION SELECT b + 4 FROM anchors WHERE allele = 3 UNION SELECT b + 10 FROM anchors) UNION ALL SELECT 'Node,color'"))
def node_colours(spark, d):
    return written(spark, "colours", lambda p: sinks.node_colours(anchors(spark, d).coalesce(1), p)).distinct()


@query(duck(f"WITH {ANCHORS} SELECT node, count(*) AS n FROM (SELECT b AS node FROM anchors UNION ALL SELECT b + allele FROM anchors UNION ALL SELECT b + 4 FROM anchors WHERE allele = 3 UNION ALL SELECT b + 10 FROM anchors) GROUP BY 1"))
def extended_colours(spark, d):
    lines = written(spark, "colours", lambda p: sinks.node_colours(anchors(spark, d), p, "#e25759", once=False)).filter("value like '%,#e25759'")
    return lines.groupBy(F.split("value", ",")[0].cast("long").alias("node")).agg(F.count("*").alias("n"))


@query(duck(f"WITH {STEPS} SELECT b || ',' || (b + 10) || ',\"[' || (b + 1) || ', ' || (b + 2) || ', ' || (b + 3) || ', ' || (b + 4) || ']\"' AS value FROM sites"))
def boundary_files(spark, d):
    from .queries_genome import bubbles

    return written(spark, "bounds", lambda p: sinks.boundaries(bubbles(spark, d), p))


@query(duck(f"WITH {ANCHORS} SELECT 'chm13' || chr(9) || site * 3 || chr(9) || (site * 3 + inner_length + 2) || chr(9) || walk AS value FROM anchors"))
def anchor_bed(spark, d):
    return written(spark, "bed", lambda p: sinks.anchor_bed(placed(spark, d).withColumn("chromosome", F.lit("chm13")), p))


@query(duck(f"WITH {HITS} SELECT r AS read, least(key0, key1) AS anchor, ok AS sequence_agrees, CASE WHEN ok THEN CAST(CASE WHEN second THEN s0 - 4 - cut ELSE s0 - 3 END AS BIGINT) ELSE -1 END AS cs_left FROM agreed"))
def read_anchor_file(spark, d):
    from .operators import matching

    a = alignments(spark, d)
    path = place(spark, "hits")
    sinks.read_anchor(matching.agreed_hits(matching.walk_hits(a, anchors(spark, d)), a), path)
    back = spark.read.csv(path, header=True)
    return back.select(F.col("read").cast("long").alias("read"), "anchor", F.col("sequence_agrees").cast("boolean").alias("sequence_agrees"), F.coalesce(F.col("cs_left").cast("long"), F.lit(-1)).alias("cs_left"))


@query(f"WITH {ACCEPTED} SELECT 'r' || r || chr(9) || '90' || chr(9) || 'false' || chr(9) || r % 4 || chr(9) || CASE WHEN r % 17 = 0 THEN '99' || chr(9) || '40' ELSE '3' || chr(9) || '93' END AS value FROM good")
def reads_processed(spark, d):
    good, _ = files.gaf(spark, text(spark, gaf_lines(spark, d), "gaf"), DEFAULT)
    f = F.split("value", "\t")
    lines = written(spark, "reads", lambda p: sinks.reads_processed(good, p))
    return lines.select(F.concat_ws("\t", f[0], f[1], f[2], f[3], f[5], f[6]).alias("value"))


EVENTS = "hits AS (SELECT CAST(json_extract_string(props, '$.k') AS INT) AS snarl, user_id AS read, event_type AS allele FROM events), a AS (SELECT snarl, allele, count(*) AS n, count(DISTINCT read) AS r FROM hits GROUP BY 1, 2)"


def hits(spark: SparkSession, d: str) -> DataFrame:
    from .queries import hits as made

    return made(spark, d)


@query(f"WITH {EVENTS} SELECT 'coverage' AS what, snarl, '' AS other, count(DISTINCT read) AS n FROM hits GROUP BY ALL UNION ALL SELECT 'allelic_coverage', snarl, allele, n FROM a")
def coverage_tables(spark, d):
    path = place(spark, "tables")
    sinks.json_tables({k: v for k, v in linkage.snarl_tables(hits(spark, d)).items() if "coverage" in k}, path)
    c, a = spark.read.json(f"{path}/coverage"), spark.read.json(f"{path}/allelic_coverage")
    return c.select(F.lit("coverage").alias("what"), F.col("snarl").cast("int").alias("snarl"), F.lit("").alias("other"), F.col("reads").alias("n")).unionByName(a.select(F.lit("allelic_coverage").alias("what"), F.col("snarl").cast("int").alias("snarl"), F.col("allele").alias("other"), F.col("matches").alias("n")))


@query(f"""WITH {EVENTS}, once AS (SELECT DISTINCT * FROM hits), s AS (SELECT x.snarl AS s1, y.snarl AS s2, x.read, x.allele AS a1, y.allele AS a2 FROM once x JOIN once y ON x.read = y.read AND x.snarl <> y.snarl),
linked AS (SELECT s1, s2, count(DISTINCT read) AS shared FROM s GROUP BY 1, 2 HAVING count(DISTINCT read) >= 3 AND count(DISTINCT a1) > 1 AND count(DISTINCT a2) > 1)
SELECT s1 AS snarl, s2 AS linked, shared FROM linked""")
def common_reads_table(spark, d):
    path = place(spark, "tables")
    sinks.json_tables({"common_reads": linkage.snarl_tables(hits(spark, d))["common_reads"]}, path)
    return spark.read.json(f"{path}/common_reads").select(F.col("snarl").cast("int").alias("snarl"), F.col("linked").cast("int").alias("linked"), "shared")


@query(f"""WITH {EVENTS}, once AS (SELECT DISTINCT * FROM hits), s AS (SELECT x.snarl AS s1, y.snarl AS s2, x.read, x.allele AS a1, y.allele AS a2 FROM once x JOIN once y ON x.read = y.read AND x.snarl < y.snarl),
linked AS (SELECT s1, s2 FROM s GROUP BY 1, 2 HAVING count(DISTINCT read) >= 3 AND count(DISTINCT a1) > 1 AND count(DISTINCT a2) > 1)
SELECT s1, s2, count(DISTINCT a1) AS primary_sets, count(DISTINCT a2) AS other_sets, count(DISTINCT read) AS reads FROM s JOIN linked USING (s1, s2) GROUP BY 1, 2""")
def partitions_table(spark, d):
    parts = linkage.snarl_tables(hits(spark, d))["partitions"]
    reads = F.size(F.array_distinct(F.flatten("primary")))
    return parts.select("s1", "s2", F.size("primary").cast("long").alias("primary_sets"), F.size("other").cast("long").alias("other_sets"), reads.cast("long").alias("reads"))


@query(f"WITH {EVENTS} SELECT snarl, count(DISTINCT read) AS reads FROM hits WHERE allele <> 'view' GROUP BY 1")
def extended_coverage(spark, d):
    return linkage.snarl_coverage(hits(spark, d).filter("allele <> 'view'"))


@query("SELECT 'r' || o_orderkey AS value FROM orders")
def id_list(spark, d):
    return written(spark, "ids", lambda p: sinks.id_list(matches(spark, d), p))


@query("SELECT 16 AS anchor_length, 2 AS anchor_reads, 40 AS dust_window")
def settings_file(spark, d):
    lines = written(spark, "settings", lambda p: sinks.settings(spark, DEFAULT, p))
    return lines.select(*[F.get_json_object("value", f"$.{c}").cast("int").alias(c) for c in ("anchor_length", "anchor_reads", "dust_window")])


@query(duck(f"WITH {NODES} SELECT node, {sized('node')} AS length FROM nodes"))
def parquet_roundtrip(spark, d):
    path = place(spark, "table")
    sinks.table(steps(spark, d).select("node", "length").distinct(), path)
    return spark.read.parquet(path)


@query(duck(f"WITH {ANCHORS} SELECT site AS snarl_id, walk AS extended FROM anchors"))
def inserted_node(spark, d):
    """A node put on an anchor's left and taken off again, by walk direction."""
    w = F.col("walk")
    node = F.struct(F.lit(5).cast("long").alias("id"), F.lit(9).cast("long").alias("length"), F.element_at(w, 1)["fwd"].alias("fwd"))
    grown = wk.inserted(w.cast("array<struct<id:bigint,length:bigint,fwd:boolean>>"), node, True)
    back = F.filter(grown, lambda n: n["id"] != 5)
    both = F.when((F.element_at(grown, 1)["id"] == 5) == F.element_at(w, 1)["fwd"], wk.walk_text(back))
    return anchors(spark, d).select("snarl_id", both.alias("extended"))


@query(duck(f"WITH {STEPS} SELECT path, count(*) AS nodes, CAST(sum(length) AS BIGINT) AS span FROM steps GROUP BY 1"))
def walk_spans(spark, d):
    node = F.struct("idx", F.col("node").alias("id"), "length", "fwd")
    w = steps(spark, d).groupBy("path").agg(F.array_sort(F.collect_list(node)).alias("w"))
    half = F.floor(F.size("w") / 2).cast("int")
    joined = wk.concatenated(F.slice("w", F.lit(1), half + 1), F.slice("w", half + 1, F.size("w")))
    return w.select("path", F.size(joined).cast("long").alias("nodes"), wk.span(joined).alias("span"))
