"""Each operator over the relational tables, and the same in SQL.

The tables hold no genomes, so they are read under other names: in ``events`` the bubble is ``props.k``, the read the
user, the allele the event type, the place on the read (ts, event_id); in ``lineitem`` the path is the order, its steps
the lines in a total order, the node the part and its length the part's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import DEFAULT
from .functions import alignments as al
from .functions import sequences as sq
from .functions import walks as wk
from .operators import graph, intervals, journeys, linkage, matching, quality, stats, traversal
from .ship import ship

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet").select(*cols)


def hits(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events", "user_id", "event_type", "props").select(F.get_json_object("props", "$.k").cast("int").alias("snarl"), F.col("user_id").alias("read"), F.col("event_type").alias("allele"))


def visits(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events", "event_id", "ts", "user_id", "event_type", "props")
    anchor = F.concat_ws(":", F.get_json_object("props", "$.k"), "event_type")
    return e.select(F.col("user_id").alias("read"), anchor.alias("anchor"), F.struct("ts", "event_id").alias("start"))


#: The order of a path's steps: line numbers repeat within an order.
STEP = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


def steps(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem", "l_orderkey", "l_returnflag", *STEP)
    parts = t(spark, d, "part", "p_partkey", "p_size")
    order = Window.partitionBy("l_orderkey").orderBy(*STEP)
    j = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.col("l_orderkey").alias("path"), F.row_number().over(order).alias("idx"), F.col("l_partkey").alias("node"), (F.col("l_returnflag") != "R").alias("fwd"), F.col("p_size").alias("length"))


def path_walks(spark: SparkSession, d: str) -> DataFrame:
    """(path, walk) of every order of two lines or more."""
    w = F.array_sort(F.collect_list(F.struct("idx", F.col("node").alias("id"), F.col("length").cast("long").alias("length"), "fwd")))
    got = steps(spark, d).groupBy("path").agg(w.alias("w")).filter(F.size("w") >= DEFAULT.nodes_in_anchor)
    return got.select("path", F.transform("w", lambda n: F.struct(n["id"].alias("id"), n["length"].alias("length"), n["fwd"].alias("fwd"))).alias("walk"))


HITS = "hits AS (SELECT CAST(json_extract_string(props, '$.k') AS INT) AS snarl, user_id AS read, event_type AS allele FROM events)"
VISITS = "visits AS (SELECT user_id AS read, json_extract_string(props, '$.k') || ':' || event_type AS anchor, ts, event_id FROM events), firsts AS (SELECT read, anchor, min(row(ts, event_id)) AS start FROM visits GROUP BY 1, 2)"
STEPS = f"""steps AS (SELECT l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(STEP)}) AS idx,
 l_partkey AS node, l_returnflag <> 'R' AS fwd, p_size AS length FROM lineitem JOIN part ON l_partkey = p_partkey)"""
WALKS = f"""{STEPS}, walks AS (SELECT path, count(*) AS n, list(node ORDER BY idx) AS ids, list(length ORDER BY idx) AS lens, list(fwd ORDER BY idx) AS fwds,
 string_agg(CASE WHEN fwd THEN '>' ELSE '<' END || node, '' ORDER BY idx) AS walk,
 string_agg(CASE WHEN fwd THEN '<' ELSE '>' END || node, '' ORDER BY idx DESC) AS back FROM steps GROUP BY path HAVING count(*) >= 2)"""


@query(f"""WITH {HITS}, once AS (SELECT DISTINCT * FROM hits)
SELECT a.snarl AS s1, b.snarl AS s2, count(DISTINCT a.read) AS shared FROM once a JOIN once b ON a.read = b.read AND a.snarl < b.snarl
GROUP BY 1, 2 HAVING count(DISTINCT a.read) >= 3 AND count(DISTINCT a.allele) > 1 AND count(DISTINCT b.allele) > 1""")
def snarl_linkage(spark, d):
    return linkage.linked_snarls(hits(spark, d), DEFAULT.linkage)


@query(f"WITH {HITS} SELECT snarl, count(DISTINCT read) AS reads FROM hits GROUP BY 1")
def snarl_coverage(spark, d):
    return linkage.snarl_coverage(hits(spark, d))


@query(f"WITH {HITS} SELECT snarl, allele, count(*) AS matches FROM hits GROUP BY 1, 2")
def allelic_coverage(spark, d):
    return linkage.allelic_coverage(hits(spark, d))


@query(f"WITH {HITS} SELECT snarl, allele, count(*) AS matches FROM hits GROUP BY 1, 2 HAVING count(*) > 2")
def valid_anchors(spark, d):
    return linkage.valid_anchors(hits(spark, d), DEFAULT.anchor_reads)


@query(f"""WITH {HITS}, a AS (SELECT snarl, allele FROM hits GROUP BY 1, 2 HAVING count(*) > 2)
SELECT snarl, count(*) AS n_anchors, CASE WHEN count(*) > 1 THEN 'het' ELSE 'hom' END AS zygosity FROM a GROUP BY 1""")
def zygosity(spark, d):
    return linkage.zygosity(linkage.valid_anchors(hits(spark, d), DEFAULT.anchor_reads))


COMPATIBLE = f"""{HITS}, once AS (SELECT DISTINCT * FROM hits), s AS (SELECT a.snarl AS s1, b.snarl AS s2, a.read, a.allele AS a1, b.allele AS a2
 FROM once a JOIN once b ON a.read = b.read AND a.snarl < b.snarl),
linked AS (SELECT s1, s2 FROM s GROUP BY 1, 2 HAVING count(DISTINCT read) >= 3 AND count(DISTINCT a1) > 1 AND count(DISTINCT a2) > 1),
l AS (SELECT s1, s2, list_sort(list(r)) AS p FROM (SELECT s1, s2, a1, list_sort(list(DISTINCT read)) AS r FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2),
r AS (SELECT s1, s2, list_sort(list(r)) AS p FROM (SELECT s1, s2, a2, list_sort(list(DISTINCT read)) AS r FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2),
compatible AS (SELECT s1, s2, l.p = r.p AS compatible FROM linked JOIN l USING (s1, s2) JOIN r USING (s1, s2))"""


@query(f"WITH {COMPATIBLE} SELECT * FROM compatible")
def snarl_compatibility(spark, d):
    return linkage.compatible_snarls(hits(spark, d), DEFAULT.linkage)


@query(f"""WITH {COMPATIBLE}, z AS (SELECT snarl, count(*) AS n FROM (SELECT snarl, allele FROM hits GROUP BY 1, 2 HAVING count(*) > 2) GROUP BY 1),
v AS (SELECT snarl, count(*) FILTER (compatible) AS n_true, count(*) AS n_linked FROM (SELECT s1 AS snarl, compatible FROM compatible UNION ALL SELECT s2, compatible FROM compatible) GROUP BY 1)
SELECT z.snarl, CASE WHEN n > 1 THEN 'het' ELSE 'hom' END AS zygosity, coalesce(n_true, 0) AS n_true, coalesce(n_linked, 0) AS n_linked,
 n = 1 OR coalesce(n_true / nullif(n_linked, 0), 0) > 0.1 AS reliable FROM z LEFT JOIN v ON z.snarl = v.snarl""")
def reliable_snarls(spark, d):
    h = hits(spark, d)
    return linkage.reliable_snarls(linkage.valid_anchors(h, DEFAULT.anchor_reads), linkage.compatible_snarls(h, DEFAULT.linkage), DEFAULT.reliable_fraction, DEFAULT.add_back_hom)


@query("""SELECT l_suppkey AS snarl, l_linenumber AS place, CASE WHEN count(DISTINCT p_size) > 1 THEN 'INDEL' WHEN min(p_size) = 1 THEN 'SNP' ELSE 'MNP' END AS variant
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def variant_type(spark, d):
    j = t(spark, d, "lineitem", "l_suppkey", "l_linenumber", "l_partkey").join(t(spark, d, "part", "p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("l_suppkey").alias("snarl"), F.col("l_linenumber").alias("place")).agg(al.variant_type(F.col("p_size")).alias("variant"))


@query(f"""WITH {VISITS} SELECT a.anchor AS a, b.anchor AS b, count(*) AS common_reads FROM firsts a JOIN firsts b ON a.read = b.read AND a.anchor < b.anchor GROUP BY 1, 2""")
def anchor_connectivity(spark, d):
    return journeys.connectivity(visits(spark, d))


@query(f"WITH {VISITS} SELECT read, string_agg(anchor, ' ' ORDER BY start, anchor) AS journey FROM firsts GROUP BY 1")
def read_journeys(spark, d):
    return journeys.journeys(visits(spark, d)).select("read", F.array_join("journey", " ").alias("journey"))


EDGES = f"""{VISITS}, pairs AS (SELECT anchor, lead(anchor) OVER (PARTITION BY read ORDER BY start, anchor) AS nxt FROM firsts),
edges AS (SELECT least(anchor, nxt) AS a, greatest(anchor, nxt) AS b, count(*) AS weight FROM pairs WHERE nxt IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {EDGES} SELECT * FROM edges")
def journey_edges(spark, d):
    return journeys.journey_edges(visits(spark, d))


@query(f"""WITH {VISITS}, n AS (SELECT read, anchor, lead(anchor) OVER (PARTITION BY read ORDER BY start, anchor) AS nxt FROM firsts)
SELECT DISTINCT read FROM n WHERE (anchor = '1:click' AND nxt = '1:view') OR (anchor = '1:view' AND nxt = '1:click')""")
def edge_reads(spark, d):
    return journeys.edge_reads(visits(spark, d), "1:click", "1:view")


@query(f"WITH {VISITS} SELECT read, anchor, event_id FROM visits WHERE anchor NOT IN (SELECT anchor FROM firsts GROUP BY 1 HAVING count(*) < 12)")
def drop_anchors(spark, d):
    v = visits(spark, d)
    rare = journeys.first_visits(v).groupBy("anchor").count().filter("count < 12")
    return journeys.dropped(v, rare, "anchor").select("read", "anchor", F.col("start.event_id").alias("event_id"))


@query(f"WITH {EDGES} SELECT DISTINCT anchor FROM firsts WHERE anchor IN (SELECT a FROM edges WHERE weight > 2 UNION SELECT b FROM edges WHERE weight > 2)")
def non_isolated(spark, d):
    v = visits(spark, d)
    return journeys.connected_only(v.select("anchor").distinct(), journeys.journey_edges(v).filter("weight > 2"))


@query("SELECT DISTINCT l_partkey AS node FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)")
def unknown_nodes(spark, d):
    asked = t(spark, d, "lineitem", "l_partkey").select(F.col("l_partkey").alias("node"))
    return journeys.unknown(asked, t(spark, d, "part", "p_partkey", "p_size").filter("p_size > 3").select(F.col("p_partkey").alias("node")), "node")


@query(f"WITH {STEPS} SELECT path, CAST(idx AS INT) AS idx, node, CAST(sum(length) OVER (PARTITION BY path ORDER BY idx) AS BIGINT) AS bp_end FROM steps")
def path_coordinates(spark, d):
    return traversal.path_coordinates(steps(spark, d)).select("path", "idx", "node", "bp_end")


@query(f"WITH {WALKS} SELECT path, walk, list_aggregate(ids, 'string_agg', ',') AS nodes, list_count(list_filter(fwds, lambda x: x)) * 2 > n AS forward FROM walks")
def walk_strings(spark, d):
    w = F.col("walk")
    return path_walks(spark, d).select("path", wk.walk_text(w).alias("walk"), wk.id_list(w).alias("nodes"), wk.mostly_forward(w).alias("forward"))


@query(f"WITH {WALKS} SELECT least(walk, back) AS walk, count(*) AS n, min(path) AS first_path FROM walks GROUP BY 1")
def canonical_walks(spark, d):
    return path_walks(spark, d).groupBy(wk.canonical(F.col("walk")).alias("walk")).agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


@query(f"WITH {WALKS} SELECT path, ids[CASE WHEN fwds[1] THEN (n - 1) // 2 + 1 ELSE n - (n + 1) // 2 + 1 END] AS sentinel FROM walks")
def sentinels(spark, d):
    return path_walks(spark, d).select("path", wk.sentinel(F.col("walk")).alias("sentinel"))


@query(f"""WITH {WALKS} SELECT path, coalesce(CAST(list_sum(lens[2:n-1]) AS BIGINT), 0) AS inner_length, least(ids[1], ids[n]) AS start_id, greatest(ids[1], ids[n]) AS end_id,
 coalesce(CAST(list_sum(lens[2:n-1]) AS BIGINT), 0) + CASE WHEN lens[1] = 1 THEN 0 ELSE 1 END + CASE WHEN lens[n] = 1 THEN 0 ELSE 1 END AS length FROM walks""")
def anchor_bp_length(spark, d):
    w = F.col("walk")
    return path_walks(spark, d).select("path", wk.inner_length(w).alias("inner_length"), wk.anchor_length(w).alias("length"), wk.boundary(w)["start"].alias("start_id"), wk.boundary(w)["end"].alias("end_id"))


def tags(spark, d):
    """Difference tags made of line items: equal, substitution, insertion, equal, deletion."""
    lines = t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    n = lambda c: F.col(c).cast("int").cast("string")
    tag = F.concat(F.lit("cs:Z::"), n("l_quantity"), F.lit("*ag+"), F.expr("repeat('t', l_linenumber)"), F.lit(":"), n("l_suppkey"), F.lit("-"), F.expr("repeat('c', cast(l_discount * 100 as int))"), F.lit(":7:"), n("l_linenumber"))
    return lines.withColumn("tag", tag)


TAGS = """tags AS (SELECT *, 'cs:Z::' || CAST(floor(l_quantity) AS INT) || '*ag+' || repeat('t', l_linenumber) || ':' || l_suppkey || '-' || repeat('c', CAST(floor(l_discount * 100) AS INT)) || ':7:' || l_linenumber AS tag FROM lineitem)"""


@query(f"""WITH {TAGS}, x AS (SELECT unnest(regexp_extract_all(substr(tag, 6), '([+=-][^:*+=-]*|:[0-9]+|[*]..)', 1)) AS x FROM tags)
SELECT x[1] AS op, CASE WHEN x[1] = '*' THEN 1 WHEN x[1] = ':' THEN TRY_CAST(x[2:] AS INT) ELSE length(x) - 1 END AS n, count(*) AS times FROM x GROUP BY 1, 2""")
def cs_parse(spark, d):
    ops = tags(spark, d).select(F.explode(al.parse_cs(F.col("tag"))).alias("x"))
    return ops.groupBy(F.col("x.op").alias("op"), F.col("x.n").cast("long").alias("n")).agg(F.count("*").alias("times"))


@query(f"""WITH {WALKS}, x AS (SELECT path, generate_subscripts(ids, 1) AS i, ids, fwds FROM walks) SELECT path, i AS place, ids[i] AS id, fwds[i] AS fwd FROM x""")
def walk_parse(spark, d):
    text = path_walks(spark, d).select("path", wk.walk_text(F.col("walk")).alias("text"))
    return text.select("path", F.posexplode(wk.parse_walk(F.col("text"))).alias("i", "n")).select("path", (F.col("i") + 1).cast("long").alias("place"), "n.id", "n.fwd")


@query(f"""WITH {STEPS}, b AS (SELECT *, sum(length) OVER (PARTITION BY path ORDER BY idx) - length AS ps FROM steps),
w AS (SELECT path, max(ps) + 1 AS stop FROM b GROUP BY 1), a AS (SELECT path, s, s + 5 AS e FROM w, unnest(generate_series(0, CAST(stop AS BIGINT), 11)) AS u(s))
SELECT a.path, a.s AS start, CAST(a.s + 3 * (b.idx - 1) AS BIGINT) AS read_start, CAST(a.s - b.ps AS BIGINT) AS cs_left, CAST(b.ps + b.length - a.e AS BIGINT) AS cs_right
FROM a JOIN b ON a.path = b.path AND b.ps <= a.s AND b.ps + b.length >= a.e + 1""")
def block_containment(spark, d):
    ops = F.array_sort(F.collect_list(F.struct("idx", "length")))
    cs = F.flatten(F.transform("o", lambda x: F.array(F.struct(F.lit(":").alias("op"), x["length"].cast("int").alias("n")), F.struct(F.lit("+").alias("op"), F.lit(3).alias("n")))))
    rows = steps(spark, d).groupBy("path").agg(ops.alias("o"), (F.sum("length") - F.max_by("length", "idx") + 1).alias("stop"))
    lines = rows.select(F.col("path").alias("at"), "stop", cs.alias("cs"), F.lit(0).alias("path_start"))
    rows = lines.drop("cs", "path_start").join(matching.equal_blocks(lines), "at").withColumnRenamed("at", "path")
    rows = rows.select("path", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stop"), F.lit(11).cast("long"))).alias("start"))
    got = rows.withColumn("m", al.containing_block(F.col("blocks"), F.col("start"), F.col("start") + 5)).filter("m is not null")
    return got.select("path", "start", "m.read_start", "m.cs_left", "m.cs_right")


DROPS = "greatest(0, least(CAST(floor(n * 0.1) AS BIGINT), n - 9))"


@query(f"""WITH s AS (SELECT l_suppkey, count(*) AS n, list_sort(list(CAST(floor(l_quantity) AS INT))) AS q FROM lineitem GROUP BY 1)
SELECT l_suppkey AS anchor, CAST({DROPS} AS INT) AS drops, q[CAST({DROPS} AS INT) + 1] AS available FROM s""")
def kth_available_bp(spark, d):
    g = t(spark, d, "lineitem", "l_suppkey", "l_quantity").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.collect_list(F.col("l_quantity").cast("int")).alias("q"))
    drops = al.allowed_drops(F.col("n"), 1, DEFAULT.read_floor, DEFAULT.drop_fraction)
    return g.select(F.col("l_suppkey").alias("anchor"), drops.alias("drops"), al.kth_smallest(F.col("q"), drops).alias("available"))


@query("""WITH a AS (SELECT o_custkey AS anchor, count(*) AS n FROM orders GROUP BY 1)
SELECT anchor, 0 AS drops_0, CAST(greatest(0, least(CAST(floor(n * 0.1) AS BIGINT), n - 9)) AS INT) AS drops_1, CAST(greatest(0, n - 9) AS INT) AS drops_2 FROM a""")
def allowed_read_drops(spark, d):
    g = t(spark, d, "orders", "o_custkey").groupBy(F.col("o_custkey").alias("anchor")).agg(F.count("*").alias("n"))
    return g.select("anchor", *[al.allowed_drops(F.col("n"), i, DEFAULT.read_floor, DEFAULT.drop_fraction).alias(f"drops_{i}") for i in range(3)])


@query("""WITH r AS (SELECT l_suppkey AS anchor, CAST(floor(l_quantity) AS INT) AS l, l_linenumber AS r FROM lineitem),
c AS (SELECT anchor, o, count(*) AS n FROM r, unnest(generate_series(0, 10)) AS u(o) WHERE l >= o AND r >= 10 - o GROUP BY 1, 2)
SELECT anchor, CAST(arg_max(o, row(n, o)) AS INT) AS left_bases, max(n) AS reads FROM c GROUP BY 1 HAVING max(n) >= 3""")
def best_offset(spark, d):
    from .operators.extension import best_offsets

    reads = t(spark, d, "lineitem", "l_suppkey", "l_quantity", "l_linenumber").select(F.col("l_suppkey").alias("anchor"), F.col("l_quantity").cast("int").alias("left"), F.col("l_linenumber").alias("right"))
    anchors = reads.select("anchor").distinct().select("anchor", F.lit(6).alias("length"), F.lit(100).alias("free_left"), F.lit(100).alias("free_right"))
    return best_offsets(anchors, reads, DEFAULT.anchor_length, DEFAULT.independent_reads).select("anchor", F.col("offset").alias("left_bases"), "reads")


SPANS = "iv AS (SELECT o_custkey AS key, CAST(epoch(o_orderdate) AS BIGINT) // 86400 AS s, CAST(epoch(o_orderdate) AS BIGINT) // 86400 + 20 + o_orderkey % 50 AS e FROM orders)"
ISLANDS = f"""{SPANS}, m AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM iv),
k AS (SELECT *, sum(CASE WHEN far IS NULL OR s > far THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
u AS (SELECT key, min(s) AS s, max(e) AS e FROM k GROUP BY key, island)"""


def spans(spark, d):
    o = t(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    day = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400)
    return o.select(F.col("o_custkey").alias("key"), day.alias("start"), (day + 20 + F.col("o_orderkey") % 50).alias("end"))


@query(f'WITH {ISLANDS} SELECT key, s AS "start", e AS "end" FROM u')
def interval_union(spark, d):
    return intervals.union(spans(spark, d), "key")


@query(f"""WITH {ISLANDS}, g AS (SELECT key, lag(e, 1, 0) OVER (PARTITION BY key ORDER BY s) AS s, s AS e FROM u)
SELECT key, s AS "start", e AS "end" FROM g WHERE s < e UNION ALL SELECT c_custkey, coalesce(max(e), 0), 20000 FROM customer LEFT JOIN u ON key = c_custkey GROUP BY c_custkey HAVING coalesce(max(e), 0) < 20000""")
def interval_gaps(spark, d):
    ends = t(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("key"), F.lit(20000).cast("long").alias("length"))
    return intervals.gaps(spans(spark, d), "key", 0, ends)


@query(f"""WITH RECURSIVE {SPANS}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s, e) AS r FROM iv),
f AS (SELECT key, r, s, e, e AS far, false AS bad FROM o WHERE r = 1 UNION ALL
 SELECT o.key, o.r, o.s, o.e, CASE WHEN o.s < f.far THEN f.far ELSE o.e END, o.s < f.far FROM f JOIN o ON o.key = f.key AND o.r = f.r + 1)
SELECT key, s AS "start", e AS "end" FROM f WHERE bad""")
def overlap_check(spark, d):
    out = intervals.overlaps(spans(spark, d), "key")
    return out.select("key", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("SELECT doc_id, translate(reverse(regexp_replace(text, '[^ACGT]', '', 'g')), 'ACGT', 'TGCA') AS strict, translate(reverse(text), 'ACGTacgt', 'TGCAtgca') AS kept FROM documents")
def reverse_complement(spark, d):
    return t(spark, d, "documents", "doc_id", "text").select("doc_id", sq.reverse_complement_strict(F.col("text")).alias("strict"), sq.reverse_complement(F.col("text")).alias("kept"))


@query("""SELECT doc_id, substr(CASE WHEN doc_id % 2 = 1 THEN translate(reverse(text), 'ACGTacgt', 'TGCAtgca') ELSE text END, CAST(doc_id % 17 AS INT) + 1, 40) AS piece FROM documents""")
def subsequence(spark, d):
    start = (F.col("doc_id") % 17).cast("int")
    return t(spark, d, "documents", "doc_id", "text").select("doc_id", sq.subsequence(F.col("text"), start, start + 40, F.col("doc_id") % 2).alias("piece"))


#: Documents with one text are an anchor's reads; its bases are those of the text's turned or straight middle.
PIECES = """reads AS (SELECT doc_id AS read, text AS seq, doc_id % 2 AS strand, 5 + length(source || lang) AS s, source || ':' || lang || ':' || (length(text) // 40) AS anchor FROM documents),
pieces AS (SELECT anchor, read, s, strand, length(seq) AS n, substr(CASE WHEN strand = 1 THEN translate(reverse(seq), 'ACGTacgt', 'TGCAtgca') ELSE seq END, CAST(s + 1 AS INT), 30) AS piece FROM reads)"""


def anchor_reads(spark, d):
    x = t(spark, d, "documents", "doc_id", "text", "source", "lang").select(F.col("doc_id").alias("read"), F.col("text").alias("seq"), (F.col("doc_id") % 2).cast("int").alias("strand"), "source", "lang")
    s = F.lit(5) + F.length(F.concat("source", "lang"))
    anchor = F.concat_ws(":", "source", "lang", F.floor(F.length("seq") / 40).cast("string"))
    rows = x.select(anchor.alias("anchor"), "read", "strand", s.cast("long").alias("start"), (s + 30).cast("long").alias("end"))
    return rows, x.select("read", "seq")


@query(f"WITH {PIECES} SELECT anchor, count(DISTINCT piece) = 1 AS identical, count(*) AS reads FROM pieces GROUP BY 1")
def sequence_identity(spark, d):
    return quality.identical(quality.sequences_of(*anchor_reads(spark, d)))


@query(f"WITH {PIECES} SELECT anchor, read, strand, s AS start, s + 30 AS \"end\", CAST(n AS INT) AS read_length FROM pieces WHERE s >= n OR s + 30 > n")
def out_of_range(spark, d):
    return quality.out_of_range(quality.sequences_of(*anchor_reads(spark, d)))


@query(f"WITH {PIECES} SELECT DISTINCT read, length(seq) AS bases FROM reads")
def used_reads(spark, d):
    rows, reads = anchor_reads(spark, d)
    return quality.used_reads(rows, reads).select("read", F.length("seq").cast("long").alias("bases"))


@query(f"WITH {HITS}, a AS (SELECT snarl, allele, count(DISTINCT read) AS coverage FROM hits GROUP BY 1, 2) SELECT coverage, count(*) AS n FROM a GROUP BY 1")
def coverage_histogram(spark, d):
    a = hits(spark, d).groupBy("snarl", "allele").agg(F.count_distinct("read").alias("coverage"))
    return stats.histogram(a, "coverage")


@query(f"""WITH {HITS}, a AS (SELECT snarl, allele, count(DISTINCT read) AS c FROM hits GROUP BY 1, 2)
SELECT CASE WHEN c < 1 THEN '0' WHEN c < 5 THEN '1-5' WHEN c < 10 THEN '5-10' WHEN c < 20 THEN '10-20' WHEN c < 40 THEN '20-40' WHEN c < 60 THEN '40-60' WHEN c < 100 THEN '60-100' WHEN c < 1000 THEN '100-1000' ELSE '>=1000' END AS bucket,
 count(*) AS n, min(snarl) AS first_snarl FROM a GROUP BY 1""")
def range_buckets(spark, d):
    a = hits(spark, d).groupBy("snarl", "allele").agg(F.count_distinct("read").alias("c"))
    return a.groupBy(stats.range_label(F.col("c"), DEFAULT.ranges).alias("bucket")).agg(F.count("*").alias("n"), F.min("snarl").alias("first_snarl"))


@query(f"""WITH {HITS}, a AS (SELECT snarl, count(DISTINCT read) AS c FROM hits GROUP BY 1) SELECT avg(c) AS mean, quantile_cont(c, 0.5) AS median, min(c) AS low, max(c) AS high FROM a""")
def coverage_stats(spark, d):
    return stats.summary(linkage.snarl_coverage(hits(spark, d)), "reads")


@query(f"""WITH {HITS}, a AS (SELECT snarl, count(*) AS x, count(DISTINCT read) AS y FROM hits GROUP BY 1) SELECT count(*) AS anchors, avg(y - x) AS mean_change FROM a""")
def coverage_change(spark, d):
    h = hits(spark, d)
    return stats.coverage_change(h.groupBy("snarl").agg(F.count("*").alias("coverage")).withColumnRenamed("snarl", "anchor"), linkage.snarl_coverage(h).select(F.col("snarl").alias("anchor"), F.col("reads").alias("coverage")))


@query("SELECT p_size AS length, count(*) AS n FROM part GROUP BY 1")
def length_histogram(spark, d):
    return stats.histogram(t(spark, d, "part", "p_size").withColumnRenamed("p_size", "length"), "length")


@query("SELECT l_linenumber AS mapq, count(*) AS n, quantile_cont(l_discount, 0.25) AS q1, quantile_cont(l_discount, 0.5) AS q2, quantile_cont(l_discount, 0.75) AS q3 FROM lineitem GROUP BY 1")
def mapq_distribution(spark, d):
    rows = t(spark, d, "lineitem", "l_linenumber", "l_discount").withColumnRenamed("l_linenumber", "mapq")
    return stats.spread_by(rows, "mapq", "l_discount").select("mapq", "n", *[F.round(c, 9).alias(c) for c in ("q1", "q2", "q3")])


ORACLES["mapq_distribution"] = "SELECT mapq, n, round(q1, 9) AS q1, round(q2, 9) AS q2, round(q3, 9) AS q3 FROM (" + ORACLES["mapq_distribution"] + ")"


@query("""WITH v AS (SELECT l_partkey, count(*) AS c FROM lineitem GROUP BY 1 HAVING count(*) >= 5) SELECT count(*) AS nodes, CAST(sum(p_size) AS BIGINT) AS bases FROM v JOIN part ON l_partkey = p_partkey""")
def node_coverage(spark, d):
    return stats.covered_bases(t(spark, d, "lineitem", "l_partkey").withColumnRenamed("l_partkey", "node"), t(spark, d, "part", "p_partkey", "p_size").toDF("node", "length"))


@query("""SELECT l_suppkey AS snarl, count(*) > 1 AND count(DISTINCT row(l_partkey, l_quantity)) > 1 AS independent FROM lineitem GROUP BY 1""")
def independent_extension(spark, d):
    from .operators.extension import independently_extended

    rows = t(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_quantity").select(F.col("l_suppkey").alias("snarl"), F.col("l_partkey").alias("low_id"), F.col("l_partkey").alias("high_id"), F.col("l_quantity").alias("occ_low"), F.col("l_quantity").alias("occ_high"))
    return independently_extended(rows)


@query("""SELECT l_suppkey AS snarl, min(l_partkey) AS low_id, CAST(arg_min(l_quantity, row(l_partkey, -l_quantity)) AS INT) AS occ_low, max(l_partkey) AS high_id, CAST(arg_max(l_quantity, row(l_partkey, l_quantity)) AS INT) AS occ_high FROM lineitem GROUP BY 1""")
def outer_boundaries(spark, d):
    from .operators.extension import outer_boundaries as outer

    rows = t(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_quantity").select(F.col("l_suppkey").alias("snarl"), F.col("l_partkey").alias("low_id"), F.col("l_partkey").alias("high_id"), F.col("l_quantity").cast("int").alias("occ_low"), F.col("l_quantity").cast("int").alias("occ_high"))
    return outer(rows)


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)
SELECT node, side, count(*) AS degree, min(nbr) AS neighbour FROM (SELECT src AS node, 'R' AS side, dst AS nbr FROM e UNION ALL SELECT dst, 'L', src FROM e) GROUP BY 1, 2""")
def node_degrees(spark, d):
    e = t(spark, d, "lineitem", "l_suppkey", "l_partkey").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return graph.degrees(e.select("src", F.lit(True).alias("src_fwd"), "dst", F.lit(True).alias("dst_fwd")))


@query()
def low_complexity(spark, d):
    rows = t(spark, d, "documents", "doc_id", "text").select("doc_id", sq.low_complexity(F.translate(F.upper("text"), "EILN", "ACGT")).alias("x"))
    return rows.select("doc_id", F.size("x").alias("n_intervals"), F.aggregate("x", F.lit(0), lambda s, i: s + i["e"] - i["s"]).alias("masked"))


#: Reads of anchors that a node beyond the boundary may take in: order lines; the bubble is the supplier.
NODE_READS = """reads AS (SELECT l_suppkey AS snarl, CAST(l_linenumber % 3 AS INT) AS anchor, l_orderkey * 10 + l_linenumber AS read, CAST(l_orderkey % 2 AS INT) AS strand, l_orderkey AS s, l_orderkey + 2 AS e,
 CAST(l_quantity AS INT) AS cl, CAST(51 - l_quantity AS INT) AS cr, 1 + l_suppkey % 5 AS b, 1 + l_suppkey % 4 AS n FROM lineitem),
r AS (SELECT *, (b + 1) // 2 + n // 2 + 1 AS added, CASE WHEN strand = 0 THEN cl ELSE cr END >= (b + 1) // 2 + n // 2 + 1 AS fits FROM reads),
able AS (SELECT snarl, anchor FROM r GROUP BY 1, 2 HAVING count(*) FILTER (fits) >= count(*) * 0.9), grown AS (SELECT snarl FROM able GROUP BY 1 HAVING count(*) >= 2)"""


@query(f"""WITH {NODE_READS} SELECT r.snarl, r.anchor, read, strand, s - added + 1 AS start, e AS "end", cl - CASE WHEN strand = 0 THEN added - 1 ELSE 0 END AS cs_left, cr - CASE WHEN strand = 0 THEN 0 ELSE added - 1 END AS cs_right, true AS extended
FROM r JOIN able ON r.snarl = able.snarl AND r.anchor = able.anchor JOIN grown ON grown.snarl = r.snarl WHERE fits UNION ALL SELECT snarl, anchor, read, strand, s, e, cl, cr, false FROM r WHERE snarl NOT IN (FROM grown)""")
def extended_into_node(spark, d):
    from .operators.extension import extended_into_node as grow

    x = t(spark, d, "lineitem", "l_suppkey", "l_linenumber", "l_orderkey", "l_quantity")
    q = F.col("l_quantity").cast("int")
    reads = x.select(F.col("l_suppkey").alias("snarl"), (F.col("l_linenumber") % 3).cast("int").alias("anchor"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read"), (F.col("l_orderkey") % 2).cast("int").alias("strand"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + 2).alias("end"), q.cast("long").alias("cs_left"), (51 - q).cast("long").alias("cs_right"))
    s = reads.select("snarl").distinct()
    return grow(reads, s.select("snarl", (1 + F.col("snarl") % 5).alias("boundary_length"), (1 + F.col("snarl") % 4).alias("node_length")), True)


@query("""WITH s AS (SELECT l_orderkey AS k, coalesce(list(DISTINCT l_linenumber % 3) FILTER (l_returnflag = 'R'), []) AS a, coalesce(list(DISTINCT l_linenumber % 3) FILTER (l_returnflag <> 'R'), []) AS b FROM lineitem GROUP BY 1)
SELECT k AS read, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 OR len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS subset FROM s""")
def read_subsets(spark, d):
    x = t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").withColumn("m", F.col("l_linenumber") % 3)
    g = x.groupBy(F.col("l_orderkey").alias("read")).agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("m"))).alias("a"), F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("m"))).alias("b"))
    return g.select("read", linkage.subsets(F.col("a"), F.col("b")).alias("subset"))


@query("SELECT doc_id, substr(text, 1, CAST(doc_id % 7 AS INT)) || substr(text, CAST(doc_id % 7 + 6 AS INT), 10) || substr(text, CAST(doc_id % 7 + 20 AS INT)) AS kept FROM documents")
def outside_intervals(spark, d):
    at = (F.col("doc_id") % 7).cast("int")
    iv = F.array(F.struct((at + 15).alias("s"), (at + 19).alias("e")), F.struct(at.alias("s"), (at + 4).alias("e")), F.struct((at + 2).alias("s"), (at + 5).alias("e")))
    return t(spark, d, "documents", "doc_id", "text").select("doc_id", sq.outside(F.col("text"), iv).alias("kept"))


#: Anchors of a bubble whose pieces are alike outside low complexity: here no piece has any, so alike at all.
@query("""WITH r AS (SELECT p_size AS snarl_id, p_brand AS anchor, min(p_partkey) AS read FROM part GROUP BY 1, 2), s AS (SELECT snarl_id, anchor, CASE WHEN read % 3 = 0 THEN 'ACGTTGCA' ELSE 'ACGT' || lpad(bin(read), 16, '0') END AS piece FROM r WHERE snarl_id % 5 <> 0)
SELECT DISTINCT snarl_id FROM (SELECT snarl_id, piece FROM s GROUP BY 1, 2 HAVING count(*) > 1)""")
def repeated_snarls(spark, d):
    p = t(spark, d, "part", "p_partkey", "p_size", "p_brand")
    piece = F.when(F.col("p_partkey") % 3 == 0, "ACGTTGCA").otherwise(F.concat(F.lit("ACGT"), F.lpad(F.bin("p_partkey"), 16, "0")))
    reads = p.select(F.col("p_partkey").alias("read"), piece.alias("seq"))
    rows = p.select(F.col("p_size").alias("snarl_id"), F.col("p_brand").alias("anchor"), F.col("p_partkey").alias("read"), F.lit(0).alias("strand"), F.lit(0).cast("long").alias("start"), F.when(F.col("p_partkey") % 3 == 0, 8).otherwise(20).cast("long").alias("end"))
    exempt = p.filter("p_size % 5 = 0").select(F.col("p_size").alias("snarl_id")).distinct()
    return quality.repeated_snarls(rows, reads, exempt)


@query("SELECT l_suppkey AS snarl, min(l_quantity) < 16 AS short, count(DISTINCT l_linenumber) > 1 AS het FROM lineitem GROUP BY 1")
def extension_gate(spark, d):
    x = t(spark, d, "lineitem", "l_suppkey", "l_linenumber", "l_quantity")
    from .operators.extension import gate

    return gate(x.select(F.col("l_suppkey").alias("snarl"), F.col("l_linenumber").alias("key"), F.col("l_quantity").alias("length")), DEFAULT.anchor_length)


from . import queries_files, queries_genome, queries_viewer  # noqa: E402, F401  add their own
