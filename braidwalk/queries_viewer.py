"""Queries of the viewer's operators over ``events``, and the same in SQL.

An anchor is ``props.k`` and the event type, its bubble ``props.k``, a read the user; the place on the read is the
event's id, the strand its parity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import journeys, viewer
from .queries import query, t
from .shared import place
from .sinks import table

ROWS = """rows AS (SELECT json_extract_string(props, '$.k') || ':' || event_type AS anchor, json_extract_string(props, '$.k') AS k, user_id AS read,
 CAST(event_id % 2 AS INT) AS strand, event_id AS start, event_id + 10 AS e FROM events),
firsts AS (SELECT read, anchor, min(start) AS start FROM rows GROUP BY 1, 2)"""
#: What is dropped: an anchor and a read.
DROPPED = f"""{ROWS}, lefts AS (SELECT * FROM firsts WHERE anchor <> '1:click' AND read <> 7),
pairs AS (SELECT anchor, lead(anchor) OVER (PARTITION BY read ORDER BY start, anchor) AS nxt FROM lefts),
edges AS (SELECT least(anchor, nxt) AS a, greatest(anchor, nxt) AS b, count(*) AS weight FROM pairs WHERE nxt IS NOT NULL GROUP BY 1, 2)"""


def rows(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events", "event_id", "user_id", "event_type", "props")
    k = F.get_json_object("props", "$.k")
    return e.select(F.concat_ws(":", k, "event_type").alias("anchor"), k.alias("k"), F.col("user_id").alias("read"), (F.col("event_id") % 2).cast("int").alias("strand"), F.col("event_id").alias("start"), (F.col("event_id") + 10).alias("end"))


def one(spark: SparkSession, name: str, value, kind: str) -> DataFrame:
    return spark.createDataFrame([(value,)], f"{name} {kind}")


@query("SELECT doc_id, CAST(coalesce(try_cast(split_part(replace(CASE WHEN doc_id % 3 = 0 THEN 'snarl_id' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN source ELSE CAST(doc_id % 97 AS VARCHAR) END || '-5', 'snarl_id', ''), '-', 1) AS INT), 0) AS INT) AS number FROM documents")
def snarl_numbers(spark, d):
    x = t(spark, d, "documents", "doc_id", "source")
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, "snarl_id").otherwise(""), F.when(F.col("doc_id") % 7 == 0, F.col("source")).otherwise((F.col("doc_id") % 97).cast("string")), F.lit("-5"))
    return x.select("doc_id", viewer.snarl_number(text).alias("number"))


@query(r"""SELECT conv_id, turn, len(list_filter(string_split_regex(replace(text, ',', ' '), '[ \t\n\r\f\v]+'), lambda x: x <> '')) AS ids FROM conversations""")
def id_tokens(spark, d):
    x = t(spark, d, "conversations", "conv_id", "turn", "text")
    return x.select("conv_id", "turn", F.size(viewer.id_tokens(F.col("text"))).cast("long").alias("ids"))


@query(f"WITH {ROWS} SELECT anchor, string_agg(read || '/' || strand || '/' || start || '/' || e, ' ' ORDER BY read, strand, start) AS reads FROM rows GROUP BY 1")
def merged_anchors(spark, d):
    text = F.transform("reads", lambda r: F.concat_ws("/", r["read"].cast("string"), r["strand"].cast("string"), r["start"].cast("string"), r["end"].cast("string")))
    return viewer.merged_anchors(rows(spark, d).drop("k")).select("anchor", F.array_join(text, " ").alias("reads"))


@query(f"WITH {ROWS} SELECT DISTINCT k AS snarl, anchor FROM rows WHERE start % 5 = 0")
def snarl_anchors(spark, d):
    r = rows(spark, d)
    sizes = r.select(F.col("k").alias("snarl_id"), F.col("anchor").alias("Anchor_path"))
    return viewer.snarl_anchors(r.filter("start % 5 = 0"), sizes)


@query(f"""WITH {ROWS} SELECT read, CASE WHEN s.strand = 0 THEN '+' ELSE '-' END AS strand, journey FROM (SELECT read, arg_min(strand, start) AS strand FROM rows GROUP BY 1) s
JOIN (SELECT read, string_agg(anchor, ' ' ORDER BY start, anchor) AS journey FROM firsts GROUP BY 1) j USING (read)""")
def read_info(spark, d):
    return viewer.read_info(rows(spark, d)).select("read", "strand", F.array_join("journey", " ").alias("journey"))


def shown(spark, d):
    r = rows(spark, d)
    return viewer.shown_graph(r, r.select("anchor").distinct(), one(spark, "anchor", "1:click", "string"), one(spark, "read", 7, "long"))


@query(f"WITH {DROPPED} SELECT * FROM edges")
def shown_edges(spark, d):
    return shown(spark, d)[1]


@query(f"WITH {DROPPED} SELECT a AS anchor FROM edges UNION SELECT b FROM edges")
def shown_nodes(spark, d):
    return shown(spark, d)[0].select("anchor")


@query(f"WITH {ROWS} SELECT read, strand, start, e AS \"end\" FROM rows WHERE anchor = '1:view'")
def anchor_info(spark, d):
    return viewer.anchor_info(rows(spark, d), "1:view")


@query(f"""WITH {ROWS}, n AS (SELECT read, anchor, lead(anchor) OVER (PARTITION BY read ORDER BY start, anchor) AS nxt FROM firsts)
SELECT read, anchor, strand, start, e AS "end" FROM rows WHERE anchor IN ('1:click', '1:view') AND read IN (SELECT read FROM n WHERE (anchor = '1:click' AND nxt = '1:view') OR (anchor = '1:view' AND nxt = '1:click'))""")
def edge_info(spark, d):
    return viewer.edge_info(rows(spark, d), "1:click", "1:view")


@query(f"WITH {ROWS} SELECT anchor, CAST(row_number() OVER (ORDER BY start, anchor) - 1 AS INT) AS place FROM firsts WHERE read = 7")
def journey_highlight(spark, d):
    return viewer.on_journey(viewer.read_info(rows(spark, d)), 7)


@query(f"WITH {ROWS} SELECT anchor, count(*) AS n FROM rows WHERE anchor <> '1:view' GROUP BY 1")
def drop_and_undo(spark, d):
    v = rows(spark, d).withColumn("read", F.col("read").cast("string"))
    state = viewer.Drops(v).drop("anchor", "1:click", "1:view").drop("read", "7").restore("anchor", "1:click").undo()
    return state.remaining().groupBy("anchor").agg(F.count("*").alias("n"))


@query(f"WITH {ROWS} SELECT anchor, read, strand, start, e AS \"end\" FROM rows WHERE anchor <> '1:click' AND read <> 7")
def saved_state(spark, d):
    r = rows(spark, d).drop("k")
    path = place(spark, "state")
    viewer.save(r, path, 1)
    now = spark.read.parquet(f"{path}/version=1")
    left = journeys.dropped(journeys.dropped(now, one(spark, "anchor", "1:click", "string"), "anchor"), one(spark, "read", 7, "long"), "read")
    return spark.read.parquet(viewer.save(left, path, 2))


LAYOUT = f"""{ROWS}, nodes AS (SELECT DISTINCT k AS snarl, anchor FROM rows), places AS (SELECT snarl, count(*) AS n, row_number() OVER (ORDER BY CAST(snarl AS INT), snarl) - 1 AS i FROM nodes GROUP BY 1),
t AS (SELECT count(*) AS total FROM places), placed AS (SELECT snarl, anchor, i * 250.0 AS x,
 2000 * sin(i / total * pi()) * sin(i * 0.08) + (row_number() OVER (PARTITION BY snarl ORDER BY anchor) - 1 - (n - 1) / 2) * 30 AS y FROM nodes JOIN places USING (snarl), t)"""


@query(f"WITH {LAYOUT} SELECT snarl, anchor, CAST(x AS DOUBLE) AS x, round(y, 6) AS y FROM placed")
def layout(spark, d):
    nodes = rows(spark, d).select(F.col("k").alias("snarl"), "anchor").distinct()
    return viewer.start_layout(nodes).select("snarl", "anchor", "x", F.round("y", 6).alias("y"))


@query()
def relaxed_layout(spark, d):
    r = rows(spark, d)
    nodes = r.select(F.col("k").alias("snarl"), "anchor").distinct()
    out = viewer.relaxed_layout(nodes, journeys.journey_edges(r))
    path = place(spark, "layout")
    table(out, path)
    return spark.read.parquet(path)
