import random

from pyspark.sql import functions as F

from braidwalk.functions import alignments as al
from braidwalk.operators import matching
from braidwalk.functions import sequences as sq
from braidwalk.functions import walks as wk


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first()["x"]


def test_cs_tags(spark):
    cases = {
        "cs:Z::6*ag+tt": [(":", 6), ("*", 1), ("+", 2)],
        "cs:Z:-acg:10": [("-", 3), (":", 10)],
        "cs:Z:=ACGT*at": [("=", 4), ("*", 1)],
        "cs:Z:": [],
    }
    for tag, want in cases.items():
        assert [tuple(x) for x in one(spark, tag, al.parse_cs(F.col("v")))] == want


def test_walks(spark):
    w = [(1, 10, True), (2, 1, True), (3, 5, True), (7, 1, True)]
    kind = "array<struct<id:bigint,length:bigint,fwd:boolean>>"
    v = F.col("v")
    assert one(spark, w, wk.walk_text(v), kind) == ">1>2>3>7"
    assert one(spark, w, wk.sentinel(v), kind) == 2
    assert one(spark, w, wk.sentinel(wk.flipped(v)), kind) == 2
    assert one(spark, w, wk.anchor_length(v), kind) == 6 + 1 + 0
    assert one(spark, w, wk.canonical(v), kind) == one(spark, w, wk.canonical(wk.flipped(v)), kind)
    assert one(spark, w, wk.walk_text(wk.inserted(v, F.struct(F.lit(9).cast("long").alias("id"), F.lit(1).cast("long").alias("length"), F.lit(True).alias("fwd")), True)), kind) == ">9>1>2>3>7"
    assert [tuple(x) for x in one(spark, ">12<7", wk.parse_walk(v))] == [(12, True), (7, False)]


def scan(ops, path_start, start, end):
    """Containment by scanning, base by base."""
    cells, p, q = [], path_start, 0
    for op, n in ops:
        if op == ":":
            cells += [(p + i, q + i, i == 0) for i in range(n)]
        p += n if op in ":*-" else 0
        q += n if op in ":*+" else 0
    at = {c[0]: c[1] for c in cells}
    if any(x not in at for x in range(start, end + 1)):
        return None
    if any(at[x + 1] != at[x] + 1 for x in range(start, end)):
        return None
    return at[start], at[start] + end - start


def test_blocks_against_a_scan(spark):
    rng = random.Random(1)
    rows, want = [], []
    for _ in range(600):
        ops = []
        for _ in range(rng.randint(1, 7)):
            op = rng.choice(":*+-")
            if ops and op == ":" and ops[-1][0] == ":":
                op = "*"
            ops.append((op, 1 if op == "*" else rng.randint(1, 6)))
        s = rng.randint(0, 10)
        e = s + rng.randint(0, 4)
        rows.append((ops, s, e))
        want.append(scan(ops, 2, s, e))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "at int, cs array<struct<op:string,n:int>>, s long, e long").withColumn("path_start", F.lit(2))
    df = df.join(matching.equal_blocks(df), "at", "left").orderBy("at")
    got = df.select(al.containing_block(F.col("blocks"), F.col("s"), F.col("e")).alias("m")).collect()
    # the scan joins blocks only where nothing lies between, as ours does; an insertion or a deletion parts them
    for g, w, r in zip(got, want, rows):
        assert (tuple(g["m"][:2]) if g["m"] else None) == w, r


def test_sequences(spark):
    assert one(spark, "ACGTNacg", sq.reverse_complement(F.col("v"))) == "cgtNACGT"
    assert one(spark, "ACGTNacg", sq.reverse_complement_strict(F.col("v"))) == "ACGT"
    iv = F.array(F.struct(F.lit(2).alias("s"), F.lit(4).alias("e")), F.struct(F.lit(3).alias("s"), F.lit(5).alias("e")))
    assert one(spark, "abcdefg", sq.outside(F.col("v"), iv)) == "abfg"
    assert sq.dust_intervals("A" * 30) == [(0, 30)]
    assert sq.dust_intervals("ACACACACACACACACACACACAC")
    rng = random.Random(0)
    assert sum(e - s for s, e in sq.dust_intervals("".join(rng.choice("ACGT") for _ in range(60)))) < 30
    assert sq.dust_intervals("") == []


def test_allowed_drops(spark):
    got = spark.createDataFrame([(5,), (9,), (12,), (200,)], "v int").select(*[al.allowed_drops(F.col("v"), i).alias(f"d{i}") for i in range(3)]).collect()
    assert [tuple(r) for r in got] == [(0, 0, 0), (0, 0, 0), (0, 1, 3), (0, 20, 191)]
