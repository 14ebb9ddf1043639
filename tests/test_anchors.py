"""Traversal, matching, extension and the pipelines on small graphs."""

import random

from pyspark.sql import functions as F

from braidwalk.functions import walks as wk
from braidwalk.operators import folding, graph, intervals, linkage, quality, traversal
from braidwalk.plans import pipelines
from braidwalk.sources import files


def walk_by_state(steps, bubbles):
    """Traversals by a state machine over one path."""
    out, open_, walk = [], None, []
    for node in steps:
        if open_ is not None:
            end, inside = bubbles[open_]
            if node != end and node in inside:
                walk.append(node)
                continue
            if node == end:
                out.append((open_, [*walk, node]))
            open_ = None
        if node in bubbles:
            open_, walk = node, [node]
    return out


def test_traversals_against_a_state_machine(spark):
    rng = random.Random(3)
    bubbles = {1: (4, {2, 3}), 4: (7, {5, 6}), 8: (11, {9, 10})}
    paths = {p: [rng.randint(1, 12) if rng.random() < 0.4 else (i % 12) + 1 for i in range(60)] for p in range(30)}
    steps = spark.createDataFrame([(str(p), i, n, True, 5) for p, s in paths.items() for i, n in enumerate(s)], "path string, idx long, node long, fwd boolean, length long")
    rows = spark.createDataFrame([(k, k, e, sorted(i)) for k, (e, i) in bubbles.items()], "snarl_id long, start long, end long, inside array<long>")
    got = {(r["path"], r["start"], r["first_idx"]): [n["id"] for n in r["walk"]] for r in traversal.traversals(steps, rows).collect()}
    want = sorted((str(p), s, w) for p, path in paths.items() for s, w in walk_by_state(path, bubbles))
    assert sorted((k[0], k[1], v) for k, v in got.items()) == want and want


def test_overlaps_fold(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("a", 5, 50), ("a", 9, 12), ("a", 12, 20)], "read string, start long, end long")
    assert sorted((r["start"], r["end"]) for r in intervals.overlaps(rows, "read").collect()) == [(5, 50), (9, 12)]


def test_partitions_with_tolerance():
    assert linkage.matched_partitions([{1, 2}, {3}], [{3}, {1, 2}])
    assert not linkage.matched_partitions([{1, 2}, {3}], [{3, 2}, {1}])
    assert linkage.matched_partitions([{1, 2, 4}, {3}], [{3}, {1, 2}], 1)


def test_chains(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (3, 5), (4, 6), (5, 6), (6, 7)], "src long, dst long")
    got = {r["node"]: (r["chain"], r["rank"]) for r in graph.chains(edges).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (6, 1)}


def anchor(key, ids, reads, lengths, paths=("p",)):
    walk = [(i, lengths[i], True) for i in ids]
    low, high = (0 if walk[0][1] == 1 else 1), (0 if walk[-1][1] == 1 else 1)
    return {"key": key, "walk": walk, "low": low, "high": high, "paths": list(paths), "reads": [{"read": f"r{k}", "strand": 0, "start": 100, "end": 103, "match_limit": 90, "cs_left": l, "cs_right": r} for k, (l, r) in enumerate(reads)]}


def test_extension_fold():
    lengths = {1: 50, 2: 1, 3: 1, 4: 50, 5: 1, 6: 1, 7: 50}
    near = {(1, False): [2, 3], (2, False): [4], (3, False): [4], (4, False): [5, 6], (4, True): [2, 3], (5, False): [7], (6, False): [7], (7, True): [5, 6], (2, True): [1], (3, True): [1], (5, True): [4], (6, True): [4]}
    snarls = [
        {"id": "1", "members": [1], "anchors": [anchor("a", [1, 2, 4], [(20, 20)] * 4, lengths), anchor("b", [1, 3, 4], [(30, 9)] * 4, lengths)]},
        {"id": "2", "members": [2], "anchors": [anchor("c", [4, 5, 7], [(20, 20)] * 4, lengths), anchor("d", [4, 6, 7], [(20, 20)] * 4, lengths)]},
    ]
    done, log = folding.fold(snarls, folding.Graph(lengths, near))
    first = done[0]["anchors"]
    # no neighbour on the left; on the right the scarcest read allows 9 bases, so both alleles grow by 9 to 12
    assert [folding.size(a) for a in first] == [16, 12] and first[1]["high"] == 10
    assert all(r["end"] == 112 and r["cs_right"] == 0 for r in first[1]["reads"])
    # alone, the first allele has reads for all 13 missing bases on the right
    assert first[0]["high"] == 14 and all((r["start"], r["end"], r["cs_right"]) == (100, 116, 7) for r in first[0]["reads"])
    assert [folding.size(a) for a in done[1]["anchors"]] == [16, 16] and not log


def test_merge_of_touching_snarls():
    lengths = {1: 5, 2: 1, 3: 1, 4: 2, 5: 1, 6: 1, 7: 5}
    reads = [(9, 9)] * 12
    snarls = [
        {"id": "1", "members": [1], "anchors": [anchor("a", [1, 2, 4], reads, lengths, ["p"]), anchor("b", [1, 3, 4], reads, lengths, ["q"])]},
        {"id": "2", "members": [2], "anchors": [anchor("c", [4, 5, 7], reads, lengths, ["p"]), anchor("d", [4, 6, 7], reads, lengths, ["q"])]},
    ]
    got = folding.merged(*snarls, folding.Graph(lengths), folding.DEFAULT)
    assert got["id"] == "1-2" and [[n[0] for n in a["walk"]] for a in got["anchors"]] == [[1, 2, 4, 5, 7], [1, 3, 4, 6, 7]]


def world(tmp_path):
    """A graph of two bubbles in a row, two haplotypes, reads of both, and their alignments."""
    rng = random.Random(5)
    seq = {i: "".join(rng.choice("ACGT") for _ in range(n)) for i, n in {1: 40, 2: 1, 3: 1, 4: 40, 5: 1, 6: 1, 7: 40}.items()}
    seq[2], seq[3], seq[5], seq[6] = "A", "C", "G", "T"
    haps = {"chm13#0#c": [1, 2, 4, 5, 7], "other#1#c": [1, 3, 4, 6, 7]}
    edges = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (4, 6), (5, 7), (6, 7)]
    gfa = [f"S\t{i}\t{s}" for i, s in seq.items()] + [f"L\t{a}\t+\t{b}\t+\t0M" for a, b in edges]
    gfa += ["\t".join(["W", *p.split("#"), "0", "0", "".join(f">{i}" for i in w)]) for p, w in haps.items()]
    fasta, gaf = [], []
    for k in range(24):
        w = list(haps.values())[k % 2]
        s = "".join(seq[i] for i in w)
        fasta.append(f">read{k} x\n{s[:60]}\n{s[60:]}")
        gaf.append("\t".join([f"read{k}", str(len(s)), "0", str(len(s)), "+", "".join(f">{i}" for i in w), str(len(s)), "0", str(len(s)), str(len(s)), str(len(s)), "60", "AS:i:1", "bq:f:1", f"cs:Z::{len(s)}", "dv:f:0.0"]))
    gaf += [gaf[0], "read99\tbad\tline", gaf[1].replace("\t60\t", "\t0\t")]
    for name, rows in (("g.gfa", gfa), ("r.fa", fasta), ("a.gaf", gaf)):
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    return seq, haps


def test_pipelines(spark, tmp_path):
    seq, haps = world(tmp_path)
    anchors = pipelines.build(spark, f"{tmp_path}/g.gfa", f"{tmp_path}/d")
    texts = sorted(r["x"] for r in anchors.select(wk.walk_text(F.col("walk")).alias("x")).collect())
    assert texts == [">1>2>4", ">1>3>4", ">4>5>7", ">4>6>7"]
    assert {r["position"] for r in anchors.collect()} == {(40 + 81) // 2, (81 + 122) // 2}
    got = pipelines.get_anchors(spark, f"{tmp_path}/d", f"{tmp_path}/a.gaf", f"{tmp_path}/r.fa", f"{tmp_path}/o").collect()
    assert spark.read.parquet(f"{tmp_path}/o/rejects").count() == 2
    assert spark.read.parquet(f"{tmp_path}/o/matches").count() == 48
    assert len({r["read"] for r in got}) == 24
    # every anchor's reads spell the same bases
    reads = files.fasta(spark, f"{tmp_path}/r.fa").select(F.col("id").alias("read"), "seq")
    rows = files.anchors_json(spark, f"{tmp_path}/o/extended.jsonl")
    assert rows.count() == len(got)
    checked = quality.identical(quality.sequences_of(rows, reads)).collect()
    assert len(checked) == 4 and all(r["identical"] and r["reads"] == 12 for r in checked)
    assert all(r["end"] - r["start"] == 16 for r in got)
    out = f"{tmp_path}/o"
    assert files.anchors_json(spark, f"{out}/primary.jsonl").count() == 48
    listed = spark.read.csv(f"{out}/reliable_snarls.tsv", sep="\t", header=True).collect()
    assert sorted((r["zygosity"], r["is_reliable"]) for r in listed) == [("2", "true")] * 2 and all(r["linked_snarls"] != "[]" for r in listed)
    assert {r["compatible"] for r in spark.read.json(f"{out}/snarls/compatibility").collect()} == {True}
    assert {r["variant"] for r in spark.read.json(f"{out}/snarls/variant_type").collect()} == {"SNP"}
    assert spark.read.csv(f"{out}/read_anchor.csv", header=True).count() == 48 and spark.read.text(f"{out}/reads_processed.tsv").count() == 24
    assert sum(r["initial"] for r in files.coverage_json(spark, f"{out}/coverage.json").collect()) == 48
    sizes = files.sizes(spark, f"{out}/extended_sizes.tsv").collect()
    assert len(sizes) == 4 and {r["bp_matched_reads"] for r in sizes} == {"12"} and {r["Anchor_length"] for r in sizes} == {"16"}
    pipelines.view(spark, f"{out}/extended.jsonl", f"{out}/extended_sizes.tsv", f"{tmp_path}/v")
    assert spark.read.json(f"{tmp_path}/v/nodes").count() == 4 and spark.read.json(f"{tmp_path}/v/edges").count() == 2
    assert {r["strand"] for r in spark.read.json(f"{tmp_path}/v/reads").collect()} == {"+"}


def test_build_with_longer_boundaries(spark, tmp_path):
    """Bubbles with alleles of two nodes and short boundaries: found, and grown along unbranched nodes."""
    length = {1: 30, 2: 5, 3: 1, 4: 2, 5: 3, 6: 4, 7: 30}  # 1 - 2 (3 4 | 5) 6 - 7
    edges = [(1, 2), (2, 3), (3, 4), (4, 6), (2, 5), (5, 6), (6, 7)]
    rows = [f"S\t{i}\t{'ACGT' * 8:.{n}}" for i, n in length.items()] + [f"L\t{a}\t+\t{b}\t+\t0M" for a, b in edges]
    rows += [f"W\t{p}\t0\tc\t0\t0\t{''.join(f'>{i}' for i in w)}" for p, w in (("chm13", [1, 2, 3, 4, 6, 7]), ("h", [1, 2, 5, 6, 7]))]
    (tmp_path / "g.gfa").write_text("\n".join(rows) + "\n")
    walks = lambda a: sorted(r["x"] for r in a.select(wk.walk_text(F.col("walk")).alias("x")).collect())
    assert walks(pipelines.build(spark, f"{tmp_path}/g.gfa", f"{tmp_path}/d")) == [">2>3>4>6", ">2>5>6"]
    assert walks(pipelines.build(spark, f"{tmp_path}/g.gfa", f"{tmp_path}/e", extend=True)) == [">1>2>3>4>6", ">1>2>5>6"]


def test_matched_places_are_matched_reads(spark):
    """Anchors that share a middle node, in both directions and with repeats, against the wide way."""
    from braidwalk.operators import matching, stats
    from braidwalk.shared import ranked

    rng = random.Random(5)
    node = "array<struct<id:long,length:long,fwd:boolean>>"
    length = {i: rng.choice([1, 2, 5, 9]) for i in range(1, 13)}
    turned = lambda w: [(i, n, not f) for i, n, f in reversed(w)]
    reads, seen = [], []
    for r in range(300):
        ids = [rng.randint(1, 12) for _ in range(rng.randint(1, 12))] if r % 2 else sorted(rng.sample(range(1, 13), rng.randint(3, 12)))
        w = [(i, length[i], r % 3 > 0 or rng.random() < 0.5) for i in ids]
        w = turned(w) if r % 5 == 0 else w
        total = sum(x[1] for x in w)
        a = rng.randint(0, total)
        reads.append((r, 500, 1000 + r, 0, total, w, [(":", a // 2), (":", a - a // 2), ("*", 1), (":", max(0, total - a - 1))]))
        seen += [w[k : k + n] for k in range(len(w)) for n in (2, 3, 4) if k + n <= len(w)]
    walks = {}
    for w in rng.sample(seen, 150):
        walks.setdefault(min(str(w), str(turned(w))), w)
    known = [(k % 40, f"k{k % 90}", w[(len(w) - 1) // 2][0], w, ("p", k)) for k, w in enumerate(walks.values())]
    known = list({(x[0], x[1]): x for x in known}.values())
    a = spark.createDataFrame(reads, f"read long, read_length long, at long, path_start long, path_end long, walk {node}, cs array<struct<op:string,n:int>>")
    b = spark.createDataFrame(known, f"snarl_id long, key string, sentinel long, walk {node}, first struct<path:string,first_idx:int>")
    wide = matching.matched_reads(a, b).select(F.col("key").alias("anchor"), "read")
    order = ranked(b.select("key", "sentinel", "walk", "first.*", "snarl_id"), "path", "first_idx", "snarl_id", "key")
    lean = matching.matched_places(a, order.select("rank", "sentinel", "walk"))
    names = order.select("rank", F.col("key").alias("anchor"))
    assert sorted(lean.join(names, "rank").select("anchor", "read").collect()) == sorted(wide.collect()) and wide.count() > 50
    got = stats.anchor_coverage_of(lean, F.col("read") % 3 == 0, names).collect()
    assert sorted(map(tuple, got)) == sorted((r[0], r[1], r[2], r[3]) for r in stats.anchor_coverage(wide, wide.filter("read % 3 = 0")).withColumn("reads", F.col("reads").cast("array<string>")).collect())


def test_fastq(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "r.fq.gz", "wt") as f:
        f.write("@a\tx\nACGT\n+\n@@@@\n@b\nAC\n+\nII\n")
    assert sorted(tuple(r) for r in files.fastq(spark, f"{tmp_path}/r.fq.gz").collect()) == [("a", "ACGT", "+", "@@@@"), ("b", "AC", "+", "II")]


def test_fastq_in_many_splits(spark, tmp_path):
    """Files larger than a split, of several sizes: a record's lines lie in splits that are read in order of size."""
    want = []
    (tmp_path / "r").mkdir()
    for name, n in (("a", 40), ("b", 70), ("c", 25)):
        reads = [(f"{name}{i}", "ACGT" * (1 + i % 5), "+", "@" + "I" * (3 + 4 * (i % 5))) for i in range(n)]
        (tmp_path / "r" / f"{name}.fq").write_text("".join(f"@{h}\n{s}\n{p}\n{q}\n" for h, s, p, q in reads))
        want += reads
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = files.fastq(spark, f"{tmp_path}/r")
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)


def test_cut_components_fold_alike(spark):
    """A long chain of bubbles with short and long boundary nodes: runs give what the whole component gives."""
    rng = random.Random(21)
    nodes, edges, anchors, reads = [], [], [], []
    n = 60
    bound = lambda k: 10 * k
    length = {bound(k): rng.choice([1, 3, 8, 17, 18, 30, 34, 35, 80]) for k in range(n + 1)}
    for k in range(n):
        step = rng.random() < 0.3  # a further unbranched node between this bubble and the next
        for j in (1, 2):
            length[bound(k) + j] = rng.choice([1, 1, 2])
            edges += [(bound(k), bound(k) + j), (bound(k) + j, bound(k) + 5 if step else bound(k + 1))]
        if step:
            length[bound(k) + 5] = rng.choice([1, 4, 20, 60])
            edges.append((bound(k) + 5, bound(k + 1)))
        end = bound(k) + 5 if step else bound(k + 1)
        for j in (1, 2):
            anchors.append((0, k, f"{k}.{j}", [(i, length[i], True) for i in (bound(k), bound(k) + j, end)], ["p", f"h{j}"]))
            for r in range(rng.choice([4, 12, 15])):
                reads.append((k, f"{k}.{j}", f"r{j}.{r}", rng.choice([0, 1]), 1000, 1002, 99, rng.randint(0, 40), rng.randint(0, 40)))
    node = "array<struct<id:long,length:long,fwd:boolean>>"
    a = spark.createDataFrame(anchors, f"component long, snarl_id long, key string, walk {node}, paths array<string>")
    r = spark.createDataFrame(reads, "snarl_id long, key string, read string, strand int, start long, end long, match_limit long, cs_left long, cs_right long")
    nodes = spark.createDataFrame([(0, i, x) for i, x in length.items()], "component long, id long, length long")
    signed = spark.createDataFrame([(x, True, y, True) for x, y in edges], "src long, src_fwd boolean, dst long, dst_fwd boolean")
    near = graph.sides(signed).select(F.lit(0).cast("long").alias("component"), "node", (F.col("side") == "L").alias("left"), "nbr")
    whole, cut = (sorted(map(str, folding.extend_components(a, r, nodes, near, cut=c).collect())) for c in (False, True))
    assert whole == cut and len(whole) > 500
    assert any("'" in x and "-" in x.split("snarl_id='")[1].split("'")[0] for x in whole)  # some have merged
    bounds = spark.createDataFrame([(0, k, bound(k), length[bound(k)], bound(k + 1), length[bound(k + 1)]) for k in range(n)], "component long, snarl_id long, low_node long, low_length long, high_node long, high_length long")
    assert folding.windows(bounds, 16).select("win").distinct().count() > 8
