"""The ordered part of extension: each snarl's room depends on neighbours that the same pass has already changed.

Runs of snarls that can touch are folded in order by ``extend_components``; everything that needs no order is relational
(see extension.py).  Values are plain rows: a snarl is a dict of id, members and anchors, an anchor a dict of key, walk,
low / high (bases occupied at its graph-left / graph-right end), paths and reads.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import walks
from ..shared import kept


@dataclass
class Graph:
    """What the fold needs to know of a component: node lengths, and neighbours by (node, to the left?)."""

    length: dict[int, int]
    near: dict[tuple[int, bool], list[int]] = field(default_factory=dict)


def ends(anchor: dict) -> tuple[int, int]:
    ids = anchor["walk"][0][0], anchor["walk"][-1][0]
    return min(ids), max(ids)


def size(anchor: dict) -> int:
    return anchor["low"] + anchor["high"] + sum(n[1] for n in anchor["walk"][1:-1])


def shortest(snarl: dict) -> int:
    return min(map(size, snarl["anchors"]))


def room(read: dict, left: bool) -> str:
    """Name of a read's spare bases towards a side of the graph."""
    return "cs_left" if left == (read["strand"] == 0) else "cs_right"


def allowed(coverage: int, iteration: int, s: Settings) -> int:
    spare = coverage - s.read_floor
    return 0 if iteration == 0 else max(0, min(int(s.drop_fraction * coverage), spare) if iteration == 1 else spare)


def limits(snarl: dict, left: bool, iteration: int, s: Settings) -> list[int]:
    out = []
    for a in snarl["anchors"]:
        spare = sorted(r[room(r, left)] for r in a["reads"])
        k = allowed(len(spare), iteration, s)
        out.append(spare[k] if k < len(spare) else 0)
    return out


def grow(snarl: dict, other: dict, graph: Graph, left: bool, most: list[int], iteration: int, log: list, s: Settings) -> None:
    """Extend all anchors of a snarl by the same bases towards a neighbour, node by node along the unbranched stretch."""
    side, facing = ("low", "high") if left else ("high", "low")
    mine, theirs = snarl["anchors"][0], other["anchors"][0]
    node, goal, at_home = ends(mine)[not left], ends(theirs)[left], True
    left_over = min(most, default=0)
    while True:
        free = graph.length[node] - (mine[side] if at_home else 0)
        if node == goal:
            free -= theirs[facing]
        last = node == goal or left_over <= free
        add = min(left_over, free)
        if add + shortest(snarl) > s.anchor_length:
            add, last = max(0, s.anchor_length - shortest(snarl)), True
        left_over -= add
        for a in snarl["anchors"]:
            if not at_home and add:
                entry = (node, graph.length[node], a["walk"][0][2])
                a["walk"] = [entry, *a["walk"]] if left == (a["walk"][0][0] <= a["walk"][-1][0]) else [*a["walk"], entry]
                a[side] = 0
            a[side] += add
            kept = []
            for r in a["reads"]:
                r = r | ({"start": r["start"] - add} if left else {"end": r["end"] + add})
                r[room(r, left)] -= add
                (kept if r[room(r, left)] >= 0 else log).append(r if r[room(r, left)] >= 0 else {"snarl": snarl["id"], "anchor": a["key"], "iteration": iteration, "read": r["read"]})
            a["reads"] = kept
        onward = graph.near.get((node, left), [])
        if last or len(onward) != 1:
            return
        node, at_home = onward[0], False


def extend_pass(snarls: list[dict], graph: Graph, het: bool, iteration: int, log: list, s: Settings) -> None:
    for i, snarl in enumerate(snarls):
        if not snarl["anchors"] or shortest(snarl) >= s.anchor_length or (len(snarl["anchors"]) > 1) != het:
            continue
        for left in (True, False):
            k = i - 1 if left else i + 1
            if 0 <= k < len(snarls) and snarls[k]["anchors"]:
                grow(snarl, snarls[k], graph, left, limits(snarl, left, iteration, s), iteration, log, s)


def joined(a: dict, b: dict, reads: list[dict]) -> dict:
    """One anchor of two that share a boundary node; ``a`` is the graph-left one."""
    wa = a["walk"] if a["walk"][0][0] <= a["walk"][-1][0] else [(i, n, not f) for i, n, f in reversed(a["walk"])]
    wb = b["walk"] if b["walk"][0][0] <= b["walk"][-1][0] else [(i, n, not f) for i, n, f in reversed(b["walk"])]
    return {"key": f"{a['key']}+{b['key']}", "walk": [*wa, *wb[1:]], "low": a["low"], "high": b["high"], "paths": sorted(set(a["paths"]) & set(b["paths"])), "reads": reads}


def merged(left: dict, right: dict, graph: Graph, s: Settings, round_: int = 0) -> dict | None:
    """Two neighbouring het snarls as one, if two allele pairs or more share a path and enough reads."""
    if len(left["anchors"]) < 2 or len(right["anchors"]) < 2:
        return None
    a0, b0 = left["anchors"][0], right["anchors"][0]
    node = ends(a0)[1]
    if node != ends(b0)[0] or a0["high"] + b0["low"] != graph.length[node]:
        return None
    pairs = []
    for a in left["anchors"]:
        mine = {r["read"]: r for r in a["reads"] if r[room(r, False)] >= 1}
        for b in right["anchors"]:
            if not set(a["paths"]) & set(b["paths"]):
                continue
            reads = [
                x | {"start": min(x["start"], y["start"]), "end": max(x["end"], y["end"]), "cs_left": min(x["cs_left"], y["cs_left"]), "cs_right": min(x["cs_right"], y["cs_right"])}
                for y in b["reads"]
                if y[room(y, True)] >= 1 and (x := mine.get(y["read"]))
            ]
            if len(reads) > s.merge_reads[round_]:
                pairs.append(joined(a, b, sorted(reads, key=lambda r: r["read"])))
    return {"id": f"{left['id']}-{right['id']}", "members": left["members"] + right["members"], "anchors": pairs} if len(pairs) >= 2 else None


def merge_pass(snarls: list[dict], graph: Graph, s: Settings) -> list[dict]:
    """Short het snarls join their neighbours, left first, until nothing changes."""
    out, i = list(snarls), 0
    while i < len(out):
        changed = False
        for left in (True, False):
            k = i - 1 if left else i + 1
            short = out[i]["anchors"] and len(out[i]["anchors"]) > 1 and shortest(out[i]) < s.anchor_length
            if short and 0 <= k < len(out):
                lo = min(i, k)
                got = merged(out[lo], out[lo + 1], graph, s)
                if got:
                    out[lo : lo + 2] = [got]
                    i, changed = lo, True
        i += not changed
    return out


def stretch(anchor: dict, other: dict | None, graph: Graph, left: bool) -> list[tuple[int, int]]:
    """(node, free bases) from an anchor's boundary towards a neighbour, along unbranched nodes."""
    side, facing = ("low", "high") if left else ("high", "low")
    node = ends(anchor)[not left]
    goal = ends(other["anchors"][0])[left] if other and other["anchors"] else None
    out = []
    while goal is not None:
        free = graph.length[node] - (0 if out else anchor[side]) - (other["anchors"][0][facing] if node == goal else 0)
        out.append((node, max(0, free)))
        onward = graph.near.get((node, left), [])
        if node == goal or len(onward) != 1:
            break
        node = onward[0]
    return out


def reached(anchor: dict, way: list[tuple[int, int]], bases: int, left: bool, graph: Graph) -> None:
    """Occupy so many bases along a stretch, adding the nodes it needs."""
    side = "low" if left else "high"
    for k, (node, free) in enumerate(way):
        take = min(bases, free)
        if k and take:
            entry = (node, graph.length[node], anchor["walk"][0][2])
            at_front = left == (anchor["walk"][0][0] <= anchor["walk"][-1][0])
            anchor["walk"] = [entry, *anchor["walk"]] if at_front else [*anchor["walk"], entry]
            anchor[side] = 0
        anchor[side] += take
        bases -= take


def independent_pass(snarls: list[dict], before: dict[str, list[dict]], graph: Graph, s: Settings) -> None:
    """Anchors of short, unmerged het snarls choose their own bounds, from how they were before any extension.

    Of the ways to split the missing bases over both sides the one most reads allow wins, the largest left part first;
    with fewer than ``independent_reads`` an anchor stays as it is.  Neighbours count as they are by now.
    """
    for i, snarl in enumerate(snarls):
        if len(snarl["members"]) > 1 or len(snarl["anchors"]) < 2 or shortest(snarl) >= s.anchor_length:
            continue
        old = {a["key"]: a for a in before[snarl["id"]]}
        cap = s.anchor_length - min(map(size, old.values()))
        near = [snarls[k] if 0 <= k < len(snarls) else None for k in (i - 1, i + 1)]
        first = next(iter(old.values()))
        ways = [stretch(first, n, graph, left) for n, left in zip(near, (True, False))]
        free = [min(cap, sum(f for _, f in w)) for w in ways]
        if sum(free) < cap:
            continue
        for at, a in enumerate(snarl["anchors"]):
            base = old[a["key"]]
            missing = s.anchor_length - size(base)
            best: tuple[int, int] | None = None
            for off in range(max(0, min(missing, free[0])), max(0, missing - free[1]) - 1, -1):
                fit = sum(r[room(r, True)] >= off and r[room(r, False)] >= missing - off for r in base["reads"])
                if best is None or fit > best[0]:
                    best = fit, off
            if best is None or best[0] < s.independent_reads:
                continue
            off, rest = best[1], missing - best[1]
            new = base | {"walk": list(base["walk"]), "reads": []}
            for r in base["reads"]:
                if r[room(r, True)] >= off and r[room(r, False)] >= rest:
                    r = r | {"start": r["start"] - off, "end": r["end"] + rest}
                    r[room(r, True)] -= off
                    r[room(r, False)] -= rest
                    new["reads"].append(r)
            reached(new, ways[0], off, True, graph)
            reached(new, ways[1], rest, False, graph)
            snarl["anchors"][at] = new


def fold(snarls: list[dict], graph: Graph, settings: Settings = DEFAULT) -> tuple[list[dict], list[dict]]:
    """Het passes 0 to 2, hom passes 0 to 2, merging, independent extension; (snarls, dropped reads)."""
    log: list[dict] = []
    before = {s["id"]: [a | {"walk": list(a["walk"]), "reads": [dict(r) for r in a["reads"]]} for a in s["anchors"]] for s in snarls}
    for het in (True, False):
        for iteration in range(3):
            extend_pass(snarls, graph, het, iteration, log, settings)
    done = merge_pass(snarls, graph, settings)
    independent_pass(done, before, graph, settings)
    return done, log


OUT = "component long, snarl_id string, members array<long>, key string, walk array<struct<id:bigint,length:bigint,fwd:boolean>>, low int, high int, length int, paths array<string>, read string, strand int, start long, end long, match_limit long, cs_left long, cs_right long, dropped_in int"


def windows(snarls: DataFrame, reach: int, cut: bool = True) -> DataFrame:
    """(component, win, snarl_id, own): runs of snarls that can touch each other, with the snarl before and after each run.

    snarls (component, snarl_id, low_node, low_length, high_node, high_length), in order of their ids.  A snarl grows by
    ``reach`` bases at most.  Between two of them nothing can meet if they share a boundary node of more than 2 (reach + 1)
    bases, or both boundary nodes are longer than reach + 1: neither then leaves its own node, and they cannot merge.
    The neighbours of a run stand in it as they were, since a snarl grows only towards one that is there.
    """
    order = Window.partitionBy("component").orderBy("snarl_id")
    before = {c: F.lag(c).over(order) for c in ("high_node", "high_length")}
    shared = before["high_node"] == F.col("low_node")
    apart = F.when(shared, F.col("low_length") > 2 * (reach + 1)).otherwise((F.col("low_length") > reach + 1) & (before["high_length"] > reach + 1))
    first = before["high_node"].isNull() | (apart & F.lit(cut))
    rows = snarls.withColumn("first", first)
    rows = rows.withColumns({"win": F.sum(F.col("first").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("first").over(order)})
    last = F.when(F.col("next"), F.col("win") + 1)
    previous = F.when(F.col("first") & (F.col("win") > 1), F.col("win") - 1)
    places = F.array(F.struct(F.col("win").alias("win"), F.lit(True).alias("own")), F.struct(previous.alias("win"), F.lit(False).alias("own")), F.struct(last.alias("win"), F.lit(False).alias("own")))
    return rows.select("component", "snarl_id", F.explode(places).alias("x")).filter("x.win is not null").select("component", "x.win", "snarl_id", "x.own")


def ways_out(origins: DataFrame, nodes: DataFrame, edges: DataFrame, reach: int) -> DataFrame:
    """(origin, ways: array of (left, node, nbr, length)): the only way on from a boundary node, up to ``reach`` bases.

    A round is a join along the sides with one neighbour; a way ends at a branch or when it is long enough, so there are
    as many rounds as the longest way has nodes, reach + 1 at most.
    """
    single = kept(edges.groupBy("node", "left").agg(F.count_distinct("nbr").alias("n"), F.min("nbr").alias("nbr")).filter("n = 1").drop("n"))
    sizes = nodes.select(F.col("id").alias("nbr"), "length")
    at = origins.select(F.col("node").alias("origin"), F.explode(F.array(F.lit(True), F.lit(False))).alias("left"), "node", F.lit(0).cast("long").alias("bases"))
    found = None
    for _ in range(min(reach, 1 << 16) + 2):
        step = kept(at.join(single, ["node", "left"]).join(sizes, "nbr").select("origin", "left", "node", "nbr", "length", (F.col("bases") + F.col("length")).alias("bases")))
        found = step if found is None else found.unionByName(step)
        at = step.filter(F.col("bases") <= reach).select("origin", "left", F.col("nbr").alias("node"), "bases")
        if not at.limit(1).count():
            break
    return found.groupBy("origin").agg(F.collect_set(F.struct("left", "node", "nbr", "length")).alias("ways"))


def extend_components(anchors, reads, nodes, edges, settings: Settings = DEFAULT, cut: bool = True):
    """Fold every run of snarls: anchors (component, snarl_id, key, walk, paths), reads as matched, nodes (component, id,
    length), edges (component, node, left, nbr).  Rows: an anchor's reads, and dropped reads with their iteration.

    A component is cut where no two snarls can touch (``windows``), and a run brings only the nodes its snarls can reach,
    so what one task folds does not grow with the component.  Without ``cut`` a component is one run.
    """
    w = F.col("walk")
    a = anchors.select("component", "snarl_id", "key", "walk", "paths", walks.occupied(w[0]).alias("low"), walks.occupied(F.element_at(w, -1)).alias("high"))
    per = reads.groupBy("snarl_id", "key").agg(F.array_sort(F.collect_list(F.struct("read", "strand", "start", "end", "match_limit", "cs_left", "cs_right"))).alias("reads"))
    one = F.array_sort(F.collect_list(F.struct("key", "walk", "paths", "low", "high", "reads")))
    snarls = kept(a.join(per, ["snarl_id", "key"]).groupBy("component", "snarl_id").agg(one.alias("anchors")))
    ends_ = F.array_sort(F.array(*[F.struct(F.element_at(F.col("anchors")[0]["walk"], i)["id"].alias("node"), F.element_at(F.col("anchors")[0]["walk"], i)["length"].cast("long").alias("length")) for i in (1, -1)]))
    bounds = snarls.select("component", "snarl_id", ends_.alias("e")).select("component", "snarl_id", *[F.col("e")[i][c].alias(f"{side}_{c}") for i, side in ((0, "low"), (1, "high")) for c in ("node", "length")])
    bounds = kept(bounds)
    placed = windows(bounds, settings.anchor_length, cut)
    origins = bounds.select(F.explode(F.array("low_node", "high_node")).alias("node")).distinct()
    ways = ways_out(origins, nodes, edges, settings.anchor_length if cut else 1 << 40)
    known = bounds.select("component", "snarl_id", F.explode(F.array("low_node", "high_node")).alias("origin")).join(ways, "origin")
    known = known.groupBy("component", "snarl_id").agg(F.flatten(F.collect_list("ways")).alias("ways"))
    rows = placed.join(snarls, ["component", "snarl_id"]).join(known, ["component", "snarl_id"], "left")
    runs = rows.groupBy("component", "win").agg(F.array_sort(F.collect_list(F.struct("snarl_id", "own", "anchors", "ways"))).alias("run"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for c, members in zip(pdf["component"], pdf["run"]):
                g = Graph({})
                snarls, own = [], set()
                for x in members:
                    for n in x["ways"] if x["ways"] is not None else ():
                        g.length[n["nbr"]] = n["length"]
                        g.near[n["node"], n["left"]] = [n["nbr"]]
                    anchors_ = []
                    for y in x["anchors"]:
                        d = {k: y[k] for k in ("key", "low", "high")} | {"walk": [(n["id"], n["length"], n["fwd"]) for n in y["walk"]], "paths": list(y["paths"]), "reads": [dict(r) for r in y["reads"]]}
                        g.length |= {i: n for i, n, _ in d["walk"]}
                        # low and high are of the walk's ends; here they are of the graph's sides
                        if d["walk"][0][0] > d["walk"][-1][0]:
                            d["low"], d["high"] = d["high"], d["low"]
                        anchors_.append(d)
                    snarls.append({"id": str(x["snarl_id"]), "members": [x["snarl_id"]], "anchors": anchors_})
                    own |= {x["snarl_id"]} if x["own"] else set()
                done, log = fold(snarls, g, settings)
                for s in done:
                    if s["members"][0] not in own:
                        continue
                    for x in s["anchors"]:
                        walk = [{"id": i, "length": n, "fwd": bool(f)} for i, n, f in x["walk"]]
                        rows += [(c, s["id"], s["members"], x["key"], walk, x["low"], x["high"], size(x), x["paths"], r["read"], r["strand"], r["start"], r["end"], r["match_limit"], r["cs_left"], r["cs_right"], None) for r in x["reads"]]
                mine = {str(k) for k in own}
                rows += [(c, x["snarl"], None, x["anchor"], None, None, None, None, None, x["read"], None, None, None, None, None, None, x["iteration"]) for x in log if x["snarl"] in mine]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in OUT_NAMES]).astype({"strand": "Int32", "low": "Int32", "high": "Int32", "length": "Int32", "dropped_in": "Int32", **{k: "Int64" for k in ("start", "end", "match_limit", "cs_left", "cs_right")}})

    return runs.select("component", "run").mapInPandas(run, OUT)


OUT_NAMES = ("component", "snarl_id", "members", "key", "walk", "low", "high", "length", "paths", "read", "strand", "start", "end", "match_limit", "cs_left", "cs_right", "dropped_in")
