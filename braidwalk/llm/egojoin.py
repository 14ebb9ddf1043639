"""Embedding near-dedup by an epsilon-grid-order join.

Unit vectors with cosine >= t are at most eps = sqrt(2 - 2t) apart, in every orthogonal projection too.  Vectors are
sorted, within equal labels, by their grid cells (side eps) on the leading principal directions; the sorted sequence is
cut into segments of ``SEGMENT`` vectors, and intervals of ``TILE`` segments, each with its box of projections.  Intervals
whose boxes are within eps become pairs, found by an equi-join on label and leading cell; each pair is one unit of work, so
a hot label is spread over as many tasks as it has pairs, and a vector is sent once to each interval near its own (never
to each segment).  Within a pair the two sequences are halved recursively, skipping halves that the boxes prove distant,
down to ``LEAF`` rows, where a matrix product gives the cosines in double precision.

A unit returns the number of links of each vector and a spanning forest of the links, never all pairs.  Vectors that are
equal number for number are one node with a multiplicity.

Rows whose vector is null, zero, or holds null or non-finite components, or whose label or id is null, link with
nothing; vectors of different lengths do not link.  Rows that repeat an id are one vector for components; equal cells are
ordered by id; an empty table gives an empty result.  Only vec_id, label and embedding are read, so other columns cannot
clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, skew_join, stored

SEGMENT, TILE, LEAF, DIRECTIONS, COORDINATES = 1024, 16, 256, 6, 128


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding) -> with the unit vector's bytes and a hash; null bytes where nothing may link."""
    import xxhash

    names = ["vec_id", "label", "dim", "h1", "h2", "unit"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part, out = batch.slice(lo, 1024), []
            for vec_id, label, x in zip(part.column("vec_id").to_pylist(), part.column("label").to_pylist(), part.column("embedding")):
                values = x.values if x.is_valid else None
                row = (vec_id, label, None, None, None, None)
                if vec_id is not None and label is not None and values is not None and len(values) and not values.null_count:
                    v = values.to_numpy(zero_copy_only=False).astype(np.float64)
                    size = np.sqrt(v @ v)
                    if not np.isfinite(size) or not size:  # too large or small to square: scale first
                        top = np.abs(v).max()
                        v = v / top if np.isfinite(top) and top else v
                        size = np.sqrt(v @ v)
                    if np.isfinite(size) and size:
                        h = xxhash.xxh3_128_intdigest(v.tobytes())
                        h1, h2 = (k - (1 << 64) if k >> 63 else k for k in (h >> 64, h & (1 << 64) - 1))
                        row = (vec_id, label, len(v), h1, h2, (v / size).tobytes())
                out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of the (leading) coordinates, with 1 in front, by vector length."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, unit in zip(batch.column("dim").to_pylist(), batch.column("unit").to_pylist()):
            v = np.concatenate([[1.0], np.frombuffer(unit)[:COORDINATES]])
            total.setdefault(dim, []).append(v)
        for dim, v in total.items():
            if isinstance(v, list):
                v = np.array(v)
                total[dim] = v.T @ v
        for dim, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * m.size, pa.int32()), pa.array(np.arange(m.size), pa.int32()), pa.array(m.ravel())], ["dim", "k", "x"])
        total = {}


def principal_directions(units: DataFrame) -> dict[int, np.ndarray]:
    """Orthonormal leading directions (coordinates x directions) by vector length, from all vectors' second moments."""
    sums = units.select("dim", "unit").mapInArrow(_moments, "dim int, k int, x double").groupBy("dim", "k").agg(F.sum("x").alias("x"))
    out: dict[int, dict[int, float]] = {}
    for dim, k, x in sums.collect():  # (coordinates + 1)^2 numbers a length
        out.setdefault(dim, {})[k] = x
    found = {}
    for dim, cells in out.items():
        m = np.array([cells[k] for k in range(len(cells))]).reshape(min(dim, COORDINATES) + 1, -1)
        mean = m[0, 1:] / m[0, 0]
        found[dim] = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))[1][:, ::-1][:, :DIRECTIONS]
    return found


def _projected(directions: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for dim, unit in zip(batch.column("dim").to_pylist(), batch.column("unit").to_pylist()):
                p = np.frombuffer(unit)[:COORDINATES] @ directions[dim]
                out.append(p.tolist() + [0.0] * (DIRECTIONS - len(p)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, "p"])

    return run


def _cut(segment: int, tile_size: int):
    """Sorted rows -> segments, numbered by interval."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here, count, tile = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), *[pa.list_(pa.float64())] * 3]
        names = ["seg", "tile", "label", "dim", "ids", "copies", "units", "p", "low", "high"]

        def out():
            nonlocal count, held
            p = np.array([r[5] for r in held])
            row = [here << 32 | count, here << 32 | tile, held[0][0], held[0][1], [r[2] for r in held], [r[3] for r in held], b"".join(r[4] for r in held), p.ravel().tolist(), p.min(0).tolist(), p.max(0).tolist()]
            count, held = count + 1, []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

        full = 0  # segments of this interval
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "first", "copies", "unit", "p"))):
                if held and (len(held) == segment or held[0][:2] != r[:2]):
                    ended = held[0][:2] != r[:2]
                    yield out()
                    full += 1
                    if ended or full == tile_size:
                        tile, full = tile + 1, 0
                held.append(r)
        if held:
            yield out()

    return run


def _links_of(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the components of a bipartite block of links."""
    i, j = np.nonzero(near)
    if len(i) <= 4 * sum(near.shape):
        return list(zip(a[i].tolist(), b[j].tolist()))
    out, left = [], near.any(axis=1)
    for r in range(len(left)):
        if not left[r]:
            continue
        rows, cols = np.zeros(len(left), bool), np.zeros(near.shape[1], bool)
        front = np.zeros(len(left), bool)
        front[r] = True
        while front.any():
            rows |= front
            new = near[front].any(axis=0) & ~cols
            cols |= new
            front = near[:, new].any(axis=1) & ~rows
        left &= ~rows
        out += [(int(a[r]), int(x)) for x in [*a[rows], *b[cols]] if x != a[r]]
    return out


def block_join(a: dict, b: dict, least: float, same: bool, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of two segments (or one with itself): weighted link counts of both, spanning edges."""
    eps = np.sqrt(2 - 2 * least) * (1 + 1e-9) + 1e-12
    na, nb = np.zeros(len(a["ids"]), np.int64), np.zeros(len(b["ids"]), np.int64)
    edges: list[tuple[int, int]] = []

    def join(al: int, ah: int, bl: int, bh: int) -> None:
        pa_, pb = a["p"][al:ah], b["p"][bl:bh]
        gap = np.maximum(0, np.maximum(pa_.min(0) - pb.max(0), pb.min(0) - pa_.max(0)))
        if gap @ gap > eps * eps or same and al >= bh:
            return
        if ah - al <= leaf and bh - bl <= leaf:
            near = a["units"][al:ah] @ b["units"][bl:bh].T >= least
            if same:
                near &= np.arange(al, ah)[:, None] < np.arange(bl, bh)[None, :]
            if near.any():
                na[al:ah] += near @ b["copies"][bl:bh]
                nb[bl:bh] += a["copies"][al:ah] @ near
                edges.extend(_links_of(near, a["ids"][al:ah], b["ids"][bl:bh]))
            return
        am, bm = (al + ah) // 2, (bl + bh) // 2
        for x in ((al, am), (am, ah)) if ah - al > leaf else ((al, ah),):
            for y in ((bl, bm), (bm, bh)) if bh - bl > leaf else ((bl, bh),):
                join(*x, *y)

    join(0, len(na), 0, len(nb))
    return na, nb, edges


def _pair(least: float, leaf: int):
    def joined(rows: list[dict]) -> dict:
        n = sum(len(r["ids"]) for r in rows)
        whole = {k: np.concatenate([np.array(r[k], np.int64) for r in rows]) for k in ("ids", "copies")}
        return whole | {"units": np.concatenate([np.frombuffer(r["units"]) for r in rows]).reshape(n, -1), "p": np.concatenate([np.array(r["p"]) for r in rows]).reshape(n, -1)}

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["seg"])
        i, j = rows[0]["i"], rows[0]["j"]
        a = joined([r for r in rows if r["tile"] == i])
        b = a if i == j else joined([r for r in rows if r["tile"] == j])
        na, nb, edges = block_join(a, b, least, i == j, leaf)
        ids = [*np.concatenate([a["ids"][na > 0], b["ids"][nb > 0]]).tolist(), *(e[0] for e in edges)]
        n = [*np.concatenate([na[na > 0], nb[nb > 0]]).tolist(), *[None] * len(edges)]
        other = [None] * (len(ids) - len(edges)) + [e[1] for e in edges]
        return pa.table({"a": pa.array(ids, pa.int64()), "b": pa.array(other, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = stored(rows.mapInArrow(_units, "vec_id long, label long, dim int, h1 long, h2 long, unit binary"))
    key = ["label", "dim", "h1", "h2"]
    valid = rows.filter("unit is not null")
    nodes = stored(valid.groupBy(*key).agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("unit").alias("unit")))
    directions = principal_directions(nodes)
    eps = float(np.sqrt(2 - 2 * least))
    cells = [F.floor(F.col("p")[k] / eps).alias(f"c{k}") for k in range(DIRECTIONS)]
    placed = nodes.select("label", "dim", "first", "copies", "unit").mapInArrow(_projected(directions), "label long, dim int, first long, copies long, unit binary, p array<double>").select("*", *cells)
    order = ["label", "dim", *(f"c{k}" for k in range(DIRECTIONS)), "first"]
    segments = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop(*(f"c{k}" for k in range(DIRECTIONS)))
    segments = stored(segments.mapInArrow(_cut(SEGMENT, TILE), "seg long, tile long, label long, dim int, ids array<long>, copies array<long>, units binary, p array<double>, low array<double>, high array<double>"))
    box = lambda c, agg: F.array(*[agg(F.col(c)[k]) for k in range(DIRECTIONS)]).alias(c)
    boxes = stored(segments.groupBy("tile", "label", "dim").agg(box("low", F.min), box("high", F.max)))
    cell = lambda c: F.floor(F.col(c)[0] / eps).cast("int")
    left = boxes.withColumn("cell", F.explode(F.sequence(cell("low"), cell("high"))))
    right = boxes.select(F.col("tile").alias("other"), "label", "dim", F.col("low").alias("low2"), F.col("high").alias("high2"), F.explode(F.sequence(cell("low") - 1, cell("high") + 1)).alias("cell"))
    gap = F.aggregate(F.sequence(F.lit(0), F.lit(DIRECTIONS - 1)), F.lit(0.0), lambda s, k: s + F.pow(F.greatest(F.lit(0.0), F.get("low", k) - F.get("high2", k), F.get("low2", k) - F.get("high", k)), F.lit(2.0)))
    pairs = left.join(right, ["label", "dim", "cell"]).filter("tile <= other").filter(gap <= eps * eps * (1 + 1e-6) + 1e-12).select("tile", "other").distinct()
    sides = pairs.select(F.col("tile").alias("i"), F.col("other").alias("j"), F.explode(F.array_distinct(F.array("tile", "other"))).alias("tile"))
    units = sides.join(segments.select("seg", "tile", "ids", "copies", "units", "p"), "tile")
    found = stored(units.groupBy("i", "j").applyInArrow(_pair(least, LEAF), "a long, b long, n long"))
    counts = found.filter("b is null").groupBy(F.col("a").alias("first")).agg(F.sum("n").alias("n"))
    joined = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "first")
    named = nodes.select(*key, "first", "copies").join(counts, "first", "left").join(joined, "first", "left")
    named = stored(named.select(*key, "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id")))
    linked = skew_join(valid.select("vec_id", *key), named, key, "copies").select("vec_id", "n_links", "component_id")
    apart = rows.filter("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(apart).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
